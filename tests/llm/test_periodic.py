"""Operator 11 against a search of every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.llm import periodic
from lotwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def smallest_period(x):
    return next(p for p in range(1, len(x) + 1) if all(x[i] == x[i - p] for i in range(p, len(x))))


def plain_runs(x, least=12):
    out = []
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and smallest_period(x[i : j + q]) == q:
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_echo(own, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(own)
    if h % 10 or not n:
        return own
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]


def found(texts, least=12):
    ids = np.array([w for t in texts for w in t], np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = periodic.runs_in(ids, first, least)
    return [[tuple(r) for r in got.get(i, np.zeros((0, 3))).tolist()] for i in range(len(texts))]


def hostile():
    rng = random.Random(5)
    thue = [bin(i).count("1") % 2 for i in range(300)]
    fib = [0]
    other = [1]
    while len(fib) < 250:
        fib, other = fib + other, fib
    yield from ([0] * n for n in (0, 1, 11, 12, 13, 200))
    yield from (thue, fib)
    for _ in range(60):
        t = [rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(t))
            b = rng.randrange(a, min(len(t), a + 40)) + 1
            t[a:b] = (t[a:b] * 8)[: rng.randrange(1, 8 * (b - a))]
        yield t


@pytest.mark.parametrize("heavy", [None, 2, 10**9])
def test_runs_against_every_place(monkeypatch, heavy):
    """With words counted as usual, nearly all by transforms, and all pair by pair."""
    if heavy:
        monkeypatch.setattr(periodic, "frequent", lambda n: np.full(len(n), heavy))
    texts = list(hostile())
    monkeypatch.setattr(periodic, "SLICE", 500)
    assert found(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.integers(4, 14))
def test_runs_of_few_words(texts, least):
    assert found(texts, least) == [plain_runs(t, least) for t in texts]


def test_lag_counts_are_exact():
    rng = np.random.default_rng(3)
    texts = [(rng.zipf(1.3, n) % 500).astype(np.int64) for n in (0, 1, 2, 700, 3000)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    pairs, lag0 = periodic.lag_counts(np.concatenate(texts), first)
    for r, t in enumerate(texts):
        assert pairs[lag0[r] : lag0[r + 1]].tolist() == [int((t[:-q] == t[q:]).sum()) for q in range(1, len(t) // 2 + 1)]


def test_long_texts_end():
    """A text of one word, one of two words at random, and a period of thousands of words."""
    rng = np.random.default_rng(4)
    block = rng.integers(0, 50_000, 6000)
    texts = [np.zeros(200_000, np.int64), rng.integers(0, 2, 50_000), np.tile(block, 4)]
    got = found([t.tolist() for t in texts])
    assert got[0] == [(0, 200_000, 1)] and got[2] == [(0, 24_000, 6000)]
    assert all(length >= max(12, 2 * q) for _, length, q in got[1]) and len(got[1]) > 100


def contract(doc_id, text):
    own = plain_echo((text or "").encode().split(), doc_id) if doc_id is not None else (text or "").encode().split()
    runs = plain_runs(own)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(own) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_on_small_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_periodic"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if len((r.text or "").split()) < 400:
            assert got[r.doc_id] == contract(r.doc_id, r.text)


def test_odd_rows(spark, tmp_path):
    long = "a b c " * 30_000
    rows = [(None, None), (None, "x " * 20), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 12), (4, "x " * 12), (5, "x " * 11), (6, "é b  " * 9), (7, long)]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, start int, runs string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_periodic"](spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got if r["doc_id"] != 7), key=key) == sorted((contract(i, t) for i, t in rows if i != 7), key=key)
    assert [(r["n_runs"], r["length"], r["period"]) for r in got if r["doc_id"] == 7] == [(1, 90_000, 3)]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    texts = {r["doc_id"]: r["text"] for r in periodic.periodic_runs(docs).collect()}
    assert texts[7] == "a b c" and texts[5] == " ".join("x" * 11) and texts[1] == ""
