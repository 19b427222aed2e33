"""Operator 13 against a plain model with the same classes."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lotwise.llm import brown
from lotwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain_base(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens and base_score of rows (doc_id, text)."""
    count = Counter(t for i, x in rows if not held(i) for t in tokens_of(x))
    total, v = sum(count.values()), len(count)
    return [(i, held(i), len(own := tokens_of(x)), sum(count[t] > 0 for t in own), total, sum(math.log10((count[t] + 0.5) / (total + 0.5 * (v + 1))) for t in own)) for i, x in rows]


def plain_scores(rows, class_of):
    """The scores of texts when class_of has each training word's class."""
    train = [tokens_of(x) for i, x in rows if not held(i)]
    count = Counter(t for x in train for t in x)
    of = lambda t: brown.END if t is None else class_of.get(t, brown.NEW)
    pairs, mass = np.zeros((brown.CLASSES, brown.CLASSES)), Counter()
    for x in train:
        for a, b in zip([None, *x], x, strict=False):
            pairs[of(a), of(b)] += 1
            mass[of(b)] += 1
    p, out = brown.smoothed(pairs), []
    new = 0.5 if mass[brown.NEW] else 1.0
    for _, x in rows:
        own, s = tokens_of(x), 0.0
        for a, b in zip([None, *own], own, strict=False):
            c = of(b)
            word = 1.0 if c == brown.END else count[b] / mass[c] if c != brown.NEW else new / mass[c] if count[b] else new
            s += math.log10(p[of(a), c]) + math.log10(word)
        out.append(s)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x, held(i), 7, "r") for i, x in rows], "doc_id long, text string, held_out boolean, n int, classes string").repartition(3)


def two_tongues(n=150):
    rng = random.Random(2)
    tongue = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]]
    docs = []
    for i in range(n):
        own = tongue[i % 2]
        docs.append((i, " ".join(rng.choice(own[k % 2 :: 2]).upper() if k % 5 == 0 else rng.choice(own[k % 2 :: 2]) for k in range(rng.randrange(5, 60)))))
    return docs


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(brown, "CLASSES", 10)
    monkeypatch.setattr(brown, "SHARE", 300)
    monkeypatch.setattr(brown, "SLICE", 16)
    monkeypatch.setattr(brown, "FAN", 2)
    monkeypatch.setattr(brown, "CHUNK", 2000)


def test_scores_against_a_plain_model(spark, small, monkeypatch):
    rows = [*two_tongues(), *[(1000 + i, f"a1 rare{i % 9} a2 once{i}") for i in range(40)]]
    seen, coded = {}, brown.coded

    def look(chunks, table, *rest):
        seen.update({r["word"]: r["class"] for r in table.collect()})
        return coded(chunks, table, *rest)

    monkeypatch.setattr(brown, "coded", look)
    got = {r["doc_id"]: r for r in brown.scored(frame(spark, rows)).collect()}
    every = sorted({t for _, x in rows for t in tokens_of(x) if t})
    w = brown.words.Words(*brown.words.utf8(brown.pa.array([" ".join(every)])))
    class_of = {t: seen[h] for t, h in zip(every, w.hashes().view(np.int64).tolist(), strict=True) if h in seen}
    for (i, _), base, score in zip(rows, plain_base(rows), plain_scores(rows, class_of), strict=True):
        r = got[i]
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == base[:5]
        assert math.isclose(r["base_score"], base[5], rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    # the classes tell the tongues apart, and held-out text of them gains by it
    tongues = [{class_of[t] for t in class_of if t[0] == x and t[1:].isdigit() and class_of[t] != brown.NEW} for x in "ab"]
    assert all(tongues) and not tongues[0] & tongues[1]
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 3, (brown.CLASSES, brown.CLASSES)).astype(float)
    pairs[5] = 0
    assert np.allclose(brown.smoothed(pairs).sum(1), 1) and (brown.smoothed(pairs) > 0).all()


def test_exchange_finds_the_best_class(monkeypatch):
    """Against the likelihood of all classes, counted anew."""
    monkeypatch.setattr(brown, "CLASSES", 7)
    rng = np.random.default_rng(4)
    text = np.arange(4000) % 5 + 5 * rng.integers(0, 6, 4000)  # the classes follow each other
    of = np.where(rng.random(30) < 0.7, np.arange(30) % 5, rng.integers(0, 5, 30)) + 2

    def pairs_of(of):
        c = of[text]
        return np.bincount(c[:-1] * 7 + c[1:], minlength=49).reshape(7, 7).astype(float)

    pairs = pairs_of(of)
    for w in range(30):
        at = np.flatnonzero(text == w)
        before = np.bincount(of[text[at[at > 0] - 1]], minlength=7)
        after = np.bincount(of[text[at[at < len(text) - 1] + 1]], minlength=7)
        to = brown.best_classes(pairs, of[[w]], before[None], after[None])[0]
        tried = []
        for b in range(2, 7):
            other = of.copy()
            other[w] = b
            tried.append(brown.likelihood(pairs_of(other)))
        assert tried[to - 2] == max(tried)


def test_rounds_raise_the_likelihood_and_parts_dont_matter(spark, small, monkeypatch):
    docs = frame(spark, two_tongues())
    found = []
    for n, fan in ((1, 2), (5, 2), (4, 32)):
        monkeypatch.setattr(brown, "FAN", fan)
        chunks = brown.written(brown.packed(docs.select("doc_id", "held_out", "text").repartition(n)), "chunks")
        counts = brown.word_counts(chunks)
        classes, pairs, history = brown.clustered(chunks, brown.frequent_words(counts, counts.agg({"n": "sum"}).first()[0]), 6)
        assert max(history) > history[0] and brown.likelihood(pairs) == max(history)
        found.append((classes.by_rank.tolist(), classes.of_rank.tolist()))
    assert found[0] == found[1] == found[2]


def test_contract_on_small_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op13_brown"](spark, SF).collect()}
    assert len(got) == len(rows)
    for want in plain_base(rows):
        r = got[want[0]]
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:5]
        assert math.isclose(r["base_score"], want[5], rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.95 * sum(r["base_score"] for r in out)


def test_odd_rows(spark):
    rows = [(None, None), (None, "one two"), (1, ""), (1, ""), (2, "Two  two\ttwo"), (3, "x " * 50_000), (4, "\n")]
    got = sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in brown.scored(frame(spark, rows)).collect())
    assert got == sorted((i or 0, *x, round(s, 6)) for i, *x, s in plain_base(rows))
    assert brown.scored(frame(spark, rows).limit(0)).collect() == []
    only = [(i, "a b c") for i in range(40) if held(i)]  # nothing to learn from
    for r in brown.scored(frame(spark, only)).collect():
        assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0) and r["score"] < 0
