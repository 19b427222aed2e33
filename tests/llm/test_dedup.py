"""Operators 2, 3 and 7 against brute force, on odd rows: nulls, empty and long texts, repeated rows, clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest

from lotwise.llm import jaccard, linededup, substring
from lotwise.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, start int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 0, 1, "x", 2) for i, t in rows], SCHEMA).repartition(3)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    shared = [[word() for _ in range(70)] for _ in range(4)]
    base = [[word() for _ in range(rng.randint(1, 200))] for _ in range(25)]
    out = []
    for i in range(90):
        kind = rng.random()
        w = list(rng.choice(base))
        if kind < 0.3:
            w[rng.randrange(len(w))] = word()
        elif kind < 0.6:
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(shared)[rng.randint(0, 10) :]
        elif kind < 0.7:
            w = [word() for _ in range(60)] + rng.choice(shared)
        out.append((i, " ".join(w)))
    out += [(90, None), (91, ""), (92, " \t\n "), (93, "a b c"), (94, "A  b\tc"), (95, " ".join(["rep"] * 300)), (96, " ".join(["rep"] * 120)), (97, " ".join(w for s in shared for w in s) * 3)]
    return out


def removed(rows):
    """(words, words removed, digest of what stays) of each document, from all windows."""
    first, out = {}, {}
    docs = {i: words_of(t) for i, t in rows}
    for i in sorted(docs):
        for k in range(len(docs[i]) - 49):
            first.setdefault(tuple(docs[i][k : k + 50]), i)
    for i, w in docs.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_against_all_windows(spark, corpus):
    got = substring.without_repeats(frame(spark, corpus)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(corpus) and len(got) == len(corpus)


def test_paths_are_compacted(spark, monkeypatch):
    """A chain of 100 unbranched nodes is one path, a branching node ends one, and a ring stays as single nodes."""
    monkeypatch.setattr(substring, "ROUNDS", 8)
    chain = [(i, 5, True, i + 1 if i < 100 else 0) for i in range(1, 101)]
    more = [(200, 5, True, 201), (201, 5, False, 202), (202, 5, True, 0), (300, 5, True, 301), (301, 5, True, 300)]
    nodes = spark.createDataFrame(chain + more, "node long, n_rows long, straight boolean, next long")
    got = {r.node: r.length for r in substring.compacted(nodes).collect()}
    assert got == {1: 100, 200: 1, 202: 1, 300: 1, 301: 1}


def test_substring_long_copies_and_hot_passages(spark, monkeypatch):
    """Copies of thousands of words, whole and cut, and a passage that every document holds."""
    from lotwise.llm import tables

    monkeypatch.setattr(tables, "HOT_ROWS", 3)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    long, hot = [word() for _ in range(3000)], [word() for _ in range(64)]
    rows = [(i, " ".join([word() for _ in range(rng.randrange(80))] + hot + [word() for _ in range(rng.randrange(80))])) for i in range(20)]
    rows += [(30, " ".join(long)), (31, "\t".join(long)), (32, " ".join(long[100:1500] + hot + long[1400:])), (33, " ".join(long[700:800] * 6))]
    want = removed(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(frame(spark, rows)).collect()}
    assert got == want


def test_substring_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    got = substring.without_repeats(frame(spark, [(2, long), (2, long), (None, long), (1, long), (3, long + " end")])).collect()
    assert sorted(((r.doc_id or 0), r.n_removed) for r in got) == [(0, 0), (1, 0), (2, 60), (2, 60), (3, 60)]
    assert substring.without_repeats(frame(spark, []).limit(0)).count() == 0


def plain_jaccard(rows):
    def shingles(t):
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: (len(s), root[i]) for i, s in sets.items()}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_against_all_pairs(spark, corpus, small, monkeypatch):
    if small:  # split blocks as huge ones are
        monkeypatch.setattr(jaccard, "POINTS", 3)
        monkeypatch.setattr(jaccard, "UNIT", 200)
    rng = random.Random(2)
    rows = corpus[:40] + corpus[90:]
    for i, t in corpus[:20]:
        w = t.split()
        rows.append((200 + i, " ".join(w[: max(1, len(w) - rng.randint(0, len(w) // 8 + 1))])))
    want = plain_jaccard(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("small", [False, True])
def test_links_are_all_pairs(spark, corpus, small, monkeypatch):
    """A group of near copies has every pair that links, and not only those that span it."""
    if small:
        monkeypatch.setattr(jaccard, "POINTS", 3)
        monkeypatch.setattr(jaccard, "UNIT", 200)
        monkeypatch.setattr(jaccard, "RUN", 2)
    base = [f"w{i}" for i in range(100)]
    copies = [(300 + i, " ".join([*base[: 4 * i], f"x{i}", *base[4 * i + 1 :]])) for i in range(20)] + [(400, " ".join(base[:84])), (401, " ".join(base[16:]))]
    rows = copies + corpus[:20] + corpus[90:]
    sets, seen = {}, set()
    for i, t in sorted(rows):
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        if own and own not in seen:
            seen.add(own)
            sets[i] = own
    want = sorted((min(a, b), max(a, b)) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert sum(a >= 300 for a, _ in want) > 21
    assert sorted((r.a, r.b) for r in jaccard.near_links(frame(spark, rows)).collect()) == want


@pytest.mark.parametrize("percent, sizes", [(80, (100, 125)), (70, (100, 140)), (50, (64, 128)), (100, (100, 100))])
def test_split_blocks_keep_sizes_that_link_together(spark, percent, sizes):
    rows = spark.createDataFrame([(1, node, size) for node, size in enumerate(sizes)], "block long, node long, size int")
    units = {}
    for r in jaccard.in_units(rows, "size", 10, percent).collect():
        units.setdefault(r.unit, set()).add(r.node)
    assert {0, 1} in units.values()


def all_in_unit(spark, seen, links):
    """A link function for spanning: the edges of ``links`` within each unit, each read row noted in ``seen``."""

    def link(units):
        members = {}
        for r in units.collect():
            seen.append(r.node)
            members.setdefault(r.unit, set()).add(r.node)
        found = [(a, b) for own in members.values() for a in own for b in own if a < b and links(a, b)]
        return spark.createDataFrame(found, "a long, b long")

    return link


def test_heavy_blocks_of_copies_are_not_copied_to_every_pair_of_parts(spark):
    """300 near copies with 20 odd ones make 64 parts: each row goes to a few units, not to all 64 parts."""
    rows = spark.createDataFrame([(1, node, 100) for node in range(320)], "block long, node long, size int")
    seen = []
    edges = jaccard.spanning(rows, "size", 1000, 80, all_in_unit(spark, seen, lambda a, b: b < 300))
    root = {r.node: r.root for r in components(edges).collect()}
    assert len(root) == 300 and len(set(root.values())) == 1
    assert len(seen) < 2 * 320 * 20  # two size classes a row


@pytest.mark.parametrize("modulus", [2, 7, 100])
def test_heavy_blocks_span_their_components(spark, modulus):
    rng = random.Random(modulus)
    size = {node: rng.choice([100, 110, 130, 150]) for node in range(120)}
    links = lambda a, b: a % modulus == b % modulus and 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b])
    rows = spark.createDataFrame([(node % 2, node, n) for node, n in size.items()], "block long, node long, size int")
    pairs = [(a, b) for a in size for b in size if a < b and a % 2 == b % 2 and links(a, b)]
    want = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    edges = jaccard.spanning(rows, "size", 500, 80, all_in_unit(spark, [], links))
    assert {r.node: r.root for r in components(edges).collect()} == want


def test_links_of_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(60))
    got = jaccard.near_links(frame(spark, [(5, t), (6, t), (None, t + " a"), (7, t + " b"), (8, ""), (9, None)])).collect()
    assert sorted((r.a or 0, r.b) for r in got) == [(0, 5), (0, 7), (5, 7)]
    assert jaccard.near_links(frame(spark, []).limit(0)).count() == 0


def test_jaccard_odd_rows(spark):
    t = "one two three four five six seven"
    got = jaccard.near_duplicates(frame(spark, [(5, t), (5, t), (None, t), (7, None), (7, "")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 3, 5), (5, 3, 5), (5, 3, 5), (7, 0, 7), (7, 0, 7)]
    assert jaccard.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


LINE = "this line is longer than forty characters, é "


def lines_of(rows):
    keys = {}
    norm = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(norm(x)) >= 40:
                keys.setdefault(norm(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(d := keys.get(norm(x), ())) >= 5 and max(d) != i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def kept(state, docs):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.without_repeated_lines(docs, state).collect()}


def test_lines_insert_and_delete(spark):
    rng = random.Random(3)
    pool = [LINE + str(i) for i in range(6)] + ["short", "é" * 39, "é" * 40, "", "  " + LINE.upper() + "0\r"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(30)] + [(30, None), (31, ""), (32, "\n")]
    a, b = frame(spark, rows[:20]), frame(spark, rows[20:])
    state = linededup.line_state(a)
    assert kept(state, a) == lines_of(rows[:20])
    more = linededup.insert(state, b)
    both = frame(spark, rows)
    assert kept(more, both) == lines_of(rows)
    less = linededup.delete(more, b.select("doc_id"))
    assert kept(less, a) == lines_of(rows[:20])
    same = lambda s: sorted((bytes(r.key), r.n_docs, r.keeper) for r in s.refs.collect())
    assert same(less) == same(state)


def test_line_state_grows(spark, monkeypatch):
    """Shards of five postings: hot keys have salts of their own, insertions make more shards, filters stay exact."""
    monkeypatch.setattr(linededup, "SHARD_ROWS", 5)
    rng = random.Random(6)
    pool = [LINE + str(i) for i in range(40)]
    rows = [(i, "\n".join([LINE, *(rng.choice(pool) for _ in range(4))])) for i in range(60)]
    state = linededup.line_state(frame(spark, []).limit(0))
    assert state.n_shards == 1
    for part in (rows[:20], rows[20:]):
        state = linededup.insert(state, frame(spark, part))
    assert state.n_shards > 10 and kept(state, frame(spark, rows)) == lines_of(rows)
    assert not any(r.spare for r in state.filters.collect())
    with pytest.raises(ValueError, match="delete them first"):
        linededup.insert(state, frame(spark, rows[3:4]))


def test_full_filters_are_built_anew():
    rng = random.Random(5)
    keys = [rng.randbytes(16) for _ in range(4000)]
    made = linededup.Cuckoo.of(keys, 500)
    assert not made.spare and len(keys) < made.slots.size <= 8 * len(keys)


def test_line_odd_rows(spark):
    docs = frame(spark, [(i, LINE + "x") for i in (1, 1, 2, 3, 4)] + [(None, LINE + "x")])
    assert all(r.n_dropped == 0 for r in linededup.without_repeated_lines(docs, linededup.line_state(docs)).collect())
    empty = frame(spark, []).limit(0)
    assert linededup.without_repeated_lines(empty, linededup.line_state(empty)).count() == 0


def test_cuckoo():
    rng = random.Random(4)
    keys = [rng.randbytes(16) for _ in range(3000)]
    c = linededup.Cuckoo(2000)
    for k in keys:
        c.insert(k)
    import numpy as np

    both = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    assert c.contains(both).all()
    other = np.frombuffer(rng.randbytes(16 * 5000), np.uint64).reshape(-1, 2)
    assert c.contains(other).mean() < 0.01
    for k in keys:
        c.delete(k)
    assert not c.contains(both).any()


def test_jaccard_tells_clashing_sets_apart(spark, corpus):
    """With nodes of 6 bits nearly all clash, and the second hash decides: the same rows as with 64."""
    docs = frame(spark, corpus)
    want = sorted(map(tuple, jaccard.near_duplicates(docs).collect()), key=str)
    assert sorted(map(tuple, jaccard.near_duplicates(docs, bits=6).collect()), key=str) == want


def test_jaccard_rows_without_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, a), (None, a + " end"), (None, b), (None, b), (9, b + " end"), (None, None), (None, "")]
    got = jaccard.one_of_each(frame(spark, rows)).collect()
    kept = [(r.doc_id, r.text) for r in got]
    assert sum(t in (a, a + " end") for _, t in kept) == 1 and (9, b + " end") in kept and (None, b) not in kept
    assert (None, None) in kept and (None, "") in kept
    found = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert sorted(str(r.component_id) for r in found) == ["9"] * 3 + ["None"] * 4


def test_long_sets_that_link_share_a_part():
    rng = np.random.default_rng(3)
    for n in (320, 399, 400, 499, 500, 501, 777, 1500, 4000):
        for _ in range(20):
            more = int(rng.integers(0, n // 4 + 1))  # all that n more shingles leave of 80 %, spent on other ones
            u = n + more
            other = (u - -(-u * 80 // 100)) - more
            x = rng.choice(1 << 62, n + more + 2 * max(other, 0), replace=False).astype(np.uint64)
            a, b = np.sort(x[:n]), np.sort(x[max(other, 0) : n + more])
            common = len(np.intersect1d(a, b))
            assert 100 * common >= 80 * (len(a) + len(b) - common)
            if max(len(a), len(b)) < jaccard.LONG:
                continue
            size = np.array([len(a), len(b)])
            keys = [set(), set()]
            for key, row in jaccard.part_rows(np.concatenate([a, b]), np.repeat([0, 1], size), size, np.ones(2, bool), 80):
                for k, i in zip(key.tolist(), row.tolist(), strict=True):
                    keys[i].add(k)
            assert keys[0] & keys[1]
    few = np.array([400, 480])  # whose shingles are all frequent ones and left out
    keys = [(k, i) for key, row in jaccard.part_rows(np.zeros(0, np.uint64), np.zeros(0, np.int64), few, np.ones(2, bool), 80) for k, i in zip(key.tolist(), row.tolist(), strict=True)]
    assert {k for k, i in keys if i == 0} & {k for k, i in keys if i == 1}


def test_long_texts_meet_over_more_than_a_passage(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passages = [[word() for _ in range(60)] for _ in range(121)]
    texts = [passages[i] + [word() for _ in range(rng.randint(500, 900))] + passages[i + 1] for i in range(120)]
    texts += [[word() if rng.random() < 0.01 else w for w in t] for t in texts[:30]]  # of their 5-word shingles some 95 % stay
    rows = frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    names = jaccard.Names()
    blocks = components(jaccard.chains(jaccard.prefix_rows(rows, 5, 80, np.zeros(0, np.uint64), names), 80))
    assert max(r["count"] for r in blocks.groupBy("root").count().collect()) <= 8
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    expected = list(range(120)) + [i if 100 * len(sets[i] & sets[120 + i]) >= 80 * len(sets[i] | sets[120 + i]) else 120 + i for i in range(30)]
    assert sum(x < 30 for x in expected[120:]) >= 25
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(rows).collect()} == dict(enumerate(expected))
