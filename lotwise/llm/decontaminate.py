"""Operator 4, benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared with A-Z lower-cased and ASCII punctuation as space. Each 3-gram of a test item is a seed. Their
document frequencies are counted over all documents. A seed is rare if at most FEW documents or the share RARE of them
hold it, or if it is at most twice as frequent as the item's median seed: an item leaked into very many documents keeps
its seeds, also those that edited copies have left, and only word sequences frequent for other reasons go. Where a document
holds a seed, the words around it are aligned with the item: 2 for a match, -1 for a mismatch, -1 for a gap. The score
over the best that the item allows tells a copy, also an edited one, from a chance seed.

Test items are the query set: they go to the tasks in blocks of at most BLOCK_BYTES, one pass over the documents each.
All documents are searched whole and none is shuffled; the only shuffle adds up seed counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import text as words

SEED, RARE, FEW, LEAST = 3, 0.001, 50, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 8 << 20
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


def plain(data: np.ndarray, at: np.ndarray) -> words.Words:
    return words.Words(_PLAIN[data], at, lower=True)


@dataclass
class Items:
    """A block of test items: word hashes of each, and the seeds (hash, item, word) in order of hash."""

    ids: np.ndarray
    tokens: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], n: int = SEED) -> Items:
        data, at = words.utf8(pa.array([t for _, t in rows], pa.string()))
        w = plain(data, at)
        h = w.hashes()
        tokens = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        seeds = [(words.grams(t, min(n, len(t))) if len(t) else t) for t in tokens]
        size = [len(s) for s in seeds]
        hashes = np.concatenate([*seeds, np.zeros(0, words.U64)])
        item = np.repeat(np.arange(len(rows)), size)
        word = np.concatenate([np.arange(k) for k in size] or [np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        return cls(np.array([i for i, _ in rows]), tokens, hashes[order], item[order], word[order])

    def only(self, keep: np.ndarray) -> Items:
        return Items(self.ids, self.tokens, self.hashes[keep], self.item[keep], self.word[keep])

    def lengths(self, n: int = SEED) -> list[int]:
        """The seed lengths in use: n, and those of items with fewer words."""
        return sorted({n, *(len(t) for t in self.tokens if 0 < len(t) < n)})


def seed_places(w: words.Words, h: np.ndarray, items: Items, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, seed): each place in a chunk at which a seed stands, by the first seed of its hash."""
    place, seed = [], []
    known = items.hashes
    for k in items.lengths(n) if len(known) else []:
        g = words.grams(h, k)
        if not len(g):
            continue
        i = np.minimum(np.searchsorted(known, g), len(known) - 1)
        hit = np.flatnonzero((known[i] == g) & w.gram_ok(k))
        place.append(hit)
        seed.append(i[hit])
    return (np.concatenate(place), np.concatenate(seed)) if place else (np.zeros(0, np.int64),) * 2


def seed_counts(documents: DataFrame, items: Items, n: int) -> dict[int, int]:
    """Documents (rows) that hold each seed; at most as many entries as there are seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.hashes), np.int64)
        for batch in batches:
            for _, _, data, at in words.chunks(batch.column(0)):
                w = plain(data, at)
                place, seed = seed_places(w, w.hashes(), items, n)
                pairs = np.unique(np.stack([w.row[place], seed], 1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
                total += np.bincount(pairs[:, 1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seed", "docs"])

    found = documents.select("text").mapInArrow(run, "seed bigint, docs bigint").groupBy("seed").agg(F.sum("docs").alias("docs"))
    return {r["seed"]: r["docs"] for r in found.collect()}


def rare(items: Items, counts: dict[int, int], n_docs: int, share: float, few: int) -> Items:
    """items with their rare seeds only."""
    first = np.searchsorted(items.hashes, items.hashes)
    docs = np.array([counts.get(int(i), 0) for i in first], np.int64)
    limit = np.zeros(len(items.ids))
    for k in np.unique(items.item):
        limit[k] = 2 * np.median(docs[items.item == k])
    return items.only(np.flatnonzero(docs <= np.maximum(limit[items.item], max(few, share * n_docs))))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment of all of Smith and Waterman's: (score, end in item, end in passage)."""
    j = np.arange(len(passage) + 1)
    above = np.zeros(len(passage) + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(item):
        here = above + GAP
        np.maximum(here[1:], above[:-1] + np.where(passage == word, MATCH, MISMATCH), out=here[1:])
        np.maximum(here, 0, out=here)
        above = np.maximum.accumulate(here - GAP * j) + GAP * j  # gaps along the passage, all lengths at once
        k = int(above.argmax())
        if above[k] > best[0]:
            best = int(above[k]), i + 1, k
    return best


def aligned(w: words.Words, h: np.ndarray, items: Items, n: int, least: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word) of the best alignment of each row and item that reaches ``least``."""
    place, seed = seed_places(w, h, items, n)
    if not len(place):
        return []
    last = np.searchsorted(items.hashes, items.hashes, "right")
    repeat = last[seed] - seed
    place = np.repeat(place, repeat)
    seed = np.repeat(seed, repeat) + np.arange(len(place)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    item, row = items.item[seed], w.row[place]
    start = place - items.word[seed]
    order = np.lexsort((start, item, row))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    done = (-1, -1, -1)
    for r, k, s in zip(row[order].tolist(), item[order].tolist(), start[order].tolist(), strict=True):
        token = items.tokens[k]
        m = len(token)
        slack = 4 + m // 4
        if done[:2] == (r, k) and s <= done[2] + slack // 2:
            continue  # the passage just aligned has this diagonal
        done = (r, k, s)
        a, b = max(int(w.first[r]), s - slack), min(int(w.first[r + 1]), s + m + 2 * slack)
        passage = h[a:b]
        if MATCH * np.isin(token, passage).sum() < least * MATCH * m:
            continue
        score, i, j = align(token, passage)
        if score >= least * MATCH * m and score / (MATCH * m) > best.get((r, k), (0,))[0]:
            _, _, back = align(token[:i][::-1], passage[:j][::-1])
            best[r, k] = score / (MATCH * m), a + j - back - int(w.first[r]), a + j - int(w.first[r])
    return [(r, k, *x) for (r, k), x in best.items()]


def blocks(benchmark: DataFrame, n: int, limit: int = BLOCK_BYTES) -> Iterator[Items]:
    """The test items in blocks of about ``limit`` bytes, streamed to the driver one partition at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("bigint"), "text").toLocalIterator():
        held.append((r[0] if r[0] is not None else -1, r[1]))
        size += 4 * len(r[1] or "") + 64
        if size > limit:
            yield Items.of(held, n)
            held, size = [], 0
    if held:
        yield Items.of(held, n)


def prepared(documents: DataFrame, benchmark: DataFrame, n: int = SEED, share: float = RARE, few: int | None = FEW) -> Iterator[Items]:
    """Blocks of test items with their seeds: the rare ones, or where few is None all of them, which loses no copy that
    the alignment would find."""
    n_docs = documents.count() if few is not None else 0
    for items in blocks(benchmark, n):
        yield items if few is None else rare(items, seed_counts(documents, items, n), n_docs, share, few)


def leaks(documents: DataFrame, benchmark: DataFrame, n: int = SEED, share: float = RARE, few: int | None = FEW, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): test items found in documents, the best place of each pair.

    start_word and end_word count the document's words as compared here. Null and empty texts and items without words
    match nothing; an item of fewer than n words is one seed. Items without item_id bear the id -1. Each row of
    documents gives its own rows, with its doc_id, null or not. An empty benchmark gives no rows. Other columns play no
    part.
    """

    def run_for(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for low, _, data, at in words.chunks(batch.column(1)):
                    w = plain(data, at)
                    found = aligned(w, w.hashes(), items, n, least)
                    r, k, score, a, b = zip(*found, strict=True) if found else [[]] * 5
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([low + x for x in r], pa.int64())), pa.array([int(items.ids[x]) for x in k], pa.int64()), pa.array(score, pa.float64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "item_id", "score", "start_word", "end_word"])

        return run

    schema = "doc_id bigint, item_id bigint, score double, start_word int, end_word int"
    own = documents.select(F.col("doc_id").cast("bigint"), "text")
    out = documents.sparkSession.createDataFrame([], schema)
    for items in prepared(documents, benchmark, n, share, few):
        out = out.unionByName(own.mapInArrow(run_for(items), schema))
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame, n: int = SEED, share: float = RARE, few: int | None = FEW, least: float = LEAST) -> DataFrame:
    """documents without the rows in which leaks() finds a test item; all columns pass through, nothing is joined."""
    at = documents.columns.index("text")

    def run_for(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for low, _, data, cuts in words.chunks(batch.column(at)):
                    w = plain(data, cuts)
                    clean[[low + x[0] for x in aligned(w, w.hashes(), items, n, least)]] = False
                yield batch.filter(pa.array(clean))

        return run

    out = documents
    for items in prepared(documents, benchmark, n, share, few):
        out = out.mapInArrow(run_for(items), documents.schema)
    return out
