"""Operator 11, periodic run detection by heavy and light lag counting.

A run is a stretch of words with a smallest period q, at least LEAST words and two periods long, that can't be made
longer. It shows as an island of equal pairs of words q apart, so that lag q has at least max(q, LEAST - q) such pairs.

For each document and each lag the pairs of equal words are counted, exactly and in two ways: words that are rare in
the document add the differences of their places, one by one; for frequent words, whose pairs would be too many, the
power spectra of their indicators are added up and one inverse transform gives all lags. Only a lag with enough pairs
is looked at: an island as long as needed has a pair at a multiple of that length, so that few places are tested, and
what looks like an island there gets one scan of the lag. Pairs that runs of a divisor explain are subtracted first,
so that a text of one repeated word takes one scan and not one a lag.

Each document is worked on by itself, many small ones at a time; nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm import text as words

LEAST, LOOK, SLICE = 12, 16, 1 << 20


def transform_size(n: int) -> int:
    """The least 2^a or 3 * 2^a that is n or more."""
    two = 1 << max(n - 1, 1).bit_length()
    return two * 3 // 4 if two * 3 // 4 >= n else two


def frequent(n: np.ndarray) -> np.ndarray:
    """From how many occurrences on a word of a document of n words is cheaper by a transform than pair by pair."""
    size = 1.5 * n + 2
    return np.maximum(8, np.sqrt(size * np.log2(size) / 6)).astype(np.int64)


def lag_counts(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, lag0): of document r, whose words are ids[first[r]:first[r + 1]], the pairs of equal words q apart are
    pairs[lag0[r] + q - 1], for q from 1 to half of its words."""
    n = np.diff(first)
    half = n // 2
    lag0 = np.concatenate([[0], np.cumsum(half)])
    pairs = np.zeros(lag0[-1], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(row * (int(ids.max(initial=0)) + 1) + ids, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = (ids[order][1:] != ids[order][:-1]) | (row[order][1:] != row[order][:-1])
    heads = np.flatnonzero(head)
    size = np.diff(np.append(heads, len(order)))
    heavy = size >= frequent(n)[row[order[heads]]]
    # rare words: the d-th next place of each, for growing d, while it is within reach
    left = np.repeat(heads + size, size) - np.arange(len(order)) - 1
    now = np.flatnonzero(np.repeat(~heavy, size) & (left > 0))
    held, waiting, d = [], 0, 1
    while len(now):
        here = order[now]
        lag, own = order[now + d] - here, row[here]
        near = lag <= half[own]
        held.append((lag0[own] + lag - 1)[near])
        waiting += len(held[-1])
        if waiting > SLICE:
            pairs += np.bincount(np.concatenate(held), minlength=len(pairs))
            held, waiting = [], 0
        d += 1
        now = now[near & (left[now] >= d)]
    if held:
        pairs += np.bincount(np.concatenate(held), minlength=len(pairs))
    # frequent words: a document at a time
    groups = np.flatnonzero(heavy)
    owners = row[order[heads[groups]]]
    for r in np.unique(owners).tolist():
        span = transform_size(int(n[r] + half[r] + 1))
        power, mine = np.zeros(span // 2 + 1), groups[owners == r]
        step = max(1, SLICE // span)
        for at in range(0, len(mine), step):
            some = mine[at : at + step]
            marks = np.zeros((len(some), span))
            for i, g in enumerate(some.tolist()):
                marks[i, order[heads[g] : heads[g] + size[g]] - first[r]] = 1.0
            f = np.fft.rfft(marks, axis=1)
            power += (f.real**2 + f.imag**2).sum(0)
        pairs[lag0[r] : lag0[r + 1]] += np.rint(np.fft.irfft(power, span)[1 : half[r] + 1]).astype(np.int64)
    return pairs, lag0


def likely_lags(ids: np.ndarray, first: np.ndarray, pairs: np.ndarray, lag0: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, lag) of the lags that have enough pairs and, at one of the places that an island can't miss, LOOK equal
    pairs one after the other or as many as it needs. In order of row and lag."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n // 2)
    lag = np.arange(len(pairs)) - lag0[row] + 1
    some = np.flatnonzero(pairs >= np.maximum(lag, least - lag))
    row, lag = row[some], lag[some]
    need = np.maximum(lag, least - lag)
    tests = -(-(n[row] - lag) // need)
    kept, through = np.zeros(len(row), bool), np.cumsum(tests)
    low = 0
    while low < len(row):
        high = max(low + 1, int(np.searchsorted(through, through[low] - tests[low] + SLICE, "right")))
        own = np.repeat(np.arange(low, high), tests[low:high])
        step = np.arange(len(own)) - np.repeat(through[low:high] - tests[low:high] - (through[low] - tests[low]), tests[low:high])
        at = first[row[own]] + step * need[own]
        equal = ids[at] == ids[at + lag[own]]
        own, at = own[equal], at[equal]
        length = np.ones(len(own), np.int64)
        for sign in (1, -1):
            now = np.arange(len(own))
            for d in range(1, LOOK):
                place, q = at[now] + sign * d, lag[own[now]]
                now, place, q = (x[(place >= first[row[own[now]]]) & (place + q < first[row[own[now]] + 1])] for x in (now, place, q))
                now = now[ids[place] == ids[place + q]]
                if not len(now):
                    break
                length[now] += 1
        kept[own[length >= np.minimum(need[own], LOOK)]] = True
        low = high
    return row[kept], lag[kept]


def runs_of(ids: np.ndarray, lags: list[int], pairs: np.ndarray, least: int) -> np.ndarray:
    """The runs of one document as rows (start, length, period), by start and period. lags: those that may have one."""
    found = np.zeros((0, 3), np.int64)
    for q in lags:
        need = max(q, least - q)
        explained = np.maximum(found[:, 1] - q, 0)[q % found[:, 2] == 0].sum() if len(found) else 0
        if pairs[q - 1] - explained < need:
            continue
        equal = np.zeros(len(ids) - q + 2, np.int8)
        equal[1:-1] = ids[:-q] == ids[q:]
        edges = np.flatnonzero(np.diff(equal))
        start, end = edges[::2], edges[1::2] + q
        long = end - start - q >= need
        start, end = start[long], end[long]
        if len(found) and len(start):  # a stretch within a run of a smaller period has that period
            order = np.argsort(found[:, 0], kind="stable")
            reach = np.maximum.accumulate(found[order, 0] + found[order, 1])
            before = np.searchsorted(found[order, 0], start, "right") - 1
            new = (before < 0) | (reach[before] < end)
            start, end = start[new], end[new]
        found = np.concatenate([found, np.stack([start, end - start, np.full(len(start), q)], 1)])
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_in(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> dict[int, np.ndarray]:
    """The runs of each document that has any."""
    pairs, lag0 = lag_counts(ids, first)
    row, lag = likely_lags(ids, first, pairs, lag0, least)
    cut = np.flatnonzero(np.diff(row)) + 1
    found = {}
    for own, lags in zip(np.split(row, cut), np.split(lag, cut), strict=True):
        if len(own):
            r = int(own[0])
            runs = runs_of(ids[first[r] : first[r + 1]], lags.tolist(), pairs[lag0[r] : lag0[r + 1]], least)
            if len(runs):
                found[r] = runs
    return found


def collapsed(own: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    gone = np.zeros(len(own) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([own[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def echoed(own: list[bytes], seed: int | None) -> list[bytes]:
    """own with its tail made periodic: of seeds divisible by ten, g being the seed's other digits, each word from place
    a = g % n on becomes the word (i - a) % p after a, with p = 1 + (n - a) // (3 + g % 8)."""
    if seed is None or seed % 10 or not own:
        return own
    g, n = seed // 10, len(own)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return own[:a] + (own[a : a + p] * (-(-(n - a) // p)))[: n - a]


RUNS = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string"


def periodic_runs(documents: DataFrame, least: int = LEAST, seed: Column | None = None) -> DataFrame:
    """(doc_id, n_words, runs, text): each row of documents with its runs of ``least`` words or more, by start and
    period, and its text without the words that a run has after its first period.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; what stays is joined by one space. Null and empty texts have no words,
    no runs and an empty text. Rows without doc_id and repeated rows have rows of their own. Runs may overlap. Columns
    other than doc_id and text play no part. With a seed, each text is first changed by echoed(), as a test of known
    runs; a null seed changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            seeds = batch.column(2).to_pylist()
            for low, high, data, at in words.chunks(batch.column(1)):
                buffer = data.tobytes()
                own = [echoed(buffer[a:b].split(), s) for (a, b), s in zip(pairwise(at.tolist()), seeds[low:high], strict=True)]
                number = defaultdict(count().__next__)
                first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
                ids = np.fromiter((number[w] for x in own for w in x), np.int64, first[-1])
                found = runs_in(ids, first, least)
                texts = [collapsed(x, found[r]) if r in found else b" ".join(x) for r, x in enumerate(own)]
                every = np.concatenate([np.zeros((0, 3), np.int64), *[found[r] for r in sorted(found)]])
                offsets = np.concatenate([[0], np.cumsum([len(found.get(r, ())) for r in range(high - low)])]).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in every.T], fields=list(kind)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(first)), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

    seed = F.lit(None).cast("bigint") if seed is None else seed.cast("bigint")
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), seed.alias("seed"))
    return own.mapInArrow(run, RUNS)


def run_digests(found: DataFrame) -> DataFrame:
    """What the query returns of periodic_runs(): the number of runs, the longest (the first of these, then the one of
    least period) with its exponent in thousandths, and digests of all runs and of the text that stays."""
    line = lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"], (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    shown = rows.select("doc_id", "n_words", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), "runs_sha256", "collapsed_sha256")
    return shown.withColumn("exponent_milli", F.expr("1000 * length div period"))
