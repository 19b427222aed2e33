"""Operator 2, line dedup: sharded cuckoo filters backed by exact reference-count tables.

The state is two exact tables: postings(key, doc_id), which line keys a document holds, and refs(key, n_docs, keeper),
how many documents hold a key and the largest of them. Keys of enough documents are also kept in cuckoo filters, one
a shard of the key space. A probe asks its shard's filter first and the shard's exact keys only where the filter says
yes, so that most lines end at the filter and its errors never reach a result. Insertions add counts; deletions
subtract them, find a new keeper where the old one goes, and take keys that fall under the limit out of the filter:
deleting what was inserted gives the former state again.

Skew: refs come from partial aggregates; probes are dealt by shard and by a salt from doc_id. A key of very many
documents has as many salts as its postings need, so that a line that a third of all documents hold still comes in
pieces of about SHARD_ROWS. The shards' number follows the number of postings, also as insertions add to it, and a
filter that fills up is built anew, at twice its size, from its shard's exact keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.tables import HOT_KEYS, written

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_ROWS, SALTS, FULL = 200_000, 16, 0.9
STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the line without [\\x20\\x09-\\x0D] at its ends and with A-Z lower-cased; None under min_chars."""
    line = line.strip(STRIP).lower()
    if len(line) < min_chars or len(line) < 4 * min_chars and sum((b & 0xC0) != 0x80 for b in line) < min_chars:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def line_postings(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id), once a row of documents. A null text is one empty line; a row without doc_id has no postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                if doc is not None and (text := text.as_py()):
                    found = {line_key(x, min_chars) for x in text.split(b"\n") if len(x) >= min_chars} - {None}
                    keys += found
                    ids += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "key binary, doc_id bigint")


def reference_counts(postings: DataFrame) -> DataFrame:
    """refs(key, n_docs, keeper). Rows with one doc_id count as one document."""
    once = postings.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


class Cuckoo:
    """A cuckoo filter of 128-bit keys: buckets of four 16-bit fingerprints, two buckets a key, exact deletions.

    Keys that find no place after MOVES moves go to a small list beside the table, so that no key is ever lost.
    """

    SLOTS, MOVES = 4, 200

    def __init__(self, n: int, slots: np.ndarray | None = None, spare: list[bytes] | None = None):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(n, 1) / (0.8 * self.SLOTS)))) if n > 3 else 1)
        self.slots = np.zeros((buckets, self.SLOTS), np.uint16) if slots is None else slots
        self.mask, self.spare = len(self.slots) - 1, list(spare or [])

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: (n, 2) unsigned. The fingerprints and both buckets."""
        print_ = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        here = (keys[:, 0] & np.uint64(self.mask)).astype(np.int64)
        return print_, here, self.other(here, print_)

    def other(self, bucket, print_):
        return (np.asarray(bucket, np.int64) ^ (np.asarray(print_, np.int64) * 0x5BD1E995)) & self.mask

    def insert(self, key: bytes) -> None:
        (p,), (a,), (b,) = self.places(np.frombuffer(key, np.uint64).reshape(1, 2))
        for bucket in (a, b):
            if (free := np.flatnonzero(self.slots[bucket] == 0)).size:
                self.slots[bucket, free[0]] = p
                return
        path, bucket = [], int(a)
        for move in range(self.MOVES):
            slot = move % self.SLOTS
            path.append((bucket, slot, self.slots[bucket, slot]))
            self.slots[bucket, slot], p = p, self.slots[bucket, slot]
            bucket = int(self.other(bucket, p))
            if (free := np.flatnonzero(self.slots[bucket] == 0)).size:
                self.slots[bucket, free[0]] = p
                return
        for bucket, slot, old in reversed(path):
            self.slots[bucket, slot] = old
        self.spare.append(key)

    def delete(self, key: bytes) -> None:
        """Only for keys that were inserted."""
        if key in self.spare:
            self.spare.remove(key)
            return
        (p,), (a,), (b,) = self.places(np.frombuffer(key, np.uint64).reshape(1, 2))
        for bucket in (a, b):
            if (at := np.flatnonzero(self.slots[bucket] == p)).size:
                self.slots[bucket, at[0]] = 0
                return

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self.places(keys)
        found = ((self.slots[a] == p[:, None]) | (self.slots[b] == p[:, None])).any(1)
        if self.spare:
            found |= np.isin(keys[:, 0], np.frombuffer(b"".join(self.spare), np.uint64)[::2])
        return found

    @classmethod
    def of(cls, keys, n: int) -> Cuckoo:
        """A filter with room for n keys that holds ``keys``; one with more room where any of them finds no place."""
        while True:
            out = cls(n)
            for key in keys:
                out.insert(key)
            if not out.spare or n > 16 * len(keys) + 64:
                return out
            n *= 2

    def stored(self) -> dict:
        return {"slots": self.slots.tobytes(), "spare": b"".join(self.spare)}

    @classmethod
    def loaded(cls, slots: bytes, spare: bytes) -> Cuckoo:
        table = np.frombuffer(slots, np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(0, table, [spare[i : i + 16] for i in range(0, len(spare), 16)])


def shard_of(n: int):
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")


FILTER = "shard int, slots binary, spare binary, keys binary, keepers binary"


def packed(keys: list[bytes], keepers: np.ndarray) -> tuple[bytes, bytes]:
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return b"".join(keys[i] for i in order), np.asarray(keepers, np.int64)[order].tobytes()


def build_filters(refs: DataFrame, n_shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """A row a shard: the cuckoo filter of its keys of at least min_docs documents, and these keys with their keepers."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = [bytes(k) for k in group["key"]]
        cuckoo = Cuckoo.of(keys, len(keys))
        exact = packed(keys, group["keeper"].to_numpy())
        return pd.DataFrame([{"shard": group["shard"].iloc[0], **cuckoo.stored(), "keys": exact[0], "keepers": exact[1]}])

    kept = refs.filter(F.col("n_docs") >= min_docs).select(shard_of(n_shards).alias("shard"), "key", "keeper")
    return kept.groupBy("shard").applyInPandas(run, FILTER)


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, n_shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """The filters after refs went from ``before`` to ``after``: only keys that cross min_docs touch their filter."""

    def run(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        if old.empty:
            cuckoo, exact = Cuckoo(2 * len(change)), {}
            shard = change["shard"].iloc[0]
        else:
            row = old.iloc[0]
            shard, cuckoo = row["shard"], Cuckoo.loaded(row["slots"], row["spare"])
            keepers = np.frombuffer(row["keepers"], np.int64)
            exact = {row["keys"][16 * i : 16 * i + 16]: int(k) for i, k in enumerate(keepers)}
        if len(exact) + len(change) > FULL * cuckoo.slots.size or cuckoo.spare:
            cuckoo = Cuckoo.of(exact, 2 * (len(exact) + len(change)))
        for key, keeper in zip(change["key"], change["keeper"], strict=True):
            key, there = bytes(key), bytes(key) in exact
            if pd.isna(keeper):
                if there:
                    cuckoo.delete(key)
                    del exact[key]
            else:
                if not there:
                    cuckoo.insert(key)
                exact[key] = int(keeper)
        exact = packed(list(exact), np.array(list(exact.values()), np.int64))
        return pd.DataFrame([{"shard": shard, **cuckoo.stored(), "keys": exact[0], "keepers": exact[1]}])

    a, b = (x.filter(F.col("n_docs") >= min_docs).select("key", F.col("keeper").alias(n)) for x, n in ((before, "old"), (after, "keeper")))
    changed = a.join(b, "key", "full").filter(~F.col("old").eqNullSafe(F.col("keeper"))).select(shard_of(n_shards).alias("shard"), "key", "keeper")
    return filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(run, FILTER)


@dataclass
class LineState:
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    n_shards: int


def probe(state: LineState) -> DataFrame:
    """(doc_id, key) of the state's postings whose key is in the filters' exact tables and has another keeper."""
    schema = "doc_id bigint, key binary"

    def run(_, asked: pa.Table, held: pa.Table) -> pa.Table:
        ids, keys = (asked.column(n).combine_chunks() for n in ("doc_id", "key"))
        if not len(ids) or not held.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "key": pa.array([], pa.binary())})
        row = held.slice(0, 1).to_pylist()[0]
        halves = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)
        maybe = np.flatnonzero(Cuckoo.loaded(row["slots"], row["spare"]).contains(halves))
        end = b"\1"  # NumPy drops zero bytes at the end of a string
        exact = np.array([row["keys"][i : i + 16] + end for i in range(0, len(row["keys"]), 16)], "S17")
        wanted = np.array([x + end for x in keys.take(pa.array(maybe)).to_pylist()], "S17")
        at = np.minimum(np.searchsorted(exact, wanted), len(exact) - 1)
        hit = (exact[at] == wanted) & (np.frombuffer(row["keepers"], np.int64)[at] != ids.to_numpy()[maybe])
        rows = pa.array(maybe[hit])
        return pa.table({"doc_id": ids.take(rows), "key": keys.take(rows).cast(pa.binary())})

    # Keys with over 1 / HOT_KEYS of all postings, at most HOT_KEYS of them, have salts by their number.
    limit = max(SHARD_ROWS, state.postings.count() // HOT_KEYS)
    shard, n = shard_of(state.n_shards), F.ceil(F.col("n_docs") / F.lit(SHARD_ROWS)).cast("int")
    hot = written(state.refs.filter(F.col("n_docs") > limit).select("key", F.greatest(n, F.lit(SALTS)).alias("salts")), "line-hot")
    most = hot.groupBy(shard.alias("shard")).agg(F.max("salts").alias("salts"))
    asked = state.postings.join(F.broadcast(hot), "key", "left")
    salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(SALTS))).cast("int")
    asked = asked.select(shard.alias("shard"), salt.alias("salt"), "doc_id", "key")
    last = F.coalesce("salts", F.lit(SALTS)) - 1
    held = state.filters.join(F.broadcast(most), "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("salts")
    return asked.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInArrow(run, schema)


def line_state(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineState:
    postings = written(line_postings(documents, min_chars), "line-postings")
    n_shards = max(1, -(-postings.count() // SHARD_ROWS))
    refs = written(reference_counts(postings), "line-refs")
    return LineState(postings, refs, written(build_filters(refs, n_shards, min_docs), "line-filters"), n_shards)


def insert(state: LineState, documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineState:
    """The state with further documents; doc_ids that the state already has must be deleted first, or this raises."""
    new = written(line_postings(documents, min_chars), "line-postings")
    if new.join(state.postings.select("doc_id").hint("merge"), "doc_id", "left_semi").head(1):
        raise ValueError("some of these doc_ids are in the state: delete them first")
    both = state.refs.unionByName(reference_counts(new)).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
    refs = written(both, "line-refs")
    postings, n_shards = state.postings.unionByName(new), state.n_shards
    if (wanted := -(-postings.count() // SHARD_ROWS)) > 2 * n_shards:
        n_shards = wanted
        filters = build_filters(refs, n_shards, min_docs)
    else:
        filters = update_filters(state.filters, state.refs, refs, n_shards, min_docs)
    return LineState(postings, refs, written(filters, "line-filters"), n_shards)


def delete(state: LineState, ids: DataFrame, min_docs: int = MIN_DOCS) -> LineState:
    """The state without the documents in ids(doc_id). Counts fall; keys whose keeper goes get their next largest."""
    gone = state.postings.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    less = gone.distinct().groupBy("key").agg(F.count("*").alias("less"), F.max("doc_id").alias("largest"))
    postings = written(state.postings.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select("key", "doc_id"), "line-postings")
    lowered = state.refs.join(less, "key", "left").withColumn("n_docs", F.col("n_docs") - F.coalesce("less", F.lit(0))).filter("n_docs > 0")
    orphans = lowered.filter(F.col("largest") == F.col("keeper")).select("key")
    again = postings.join(orphans, "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("next"))
    refs = written(lowered.join(again, "key", "left").select("key", "n_docs", F.coalesce("next", "keeper").alias("keeper")), "line-refs")
    filters = written(update_filters(state.filters, state.refs, refs, state.n_shards, min_docs), "line-filters")
    return LineState(postings, refs, filters, state.n_shards)


KEPT = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, text string"


def without_repeated_lines(documents: DataFrame, state: LineState, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, text): each row of documents without its dropped lines.

    A line goes if its key is in at least min_docs documents of the state, of which this isn't the one with the
    largest doc_id. Null and empty texts are one empty line, which stays. Rows without doc_id keep all their lines.
    Rows with one doc_id count as one document. Columns other than doc_id and text play no part. The text column holds what is kept; select it away where only the
    digest is wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in KEPT.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        for batch in batches:
            rows = []
            for doc, text, lost in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                text = text.as_py() or b""
                lines, lost = text.split(b"\n"), lost.as_py()
                kept = lines
                if lost:
                    lost = set(lost)
                    kept = [x for x in lines if len(x) < min_chars or line_key(x, min_chars) not in lost]
                    text = b"\n".join(kept)
                rows.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)

    lost = probe(state).groupBy("doc_id").agg(F.collect_set("key").alias("lost"))
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.join(lost, "doc_id", "left").select("doc_id", "text", "lost").mapInArrow(run, KEPT)
