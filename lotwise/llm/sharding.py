"""Operator 9, sharding: vector bin packing of groups of equal texts by bytes, tokens and rows jointly.

Each group goes where the dot product of its vector with the shards' residual capacity is highest, largest groups
first. What the driver packs is bounded at every input size: groups that are small against a shard are first gathered
by hash into CELLS cells a shard, and groups of more than PART of a shard's capacity are split by a hash of doc_id, as
no balance is possible with them whole. The law is ``bytes``: the shards' sizes are near equal (so are their tokens and
rows). Texts never move; the only shuffles carry a digest and three numbers a document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import text as words
from lotwise.llm.tables import written

SHARDS, CELLS, PART, SLICES = 24, 512, 0.25, 64
DIMS = ("size", "tokens", "rows")


def text_sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, text_key) a row of documents: size is UTF-8 bytes plus 8, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in words.chunks(batch.column(1)):
                tokens = np.diff(words.Words(data, at).first)
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(at) + 8), pa.array(tokens.astype(np.int64)), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())],
                    ["doc_id", "size", "tokens", "text_crc32", "text_key"],
                )

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, size bigint, tokens bigint, text_crc32 bigint, text_key binary")


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item of items (n, dims), placed largest first where item . residual capacity is highest."""
    total = items.sum(0)
    scaled = items / np.where(total > 0, total / shards, 1)
    residual = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -scaled[:, 0], -scaled.max(1))):
        out[i] = k = int(np.argmax(residual @ scaled[i]))
        residual[k] -= scaled[i]
    return out


def shards_of(documents: DataFrame, shards: int = SHARDS, cells: int = CELLS, part: float = PART) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens, group_id) a row of documents.

    Equal texts go to one shard, unless they hold more than ``part`` of a shard's mean bytes, tokens or rows; then
    their rows are split by doc_id. Slots count from 0 in each shard without gaps; ties in a cell are ordered by doc_id. Null
    texts count as empty; rows without doc_id and repeated rows have their own slots. An empty table gives no rows.
    Columns other than doc_id and text play no part.
    """
    spark = documents.sparkSession
    rows = written(text_sizes(documents), "shard-sizes")
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMS[:2]], F.count("*").alias("rows")).first()
    share = F.greatest(*[F.col(c) / F.lit(float(max(total[c], 1))) for c in DIMS]) * shards  # of a mean shard
    # Groups of over 1 / cells of a shard are at most 3 * shards * cells.
    alone = groups.withColumn("share", share).filter(F.col("share") > 1.0 / cells).select("text_key", F.ceil(F.col("share") / F.lit(part)).cast("int").alias("parts"))
    alone = written(alone, "shard-large")
    cell = F.when(F.col("parts").isNull(), F.concat(F.lit("c"), F.pmod(F.xxhash64("text_key"), F.lit(shards * cells)).cast("string"))).otherwise(
        F.concat(F.hex("text_key"), F.lit("-"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("string"))
    )
    # The parts of groups that are split, of which there are at most 3 * shards / part, are numbered in slices.
    slice_ = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.lit(SLICES))).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(alone), "text_key", "left").withColumn("cell", cell).withColumn("slice", slice_).drop("parts")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    found = rows.groupBy("cell", "slice").agg(*sums).orderBy("cell", "slice").collect()
    cells_ = {c: i for i, c in enumerate(dict.fromkeys(r["cell"] for r in found))}
    vectors = np.zeros((len(cells_), len(DIMS)))
    np.add.at(vectors, [cells_[r["cell"]] for r in found], np.array([[r[c] for c in DIMS] for r in found], float).reshape(-1, len(DIMS)))
    placed = pack(vectors, shards).tolist()
    start, plan = [0] * shards, []
    for r in found:
        k = placed[cells_[r["cell"]]]
        plan.append((r["cell"], r["slice"], k, start[k]))
        start[k] += r["rows"]
    plan = spark.createDataFrame(plan, "cell string, slice int, shard int, start bigint")
    slot = F.col("start") + F.row_number().over(Window.partitionBy("cell", "slice").orderBy("doc_id", "text_crc32")) - 1
    return rows.join(F.broadcast(plan), ["cell", "slice"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens", F.hex("text_key").alias("group_id")
    )
