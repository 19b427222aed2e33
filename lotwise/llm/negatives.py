"""Operator 12, hard-negative mining over a pivot table.

A vector x gets one more component, sqrt(M - |x|^2) with M the largest squared length, and a query q a zero. Then
d(q, x)^2 = |q|^2 + M - 2 q.x: the largest inner product is the least distance. For each row the distances to a few
pivots are stored; by the triangle inequality |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p) for each pivot p, which
brackets every score before it is computed. What the brackets leave is checked exactly, in whole numbers.

Rows are ordered by label, nearest pivot and distance to it, and cut into tiles of one label, each with the range of its
distances to every pivot. Tiles of anchors meet tiles of rows: a join on the part of the table that a tile lies in, so
that no tile moves but those of anchors, which are a hundredth of the rows. Pairs of tiles that the brackets rule out
end there; within a pair the brackets of single rows choose what is multiplied. An anchor's best rows in its own tile
bound its search for positives, and its positives bound the scores that a negative may have. A task keeps only the
best of each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.tables import drop, written

PIVOTS, SAMPLE, TILE, PART, LEAST_PARTS = 8, 2048, 4096, 1 << 16, 12
POSITIVES, NEGATIVES, LOW_PERCENT = 5, 5, 80
NONE = -(1 << 62)


def quantised(embeddings: DataFrame, factor: int = 256) -> DataFrame:
    """(vec_id, label, v): floor(factor * x) of each component as whole numbers. Rows with a null vec_id, label or
    vector, or with a null or non-finite component, are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    some = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    return some.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.transform("embedding", lambda x: F.floor(factor * x.cast("double"))).alias("v"))


def largest_component(dims: int) -> int:
    """The power of two within which 100 times a score of vectors of so many components has 63 bits."""
    return 1 << (55 - max(dims, 1).bit_length()) // 2


def dense(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a list column as rows, zeros after the shorter ones, held within largest_component()."""
    size = np.asarray(column.value_lengths())
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims)[None, :] < size[:, None]] = column.flatten().to_numpy()
    most = largest_component(dims)
    return np.clip(out, -most, most)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Space:
    """The pivots and the length that all vectors are brought to."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots, most
        self.rest = np.sqrt(np.maximum(most - (pivots.astype(float) ** 2).sum(1), 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.most - (x.astype(float) ** 2).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.most - 2 * (x.astype(float) @ self.pivots.T.astype(float)) - 2 * np.outer(rest, self.rest), 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        square = (q.astype(float) ** 2).sum(1)
        return np.sqrt(np.maximum(square[:, None] + self.most - 2 * (q.astype(float) @ self.pivots.T.astype(float)), 0))

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of rows that have these scores with queries; beyond all for NONE."""
        d = np.sqrt(np.maximum((q.astype(float) ** 2).sum(1) + self.most - 2.0 * score, 0))
        return np.where(score <= NONE, np.inf, d)

    def slack(self) -> float:
        """More than rounding can make of a distance: roots of differences lose half of the digits."""
        return 1e-5 * max(self.most, 1.0) ** 0.5


def chosen_pivots(rows: DataFrame, dims: int, most: float) -> Space:
    """Pivots far from each other, one after the other, from the SAMPLE rows with the least hash of vec_id."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    x = dense(some.column("v").combine_chunks(), dims)
    everyone = Space(x, most)
    own = [0] if len(x) else []
    while own and len(own) < min(PIVOTS, len(x)):
        near = Space(x[own], most).of_rows(x).min(1)
        if near.max() <= everyone.slack():
            break
        own.append(int(near.argmax()))
    return Space(x[own], most)


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which k of each owner come first by score, ties by least id; owner by owner, in that order."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[place < k]


def placed(rows: DataFrame, space: Space, dims: int) -> DataFrame:
    """rows with the nearest pivot, the distance to it and those to all pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column(3), dims)
            d = space.of_rows(x)
            cell = d.argmin(1)
            binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            columns = [*(batch.column(i) for i in range(3)), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), binary(x.astype(np.int32)), binary(d)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "anchor", "cell", "ring", "x", "d"])

    return rows.select("vec_id", "label", "anchor", "v").mapInArrow(run, "vec_id bigint, label bigint, anchor boolean, cell int, ring double, x binary, d binary")


ROWS = "part int, label bigint, ids binary, x binary, d binary, low array<double>, high array<double>"
ANCHORS = "tile bigint, a_label bigint, a_ids binary, a_x binary, a_d binary, a_low array<double>, a_high array<double>, bound binary, reach double, near double"


def tiles(rows: DataFrame, space: Space, dims: int, parts: int, k: int) -> DataFrame:
    """ROWS and ANCHORS of each tile: at most TILE rows of one label, neighbours by nearest pivot and distance, and the
    anchors among them, each bounded by the k-th best score of its own tile."""
    n_pivots = len(space.pivots)

    def made(part: int, number: int, label: int, held: list[pa.RecordBatch]) -> dict:
        table = pa.Table.from_batches(held)
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        ids, x, d = table.column("vec_id").to_numpy(), joined("x", np.int32).reshape(-1, dims), joined("d", float).reshape(-1, n_pivots)
        out = {"part": part, "label": label, "ids": ids.tobytes(), "x": x.tobytes(), "d": d.tobytes(), "low": d.min(0).tolist(), "high": d.max(0).tolist()}
        own = np.flatnonzero(table.column("anchor").to_numpy())
        if not len(own):
            return out
        q = x[own]
        far = space.of_queries(q)
        bound = np.full(len(own), NONE, np.int64)
        if len(ids) > k:
            s = products(q, x)
            s[np.arange(len(own)), own] = NONE
            bound = np.partition(s, -k, axis=1)[:, -k]
        reach = float(space.distance(q, bound).max())
        return out | {"tile": (part << 32) + number, "a_label": label, "a_ids": ids[own].tobytes(), "a_x": q.tobytes(), "a_d": far.tobytes(), "a_low": far.min(0).tolist(), "a_high": far.max(0).tolist(), "bound": bound.tobytes(), "reach": reach, "near": 0.0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, last = TaskContext.get().partitionId(), 0, [], 0, None
        for batch in batches:
            label = batch.column(1).to_numpy()
            for low, high in zip(cut := np.r_[0, np.flatnonzero(np.diff(label)) + 1, len(label)], cut[1:], strict=False):
                while low < high:
                    if held and (label[low] != last or size >= TILE):
                        yield pa.RecordBatch.from_pylist([made(part, number, last, held)], schema)
                        number, held, size = number + 1, [], 0
                    some = min(int(high), int(low) + TILE - size)
                    held.append(batch.slice(low, some - low))
                    size, last, low = size + some - int(low), int(label[low]), some
        if held:
            yield pa.RecordBatch.from_pylist([made(part, number, last, held)], schema)

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in f"{ROWS}, {ANCHORS}".split(", "))])
    near = rows.repartitionByRange(parts, "label", "cell", "ring", "vec_id").sortWithinPartitions("label", "cell", "ring", "vec_id")
    return near.mapInArrow(run, f"{ROWS}, {ANCHORS}")


def met(anchors: DataFrame, rows: DataFrame, same: bool, parts: int, slack: float) -> DataFrame:
    """Each tile of anchors beside each tile of rows, of the same label or of another one, that the brackets allow."""
    spread = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    labels = F.col("a_label") == F.col("label") if same else F.col("a_label") != F.col("label")
    above = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: x - y))
    least = F.greatest(above("a_low", "high"), above("low", "a_high"))
    most = F.array_min(F.zip_with("a_high", "high", lambda x, y: x + y))
    return spread.hint("merge").join(rows, "part").filter(labels & (least <= F.col("reach") + slack) & (most >= F.col("near") - slack))


def survivors(space: Space, q: np.ndarray, qd: np.ndarray, x: np.ndarray, xd: np.ndarray, reach: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs whose distance the pivots don't place beyond ``reach`` or below ``near``."""
    least, most = np.zeros((len(q), len(x))), np.full((len(q), len(x)), np.inf)
    for p in range(qd.shape[1]):
        np.maximum(least, np.abs(qd[:, p, None] - xd[None, :, p]), out=least)
        np.minimum(most, qd[:, p, None] + xd[None, :, p], out=most)
    left = (least <= reach[:, None] + space.slack()) & (most >= near[:, None] - space.slack())
    own = np.flatnonzero(left.any(0))
    i, j = np.nonzero(left[:, own])
    return i, own[j], products(q, x[own])[i, j]


class Pair:
    """A row of met() as arrays."""

    def __init__(self, row: dict, dims: int, n_pivots: int):
        ints = lambda c, kind=np.int64: np.frombuffer(row[c], kind)
        self.tile, self.ids, self.a_ids = row["tile"], ints("ids"), ints("a_ids")
        self.x, self.q = ints("x", np.int32).reshape(-1, dims), ints("a_x", np.int32).reshape(-1, dims)
        self.d, self.far = ints("d", float).reshape(-1, n_pivots), ints("a_d", float).reshape(-1, n_pivots)
        self.bound = ints("bound").reshape(len(self.a_ids), -1)


FOUND = "tile bigint, place int, goal int, vec_id bigint, score bigint"


def searched(pairs: DataFrame, space: Space, dims: int, k: int, percent: int | None) -> DataFrame:
    """FOUND: of each pair of tiles the k best rows of each anchor, or with a percentage, the k best rows whose score is
    from that share of each goal to the goal. Of pairs with the same anchors that follow each other only the best stay."""
    n_pivots = len(space.pivots)
    names = [x.split()[0] for x in FOUND.split(", ")]

    def hits(pair: Pair) -> np.ndarray:
        if percent is None:
            bound = pair.bound[:, 0]
            i, j, s = survivors(space, pair.q, pair.far, pair.x, pair.d, space.distance(pair.q, bound), np.zeros(len(bound)))
            ok = (s >= bound[i]) & (pair.ids[j] != pair.a_ids[i])
            i, j, s = i[ok], j[ok], s[ok]
            return np.stack([i, np.zeros(len(i), np.int64), pair.ids[j], s], 1)
        goal = pair.bound
        high, low = goal.max(1), lowest(goal, percent)
        i, j, s = survivors(space, pair.q, pair.far, pair.x, pair.d, space.distance(pair.q, low), space.distance(pair.q, high))
        some = (s >= low[i]) & (s <= high[i])
        i, j, s = i[some], j[some], s[some]
        parts = []
        for g in range(goal.shape[1]):
            own = goal[i, g]
            ok = (own >= 0) & (s <= own) & (100 * s >= percent * own)
            parts.append(np.stack([i[ok], np.full(int(ok.sum()), g), pair.ids[j[ok]], s[ok]], 1))
        return np.concatenate(parts)

    def batch(tile: int, found: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(found), tile), found[:, 0].astype(np.int32), found[:, 1].astype(np.int32), found[:, 2], found[:, 3]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, np.zeros((0, 4), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                pair = Pair({c: b.column(c)[i].as_py() for c in b.schema.names}, dims, n_pivots)
                if tile is not None and pair.tile != tile:
                    yield batch(tile, held)
                    held = held[:0]
                both = np.concatenate([held, hits(pair)])
                tile, held = pair.tile, both[best(both[:, 0] * POSITIVES + both[:, 1], both[:, 3], both[:, 2], k)]
        if tile is not None:
            yield batch(tile, held)

    return pairs.select("tile", "a_ids", "a_x", "a_d", "bound", "ids", "x", "d").mapInArrow(run, FOUND)


def lowest(goal: np.ndarray, percent: int) -> np.ndarray:
    """Of each row of goals the least score that belongs to one of them; beyond all scores if none is 0 or more."""
    share = -(-percent * np.maximum(goal, 0) // 100)
    return np.where(goal >= 0, share, -NONE).min(1)


def first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("tile", "place", "goal").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k)


def aimed(anchors: DataFrame, positives: DataFrame, space: Space, dims: int, percent: int) -> DataFrame:
    """Tiles of anchors bounded by the scores of their positives instead; tiles that no negative can suit are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q = np.frombuffer(row["a_x"], np.int32).reshape(-1, dims)
                goal = np.full((len(q), POSITIVES), NONE, np.int64)
                for x in row.pop("goals"):
                    goal[x["place"], x["rnk"] - 1] = x["score"]
                able = (goal >= 0).any(1)
                if able.any():
                    reach, near = space.distance(q[able], lowest(goal[able], percent)).max(), space.distance(q[able], goal[able].max(1)).min()
                    yield pa.RecordBatch.from_pylist([row | {"bound": goal.tobytes(), "reach": float(reach), "near": float(near)}], pa.schema([f for f in batch.schema if f.name != "goals"]))

    goals = positives.groupBy("tile").agg(F.collect_list(F.struct("place", "rnk", "score")).alias("goals"))
    names = [x.split()[0] for x in ANCHORS.split(", ")]
    return anchors.join(goals.hint("merge"), "tile").select(*names, "goals").mapInArrow(run, ANCHORS)


def hard_negatives(rows: DataFrame, anchor: Column, percent: int = LOW_PERCENT, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows(vec_id, label, v) of whole numbers.

    A score is an inner product; higher ones come first, ties by vec_id. Positives of an anchor (a row for which
    ``anchor`` holds) are its first n_positives other rows of its label; hard negatives of a positive are the first
    n_negatives rows of other labels that score from ``percent`` of the positive's score to that score. Anchors without
    positives and positives without such rows have no row. Rows with one vec_id count as one, the one of least
    (label, v). Shorter vectors are filled up with zeros; components are held within a power of two (2^24 for 64
    components), so that scores are exact in 64 bits. An empty table gives no row. Further columns play no part.
    """
    if not 0 < n_positives <= POSITIVES:
        raise ValueError(f"n_positives must be from 1 to {POSITIVES}")
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    once = written(once, "negatives-rows")
    n, dims = once.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    held = float(largest_component(dims))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.least(F.abs(x.cast("double")), F.lit(held)) * F.least(F.abs(x.cast("double")), F.lit(held)))
    most = once.agg(F.max(square)).first()[0] or 0.0
    parts = max(LEAST_PARTS, -(-n // PART))
    space = chosen_pivots(once, dims, most)
    near = written(placed(once, space, dims), "negatives-placed")
    every = written(tiles(near, space, dims, parts, n_positives), "negatives-tiles")
    drop(near)
    drop(once)
    parts = (every.agg(F.max("part")).first()[0] or 0) + 1
    table = every.select(*[x.split()[0] for x in ROWS.split(", ")])
    anchors = every.filter("tile is not null").select(*[x.split()[0] for x in ANCHORS.split(", ")])
    slack = space.slack()
    positives = written(first(searched(met(anchors, table, True, parts, slack), space, dims, n_positives, None), n_positives), "negatives-positives")
    goals = written(aimed(anchors, positives, space, dims, percent), "negatives-goals")
    negatives = first(searched(met(goals, table, False, parts, slack), space, dims, n_negatives, percent), n_negatives)
    names = anchors.select("tile", "a_ids").mapInArrow(numbered, "tile bigint, place int, anchor_id bigint")
    own = positives.select("tile", "place", (F.col("rnk") - 1).alias("goal"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names.hint("merge"), ["tile", "place"])
    out = negatives.select("tile", "place", "goal", F.col("rnk").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(own.hint("merge"), ["tile", "place", "goal"])
    out = written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for old in (every, positives, goals):
        drop(old)
    return out


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of tiles of anchors as rows with their places."""
    for batch in batches:
        for tile, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), tile)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], ["tile", "place", "anchor_id"])
