"""How large a break between periods must be for the test of heterogeneity to see it.

Sensors are built: noise, with failing units shifted in the first period only. Neither values nor permutations are rows: a
task draws both by number, and all that it is sent is a bit a unit, whether it fails, in order of time. Units beyond
SLAB are cut along the values, a task a piece, and a sensor's pieces are added up.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators import kernels
from lotwise.operators.running import numbered

#: Units of a piece, about, and places that a task holds for all of its sensors.
SLAB, PLACES = 1 << 22, 1 << 24
#: Counts of a stretch of sorted units lie side by side in one number, a lane a block.
LANE, LANES = 12, 5
STRETCH = (1 << LANE) - 1
SEED = 7


def failures(units: DataFrame) -> np.ndarray:
    """Whether each unit fails, in order of time; a bit a unit comes to the driver."""
    rows = numbered(units, [], F.unix_date(F.to_date("ts")), ["ts", "unit_id"]).select((F.col("row") - 1).alias("row"), F.col("y").cast("int").alias("y"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 20, np.uint8)
        bits[table.column("row").to_numpy() & ((1 << 20) - 1)] = table.column("y").to_numpy()
        return pa.table({"part": [key[0].as_py()], "n": [table.num_rows], "bits": pa.array([np.packbits(bits[: table.num_rows]).tobytes()], pa.binary())})

    parts = rows.withColumn("part", F.shiftright("row", 20)).groupBy("part").applyInArrow(run, "part bigint, n bigint, bits binary").collect()
    every = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in sorted(parts, key=lambda r: r["part"])]
    return np.concatenate(every).astype(bool) if every else np.zeros(0, bool)


def blocks_of(n: int, k: int) -> np.ndarray:
    """ntile(k) from 0 of n units in order of time."""
    return np.repeat(np.arange(k, dtype=np.uint8), [n // k + (b < n % k) for b in range(k)])


def values(shift: float, y: np.ndarray, blocks: np.ndarray, first: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """The next n values of a sensor, those of units from number first on."""
    own = slice(first, first + n)
    return rng.standard_normal(n) + shift * (y[own] & (blocks[own] == 0))


def ordered(sensor: int, shift: float, y: np.ndarray, blocks: np.ndarray, low: float, high: float) -> np.ndarray:
    """The units whose value is above low and not above high, in order of value, equal ones in order of time."""
    rng, found, kept = np.random.default_rng([SEED, sensor]), [], []
    for first in range(0, len(y), SLAB):
        x = values(shift, y, blocks, first, min(SLAB, len(y) - first), rng)
        own = np.flatnonzero((x > low) & (x <= high))
        found.append((own + first).astype(np.int32))
        kept.append(x[own])
    return np.concatenate(found)[np.argsort(np.concatenate(kept), kind="stable")]


class Order:
    """One sensor's units of a piece in order, in stretches of so many that a lane can count them."""

    def __init__(self, order: np.ndarray, y: np.ndarray):
        self.rows = -(-max(len(order), 1) // STRETCH)
        self.order = np.full(self.rows * STRETCH, len(y))  # the last place counts nothing
        self.order[: len(order)] = order
        self.at = np.flatnonzero(y[order])
        self.unit = order[self.at]
        self.stretch = (self.at // STRETCH) * LANES

    def won(self, blocks: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs in order, positives, negatives) of each block, inside the piece."""
        upto = lanes.take(self.order, mode="clip").reshape(self.rows, STRETCH).cumsum(1)
        shift = LANE * np.arange(LANES)
        in_stretch = (upto[:, -1:] >> shift) & STRETCH
        before = in_stretch.cumsum(0) - in_stretch
        block = blocks[self.unit]
        below = (upto.ravel()[self.at] >> (LANE * block.astype(np.int64))) & STRETCH
        p = np.bincount(self.stretch + block, minlength=self.rows * LANES).reshape(self.rows, LANES)
        won = np.bincount(block, below, LANES).astype(np.int64) + (p * before).sum(0)
        return won, p.sum(0), in_stretch.sum(0)


def heterogeneity(won: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(q, i2) of kernels.cochran_q, a row a replicate of (replicate, block); NaN where fewer than two blocks have an AUC."""
    p, n = p.astype(float), n.astype(float)
    some = (p > 0) & (n > 0)
    a = np.where(some, won / np.where(some, p * n, 1), 0.5)
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    var = (a * (1 - a) + (p - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a)) / np.where(some, p * n, 1)
    w = np.where(some, 1 / np.maximum(var, 1e-12), 0.0)
    mean = (w * a).sum(1) / np.maximum(w.sum(1), 1e-300)
    df = some.sum(1) - 1
    q = np.where(df >= 1, (w * (a - mean[:, None]) ** 2).sum(1), np.nan)
    return q, np.where(q > 0, np.maximum(0.0, (q - df) / np.where(q > 0, q, 1)), np.where(np.isnan(q), np.nan, 0.0))


def built(units: DataFrame, k: int, n_sensors: int, n_perms: int, shifts: dict[float, float]) -> DataFrame:
    """(sensor_id, delta, q, i2, p) of n_sensors sensors a shift: Cochran's Q over k blocks of time, and how often random
    blocks of those sizes have one at least as large, p = (1 + hits) / (n_perms + 1)."""
    if k > LANES:
        raise ValueError(f"at most {LANES} blocks")
    spark, names = units.sparkSession, list(shifts)
    y = failures(units)
    n_pieces = -(-max(len(y), 1) // SLAB)
    edges = [-math.inf, *(kernels.normal_quantile(i / n_pieces) for i in range(1, n_pieces)), math.inf]
    n, cores = len(names) * n_sensors, spark.sparkContext.defaultParallelism
    size = max(1, min(-(-n // (4 * cores)), PLACES * n_pieces // max(len(y), 1)))
    tasks = [(first, min(size, n - first), piece) for first in range(0, n, size) for piece in range(n_pieces)]
    known = spark.sparkContext.broadcast((np.packbits(y), len(y), tasks, edges, [shifts[d] for d in names]))

    def run(batches):
        bits, n_units, tasks, edges, by = known.value
        y, blocks = np.unpackbits(bits, count=n_units).astype(bool), blocks_of(n_units, k)
        lane = (1 << (LANE * np.arange(LANES))).astype(np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                first, many, piece = tasks[t]
                own = [Order(ordered(s, by[s // n_sensors], y, blocks, edges[piece], edges[piece + 1]), y) for s in range(first, first + many)]
                sums = np.zeros((many, 3, n_perms + 1, LANES), np.int64)
                for rep in range(n_perms + 1):
                    # the blocks of time, then permutations, the same for every sensor
                    now = blocks if rep == 0 else np.random.default_rng([SEED, n, rep]).permutation(blocks)
                    lanes = np.append(np.where(y, 0, lane[now]), 0)
                    for i, o in enumerate(own):
                        sums[i, :, rep] = o.won(now, lanes)
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + many), pa.int32()), pa.array([piece] * many, pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], ["sensor_id", "piece", "sums"])

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        sensor, won, p, below = key[0].as_py(), 0, 0, 0
        for part in table.sort_by("piece").column("sums").to_pylist():
            w, a, b = np.frombuffer(part, np.int64).reshape(3, n_perms + 1, LANES)
            won, p, below = won + w + a * below, p + a, below + b
        q, i2 = heterogeneity(won, p, below)
        real, null = np.round(q[0], 9), np.round(q[1:], 9)
        p_value = None if np.isnan(real) else (1 + int((null >= real).sum())) / (n_perms + 1)
        some = lambda v: None if np.isnan(v) else float(v)
        return pa.table({"sensor_id": pa.array([sensor], pa.int32()), "delta": [names[sensor // n_sensors]], "q": pa.array([some(q[0])], pa.float64()), "i2": pa.array([some(i2[0])], pa.float64()), "p": pa.array([p_value], pa.float64())})

    parts = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, "sensor_id int, piece int, sums binary")
    return parts.groupBy("sensor_id").applyInArrow(joined, "sensor_id int, delta double, q double, i2 double, p double")


def ladder(units: DataFrame, k: int, shifts: dict[float, float], n_sensors: int = 200, n_perms: int = 2000, alpha: float = 0.05, n_family: int = 1) -> DataFrame:
    """(delta, auc, shift, n_sensors, median_p, power, power_family, median_i2), a row a delta: the share of built sensors that
    the test finds at alpha, and at alpha / n_family, the strictest level that an adjustment over n_family sensors asks for."""
    rows = built(units, k, n_sensors, n_perms, shifts)
    share = lambda level: F.avg((F.col("p") < level).cast("double"))
    out = rows.groupBy("delta").agg(F.count("*").alias("n_sensors"), F.percentile("p", 0.5).alias("median_p"), share(alpha).alias("power"), share(alpha / max(n_family, 1)).alias("power_family"), F.percentile("i2", 0.5).alias("median_i2"))
    shift = F.element_at(F.create_map(*[F.lit(x) for d, s in shifts.items() for x in (d, s)]), F.col("delta"))
    return out.select("delta", (F.col("delta") + 0.5).alias("auc"), shift.alias("shift"), "n_sensors", "median_p", "power", "power_family", "median_i2")
