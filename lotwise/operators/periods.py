"""Drift between periods, and association that holds in every period."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators import kernels, resampling, stability
from lotwise.operators.graph import checkpointed


def with_blocks(readings: DataFrame, units: DataFrame, k: int) -> DataFrame:
    return readings.join(resampling.time_blocks(units, k).select("unit_id", "block"), "unit_id")


def fail_rates(units: DataFrame, k: int) -> DataFrame:
    """(block, n, n_fail, rate) of k blocks of time."""
    b = resampling.time_blocks(units, k).groupBy("block").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("n_fail"))
    return b.withColumn("rate", F.col("n_fail") / F.col("n"))


def first_against_last(readings: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """kernels.ks_two_sample of each sensor between the last and the first of k blocks of time."""
    b = with_blocks(readings, units, k).filter((F.col("block") == 1) | (F.col("block") == k))
    return kernels.ks_two_sample(b.withColumn("late", (F.col("block") == k).cast("int")), ["sensor_id"], "late")


def era(units: DataFrame, late_share: float = 0.3) -> DataFrame:
    """units with y = 1 for the last late_share in time: labels for adversarial validation."""
    return resampling.chronological(units, 1 - late_share).withColumn("y", (F.col("role") == "test").cast("int")).drop("role")


def strength(auc: Column, se: Column) -> Column:
    return F.round(F.abs(auc - 0.5) / se, 9)


class MeanRanks:
    """Each sensor's mean ranks, taken once: a label permutation moves no value, so that it sums the ranks of its positives
    only, a row a failing unit and not a unit."""

    def __init__(self, readings: DataFrame):
        own = kernels.cumulated(readings, ["sensor_id"], "value", "y").withColumn("rk", (F.col("cp") + F.col("cn")) - (F.col("p") + F.col("n") - 1) / F.lit(2.0))
        self.ranks = readings.filter("value is not null").join(own.select("sensor_id", F.col("v").alias("value"), "rk"), ["sensor_id", "value"]).select("unit_id", "sensor_id", "y", "rk")
        self.size = checkpointed(self.ranks.groupBy("sensor_id").agg(F.count("*").alias("m")))  # a row a sensor

    def strengths(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        s = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n1"), F.sum("rk").alias("s")).join(F.broadcast(self.size), "sensor_id")
        n0 = F.col("m") - F.col("n1")
        s = s.withColumn("auc", F.when(n0 > 0, (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * n0)))
        return s.withColumn("se", kernels.hanley_error(F.col("auc"), F.col("n1"), n0)).withColumn("z", strength(F.col("auc"), F.col("se")))

    def real(self) -> DataFrame:
        return self.strengths(self.ranks.filter("y = 1"), ["sensor_id"]).select("sensor_id", "auc", "se", "z")

    def null(self, units: DataFrame, n_perms: int, start: int = 0, sensors: list[int] | None = None) -> DataFrame:
        """(rep, sensor_id, z) of the permutations from start on, of some sensors or all."""
        perms = resampling.permuted_labels(units, n_perms, start=start).filter("y = 1").select("rep", "unit_id")
        ranks = self.ranks if sensors is None else self.ranks.filter(F.col("sensor_id").isin(sensors))
        return self.strengths(ranks.drop("y").join(perms, "unit_id"), ["rep", "sensor_id"]).select("rep", "sensor_id", "z")


def association(readings: DataFrame, units: DataFrame, n_perms: int) -> DataFrame:
    """(sensor_id, auc, se, z, p): p = (1 + permutations with z at least as large) / (n_perms + 1)."""
    ranks = MeanRanks(readings)
    # What is tested later is a row a sensor: without the plan that it came from, which would stand in it several times.
    real, null = checkpointed(ranks.real()), ranks.null(units, n_perms).select("sensor_id", F.col("z").alias("zp"))
    hits = checkpointed(null.join(F.broadcast(real.select("sensor_id", "z")), "sensor_id").groupBy("sensor_id").agg(F.count(F.when(F.col("zp") >= F.col("z"), 1)).alias("hits")))
    return real.join(hits, "sensor_id", "left").withColumn("p", (F.coalesce("hits", F.lit(0)) + F.lit(1.0)) / F.lit(n_perms + 1.0)).drop("hits")


#: Units times permutations that one batch deals.
AT_ONCE = 1 << 24


def sequential_p(real: DataFrame, null, most: int, stop: int, batch: int, rows: int = 1) -> DataFrame:
    """(sensor_id, n_perms, hits, p) after Besag and Clifford (1991), for real(sensor_id, x) and null(n, start, sensors), the
    (rep, sensor_id, x) of n permutations from number start on.

    A sensor leaves at the permutation in which x is as large as the real one for the stop-th time, with p = stop / number
    of permutations; one that stays to the end has (hits + 1) / (most + 1). Permutations have numbers, and batches double,
    so that p doesn't hang on their size. With so many rows a permutation, a batch has at most AT_ONCE rows or one
    permutation. Sensors with clear answers leave after a few, and only strong ones see them all.
    """
    spark = real.sparkSession
    real = checkpointed(real.select("sensor_id", F.col("x").alias("x0")))
    hits = {r["sensor_id"]: 0 for r in real.collect()}  # a row a sensor
    out, start = [], 0
    while hits and start < most:
        n = min(batch, most - start, max(1, AT_ONCE // max(rows, 1)))
        same = null(n, start, sorted(hits)).join(F.broadcast(real), "sensor_id").filter("x >= x0").select("sensor_id", "rep")
        need = spark.createDataFrame([(s, stop - h) for s, h in hits.items()], "sensor_id int, need int")
        turn = F.row_number().over(Window.partitionBy("sensor_id").orderBy("rep"))  # at most a batch's rows
        found = same.withColumn("turn", turn).join(F.broadcast(need), "sensor_id").groupBy("sensor_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("turn") == F.col("need"), F.col("rep"))).alias("last"))
        for r in found.collect():
            if r["last"] is not None:
                out.append((r["sensor_id"], r["last"] + 1, stop, stop / (r["last"] + 1)))
                del hits[r["sensor_id"]]
            else:
                hits[r["sensor_id"]] += r["n"]
        start, batch = start + n, 2 * batch
    out += [(s, most, h, (h + 1) / (most + 1)) for s, h in hits.items()]
    return spark.createDataFrame(out, "sensor_id int, n_perms int, hits int, p double")


def sequential_association(readings: DataFrame, units: DataFrame, most: int = 20_000, stop: int = 10, batch: int = 128) -> DataFrame:
    """association() with up to ``most`` permutations, as many as a sensor needs."""
    ranks = MeanRanks(readings)
    ranks.ranks = checkpointed(ranks.ranks)
    real = checkpointed(ranks.real())
    null = lambda n, start, sensors: ranks.null(units, n, start, sensors).withColumnRenamed("z", "x")
    return real.join(F.broadcast(sequential_p(real.select("sensor_id", F.col("z").alias("x")), null, most, stop, batch, units.count())), "sensor_id")


def heterogeneity(readings: DataFrame, blocks: DataFrame, keys: list[str] = ()) -> DataFrame:
    """kernels.cochran_q of AUCs by block, for blocks(keys, unit_id, block); ranks are taken anew in each block."""
    keys = list(keys)
    a = kernels.auc_with_error(readings.join(blocks, "unit_id"), [*keys, "sensor_id", "block"])
    return kernels.cochran_q(checkpointed(a), [*keys, "sensor_id"])  # a row a sensor and block


def permuted_heterogeneity(readings: DataFrame, units: DataFrame, k: int, n_perms: int, start: int = 0) -> DataFrame:
    """heterogeneity() with key rep over resampling.permuted_blocks, from readings in order of value once: what a
    permutation adds to a reading is bytes and not a row."""
    dealt = resampling.permuted_blocks(units, k, n_perms, start=start, columns=("unit_id", "y")).withColumn("mult", F.lit(1))
    every = [(rep, block) for rep in range(start, start + n_perms) for block in range(1, k + 1)]
    a = stability.replicate_aucs(readings, dealt, ["rep", "block"], every).filter("n1 + n0 > 0")
    a = a.withColumn("auc", F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("auc")))
    a = a.withColumn("se", F.when(F.col("auc").isNotNull(), kernels.hanley_error(F.col("auc"), F.col("n1"), F.col("n0"))))
    return kernels.cochran_q(checkpointed(a), ["rep", "sensor_id"])


def invariance(readings: DataFrame, units: DataFrame, k: int, n_perms: int) -> DataFrame:
    """(sensor_id, k, mean, q, df, i2, p): Cochran's Q over k blocks of time against random blocks of those sizes."""
    real = heterogeneity(readings, resampling.time_blocks(units, k).select("unit_id", "block"))
    null = permuted_heterogeneity(readings, units, k, n_perms).select("sensor_id", F.round("q", 9).alias("qp"))
    hits = null.join(F.broadcast(real.select("sensor_id", F.round("q", 9).alias("q0"))), "sensor_id").groupBy("sensor_id").agg(F.count(F.when(F.col("qp") >= F.col("q0"), 1)).alias("hits"))
    return real.join(hits, "sensor_id", "left").withColumn("p", (F.coalesce("hits", F.lit(0)) + F.lit(1.0)) / F.lit(n_perms + 1.0)).drop("hits")


def sequential_invariance(readings: DataFrame, units: DataFrame, k: int, most: int = 20_000, stop: int = 10, batch: int = 16) -> DataFrame:
    """invariance() with up to ``most`` permutations of the blocks, as many as a sensor needs."""
    real = checkpointed(heterogeneity(readings, resampling.time_blocks(units, k).select("unit_id", "block")))

    def null(n: int, start: int, sensors: list[int]) -> DataFrame:
        some = readings.filter(F.col("sensor_id").isin(sensors))
        return permuted_heterogeneity(some, units, k, n, start).select("rep", "sensor_id", F.round("q", 9).alias("x"))

    return real.join(F.broadcast(sequential_p(real.select("sensor_id", F.round("q", 9).alias("x")), null, most, stop, batch, units.count())), "sensor_id")


def gated(associated: DataFrame, invariant: DataFrame, alpha: float) -> DataFrame:
    """(sensor_id, p_assoc, associated, p_inv, invariant): the second test only for sensors that pass the first.

    A sensor is invariant if it is associated and its heterogeneity isn't rejected; both with adjusted p < alpha.
    """
    a = kernels.bh_adjust(associated, []).select("sensor_id", F.col("p_adj").alias("p_assoc")).withColumn("associated", F.col("p_assoc") < alpha)
    second = kernels.bh_adjust(invariant.join(F.broadcast(a.filter("associated").select("sensor_id")), "sensor_id", "left_semi"), []).select("sensor_id", F.col("p_adj").alias("p_inv"))
    return a.join(second, "sensor_id", "left").withColumn("invariant", F.col("associated") & (F.coalesce("p_inv", F.lit(1.0)) >= alpha))


def sensor_table(gate: DataFrame, selected: DataFrame, fold: str = "fold") -> DataFrame:
    """gate's sensors with ``folds``, in how many folds selected(fold, sensor_id) has each; the order to show them in is
    ``place``: most folds first, then the least p."""
    n = selected.groupBy("sensor_id").agg(F.count_distinct(fold).alias("folds"))
    out = gate.join(n, "sensor_id", "left").withColumn("folds", F.coalesce("folds", F.lit(0)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("folds"), F.round("p_assoc", 12), "sensor_id")  # a row a sensor
    return out.withColumn("place", F.row_number().over(order))


def described(table: DataFrame, n_folds: int, k: int) -> DataFrame:
    """(grp, n, n_associated, n_invariant) of groups of a sensor_table: the consensus (its first k), those in half of the
    folds, in any fold, associated but in none, and all."""
    groups = {"consensus": (F.col("place") <= k) & (F.col("folds") > 0), "half_of_folds": F.col("folds") >= n_folds / 2, "any_fold": F.col("folds") > 0, "associated_unselected": F.col("associated") & (F.col("folds") == 0), "all": F.lit(True)}
    member = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in groups.items()])))
    n = lambda c: F.count(F.when(c, 1))
    return table.withColumn("grp", member).groupBy("grp").agg(F.count("*").alias("n"), n(F.col("associated")).alias("n_associated"), n(F.col("invariant")).alias("n_invariant"))


#: The shift of failing units that gives an AUC of 0.5 + delta, for AUCs from 0.501 to 0.999.
SHIFTS = {d: round(math.sqrt(2) * kernels.normal_quantile(min(max(0.5 + d, 0.501), 0.999)), 8) for d in (0.05, 0.10, 0.15, 0.20, 0.25)}
