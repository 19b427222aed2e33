"""Thresholds from null worlds: worlds(world, permuted, max_support) and supports(world, permuted, sensor_id, support)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.hashing import digest
from lotwise.operators import fits, kernels, resampling, stability
from lotwise.operators.graph import checkpointed
from lotwise.operators.resampling import halves
from lotwise.operators.running import shuffled

ALPHAS = (0.10, 0.05, 0.01)


def weights_of_worlds(units: DataFrame, n_null: int, n_real: int, n_boot: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(world, rep, unit_id, y, mult), the units of each replicate with at least ``least`` failures, and these (world, rep)."""
    n = n_null + n_real
    drawn = resampling.bootstrap(units, n * n_boot, 0).withColumn("world", F.floor(F.col("rep") / n_boot).cast("int"))
    null = resampling.permuted_labels(units, n_null).withColumnRenamed("rep", "world")
    real = resampling.reps(units.select("unit_id", "y"), n_real, "world").withColumn("world", F.col("world") + n_null)
    labels = null.select("world", "unit_id", "y").unionByName(real.select("world", "unit_id", "y"))
    w = drawn.drop("y").join(labels, ["world", "unit_id"]).select("world", "rep", "unit_id", "y", "mult")
    good = w.groupBy("world", "rep").agg(F.sum(F.col("y") * F.col("mult")).alias("p")).filter(F.col("p") >= least).select("world", "rep")
    return w.join(F.broadcast(good), ["world", "rep"], "left_semi"), good


def drawn_worlds(units: DataFrame, readings: DataFrame, n_null: int, n_real: int, n_boot: int, least: int) -> DataFrame:
    """(world, rep, sensor_id, n1, n0, won) of the replicates of weights_of_worlds(): positives, negatives and twice the pairs
    in order of each sensor. Blocks of worlds have each unit once, fits.LARGE at most, and draw labels and bootstraps by
    the same digests; no replicate is a row a unit."""
    spark, n_worlds = units.sparkSession, n_null + n_real
    n_blocks = max(1, min(n_worlds, 2 * spark.sparkContext.defaultParallelism))
    name = F.col("unit_id").cast("string")
    rows = units.select("unit_id", F.col("y").cast("int").alias("y"), name.alias("name"), digest("order", F.col("unit_id")).alias("h"))
    rows = rows.join(fits.wide(readings.select("unit_id", "sensor_id", "value")), "unit_id", "left")
    rows = rows.withColumn("cells", F.coalesce("cells", F.array().cast(rows.schema["cells"].dataType)))
    blocks = spark.createDataFrame(list(enumerate(fits.apart(spark, n_blocks))), "number int, block int")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("unit_id", "ascending")])
        n, y, cells = table.num_rows, table.column("y").to_numpy(), fits.one_array(table.column("cells"))
        sensors = tuple(np.unique(cells.flatten().field("sensor_id").to_numpy()).tolist())
        along = []
        for v in (fits.scattered(cells, sensors) if sensors else np.zeros((n, 0))).T:
            order = np.argsort(v, kind="stable")[: n - int(np.isnan(v).sum())]
            along.append((order, np.flatnonzero(np.r_[True, v[order][1:] != v[order][:-1]])))
        names = [x.encode() for x in table.column("name").to_pylist()]
        tails = [b"%d" % i for i in range(1, n + 1)]
        digests = lambda head, parts: b"".join([hashlib.md5(head + x).digest() for x in parts])
        out = []
        for world in range(table.column("number")[0].as_py(), n_worlds, n_blocks):
            label = y
            if world < n_null:
                label = np.empty_like(y)
                label[np.argsort(np.frombuffer(digests(b"perm:%d:" % world, names), "S16"), kind="stable")] = y
            for rep in range(world * n_boot, (world + 1) * n_boot):
                # the first 48 bits modulo n
                row = (np.frombuffer(digests(b"boot:%d:" % rep, tails), ">u8")[::2] >> np.uint64(16)) % np.uint64(n)
                mult = np.bincount(row.astype(np.int64), minlength=n)
                p, q = mult * label, mult * (1 - label)
                if p.sum() < least:
                    continue
                for sensor, (order, start) in zip(sensors, along, strict=True):
                    a, b = p[order], q[order]
                    if len(start) < len(order):
                        a, b = np.add.reduceat(a, start), np.add.reduceat(b, start)
                    below = np.cumsum(b)
                    out.append((world, rep, sensor, int(a.sum()), int(below[-1]), int((a * (2 * below - b)).sum())))
        columns = list(zip(*out, strict=True)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.int64()] * 3, strict=True)], ["world", "rep", "sensor_id", "n1", "n0", "won"])

    dealt = rows.crossJoin(F.broadcast(blocks)).repartition(n_blocks, "block")
    return dealt.groupBy("block").applyInArrow(run, "world int, rep int, sensor_id int, n1 bigint, n0 bigint, won bigint")


def worlds(units: DataFrame, readings: DataFrame, n_null: int, n_real: int, n_boot: int, select_k: int, least: int = 5) -> DataFrame:
    """(world, permuted, sensor_id, hits, n_eff, support): worlds 0 to n_null - 1 have permuted labels, the others the
    real ones; each is bootstrapped n_boot times and the select_k best sensors of a replicate get a vote."""
    return worlds_by_depth(units, readings, n_null, n_real, n_boot, (select_k,), least).drop("depth")


def worlds_by_depth(units: DataFrame, readings: DataFrame, n_null: int, n_real: int, n_boot: int, depths: tuple[int, ...], least: int = 5) -> DataFrame:
    """worlds() for several numbers of votes a replicate, under ``depth``: replicates are ranked once, to the largest."""
    if units.count() <= fits.LARGE:
        found = checkpointed(drawn_worlds(units, readings, n_null, n_real, n_boot, least))
        good = found.select("world", "rep").distinct()
        ranked = checkpointed(kernels.top(stability.scored(found, ["world", "rep"]), ["world", "rep"], F.col("score"), max(depths)))
    else:
        w, good = weights_of_worlds(units, n_null, n_real, n_boot, least)
        ranked = checkpointed(stability.replicate_rankings(readings, w, max(depths), ["world", "rep"]))
    out = None
    for k in depths:
        own = stability.support(ranked.filter(F.col("rnk") <= k), good, ["world"]).withColumn("depth", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("permuted", F.col("world") < n_null)


def maxima(supports: DataFrame) -> DataFrame:
    """(world, permuted, max_support, n_half) of each world."""
    return supports.groupBy("world", "permuted").agg(F.max("support").alias("max_support"), F.count(F.when(F.col("support") >= 0.5, 1)).alias("n_half"))


def null_records(supports: DataFrame, stability_min: float, tau: float) -> DataFrame:
    """(world, permuted, n_merit, fallback_fired, n_reported, max_stability) of each world: how many sensors are stable
    on their merit, whether none is so that a fallback had to select, and how many a threshold tau reports."""
    n = lambda at: F.count(F.when(F.col("support") >= at - 1e-12, 1))
    out = supports.groupBy("world", "permuted").agg(n(stability_min).alias("n_merit"), n(tau).alias("n_reported"), F.max("support").alias("max_stability"))
    return out.withColumn("fallback_fired", F.col("n_merit") == 0)


def ladder(supports: DataFrame, variant: str, alpha: float) -> DataFrame:
    """(variant, tau, control, real, separation) of supports(variant, world, permuted, sensor_id, support): the share of
    null worlds that a variant's own 1 - alpha threshold leaves silent, that of real worlds it doesn't, and their sum
    less one."""
    m = supports.groupBy(variant, "world", "permuted").agg(F.max("support").alias("max_support"))
    own = m.filter("permuted").groupBy(variant).agg(F.percentile("max_support", 1 - alpha).alias("tau"))
    silent = (F.col("max_support") < F.col("tau") - 1e-12).cast("double")
    out = m.join(F.broadcast(own), variant).groupBy(variant, "tau").agg(F.avg(F.when(F.col("permuted"), silent)).alias("control"), F.avg(F.when(~F.col("permuted"), 1 - silent)).alias("real"))
    return out.withColumn("separation", F.col("control") + F.col("real") - 1)


def best_variants(rungs: DataFrame, variant: str) -> DataFrame:
    """(separating, controlled): the variant that separates best and the one that controls best, ties by name."""
    first = lambda c: F.min_by(variant, F.struct(-F.round(c, 12), F.col(variant)))
    return rungs.agg(first("separation").alias("separating"), first("control").alias("controlled"))


def taus(maxima_: DataFrame, alphas=ALPHAS) -> DataFrame:
    """(alpha, tau): the 1 - alpha quantile of the null worlds' maxima."""
    null = maxima_.filter("permuted")
    q = null.agg(*[F.percentile("max_support", 1 - a).alias(f"t{i}") for i, a in enumerate(alphas)])
    return q.select(F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"t{i}").alias("tau")) for i, a in enumerate(alphas)])).alias("x")).select("x.*")


def over(supports: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(alpha, tau, world, permuted, n_over): how many sensors of each world reach each threshold, 0 included."""
    j = supports.crossJoin(F.broadcast(thresholds))
    return j.groupBy("alpha", "tau", "world", "permuted").agg(F.count(F.when(F.col("support") >= F.col("tau") - 1e-12, 1)).alias("n_over"))


def split_half(supports: DataFrame, n_splits: int, alphas=ALPHAS) -> DataFrame:
    """(alpha, tau_mean, tau_sd, tau_min, tau_max, null_abstention, null_reported, real_abstention, real_reported):
    thresholds from half of the null worlds, rates from the other half and the real worlds, both ways, averaged."""
    m = checkpointed(maxima(supports))
    part = halves(m.filter("permuted"), "world", n_splits)
    cal = part.filter("role = 'calibrate'").join(m, "world").groupBy("split", "direction").agg(*[F.percentile("max_support", 1 - a).alias(f"t{i}") for i, a in enumerate(alphas)])
    cal = cal.select("split", "direction", F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"t{i}").alias("tau")) for i, a in enumerate(alphas)])).alias("x")).select("split", "direction", "x.*")
    counts = supports.groupBy("world", "permuted").agg(F.collect_list("support").alias("all"))  # at most p numbers a world
    kept = lambda t: F.size(F.filter("all", lambda s: s >= F.col(t) - 1e-12))
    null = part.filter("role = 'test'").select("split", "direction", "world").join(counts.filter("permuted"), "world").join(cal, ["split", "direction"])
    null = null.groupBy("alpha", "split", "direction", "tau").agg(F.avg((kept("tau") == 0).cast("double")).alias("na"), F.avg(kept("tau").cast("double")).alias("nr"))
    real = counts.filter("not permuted").crossJoin(F.broadcast(cal)).groupBy("alpha", "split", "direction").agg(F.avg((kept("tau") == 0).cast("double")).alias("ra"), F.avg(kept("tau").cast("double")).alias("rr"))
    j = null.join(real, ["alpha", "split", "direction"])
    return j.groupBy("alpha").agg(F.avg("tau").alias("tau_mean"), F.stddev_samp("tau").alias("tau_sd"), F.min("tau").alias("tau_min"), F.max("tau").alias("tau_max"), F.avg("na").alias("null_abstention"), F.avg("nr").alias("null_reported"), F.avg("ra").alias("real_abstention"), F.avg("rr").alias("real_reported"))


def attainable(maxima_: DataFrame, n_boot: int) -> DataFrame:
    """(control): the shares of silent null worlds that a threshold k / n_boot can give."""
    grid = F.explode(F.sequence(F.lit(1), F.lit(n_boot)))
    g = maxima_.filter("permuted").withColumn("k", grid).groupBy("k").agg((F.lit(1.0) - F.avg((F.col("max_support") * n_boot >= F.col("k") - 1e-9).cast("double"))).alias("control"))
    return g.select("control").distinct()


def oracle_control(maxima_: DataFrame, n_boot: int, target: float) -> DataFrame:
    """(oracle, grid_gap): the attainable control nearest to target (the larger of two as near)."""
    best = attainable(maxima_, n_boot).withColumn("d", F.round(F.abs(F.col("control") - target), 12))
    return best.agg(F.min_by("control", F.struct("d", -F.col("control"))).alias("oracle")).withColumn("grid_gap", F.lit(target) - F.col("oracle"))


def calibration_curve(maxima_: DataFrame, n_boot: int, sizes: list[int], n_reps: int, alpha: float) -> DataFrame:
    """(m, control_mean, control_sd, n_heldout, loss): thresholds from m null worlds, controls on the others."""
    null = maxima_.filter("permuted").select("world", "max_support")
    out = None
    for m in sizes:
        r = shuffled(resampling.reps(null, n_reps), ["rep"], digest("curve", F.lit(m), F.col("rep"), F.col("world")), "world")
        cal = r.filter(F.col("row") <= m).groupBy("rep").agg(F.percentile("max_support", 1 - alpha).alias("tau"))
        ev = r.filter(F.col("row") > m).join(F.broadcast(cal), "rep").groupBy("rep").agg(F.avg((F.col("max_support") < F.col("tau") - 1e-12).cast("double")).alias("c"), F.count("*").alias("n"))
        row = ev.agg(F.lit(m).alias("m"), F.avg("c").alias("control_mean"), F.stddev_samp("c").alias("control_sd"), F.max("n").alias("n_heldout"))
        out = row if out is None else out.unionByName(row)
    best = oracle_control(maxima_, n_boot, 1 - alpha).select("oracle")
    return out.crossJoin(best).withColumn("loss", F.col("oracle") - F.col("control_mean")).drop("oracle")


def saturation(maxima_: DataFrame) -> DataFrame:
    """(saturated, max_attainable) of the null worlds: maxima of 1, and the most that any threshold can silence."""
    null = maxima_.filter("permuted")
    return null.agg(F.avg((F.col("max_support") >= 1.0 - 1e-12).cast("double")).alias("saturated"), F.avg((F.col("max_support") < 1.0 - 1e-12).cast("double")).alias("max_attainable"))


def fallback_reach(supports: DataFrame, stability_min: float, thresholds: DataFrame) -> DataFrame:
    """(alpha, fired, reached, n) over the null worlds: whether no sensor had stability_min, so that the loop fell back
    on its best few, and whether some sensor reaches the threshold all the same."""
    m = maxima(supports).filter("permuted").crossJoin(F.broadcast(thresholds))
    return m.groupBy("alpha", (F.col("max_support") < stability_min).alias("fired"), (F.col("max_support") >= F.col("tau") - 1e-12).alias("reached")).agg(F.count("*").alias("n"))
