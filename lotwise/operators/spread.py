"""Bins of fits of more rows than a group may hold as values: coded() makes them a byte a sensor, at cuts that the cluster
finds. Trees are grown from them in groups, or by cluster.py.

fitted() and swapped() are fits by pyspark.ml, to compare with; no query uses them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators import selection, trees
from lotwise.operators.graph import checkpointed
from lotwise.operators.running import numbered

DEPTH, TREE_DEPTH, BINS = 30, 5, 255


def borders(train: DataFrame, sensors: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """(trees.borders() of each sensor, trees.medians()) of train(times, cells), found by counting over the cluster: the very
    cuts that a group finds, whatever the number of rows."""
    rows = checkpointed(train.select("times", F.explode("cells").alias("c")).select("times", "c.sensor_id", "c.value"))
    shares = [float(q) for q in np.linspace(0, 1, BINS)]
    place = lambda n: F.array(*[F.rint((n - 1) * F.lit(q)).cast("bigint") for q in shares])
    seen: dict[int, list[float]] = {}
    for r in selection.at_rows(rows, ["sensor_id"], "value", place, "times").filter("value is not null").collect():  # some hundred a sensor
        seen.setdefault(r["sensor_id"], []).append(r["value"])
    fill = {r["sensor_id"]: r["value"] for r in selection.quantiles(rows, ["sensor_id"], "value", 0.5, "times").collect()}
    few = [r["sensor_id"] for r in rows.groupBy("sensor_id").agg(F.approx_count_distinct("value").alias("n")).collect() if r["n"] <= 2 * BINS]
    every: dict[int, list[float]] = {}
    for r in rows.filter(F.col("sensor_id").isin(few)).select("sensor_id", "value").distinct().collect() if few else ():  # some hundred a sensor
        every.setdefault(r["sensor_id"], []).append(r["value"])
    cuts = []
    for s in sensors:
        own = np.unique(every[s] if 0 < len(every.get(s, ())) <= BINS else seen.get(s, []))
        cuts.append((own[1:] + own[:-1]) / 2)
    return cuts, np.array([fill.get(s) or 0.0 for s in sensors])


def coded(wide_rows: DataFrame, train: DataFrame, sensors: tuple[int, ...], scattered, missing: bool = False) -> DataFrame:
    """(unit_id, cells): a byte a sensor, its bin by the cuts of the rows of train(unit_id, times). missing: what is missing
    has a bin of its own, and not that of the median."""
    known = wide_rows.sparkSession.sparkContext.broadcast((sensors, *borders(train.join(wide_rows, "unit_id").select("times", "cells"), sensors)))

    def run(batches):
        sensors, cuts, fill = known.value
        for batch in batches:
            codes = trees.binned(scattered(batch.column(1), sensors), cuts, None if missing else fill)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in codes], pa.binary())], ["unit_id", "cells"])

    kind = wide_rows.schema["unit_id"].dataType.simpleString()
    return wide_rows.select("unit_id", "cells").mapInArrow(run, f"unit_id {kind}, cells binary")


def estimator(spec):
    common = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight", "maxBins": BINS, "seed": getattr(spec, "seed", 0)}
    if isinstance(spec, trees.Forest):
        return RandomForestClassifier(numTrees=spec.trees, minInstancesPerNode=spec.leaf, maxDepth=DEPTH, featureSubsetStrategy="sqrt", **common)
    # Trees of this library end at a number of leaves, those of pyspark.ml at a depth.
    return GBTClassifier(maxIter=spec.rounds, stepSize=spec.rate, minInstancesPerNode=spec.least, maxDepth=TREE_DEPTH, **common)


def fitted(wide_rows: DataFrame, members: DataFrame, plan):
    """(model, rows of the fit that it doesn't learn from), with medians of training rows filled in."""
    own = members.filter(F.col("data") == plan.data).join(wide_rows, "unit_id")
    train = own.filter("train")
    fill = train.select("times", F.explode("cells").alias("c")).groupBy("c.sensor_id").agg(F.percentile_approx("c.value", 0.5, 10_000).alias("fill"))
    known = {r["sensor_id"]: r["fill"] for r in fill.collect()}
    values = F.map_from_entries("cells")
    vector = array_to_vector(F.array(*[F.coalesce(values[s], F.lit(float(known.get(s, 0.0)))) for s in plan.sensors]))
    n, n1 = train.agg(F.sum("times"), F.sum(F.col("times") * F.col("y"))).first()
    weight = F.col("times") * F.when(F.col("y") == 1, n / (2.0 * max(n1, 1))).otherwise(n / (2.0 * max(n - n1, 1)))
    ready = own.select("unit_id", F.col("y").cast("int").alias("y"), F.col("times").cast("int").alias("times"), "train", vector.alias("features"), weight.alias("weight"))
    return estimator(plan.spec).fit(ready.filter("train")), ready.filter("not train")


def steps(sensor: int, rep: int, n: int) -> tuple[int, int]:
    """(a, b) of the order a * row + b modulo n in which rows give their values; a has no divisor in common with n."""
    rng = np.random.default_rng([sensor, rep, n])
    a = int(rng.integers(1, max(n, 2)))
    while math.gcd(a, n) > 1:
        a = a % n + 1
    return a, int(rng.integers(0, max(n, 1)))


def swapped(rest: DataFrame, sensors: tuple[int, ...], swaps: int) -> DataFrame:
    """(swap, rep, unit_id, y, times, features): rest once for each sensor and repetition, the sensor's values dealt anew.

    Rows are numbered in order of a hash; each takes the sensor's value of the row that a permutation of the numbers,
    drawn for sensor and repetition, names. That is a join by number, whatever the number of rows.
    """
    h = F.xxhash64("unit_id", "y", "times")
    rows = rest.select("unit_id", "y", "times", vector_to_array("features").alias("x"), h.alias("h"))
    rows = checkpointed(numbered(rows, [], [F.shiftright("h", 56), F.shiftright("h", 48)], ["h", "unit_id"]))
    n = rows.count()
    drawn = [(j, s, rep, *steps(s, rep, n)) for j, s in enumerate(sensors) for rep in range(swaps)]
    drawn = rest.sparkSession.createDataFrame(drawn, "j int, swap int, rep int, a bigint, b bigint")
    # numbers are below 2^31 times 2^31
    taken = rows.crossJoin(F.broadcast(drawn)).select("j", "swap", "rep", "unit_id", "y", "times", "x", ((F.col("a") * (F.col("row") - 1) + F.col("b")) % n).alias("at"))
    given = rows.select((F.col("row") - 1).alias("at"), F.posexplode("x").alias("j", "v"))
    other = taken.join(given, ["at", "j"])
    x = F.transform("x", lambda v, i: F.when(i == F.col("j"), F.col("v")).otherwise(v))
    return other.select("swap", "rep", "unit_id", "y", "times", array_to_vector(x).alias("features"))


def scores(wide_rows: DataFrame, members: DataFrame, fit: int, plan, swaps: int = 0) -> DataFrame:
    """Rows of fits.scores() of one fit, with those of swapped values."""
    model, rest = fitted(wide_rows, members, plan)
    rows = rest.select(F.lit(-1).alias("swap"), F.lit(0).alias("rep"), "unit_id", "y", "times", "features")
    if swaps:
        rows = rows.unionByName(swapped(rest, plan.sensors, swaps))
    return model.transform(rows).select(F.lit(fit).alias("fit"), "swap", "rep", "unit_id", "y", "times", vector_to_array("probability")[1].alias("s"))


def importances(wide_rows: DataFrame, members: DataFrame, fit: int, plan) -> DataFrame:
    model, _ = fitted(wide_rows, members, plan)
    raw = model.featureImportances.toArray()
    return wide_rows.sparkSession.createDataFrame([(fit, int(s), float(v)) for s, v in zip(plan.sensors, raw, strict=True)], "fit int, sensor_id int, importance double")
