"""Correlation between sensors and the groups that it forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def moments(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, n, sums and ranges) partly added up: each task holds some units as a dense matrix and multiplies it with itself, so
    that a unit's pairs of sensors never become rows. Units that lack a sensor are counted without it."""
    own = [x for x in cells.schema.fields if x.name in keys]

    def run(batches):
        for table in batches:
            rows = table.to_pylist()
            groups: dict[tuple, list] = {}
            for r in rows:
                groups.setdefault(tuple(r[k] for k in keys), []).append(r["c"])
            for key, units in groups.items():
                sensors = np.unique([x["sensor_id"] for u in units for x in u])
                x, there = np.zeros((len(units), len(sensors))), np.zeros((len(units), len(sensors)))
                for i, u in enumerate(units):
                    at = np.searchsorted(sensors, [c["sensor_id"] for c in u])
                    x[i, at], there[i, at] = [c["value"] for c in u], 1.0
                i, j = np.triu_indices(len(sensors), 1)
                n, sx, sxz, sxx = there.T @ there, x.T @ there, x.T @ x, (x * x).T @ there
                out = {"a": sensors[i], "b": sensors[j], "n": n[i, j].astype(np.int64), "sx": sx[i, j], "sz": sx[j, i], "sxz": sxz[i, j], "sxx": sxx[i, j], "szz": sxx[j, i]}
                low, high = (np.where(there > 0, x, s * np.inf) for s in (1, -1))
                out |= {"lx": low.min(0)[i], "hx": high.max(0)[i], "lz": low.min(0)[j], "hz": high.max(0)[j]}
                yield pa.RecordBatch.from_pydict({**{k: [v] * len(i) for k, v in zip(keys, key, strict=True)}, **out}, schema)

    kinds = [("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), *[(c, pa.float64()) for c in ("sx", "sz", "sxz", "sxx", "szz", "lx", "hx", "lz", "hz")]]
    schema = pa.schema([*((x.name, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[x.dataType.simpleString()]) for x in own), *kinds])
    spark_schema = ", ".join([f"{x.name} {x.dataType.simpleString()}" for x in own] + ["a int, b int, n bigint"] + [f"{c} double" for c in ("sx", "sz", "sxz", "sxx", "szz", "lx", "hx", "lz", "hz")])
    return cells.select(*keys, "c").mapInArrow(run, spark_schema)


def pearson(readings: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, a, b, r) of each pair a < b of sensors over imputed values; 0 where a sensor is constant.

    Values are taken less their sensor's mean, as sums of squares of large values lose their digits.
    """
    keys = list(keys)
    mean = readings.groupBy(*keys, "sensor_id").agg(F.avg("value").alias("_m"), (F.min("value") == F.max("value")).alias("_c"))
    centred = readings.join(mean, [*keys, "sensor_id"]).withColumn("value", F.when(F.col("_c"), 0.0).otherwise(F.col("value") - F.col("_m")))
    cells = centred.groupBy(*keys, "unit_id").agg(F.collect_list(F.struct(F.col("sensor_id").cast("int").alias("sensor_id"), "value")).alias("c"))
    sums = ("n", "sx", "sz", "sxz", "sxx", "szz")
    m = moments(cells, keys).groupBy(*keys, "a", "b").agg(*[F.sum(c).alias(c) for c in sums], (F.min("lx") == F.max("hx")).alias("cx"), (F.min("lz") == F.max("hz")).alias("cz"))
    cov = F.col("n") * F.col("sxz") - F.col("sx") * F.col("sz")
    var = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("szz") - F.col("sz") * F.col("sz"))
    r = F.when(F.col("cx") | F.col("cz"), 0.0).otherwise(F.coalesce(F.try_divide(cov, F.sqrt(F.greatest(var, F.lit(0.0)))), F.lit(0.0)))
    return m.filter("n > 0").select(*keys, "a", "b", r.alias("r"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame, node: str = "sensor_id") -> DataFrame:
    """(node, cluster_id): the least node that edges(a, b) connect each node with, itself included.

    Labels take the least label among neighbours and then that label's own label, until none changes.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = checkpointed(nodes.select(F.col(node).alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        best = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        step = now.join(best, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("other", "label")).alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = checkpointed(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        if not after.filter("label <> old").head(1):
            return after.select(F.col("node").alias(node), F.col("label").alias("cluster_id"))
        now = after.drop("old")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w): of edges(a, b, w) a forest of greatest weight, by Boruvka's rounds: each component takes the heaviest edge
    that leaves it, ties by name, and components that meet are one from then on. Cut at any weight, its components are
    those of all edges of that weight or more. Rounds are as many as the logarithm of the nodes; edges inside components go.
    """
    left = checkpointed(edges.filter("a <> b").select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("z")))
    forest = left.select("a", "b", "w").limit(0)
    while left.head(1):
        order = F.struct("w", (-F.col("a")).alias("i"), (-F.col("b")).alias("j"), F.least("x", "z").alias("x"), F.greatest("x", "z").alias("z"))
        both = left.select(F.col("x").alias("part"), order.alias("e")).unionByName(left.select(F.col("z").alias("part"), order.alias("e")))
        taken = checkpointed(both.groupBy("part").agg(F.max("e").alias("e")).select((-F.col("e.i")).alias("a"), (-F.col("e.j")).alias("b"), "e.w", "e.x", "e.z").distinct())
        forest = checkpointed(forest.unionByName(taken.select("a", "b", "w")))
        parts = taken.select(F.col("x").alias("node")).unionByName(taken.select(F.col("z").alias("node")))
        names = components(parts, taken.select(F.col("x").alias("a"), F.col("z").alias("b")), "node")
        own = left.join(names.select(F.col("node").alias("x"), F.col("cluster_id").alias("nx")), "x").join(names.select(F.col("node").alias("z"), F.col("cluster_id").alias("nz")), "z")
        left = checkpointed(own.filter("nx <> nz").select("a", "b", "w", F.col("nx").alias("x"), F.col("nz").alias("z")))
    return forest


def cut_forest(nodes: DataFrame, forest: DataFrame, thresholds: list[float], node: str = "sensor_id") -> DataFrame:
    """(threshold, node, cluster_id): the groups that edges of each threshold or more connect, for all thresholds at once."""
    wide = 1 << 32
    levels = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(thresholds)])
    name = lambda c: (F.col("l.i").cast("long") * wide + F.col(c)).alias(c)
    every = nodes.select(F.col(node).alias("node")).distinct().withColumn("l", F.explode(levels)).select(name("node"))
    kept = forest.withColumn("l", F.explode(levels)).filter(F.col("w") >= F.col("l.t")).select(name("a"), name("b"))
    found = components(every, kept, "node")
    threshold = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), (F.floor(F.col("node") / wide) + 1).cast("int"))
    part = lambda c, to: (F.col(c) % wide).cast("int").alias(to)
    return found.select(threshold.alias("threshold"), part("node", node), part("cluster_id", "cluster_id"))


def clusters_at(readings: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, sensor_id, cluster_id): correlation_clusters() at each threshold, from one search."""
    edges = pearson(readings).select("a", "b", F.round(F.abs("r"), 9).alias("w")).filter(F.col("w") >= min(thresholds))
    return cut_forest(readings.select("sensor_id"), spanning_forest(edges), thresholds)


def correlation_clusters(readings: DataFrame, threshold: float) -> DataFrame:
    """(sensor_id, cluster_id): connected by |r| >= threshold, each group named after its first sensor."""
    edges = pearson(readings).filter(F.round(F.abs("r"), 9) >= threshold)
    return components(readings.select("sensor_id"), edges)


def cluster_map(all_sensors: DataFrame, clusters: DataFrame) -> DataFrame:
    """clusters over all sensors: those that cleaning removed are groups of their own."""
    return all_sensors.select("sensor_id").distinct().join(clusters, "sensor_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "sensor_id"))


def representatives(clusters: DataFrame, scores: DataFrame, score: str = "score") -> DataFrame:
    """(cluster_id, sensor_id, score, n_members): of each group the sensor with the highest score, ties by sensor."""
    own = Window.partitionBy("cluster_id")
    j = clusters.join(scores.select("sensor_id", F.col(score).alias("score")), "sensor_id")
    j = j.withColumn("_r", F.row_number().over(own.orderBy(F.desc("score"), "sensor_id"))).withColumn("n_members", F.count("*").over(own))
    return j.filter("_r = 1").select("cluster_id", "sensor_id", "score", "n_members")


def greedy_stars(pairs: DataFrame, order: list[int], threshold: float = 0.7) -> list[list[int]]:
    """Groups in order of ``order``: each sensor not yet taken takes all later untaken ones with |r| >= threshold.

    Not transitive, and hung on the order, so that it runs over a collected table of the few sensors in ``order``.
    """
    some = F.col("a").isin(order) & F.col("b").isin(order)
    near = {(r["a"], r["b"]) for r in pairs.filter(some & (F.abs("r") >= threshold)).select("a", "b").collect()}
    out, taken = [], set()
    for i, seed in enumerate(order):
        if seed not in taken:
            group = [seed, *(x for x in order[i + 1 :] if x not in taken and (min(x, seed), max(x, seed)) in near)]
            taken |= set(group)
            out.append(group)
    return out
