"""Planted root causes: correlated sensors, a logistic label of a few of them, cells missing at random. All by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.hashing import digest, normal, unit_interval
from lotwise.operators import selection

BLOCK, SHARED, SLOPE = 20, 0.6, 1.5


def causes(p: int, n_causal: int) -> list[int]:
    """Planted sensors: evenly spread, so that they lie in different blocks where there are enough."""
    return sorted({i * p // n_causal for i in range(n_causal)})


def synthetic(spark: SparkSession, n: int = 1500, p: int = 200, n_causal: int = 5, fail_rate: float = 0.07, missing_rate: float = 0.04, seed: int = 0, units: DataFrame | None = None) -> DataFrame:
    """readings(unit_id, y, sensor_id, value): blocks of 20 sensors share a part, causes alternate in sign, and about
    fail_rate of the units fail, those with a high logit mostly. The units are those of units(unit_id), or n numbered ones."""
    s, who = str(seed), causes(p, n_causal)
    units = spark.range(n).withColumnRenamed("id", "unit_id") if units is None else units.select("unit_id")
    shared = F.transform(F.sequence(F.lit(0), F.lit((p - 1) // BLOCK)), lambda b: normal(digest("shared", F.lit(s), b, F.col("unit_id"))) * SHARED)
    cells = units.withColumn("_shared", shared).withColumn("sensor_id", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    cells = cells.withColumn("value", normal(digest("own", F.lit(s), F.col("sensor_id"), F.col("unit_id"))) + F.element_at("_shared", F.floor(F.col("sensor_id") / BLOCK).cast("int") + 1)).drop("_shared")
    sign = F.when(F.col("sensor_id").isin(who[1::2]), -1.0).otherwise(1.0)
    logit = cells.filter(F.col("sensor_id").isin(who)).groupBy("unit_id").agg(F.sum(sign * F.col("value")).alias("logit"))
    cut = selection.quantile(logit, [], "logit", 1 - fail_rate).withColumnRenamed("value", "cut")
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(SLOPE) * (F.col("logit") - F.col("cut"))))
    label = logit.crossJoin(F.broadcast(cut)).select("unit_id", (unit_interval(digest("label", F.lit(s), F.col("unit_id"))) < chance).cast("int").alias("y"))
    gone = unit_interval(digest("gone", F.lit(s), F.col("sensor_id"), F.col("unit_id"))) < missing_rate
    return cells.join(label, "unit_id").select("unit_id", "y", F.col("sensor_id").cast("int"), F.when(~gone, F.col("value")).alias("value"))
