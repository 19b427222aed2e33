"""Profile, cleaner, imputation and univariate selection over readings(unit_id, sensor_id, value).

What is fitted is an aggregate of training rows a key and sensor, and is joined back to all rows: keys is [] for one
fit, ["rep", "fold"] for many at once. A removed sensor is a row with a reason; cleaning is a semi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators import kernels, selection


def signatures(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Per sensor the counts and range of its values, and two sums over independent 64-bit hashes of its (unit, value)
    pairs, missing ones included.

    Sums need no order, so that no sensor is ever gathered, and unlike exclusive ors they don't cancel where a reading
    is repeated. -0.0 and 0.0 stay different.
    """
    cell = F.concat_ws(":", F.col("unit_id").cast("string"), F.coalesce(F.col("value").cast("string"), F.lit("-")))
    v = F.col("value")
    return readings.groupBy(*keys, "sensor_id").agg(
        F.count("*").alias("n"), F.count(v).alias("observed"), F.min(v).alias("low"), F.max(v).alias("high"), *[F.sum(F.xxhash64(F.lit(salt), cell).cast("decimal(38,0)")).alias(name) for salt, name in ((1, "_s1"), (2, "_s2"))],
    )


ALIKE = ["_s1", "_s2", "n", "observed", "low", "high"]


def cleaner(readings: DataFrame, keys: list[str] = (), min_observed: float = 0.0) -> DataFrame:
    """(keys, sensor_id, reason): NULL for a sensor that stays, else the first of all_missing, constant, too_sparse and
    duplicate_of_j that holds; duplicates are sought among the others only, and the lowest sensor stays."""
    keys = list(keys)
    s = signatures(readings, keys)
    early = F.when(F.col("observed") == 0, "all_missing").when(F.col("low") == F.col("high"), "constant").when(F.col("observed") / F.col("n") < min_observed, "too_sparse")
    s = s.withColumn("_early", early)
    alike = Window.partitionBy(*keys, F.col("_early").isNull(), *ALIKE)
    s = s.withColumn("_first", F.min("sensor_id").over(alike))
    reason = F.coalesce("_early", F.when(F.col("_first") < F.col("sensor_id"), F.concat(F.lit("duplicate_of_"), F.col("_first").cast("string"))))
    return s.select(*keys, "sensor_id", reason.alias("reason"))


def drop_counts(reasons: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, reason, n_sensors) with all duplicates under one reason."""
    return reasons.filter("reason is not null").groupBy(*keys, F.regexp_replace("reason", "_of_.*", "").alias("reason")).agg(F.count("*").alias("n_sensors"))


def kept_readings(readings: DataFrame, reasons: DataFrame, keys: list[str] = ()) -> DataFrame:
    """readings of the sensors that stay."""
    return readings.join(F.broadcast(reasons.filter("reason is null").select(*keys, "sensor_id")), [*keys, "sensor_id"], "left_semi")


def profile(readings: DataFrame) -> DataFrame:
    """One row: units, sensors, failures and their share, imbalance, missing shares, constant and duplicate sensors."""
    units = readings.groupBy("unit_id").agg(F.max("y").alias("y"), F.max(F.col("value").isNull().cast("int")).alias("gap"))
    u = units.agg(F.count("*").alias("n_units"), F.sum("y").cast("bigint").alias("n_fail"), F.sum("gap").cast("bigint").alias("rows_with_any_missing"))
    s = signatures(readings, []).withColumn("missing", (F.col("n") - F.col("observed")) / F.col("n"))
    groups = s.groupBy(*ALIKE).agg(F.count("*").alias("c")).agg(F.count(F.when(F.col("c") > 1, 1)).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).cast("bigint").alias("duplicate_sensors_removable"))
    n = lambda c: F.count(F.when(c, 1))
    a = s.agg(
        F.count("*").alias("n_sensors"), (F.sum(F.col("n") - F.col("observed")) / F.sum("n")).alias("missing_frac_overall"), n(F.col("missing") > 0).alias("sensors_any_missing"), n(F.col("missing") > 0.2).alias("sensors_over_20"),
        n(F.col("missing") > 0.5).alias("sensors_over_50"), n(F.col("observed") == 0).alias("sensors_all_missing"), F.max("missing").alias("max_missing_frac"), n((F.col("observed") == 0) | (F.col("low") == F.col("high"))).alias("constant_sensors"),
    )
    out = u.crossJoin(a).crossJoin(groups)
    return out.withColumn("fail_rate", F.col("n_fail") / F.col("n_units")).withColumn("imbalance_ratio", (F.col("n_units") - F.col("n_fail")) / F.greatest(F.col("n_fail"), F.lit(1)))


def time_span(units: DataFrame) -> DataFrame:
    """(first, last, monotone): whether time never falls along unit_id; days keep each window small."""
    own = Window.partitionBy("_b").orderBy("unit_id")
    t = units.withColumn("_b", F.floor(F.col("unit_id") / 65536)).withColumn("_prev", F.lag("ts").over(own))
    parts = t.groupBy("_b").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.coalesce(F.bool_and(F.col("ts") >= F.col("_prev")), F.lit(True)).alias("ok"), F.min_by("ts", "unit_id").alias("a"), F.max_by("ts", "unit_id").alias("z"))
    parts = parts.withColumn("before", F.lag("z").over(Window.orderBy("_b")))
    return parts.agg(F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"), F.bool_and(F.col("ok") & F.coalesce(F.col("a") >= F.col("before"), F.lit(True))).alias("monotone"))


def medians(readings: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, sensor_id, med): the exact median of the observed values, 0 where there is none."""
    found = selection.quantile(readings, [*keys, "sensor_id"], "value", 0.5)
    return found.select(*keys, "sensor_id", F.coalesce("value", F.lit(0.0)).alias("med"))


def impute(readings: DataFrame, fitted: DataFrame, keys: list[str] = ()) -> DataFrame:
    """readings with missing values filled from fitted medians."""
    return readings.join(F.broadcast(fitted), [*keys, "sensor_id"]).withColumn("value", F.coalesce("value", "med")).drop("med")


def standardise(readings: DataFrame, train: DataFrame, keys: list[str] = ()) -> DataFrame:
    """readings with z: less the mean, over the population deviation of imputed train rows (1 if that is 0)."""
    fit = train.groupBy(*keys, "sensor_id").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return readings.join(F.broadcast(fit), [*keys, "sensor_id"]).withColumn("z", (F.col("value") - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def missing_indicators(readings: DataFrame, train: DataFrame | None = None, min_frac: float = 0.01) -> DataFrame:
    """(unit_id, name, value): 0 or 1 for each sensor of which train rows miss at least min_frac."""
    train = readings if train is None else train
    own = train.groupBy("sensor_id").agg(F.avg(F.col("value").isNull().cast("double")).alias("frac")).filter(F.col("frac") >= min_frac)
    return readings.join(F.broadcast(own.select("sensor_id")), "sensor_id").select("unit_id", F.concat(F.lit("miss_"), F.col("sensor_id").cast("string")).alias("name"), F.col("value").isNull().cast("int").alias("value"))


def univariate(train: DataFrame, keys: list[str] = (), weight: str | None = None, imputed: bool = False) -> DataFrame:
    """(keys, sensor_id, n1, n0, auc, score): score is |AUC - 0.5| on median-imputed values, 0 for constants."""
    keys = list(keys)
    filled = train if imputed else impute(train, medians(train, keys), keys)
    return kernels.roc_auc(filled, [*keys, "sensor_id"], weight=weight).withColumn("score", F.round(F.abs(F.col("auc") - 0.5), 12))


def univariate_top(train: DataFrame, k: int, keys: list[str] = (), **how) -> DataFrame:
    """univariate with the k best sensors of each key and their rank."""
    return kernels.top(univariate(train, keys, **how), list(keys), F.col("score"), k)


def enough_positives(units: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The keys whose units have at least ``least`` positives."""
    return units.groupBy(*keys).agg(F.sum("y").alias("_n")).filter(F.col("_n") >= least).select(*keys)
