"""Canonical frames: units(unit_id, y, ts) and readings(unit_id, sensor_id, value), from tables and from raw files.

A missing reading is NULL, never NaN. A unit's label is 1 for a failure, 0 for anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known(value: Column) -> Column:
    """value as a double, with NaN as NULL."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def embedding_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit a vector; it fails if its label is 3."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), (F.col("label") == 3).cast("int").alias("y"))


def embedding_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 dense sensors with the unit's label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("unit_id"), (F.col("label") == 3).cast("int").alias("y"), F.posexplode("embedding").alias("sensor_id", "v")).select("unit_id", "y", "sensor_id", known(F.col("v")).alias("value"))


def faulty_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embedding_readings and four sensors for the cleaner: 64 constant, 65 like 0, 66 all missing, 67 mostly missing."""
    e = table(spark, sf_dir, "embeddings")
    extra = F.array(F.lit(7.0), F.col("embedding")[0].cast("double"), F.lit(None).cast("double"), F.when(F.col("vec_id") % 20 == 0, F.col("embedding")[1].cast("double")))
    values = F.concat(F.transform("embedding", lambda x: x.cast("double")), extra)
    return e.select(F.col("vec_id").alias("unit_id"), (F.col("label") == 3).cast("int").alias("y"), F.posexplode(values).alias("sensor_id", "v")).select("unit_id", "y", "sensor_id", known(F.col("v")).alias("value"))


def day_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit a user and day, a sensor an event type, numbered by name: its mean value, NULL where there was none. Fails
    with an error."""
    e = table(spark, sf_dir, "events").withColumn("unit_id", F.col("user_id") * 100000 + F.unix_date(F.to_date("ts")))
    kinds = sorted(k for (k,) in e.select("event_type").distinct().collect() if k is not None)  # a row a kind
    means = [F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(f"s{i}") for i, k in enumerate(kinds)]
    wide = e.groupBy("unit_id").agg(F.max((F.col("event_type") == "error").cast("int")).alias("y"), *means)
    return wide.select("unit_id", "y", F.posexplode(F.array(*[f"s{i}" for i in range(len(kinds))])).alias("sensor_id", "v")).select("unit_id", "y", "sensor_id", known(F.col("v")).alias("value"))


def event_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit an event, in time; it fails if it is an error."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("unit_id"), (F.col("event_type") == "error").cast("int").alias("y"), "ts")


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors of an event: 0 value, 1 the number in props, 2 hour of day, 3 user_id modulo 97."""
    e = table(spark, sf_dir, "events")
    sensors = F.array(F.col("value"), F.get_json_object("props", "$.k").cast("double"), F.hour("ts").cast("double"), (F.col("user_id") % 97).cast("double"))
    return e.select(F.col("event_id").alias("unit_id"), (F.col("event_type") == "error").cast("int").alias("y"), "ts", F.posexplode(sensors).alias("sensor_id", "v")).select("unit_id", "y", "ts", "sensor_id", known(F.col("v")).alias("value"))


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with quantised sensors: 0 quantity, 1 discount, 2 tax, 3 price. A unit fails if it was returned."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_timestamp("l_shipdate"))
    sensors = F.array("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return li.select(key.alias("unit_id"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.posexplode(sensors).alias("sensor_id", "v")).select("unit_id", "y", "sensor_id", known(F.col("v")).alias("value"))


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; a unit fails if its quality is 0."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit_id"), (F.col("quality") == 0).cast("int").alias("y"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, line) of the non-blank lines of a text file, numbered from 0 in file order."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0).rdd.zipWithIndex()
    return spark.createDataFrame(lines.map(lambda x: (x[1], x[0][0])), "row bigint, line string")


def load_readings(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id, sensor_id, value) of a file with white space between values, a line a unit; NaN is missing."""
    cells = numbered_lines(spark, path).select(F.col("row").alias("unit_id"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("sensor_id", "v"))
    return cells.select("unit_id", "sensor_id", known(F.expr("try_cast(v AS DOUBLE)")).alias("value"))


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id, y, ts) of a file with a label and a quoted time dd/MM/yyyy HH:mm:ss a line; 1 is a failure."""
    line = numbered_lines(spark, path)
    parts = F.regexp_extract("line", r'^\s*(\S+)\s+"?([^"]+?)"?\s*$', 1), F.regexp_extract("line", r'^\s*(\S+)\s+"?([^"]+?)"?\s*$', 2)
    return line.select(F.col("row").alias("unit_id"), F.when(F.expr("try_cast(regexp_extract(line, '^\\\\s*(\\\\S+)', 1) AS INT) = 1"), 1).otherwise(0).alias("y"), F.to_timestamp(parts[1], "dd/MM/yyyy HH:mm:ss").alias("ts"))


def load_both(spark: SparkSession, readings: str, labels: str) -> DataFrame:
    """readings with their unit's label and time, matched by line."""
    return load_readings(spark, readings).join(load_labels(spark, labels), "unit_id")


def sensor_name(sensor_id: Column) -> Column:
    return F.format_string("sensor_%03d", sensor_id)
