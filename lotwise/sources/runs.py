"""Run tables: results of experiments as JSON or Parquet, one partition a ranker, tolerant of what isn't there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def save_json(df: DataFrame, path: str) -> None:
    """One pretty small document a run; only for results that are small by design."""
    df.coalesce(1).write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The run at path, or an empty frame if there is none."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def save_part(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions of ``by`` that df has and keeps the others, so that a stopped run can go on."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def missing_parts(spark: SparkSession, path: str, by: str, wanted: list[str]) -> list[str]:
    """Those of ``wanted`` that the run table doesn't have yet."""
    if not exists(spark, path):
        return list(wanted)
    have = {r[0] for r in spark.read.parquet(path).select(by).distinct().collect()}
    return [w for w in wanted if w not in have]


def known_runs(spark: SparkSession, folder: str) -> DataFrame | None:
    """The records of a table that sweeps add to; None if it isn't there yet."""
    return spark.read.parquet(folder) if exists(spark, folder) else None


def save_run(df: DataFrame, document: Column, folder: str, source: str) -> None:
    """df, one row, as the run ``source``: a JSON document of any schema."""
    df.select(F.to_json(document).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/{source}.json")


def load_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(source, document) of every run in folder: the name of a file, or of a folder of parts, that ends in .json, and its
    content as a VARIANT, so that runs need no common schema; NULL for what isn't JSON. No rows if there is no folder."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "source string, document variant")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.json(?:/[^/]+)?$", 1)
    return files.select(name.alias("source"), F.try_parse_json("value").alias("document")).filter("source <> ''")
