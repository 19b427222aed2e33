"""Reading tables and cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HOT_ROWS, HOT_KEYS = 20_000, 10_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; without it there is none to write to."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: later reads survive lost executors and repeat no work.

    The shuffle files behind it go once it is written, so that at most one step's shuffles take disk at a time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def joined(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with keyed(keys, n_rows, ...), a row a key that has n_rows of the ``total`` rows. Keys with over
    total / HOT_KEYS rows, of which there are at most HOT_KEYS, are broadcast: their rows are not gathered."""
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(keyed.filter(F.col("n_rows") > limit))
    cold = keyed.filter(F.col("n_rows") <= limit).hint("merge")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def drop(df: DataFrame) -> None:
    """Deletes a table made by written() once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
