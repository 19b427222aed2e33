"""Numbers and running sums in levels, so that no window holds all rows of a key.

Buckets that never fall along the order split each key, finer ones inside coarser ones; totals of the finer give offsets
inside the coarser, and windows over rows run inside the finest. The results are those of one window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_bucket(value: Column, per_octave: int = 1 << 16) -> Column:
    """A bucket of a number that needs no knowledge of its distribution: its sign and its logarithm, in steps of a part
    of an octave, so that small shares, prices and far apart numbers all spread over many buckets; a year of times in
    seconds over more than a thousand."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(1100.0)) * per_octave).cast("int") + 1100 * per_octave
    return F.when(value > 0, size).when(value < 0, -size).when(value == 0, 0).otherwise(1 << 30)


def value_buckets(value: Column) -> list[Column]:
    """value_bucket by steps of a 64th of an octave, and inside them by 1024ths of these."""
    fine = value_bucket(value)
    return [F.shiftright(fine, 10), fine]


def running(df: DataFrame, keys: list[str], buckets: list[Column], order: list, sums: dict[str, Column]) -> DataFrame:
    """df with each of ``sums`` added up along the order, the row itself included; buckets from coarse to fine."""
    names = [f"_bucket{i}" for i in range(len(buckets))]
    for name, x in [*zip(names, buckets, strict=True), *((f"_{n}", x) for n, x in sums.items())]:
        df = df.withColumn(name, x)
    totals = [df.groupBy(*keys, *names).agg(*[F.sum(f"_{n}").alias(f"_all_{n}") for n in sums])]
    for i in range(len(names) - 1, 0, -1):
        totals.append(totals[-1].groupBy(*keys, *names[:i]).agg(*[F.sum(f"_all_{n}").alias(f"_all_{n}") for n in sums]))
    offsets = None
    for i, total in enumerate(reversed(totals)):
        before = Window.partitionBy(*keys, *names[:i]).orderBy(names[i]).rowsBetween(Window.unboundedPreceding, -1)
        own = total.select(*keys, *names[: i + 1], *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_own_{n}") for n in sums])
        if offsets is not None:
            own = own.join(offsets, [*keys, *names[:i]])
        off = [(F.col(f"_own_{n}") + (F.col(f"_off_{n}") if offsets is not None else 0)).alias(f"_off_{n}") for n in sums]
        offsets = own.select(*keys, *names[: i + 1], *off)
    inside = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(offsets, [*keys, *names])
    for n in sums:
        out = out.withColumn(n, F.col(f"_off_{n}") + F.sum(f"_{n}").over(inside))
    return out.drop(*names, *[f"_{n}" for n in sums], *[f"_off_{n}" for n in sums])


def numbered(df: DataFrame, keys: list[str], bucket: Column | list[Column], order: list, name: str = "row") -> DataFrame:
    """df with the number of each row of its key along the order, from 1."""
    buckets = bucket if isinstance(bucket, list) else [bucket]
    return running(df, keys, buckets, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("bigint"))


def shuffled(df: DataFrame, keys: list[str], h: Column, unit: str = "unit_id", name: str = "row") -> DataFrame:
    """Rows of each key numbered from 1 in order of a digest (ties by unit): a portable random permutation."""
    df = df.withColumn("_h", h)
    return numbered(df, keys, F.substring("_h", 1, 2), ["_h", unit], name).drop("_h")


def tiles(df: DataFrame, k: int, bucket: Column, order: list, name: str = "block") -> DataFrame:
    """ntile(k) from 1 along the order: the first blocks get one row more where k doesn't divide the rows."""
    n = df.agg(F.count("*").alias("_n"))
    out = numbered(df, [], bucket, order, "_row").crossJoin(F.broadcast(n))
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    big = more * (size + 1)
    tile = F.when(F.col("_row") <= big, F.floor((F.col("_row") - 1) / (size + 1)) + 1).otherwise(F.floor((F.col("_row") - 1 - big) / F.greatest(size, F.lit(1))) + more + 1)
    return out.withColumn(name, tile.cast("int")).drop("_row", "_n")
