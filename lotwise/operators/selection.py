"""Exact quantiles and borders of equal parts, by counting: no key's values are sorted, gathered or held in a buffer.

A double becomes a 64-bit whole number in the same order. A pass counts each group's rows by the next 16 bits and keeps,
for every wanted row number, the prefix in which that row lies and its number inside; the next pass reads rows with such
a prefix only. Where the largest prefix left has few rows, the last pass counts its values themselves: most data need two
passes, any data at most four. What moves is counts, at most 2^16 a group and prefix.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.graph import checkpointed

#: Bits below those that the first pass counts by; counts a window holds; rows of a frame that is sent to all tasks.
TOP, FEW, SMALL = 48, 1 << 16, 100_000
#: Values of one group that percentile's buffer may hold.
HELD = 1 << 18


def with_order_key(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with a double's place among all doubles, a bigint: the bits of its size, negative below 0. Both zeros are 0; NULL
    for NULL. Steps are columns of their own, so that none is worked out more than once."""
    v, size, held = F.col(value), F.abs(value), F.greatest(F.least(F.abs(value), F.lit(sys.float_info.max)), F.lit(sys.float_info.min))
    df = df.withColumn("_exp", F.floor(F.log2(held)).cast("int"))  # may be one off beside powers of 2
    half = F.shiftright("_exp", 1)
    df = df.withColumn("_part", held * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - F.col("_exp")))
    part = F.when(F.col("_part") >= 2, F.col("_part") / 2).when(F.col("_part") < 1, F.col("_part") * 2 - 2).otherwise(F.col("_part") - 1)
    normal = F.shiftleft((F.col("_exp") + 1023).cast("bigint"), 52) + (part * F.lit(2.0**52)).cast("bigint")
    tiny = (F.least(size, F.lit(sys.float_info.min)) * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    df = df.withColumn("_bits", F.when(size > sys.float_info.max, F.lit(2047 << 52)).when(size < sys.float_info.min, tiny).otherwise(normal))
    return df.withColumn(name, F.when(v < 0, -F.col("_bits")).otherwise(F.col("_bits"))).drop("_exp", "_part", "_bits")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, to be sent to all tasks where it has few rows, as counted."""
    return F.broadcast(df) if rows <= SMALL else df


def at_rows(df: DataFrame, keys: list[str], value: str, wanted, weight: str | None = None) -> DataFrame:
    """(keys, n, at, value) of the rows wanted(n), an array of row numbers from 0 along value, of each group's n rows;
    one row with NULL for a group without values. A weight is a multiplicity, NULL and NaN are left out."""
    v = F.col(value).cast("double")
    there = v.isNotNull() & ~F.isnan(v)
    times = F.col(weight) if weight else F.lit(1)
    rows = df.select(*keys, F.when(there, v + F.lit(0.0)).alias("_v"), F.when(there, times).otherwise(0).cast("bigint").alias("_w"))
    rows = with_order_key(rows, "_v", "_k")
    shift = TOP
    counts = rows.groupBy(*keys, F.shiftright("_k", shift).alias("_p")).agg(F.sum("_w").alias("_c"))
    group = Window.partitionBy(*keys)
    first = counts.withColumn("n", F.sum("_c").over(group)).withColumn("_upto", F.sum("_c").over(group.orderBy("_p")))
    mine = F.filter(F.array_distinct(wanted(F.col("n"))), lambda i: (i < F.col("_upto")) & (i >= F.col("_upto") - F.col("_c")))
    state = first.withColumn("at", F.explode_outer(F.when(F.col("n") > 0, mine))).filter("n = 0 or at is not null")
    state = checkpointed(state.select(*keys, "n", "at", (F.col("at") - F.col("_upto") + F.col("_c")).alias("_in"), "_p", F.col("_c").alias("_size")))
    while True:
        most, n = state.agg(F.max("_size"), F.count("*")).first()
        above, shift = shift, 0 if (most or 0) <= FEW else shift - 16
        left = rows.filter("_v is not null").withColumn("_p", F.shiftright("_k", above)).join(sized(state.select(*keys, "_p"), n), [*keys, "_p"], "left_semi")
        counts = left.groupBy(*keys, "_p", F.shiftright("_k", shift).alias("_d")).agg(F.sum("_w").alias("_c"), F.min("_v").alias("value")).filter("_c > 0")
        counts = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_d")))
        found = counts.join(sized(state, n), [*keys, "_p"]).filter((F.col("_in") < F.col("_upto")) & (F.col("_in") >= F.col("_upto") - F.col("_c")))
        if shift == 0:
            empty = state.filter("n = 0").select(*keys, "n", "at", F.lit(None).cast("double").alias("value"))
            return checkpointed(found.select(*keys, "n", "at", "value").unionByName(empty.distinct()))
        state = checkpointed(found.select(*keys, "n", "at", (F.col("_in") - F.col("_upto") + F.col("_c")).alias("_in"), F.col("_d").alias("_p"), F.col("_c").alias("_size")).unionByName(state.filter("n = 0")))


def quantiles(df: DataFrame, keys: list[str], value: str, share: float, weight: str | None = None) -> DataFrame:
    """(keys, n, value): the exact quantile of each group, between two rows in proportion; NULL without values."""
    place = lambda n: (n - 1) * F.lit(share)
    ends = at_rows(df, keys, value, lambda n: F.array(F.floor(place(n)), F.ceil(place(n))), weight)
    two = ends.groupBy(*keys, "n").agg(F.min("at").alias("_at"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    up = place(F.col("n")) - F.col("_at")
    between = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((F.lit(1.0) - up) * F.col("_low") + up * F.col("_high"))
    return two.select(*keys, "n", between.alias("value"))


def quantile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, value) of quantiles(), by percentile's buffers where a count says that no group has more than HELD values."""
    most = df.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) <= HELD:
        return df.groupBy(*keys).agg(F.percentile(value, share).alias("value"))
    return quantiles(df, keys, value, share).drop("n")


def borders(df: DataFrame, keys: list[str], value: str, pieces: int, weight: str | None = None) -> DataFrame:
    """(keys, borders): the distinct values, in order, at which equal parts of each group's rows begin."""
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.lit(pieces - 1)), lambda i: F.floor(i * n / F.lit(float(pieces))))
    return at_rows(df, keys, value, starts, weight).groupBy(*keys).agg(F.sort_array(F.collect_set("value")).alias("borders"))
