"""Splits, bootstraps and permutations as tables, all by digests (see functions.hashing): the same under any
partitioning, without a window over all units, and checkable by another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.hashing import digest, draw
from lotwise.operators.running import numbered, shuffled, tiles


def reps(df: DataFrame, n: int, name: str = "rep", start: int = 0) -> DataFrame:
    """df once for each number from start on, n of them."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(start), F.lit(start + n - 1))))


def stratified_folds(units: DataFrame, k: int = 5, n_reps: int = 1, seed: str = "fold") -> DataFrame:
    """(rep, unit_id, y, fold): each class dealt round in a random order, anew in each repetition."""
    u = reps(units.select("unit_id", "y"), n_reps)
    r = shuffled(u, ["rep", "y"], digest(seed, F.col("rep"), F.col("unit_id")))
    return r.select("rep", "unit_id", "y", ((F.col("row") - 1) % k).cast("int").alias("fold"))


def shuffle_split(units: DataFrame, n_reps: int, test_share: float, seed: str = "split") -> DataFrame:
    """(rep, unit_id, y, role): of each class the first test_share of a random order is 'test'."""
    u = reps(units.select("unit_id", "y"), n_reps)
    r = shuffled(u, ["rep", "y"], digest(seed, F.col("rep"), F.col("unit_id")))
    size = units.groupBy("y").agg(F.count("*").alias("_n"))
    return r.join(F.broadcast(size), "y").select("rep", "unit_id", "y", F.when(F.col("row") <= F.round(F.col("_n") * test_share), "test").otherwise("train").alias("role"))


def bootstrap(units: DataFrame, n_reps: int, least: int = 5, seed: str = "boot") -> DataFrame:
    """(rep, unit_id, y, mult): n draws with replacement a repetition as multiplicities; repetitions with fewer than
    ``least`` positives are left out (their number is that of the repetitions that stay)."""
    order = shuffled(units.select("unit_id", "y"), [], digest("order", F.col("unit_id")))
    n = order.agg(F.count("*").alias("_n"))
    draws = order.select(F.col("row").alias("_i")).crossJoin(F.broadcast(n))
    drawn = reps(draws, n_reps).withColumn("row", draw(digest(seed, F.col("rep"), F.col("_i")), F.col("_n")) + 1)
    mult = drawn.groupBy("rep", "row").agg(F.count("*").alias("mult")).join(order, "row").select("rep", "unit_id", "y", "mult")
    good = mult.groupBy("rep").agg(F.sum(F.col("y") * F.col("mult")).alias("_p")).filter(F.col("_p") >= least).select("rep")
    return mult.join(F.broadcast(good), "rep", "left_semi")


def bootstrap_redrawn(units: DataFrame, n_reps: int, least: int = 5, seed: str = "boot") -> DataFrame:
    """bootstrap() with exactly n_reps repetitions: one with too few positives is drawn again. The draws are numbered on
    and the first n_reps that have enough are taken, so that it doesn't matter how many are made at a time. Too few
    positives among the units themselves raise an error."""
    if not units.filter("y = 1").head(1) and least > 0:
        raise ValueError("no positives to draw")
    tried = n_reps
    while True:
        drawn = bootstrap(units, tried, least, seed)
        good = [r[0] for r in drawn.select("rep").distinct().orderBy("rep").limit(n_reps).collect()]
        if len(good) == n_reps:
            number = F.create_map(*[F.lit(x) for i, rep in enumerate(good) for x in (rep, i)])
            return drawn.filter(F.col("rep") <= good[-1]).withColumn("rep", number[F.col("rep")])
        if tried > 64 * n_reps + 1024:
            raise ValueError(f"hardly any draw has {least} positives")
        tried *= 2


def fold_replicates(units: DataFrame, k: int = 5, n_reps: int = 5, seed: str = "fold") -> DataFrame:
    """(rep, unit_id, y, mult): the training side of each fold of each repetition as a replicate, numbered from 0."""
    folds = stratified_folds(units, k, n_reps, seed).withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("fold <> out")
    return folds.select((F.col("rep") * k + F.col("out")).cast("int").alias("rep"), "unit_id", "y", F.lit(1).cast("long").alias("mult"))


def permuted_labels(units: DataFrame, n_reps: int, seed: str = "perm", start: int = 0) -> DataFrame:
    """(rep, unit_id, y): labels shuffled over the units in each repetition, of number start or more; class counts stay."""
    here = shuffled(units.select("unit_id", "y"), [], digest("order", F.col("unit_id")))
    there = shuffled(reps(units.select("unit_id"), n_reps, start=start), ["rep"], digest(seed, F.col("rep"), F.col("unit_id")))
    return there.join(here.select("row", "y"), "row").select("rep", "unit_id", "y")


def permuted_blocks(units: DataFrame, k: int, n_reps: int, seed: str = "block", start: int = 0, columns: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """(rep, columns, block): units dealt at random into blocks of the sizes that time blocks have, from repetition start."""
    n = units.agg(F.count("*").alias("_n"))
    r = shuffled(reps(units.select(*columns), n_reps, start=start), ["rep"], digest(seed, F.col("rep"), F.col("unit_id"))).crossJoin(F.broadcast(n))
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    big = more * (size + 1)
    block = F.when(F.col("row") <= big, F.floor((F.col("row") - 1) / (size + 1)) + 1).otherwise(F.floor((F.col("row") - 1 - big) / F.greatest(size, F.lit(1))) + more + 1)
    return r.select("rep", *columns, block.cast("int").alias("block"))


def permuted_column(readings: DataFrame, n_reps: int, seed: str = "column") -> DataFrame:
    """(rep, sensor_id, unit_id, value): within each sensor the values change places among the units."""
    here = shuffled(readings.select("sensor_id", "value", "unit_id"), ["sensor_id"], digest("order", F.col("unit_id")))
    there = shuffled(reps(readings.select("sensor_id", "unit_id"), n_reps), ["rep", "sensor_id"], digest(seed, F.col("rep"), F.col("sensor_id"), F.col("unit_id")))
    return there.join(here.select("sensor_id", "row", "value"), ["sensor_id", "row"]).select("rep", "sensor_id", "unit_id", "value")


def time_blocks(units: DataFrame, k: int) -> DataFrame:
    """units with ``block`` from 1 to k along time, ties by unit_id."""
    return tiles(units, k, F.unix_date(F.to_date("ts")), ["ts", "unit_id"])


def chronological(units: DataFrame, share: float = 0.7) -> DataFrame:
    """units with ``role``: the first share in time is 'train', half to even where it isn't whole."""
    n = units.agg(F.bround(F.count("*") * F.lit(share)).cast("bigint").alias("_n"))
    r = numbered(units, [], F.unix_date(F.to_date("ts")), ["ts", "unit_id"]).crossJoin(F.broadcast(n))
    return r.withColumn("role", F.when(F.col("row") <= F.col("_n"), "train").otherwise("test")).drop("row", "_n")


def rolling_origin(units: DataFrame, k: int) -> DataFrame:
    """(origin, role, unit columns): with origin b the blocks up to b train and block b + 1 tests."""
    b = time_blocks(units, k)
    o = b.withColumn("origin", F.explode(F.sequence(F.lit(1), F.lit(k - 1)))).filter(F.col("block") <= F.col("origin") + 1)
    return o.withColumn("role", F.when(F.col("block") <= F.col("origin"), "train").otherwise("test")).drop("block")


def halves(items: DataFrame, key: str, n_splits: int, seed: str = "half") -> DataFrame:
    """(split, direction, key, role): random halves of the items, each half calibrating once and tested once."""
    n = items.select(key).distinct().agg(F.count("*").alias("_n"))
    r = shuffled(reps(items.select(key).distinct(), n_splits, "split"), ["split"], digest(seed, F.col("split"), F.col(key)), key).crossJoin(F.broadcast(n))
    first = F.col("row") <= F.floor(F.col("_n") / 2)
    r = r.withColumn("direction", F.explode(F.array(F.lit(0), F.lit(1))))
    return r.select("split", "direction", key, F.when(first == (F.col("direction") == 0), "calibrate").otherwise("test").alias("role"))


def subsets(items: DataFrame, key: str, m: int, n_reps: int, seed: str = "subset") -> DataFrame:
    """(rep, key): m items without replacement in each repetition."""
    r = shuffled(reps(items.select(key).distinct(), n_reps), ["rep"], digest(seed, F.col("rep"), F.col(key)), key)
    return r.filter(F.col("row") <= m).select("rep", key)
