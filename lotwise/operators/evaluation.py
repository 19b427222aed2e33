"""Arms over folds: scores, records, intervals and paired comparisons.

An arm's scores are rows (arm, keys, unit_id, y, s), so that all arms and folds are scored and compared in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators import cleaning, kernels, resampling
from lotwise.operators.graph import checkpointed


def fold_roles(folds: DataFrame, k: int, least: int = 2) -> DataFrame:
    """(rep, fold, unit_id, y, role) of folds(rep, unit_id, y, fold); folds need ``least`` positives in training."""
    roles = folds.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("role", F.when(F.col("own") == F.col("fold"), "test").otherwise("train")).drop("own")
    good = cleaning.enough_positives(roles.filter("role = 'train'"), ["rep", "fold"], least)
    return roles.join(F.broadcast(good), ["rep", "fold"], "left_semi")


def signed_sums(readings: DataFrame, roles: DataFrame, arms: dict[str, int], keys: list[str]) -> DataFrame:
    """Linear scores without a fitted model: of each arm's k best training sensors the values, with the sign that
    training gave them, added up on test rows. Nothing is fitted on test rows."""
    rows = readings.select("unit_id", "sensor_id", "value").join(roles, "unit_id")
    train = rows.filter("role = 'train'")
    med = cleaning.medians(train, keys)
    best = cleaning.univariate_top(cleaning.impute(train, med, keys), max(arms.values()), keys, imputed=True)
    best = best.select(*keys, "sensor_id", "rnk", F.when(F.col("auc") >= 0.5, 1.0).otherwise(-1.0).alias("sign"))
    best = checkpointed(best)  # at most k sensors a fold; the plan starts anew from here
    table = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(k).alias("n_sensors")) for a, k in arms.items()])
    test = cleaning.impute(rows.filter("role = 'test'"), med, keys).join(F.broadcast(best), [*keys, "sensor_id"]).withColumn("a", F.explode(table)).filter(F.col("rnk") <= F.col("a.n_sensors"))
    s = test.groupBy(F.col("a.arm").alias("arm"), F.col("a.n_sensors").alias("n_sensors"), *keys, "unit_id", "y")
    return s.agg(F.round(F.sum(F.col("sign") * F.col("value")), 9).alias("s"))


def records(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_test, n_fail, auc, ap) of scores(keys, unit_id, y, s)."""
    a = kernels.roc_auc(scores, keys, "s").select(*keys, (F.col("n1") + F.col("n0")).alias("n_test"), F.col("n1").alias("n_fail"), "auc")
    return a.join(kernels.average_precision(scores, keys, "s"), keys)


def common_folds(recs: DataFrame, folds: list[str]) -> DataFrame:
    """The records of folds that every arm has."""
    arms = recs.agg(F.count_distinct("arm").alias("_a"))
    full = recs.groupBy(*folds).agg(F.count_distinct("arm").alias("_k")).crossJoin(F.broadcast(arms)).filter("_k = _a").select(*folds)
    return recs.join(F.broadcast(full), folds, "left_semi")


def same_folds(a: DataFrame, b: DataFrame, folds: list[str]) -> bool:
    """Whether two sets of records are of exactly the same folds; pairing others would be wrong."""
    x, y = (t.select(*folds).distinct().withColumn(n, F.lit(1)) for t, n in ((a, "_x"), (b, "_y")))
    return not x.join(y, folds, "full").filter("_x is null or _y is null").head(1)


def summary(recs: DataFrame, folds: list[str], metric: str = "auc") -> DataFrame:
    return kernels.mean_ci(common_folds(recs, folds), ["arm"], metric)


def paired(recs: DataFrame, folds: list[str], metric: str = "auc") -> DataFrame:
    """(arm, other, n, mean, sd, low, high, wins, losses, t, p_t, w, p_w) of metric(arm) - metric(other), all ordered
    pairs; the p-values of the paired t test and of Wilcoxon's are null where no difference is other than 0."""
    c = common_folds(recs, folds)
    b = c.select(*folds, F.col("arm").alias("other"), F.col(metric).alias("_m"))
    d = c.join(b, folds).filter("arm <> other").withColumn("d", F.round(F.col(metric) - F.col("_m"), 12))
    ci = kernels.mean_ci(d, ["arm", "other"], "d")
    wins = d.groupBy("arm", "other").agg(F.count(F.when(F.col("d") > 0, 1)).alias("wins"), F.count(F.when(F.col("d") < 0, 1)).alias("losses"))
    w = kernels.wilcoxon(d, ["arm", "other"], "d", "fold").select("arm", "other", "w", F.col("p").alias("p_w"))
    out = ci.join(wins, ["arm", "other"]).join(w, ["arm", "other"], "left")
    out = out.withColumn("t", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")))
    return out.withColumn("p_t", F.when(F.col("w").isNotNull(), kernels.t_tails(F.col("t"), F.col("n") - 1)))


def slope(recs: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept, r) of y on x, one point an arm."""
    return recs.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.when((F.min(x) != F.max(x)) & (F.min(y) != F.max(y)), F.corr(x, y)).alias("r"))


def matched(arms: DataFrame, controls: DataFrame, size: str = "n_sensors") -> DataFrame:
    """(arm, match, gap): for each arm the control nearest in size, ties by name."""
    b = controls.select(F.col("arm").alias("match"), F.col(size).alias("_n"))
    j = arms.crossJoin(F.broadcast(b)).filter("arm <> match").withColumn("gap", F.abs(F.col(size) - F.col("_n")))
    return j.groupBy("arm").agg(F.min_by("match", F.struct("gap", "match")).alias("match"), F.min("gap").alias("gap"))


def sign_counts(recs: DataFrame, folds: list[str], control: DataFrame, metric: str = "auc") -> DataFrame:
    """(arm, match, n, above, below, median) of each arm's metric less that of its control(arm, match), fold by fold."""
    c = common_folds(recs, folds)
    other = c.select(*folds, F.col("arm").alias("match"), F.col(metric).alias("_m"))
    d = c.join(F.broadcast(control.select("arm", "match")), "arm").join(other, [*folds, "match"]).withColumn("d", F.round(F.col(metric) - F.col("_m"), 12))
    n = lambda x: F.count(F.when(x, 1))
    return d.groupBy("arm", "match").agg(F.count("*").alias("n"), n(F.col("d") > 0).alias("above"), n(F.col("d") < 0).alias("below"), F.median("d").alias("median"))


def picks(recs: DataFrame, folds: list[str], metric: str = "auc") -> DataFrame:
    """(arm, n_folds): in how many folds each arm is the best, ties by name."""
    return best_arm(recs, folds, metric).groupBy("arm").agg(F.count("*").alias("n_folds"))


def ledger(recs: DataFrame) -> DataFrame:
    """(arm, n_folds, n_sensors, n_test, n_fail, auc, ap): means of each arm's records, the failures of all its tests."""
    return recs.groupBy("arm").agg(F.count("*").alias("n_folds"), F.avg("n_sensors").alias("n_sensors"), F.sum("n_test").alias("n_test"), F.sum("n_fail").alias("n_fail"), F.avg("auc").alias("auc"), F.avg("ap").alias("ap"))


def crosses_zero(low, high):
    return (low <= 0) & (high >= 0)


def marginal(low, high, eps: float = 0.005):
    """An interval that misses zero by less than eps."""
    return ~crosses_zero(low, high) & (F.least(F.abs(low), F.abs(high)) < eps)


def rolling_sweep(readings: DataFrame, units: DataFrame, counts: list[int], arms: dict[str, int], least: int = 3) -> DataFrame:
    """Records (arm, n_sensors, blocks, origin, ...) of rolling origins for each number of blocks; test blocks with
    fewer than ``least`` failures are left out."""
    parts = [resampling.rolling_origin(units, k).withColumn("blocks", F.lit(k)).select("blocks", "origin", "unit_id", "y", "role") for k in counts]
    roles = parts[0]
    for p in parts[1:]:
        roles = roles.unionByName(p)
    good = cleaning.enough_positives(roles.filter("role = 'test'"), ["blocks", "origin"], least)
    roles = roles.join(F.broadcast(good), ["blocks", "origin"], "left_semi")
    return records(signed_sums(readings, roles, arms, ["blocks", "origin"]), ["arm", "n_sensors", "blocks", "origin"])


def best_arm(recs: DataFrame, keys: list[str], metric: str = "auc") -> DataFrame:
    """(keys, arm, mean): the arm with the highest mean of each key, ties by name."""
    m = recs.groupBy(*keys, "arm").agg(F.avg(metric).alias("mean"))
    own = Window.partitionBy(*keys).orderBy(F.round("mean", 12).desc(), "arm")
    return m.withColumn("_r", F.row_number().over(own)).filter("_r = 1").drop("_r")


def recovery(ranking: DataFrame, planted: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(keys, hits, recall, precision) of top-k rankings against planted(sensor_id)."""
    n = planted.agg(F.count("*").alias("_n"))
    j = ranking.filter(F.col("rnk") <= k).join(F.broadcast(planted.withColumn("_hit", F.lit(1))), "sensor_id", "left").groupBy(*keys).agg(F.count("_hit").alias("hits"), F.count("*").alias("_k"))
    return j.crossJoin(n).select(*keys, "hits", (F.col("hits") / F.col("_n")).alias("recall"), (F.col("hits") / F.col("_k")).alias("precision"))
