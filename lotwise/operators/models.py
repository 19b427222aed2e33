"""Fitted models over readings: arms over folds, tuning, importances. The fits themselves run many at a time (fits.py).

What is filled in, scaled or selected is taken from training rows alone. Weights balance the classes: n / (2 n_class).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.hashing import digest
from lotwise.operators import cleaning, fits, kernels, resampling, trees
from lotwise.operators.fits import Logistic, Majority, Plan
from lotwise.operators.graph import checkpointed
from lotwise.operators.running import shuffled


def logistic(c: float = 0.03, least_missing: float | None = None) -> Logistic:
    return Logistic(c, least_missing=least_missing)


def plain_logistic(l2: float = 1.0) -> Logistic:
    return Logistic(1.0 / l2, mean_fill=True)


def forest(n: int = 500, leaf: int = 5, seed: int = 0) -> trees.Forest:
    return trees.Forest(n, leaf, seed)


def boosted(rounds: int = 200, rate: float = 0.05, leaves: int = 15) -> trees.Boosted:
    return trees.Boosted(rounds, rate, leaves)


# The grids of the tuned models.
LOGISTICS = {f"c_{c}": logistic(c) for c in (0.003, 0.03, 0.3)}
BOOSTED = {f"rate_{rate}_leaves_{leaves}": boosted(200, rate, leaves) for rate in (0.03, 0.05, 0.1) for leaves in (7, 15, 31)}
FORESTS = {f"leaf_{leaf}": forest(500, leaf) for leaf in (1, 5, 10)}
BASES = {"logreg": logistic(), "logreg_missind": logistic(least_missing=0.01), "rf": forest(), "hgb": boosted()}


def together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def everyone(readings: DataFrame, train: bool = True) -> DataFrame:
    """members of one fit on all units of readings."""
    return readings.select("unit_id", "y").distinct().select(F.lit(0).alias("data"), "unit_id", "y", F.lit(1).alias("times"), F.lit(train).alias("train"))


def sensors_of(readings: DataFrame) -> tuple[int, ...]:
    return tuple(r[0] for r in readings.select("sensor_id").distinct().orderBy("sensor_id").collect())


def parted(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Training rows of the data numbers that fit a group, and those of larger ones if there are any."""
    train, large = members.filter("train"), [d for d, n in fits.sizes_of(members).items() if n > fits.LARGE]
    return (train.filter(~F.col("data").isin(large)), train.filter(F.col("data").isin(large))) if large else (train, None)


def kept_sensors(readings: DataFrame, members: DataFrame, min_observed: float = 0.0) -> dict[int, tuple[int, ...]]:
    """The sensors that the cleaner keeps of each data number's training rows: those of many data numbers side by side,
    units once a block."""
    small, large = parted(members)
    out: dict[int, list[int]] = {r["data"]: [] for r in members.select("data").distinct().collect()}

    def work(data: int, block: fits.Block, place: tuple) -> dict:
        row = np.unique(place[0])
        x, n = block.x[row], block.there[row].sum(0)
        observed = (~np.isnan(x)).sum(0)
        low, high = np.fmin.reduce(x, 0), np.fmax.reduce(x, 0)
        good = (observed > 0) & (low != high) & ~(observed < min_observed * n)
        seen, kept = set(), []
        sums = [m[row].sum(0) for m in block.marks]
        for i in np.flatnonzero(good).tolist():
            alike = (int(sums[0][i]), int(sums[1][i]), int(n[i]), int(observed[i]))
            if alike not in seen:
                seen.add(alike)
                kept.append(block.sensors[i])
        return {"data": pa.array([data] * len(kept), pa.int32()), "sensor_id": pa.array(kept, pa.int32())}

    found = fits.by_data(fits.all_cells(readings.select("unit_id", "sensor_id", "value")), small, "data int, sensor_id int", work)
    if large is not None:
        rows = large.select("data", "unit_id").distinct().join(readings.select("unit_id", "sensor_id", "value"), "unit_id")
        found = found.unionByName(cleaning.cleaner(rows, ["data"], min_observed).filter("reason is null").select("data", F.col("sensor_id").cast("int").alias("sensor_id")))
    for r in found.collect():  # a row a data number and sensor
        out[r["data"]].append(r["sensor_id"])
    return {d: tuple(sorted(s)) for d, s in out.items()}


def univariate_of(readings: DataFrame, members: DataFrame, kept: dict[int, tuple[int, ...]]) -> DataFrame:
    """(data, sensor_id, score): cleaning.univariate() of each data number's kept sensors on its training rows."""
    small, large = parted(members)

    def work(data: int, block: fits.Block, place: tuple) -> dict:
        row, y, times, _ = place
        y, times = y.astype(np.int64), times.astype(np.int64)
        own = kept.get(data, ())
        at = block.columns(own)
        x, there = block.filled(row, at), block.there[np.ix_(row, at)] > 0
        score = [round(abs(fits.weighted_auc(y[t], times[t], x[t, i]) - 0.5), 12) for i, t in enumerate(there.T)]
        return {"data": pa.array([data] * len(own), pa.int32()), "sensor_id": pa.array(own, pa.int32()), "score": pa.array(score, pa.float64())}

    found = fits.by_data(fits.all_cells(readings.select("unit_id", "sensor_id", "value")), small, "data int, sensor_id int, score double", work)
    if large is not None:
        some = readings.sparkSession.createDataFrame([(d, s) for d, own in kept.items() for s in own], "data int, sensor_id int")
        train = large.select("data", "unit_id", "y", "times").join(readings.select("unit_id", "sensor_id", "value"), "unit_id").join(F.broadcast(some), ["data", "sensor_id"])
        found = found.unionByName(cleaning.univariate(train, ["data"], weight="times").select("data", F.col("sensor_id").cast("int").alias("sensor_id"), "score"))
    return found


def best_sensors(readings: DataFrame, members: DataFrame, kept: dict[int, tuple[int, ...]], k: int) -> dict[int, tuple[int, ...]]:
    """The k of kept sensors with the best |AUC - 0.5| of each data number's training rows."""
    out: dict[int, list] = {d: [] for d in kept}
    for r in univariate_of(readings, members, kept).collect():  # a row a data number and sensor
        out[r["data"]].append((-r["score"], r["sensor_id"]))
    return {d: tuple(sorted(s for _, s in sorted(own)[:k])) for d, own in out.items()}


@dataclass
class Model:
    """A specification with its training rows. It is grown where it scores; the same rows make the same model."""

    spec: object
    sensors: tuple[int, ...]
    wide: DataFrame
    members: DataFrame

    @property
    def plans(self) -> dict[int, Plan]:
        return {0: Plan(0, self.spec, self.sensors)}

    def score(self, readings: DataFrame) -> DataFrame:
        """(unit_id, y, s): probability of failure."""
        new = lambda df: df.withColumn("unit_id", F.struct(F.lit(True).alias("new"), F.col("unit_id").cast("string").alias("name")))
        old = lambda df: df.withColumn("unit_id", F.struct(F.lit(False).alias("new"), F.col("unit_id").cast("string").alias("name")))
        flat = lambda df: df.withColumn("unit_id", F.concat_ws(":", F.when(F.col("unit_id.new"), "+").otherwise("-"), "unit_id.name"))
        rows = flat(old(self.wide).unionByName(new(fits.wide(readings))))
        members = flat(old(self.members).unionByName(new(everyone(readings, False))))
        kind = readings.schema["unit_id"].dataType
        return fits.scores(rows, members, self.plans).select(F.substring("unit_id", 3, 1 << 20).cast(kind).alias("unit_id"), "y", "s")

    def importance(self) -> dict[int, float]:
        """|coefficient| or the share of what splits gain, a sensor."""
        return {r["sensor_id"]: r["importance"] for r in fits.importances(self.wide, self.members, self.plans).collect()}


def fit(readings: DataFrame, spec, sensors: list[int] | None = None) -> Model:
    sensors = tuple(sensors) if sensors else sensors_of(readings)
    own = readings.filter(F.col("sensor_id").isin(list(sensors)))
    return Model(spec, sensors, checkpointed(fits.wide(own)), checkpointed(everyone(readings)))


def ranking(spark, found: dict[int, float], k: int | None = None) -> DataFrame:
    """(sensor_id, score, rnk) of a fitted model's few sensors."""
    order = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
    return spark.createDataFrame([(s, v, i + 1) for i, (s, v) in enumerate(order)], "sensor_id int, score double, rnk int")


def auc_of(rows: DataFrame) -> float:
    return kernels.roc_auc(rows, [], "s").first()["auc"]


def split_members(members: DataFrame, n_splits: int, test_share: float, seed: str, most: int = 1 << 10) -> DataFrame:
    """members of n_splits random splits of each data number's training rows, number data * most + split: of each class
    the first test_share of a random order tests. A row that counts several times is dealt copy by copy."""
    rows = members.filter("train").select("data", "unit_id", "y", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    rows = resampling.reps(rows, n_splits, "split").withColumn("name", F.concat_ws("#", "unit_id", "copy"))
    rows = shuffled(rows, ["data", "split", "y"], digest(seed, F.col("data"), F.col("split"), F.col("name")), "name")
    size = rows.groupBy("data", "split", "y").agg(F.count("*").alias("_n"))
    rows = rows.join(size, ["data", "split", "y"]).withColumn("train", F.col("row") > F.round(F.col("_n") * test_share))
    return rows.groupBy((F.col("data") * most + F.col("split")).cast("int").alias("data"), "unit_id", "y", "train").agg(F.count("*").cast("int").alias("times"))


def falls(wide: DataFrame, members: DataFrame, plans: dict[int, Plan], n_splits: int, n_repeats: int, test_share: float = 0.3, seed: str = "importance", held_out: bool = True) -> DataFrame:
    """(fit, sensor_id, importance): the mean fall of AUC when a sensor's values change places among held-out rows.

    Splits with fewer than two failures on a side are left out; a fit without any other has importances of 0.
    held_out=False measures on the training rows themselves.
    """
    spark, most = wide.sparkSession, 1 << 10
    if held_out:
        own = checkpointed(split_members(members, n_splits, test_share, seed, most))
    else:
        n_splits = 1
        once = members.filter("train").withColumn("data", (F.col("data") * most).cast("int"))
        own = checkpointed(once.unionByName(once.withColumn("train", F.lit(False))))
    few = own.groupBy("data", "train").agg(F.sum(F.col("times") * F.col("y")).alias("p")).filter("p < 2" if held_out else "p < 1").select("data").distinct()
    bad = {r[0] for r in few.collect()}
    inner = {fit * most + split: Plan(p.data * most + split, p.spec, p.sensors) for fit, p in plans.items() for split in range(n_splits) if p.data * most + split not in bad}
    none = spark.createDataFrame([(f, s) for f, p in plans.items() for s in p.sensors], "fit int, sensor_id int")
    if not inner:
        return none.withColumn("importance", F.lit(0.0))
    auc = fits.aucs(wide, own, inner, n_repeats)
    # numbers of plans are fit * most + split, whatever their data
    auc = checkpointed(auc.groupBy("fit", "swap").agg(F.avg("auc").alias("auc")))
    fall = auc.filter("swap >= 0").join(auc.filter("swap = -1").select("fit", F.col("auc").alias("whole")), "fit")
    mean = fall.groupBy(F.floor(F.col("fit") / most).cast("int").alias("fit"), F.col("swap").alias("sensor_id")).agg(F.avg(F.col("whole") - F.col("auc")).alias("importance"))
    return none.join(mean, ["fit", "sensor_id"], "left").fillna(0.0, ["importance"])


def permutation_importance(readings: DataFrame, spec, sensors: list[int], n_splits: int = 3, n_repeats: int = 3, test_share: float = 0.3, seed: str = "importance", held_out: bool = True) -> dict[int, float]:
    """falls() of one fit on all units."""
    plans = {0: Plan(0, spec, tuple(sensors))}
    found = falls(checkpointed(fits.wide(readings)), checkpointed(everyone(readings)), plans, n_splits, n_repeats, test_share, seed, held_out)
    return {r["sensor_id"]: r["importance"] for r in found.collect()}


def inner_members(members: DataFrame, k: int, seed: str, most: int = 1 << 10) -> DataFrame:
    """members of k stratified folds of each data number's training rows, number data * most + fold."""
    rows = shuffled(members.filter("train").select("data", "unit_id", "y", "times"), ["data", "y"], digest(seed, F.col("data"), F.col("unit_id")))
    rows = rows.withColumn("own", ((F.col("row") - 1) % k).cast("int")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.select((F.col("data") * most + F.col("fold")).cast("int").alias("data"), "unit_id", "y", "times", (F.col("own") != F.col("fold")).alias("train"))


def chosen(wide: DataFrame, members: DataFrame, sensors: dict[int, tuple[int, ...]], grid: dict[str, object], k: int = 3, seed: str = "tune") -> dict[int, dict[str, float]]:
    """The mean AUC over k inner folds of each name in the grid, for each data number; all fits in one job."""
    most, names = 1 << 10, sorted(grid)
    inner = checkpointed(inner_members(members, k, seed, most))
    number = {(d, g, f): i for i, (d, g, f) in enumerate((d, g, f) for d in sensors for g in names for f in range(k))}
    plans = {i: Plan(d * most + f, grid[g], sensors[d]) for (d, g, f), i in number.items()}
    auc = {r["fit"]: r["auc"] for r in fits.aucs(wide, inner, plans).collect()}
    return {d: {g: sum(auc[number[d, g, f]] for f in range(k)) / k for g in names} for d in sensors}


def best_of(means: dict[str, float]) -> str:
    return max(sorted(means), key=means.__getitem__)


def tuned(readings: DataFrame, grid: dict[str, object], k: int = 3, seed: str = "tune") -> tuple[str, Model, dict[str, float]]:
    """The best of named specifications by mean AUC over k inner stratified folds, fitted on all rows."""
    made = fit(readings, None)
    means = chosen(made.wide, made.members, {0: made.sensors}, grid, k, seed)[0]
    made.spec = grid[best_of(means)]
    return best_of(means), made, means


@dataclass(frozen=True)
class Arm:
    """What is fitted on a split's training rows: spec on all cleaned sensors, on the best ``top`` by univariate AUC, or
    on what a loop selects (a loop.Config); with a grid, spec is chosen by inner folds."""

    spec: object = None
    top: int | None = None
    grid: tuple[tuple[str, object], ...] = ()
    loop: object = None


def tuned_arm(grid: dict[str, object]) -> Arm:
    return Arm(grid=tuple(sorted(grid.items())))


def arms() -> dict[str, Arm]:
    """The named arms without the loop; loop.arms() has those with it."""
    return {
        "majority": Arm(Majority()), "logreg": Arm(logistic()), "logreg_missind": Arm(logistic(least_missing=0.01)), "logreg_all": tuned_arm(LOGISTICS), "hgb": Arm(boosted()), "hgb_all": tuned_arm(BOOSTED),
        "rf": Arm(forest()), "rf_all": tuned_arm(FORESTS), "univar_top25_rf": Arm(forest(), top=25),
    }


def numbered_splits(roles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, data): a number for each split."""
    return roles.select(*keys).distinct().withColumn("data", F.row_number().over(Window.orderBy(*keys)) - 1)  # a row a split


def cross_validated(readings: DataFrame, roles: DataFrame, made: dict[str, Arm], keys: list[str], select=None) -> DataFrame:
    """(arm, keys, unit_id, y, s, n_sensors): the test rows of each split in roles(keys, unit_id, role), scored by each arm
    that was fitted, cleaned and tuned on the split's training rows alone. All arms see the same splits, and the fits of
    all splits and arms run side by side. select(readings, wide, members, kept, configs) gives loops' sensors."""
    splits = checkpointed(numbered_splits(roles, keys))
    labels = readings.select("unit_id", "y").distinct()
    members = roles.select(*keys, "unit_id", "role").join(F.broadcast(splits), keys).join(labels, "unit_id")
    members = checkpointed(members.select(F.col("data").cast("int").alias("data"), "unit_id", "y", F.lit(1).alias("times"), (F.col("role") == "train").alias("train")))
    wide = checkpointed(fits.wide(readings))
    kept = kept_sensors(readings, members)
    tops = {k: best_sensors(readings, members, kept, k) for k in {a.top for a in made.values() if a.top}}
    grids = {a.grid: chosen(wide, members, kept, dict(a.grid)) for a in made.values() if a.grid}
    configs = {a.loop for a in made.values() if a.loop is not None}
    looped = select(readings, wide, members, kept, configs) if configs else {}
    plans, names = {}, []
    for name, arm in made.items():
        for d, own in kept.items():
            sensors = looped[arm.loop][d] if arm.loop is not None else tops[arm.top][d] if arm.top else own
            spec = dict(arm.grid)[best_of(grids[arm.grid][d])] if arm.grid else arm.spec
            names.append((len(plans), name, d, len(sensors)))
            plans[len(plans)] = Plan(d, spec, sensors)
    whose = readings.sparkSession.createDataFrame(names, "fit int, arm string, data int, n_sensors int")
    rows = fits.scores(wide, members, plans).drop("swap", "rep").join(F.broadcast(whose), "fit").join(F.broadcast(splits), "data")
    return checkpointed(rows.select("arm", *keys, "unit_id", "y", F.round("s", 9).alias("s"), "n_sensors"))


def held_out_aucs(readings: DataFrame, labels: DataFrame, grid: dict[str, object], k: int, n_reps: int, seed: str = "fold") -> DataFrame:
    """(world, rep, fold, auc): for each labelling in labels(world, unit_id, y), the AUC of each of k stratified folds in
    each of n_reps repetitions, so that every unit is scored held out once a repetition; cleaning and tuning see the
    other folds only. All worlds, folds and grid points run side by side."""
    worlds = [r[0] for r in labels.select("world").distinct().orderBy("world").collect()]
    parts = [resampling.stratified_folds(labels.filter(F.col("world") == w).select("unit_id", "y"), k, n_reps, seed).withColumn("world", F.lit(w)) for w in worlds]
    folds = checkpointed(together(parts)).withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    number = reduce(lambda x, i: x.when(F.col("world") == worlds[i], i), range(1, len(worlds)), F.when(F.col("world") == worlds[0], 0))
    number = ((number * n_reps + F.col("rep")) * k + F.col("out")).cast("int")
    members = checkpointed(folds.select(number.alias("data"), "unit_id", "y", F.lit(1).alias("times"), (F.col("fold") != F.col("out")).alias("train")))
    wide = checkpointed(fits.wide(readings))
    kept = kept_sensors(readings, members)
    means = chosen(wide, members, kept, grid)
    plans = {d: Plan(d, grid[best_of(means[d])], own) for d, own in kept.items()}
    auc = fits.aucs(wide, members, plans).select(F.col("fit").alias("data"), "auc")
    name = F.element_at(F.array(*[F.lit(w) for w in worlds]), (F.floor(F.col("data") / (k * n_reps)) + 1).cast("int"))
    return auc.select(name.alias("world"), (F.floor(F.col("data") / k) % n_reps).cast("int").alias("rep"), (F.col("data") % k).cast("int").alias("fold"), "auc")


def cv_auc(readings: DataFrame, spec, k: int = 5, seed: str = "fold") -> list[float]:
    """The AUC of each stratified fold under a plain fit; folds with fewer than two failures in training or none in the
    test are left out."""
    made = fit(readings, spec)
    inner = checkpointed(inner_members(made.members, k, seed))
    n = {(r["data"], r["train"]): r["n"] for r in inner.groupBy("data", "train").agg(F.sum("y").alias("n")).collect()}
    plans = {d: Plan(d, spec, made.sensors) for d in range(k) if n.get((d, False), 0) >= 1 and n.get((d, True), 0) >= 2}
    found = fits.aucs(made.wide, inner, plans).orderBy("fit").collect() if plans else []
    return [r["auc"] for r in found]
