"""Decisions of the loop, arms over folds, and the statistics that other tests compare with."""

import math

import pytest
from pyspark.sql import functions as F

from lotwise.operators import cleaning, evaluation, graph, kernels, loop, models, periods, resampling, running, stability
from lotwise.operators.reporting import numbers
from lotwise.sources.synthetic import causes, synthetic


def test_repeated_readings_make_no_duplicates(spark):
    """Three sensors with other values, each reading twice, are no copies; an equal fourth one is."""
    rows = [(u, u % 2, s, float(u * (s % 3 + 1))) for u in range(6) for s in range(4) for _ in range(2)]
    x = spark.createDataFrame(rows, "unit_id long, y int, sensor_id int, value double")
    assert {r.sensor_id: r.reason for r in cleaning.cleaner(x).collect()} == {0: None, 1: None, 2: None, 3: "duplicate_of_0"}
    assert cleaning.profile(x).first()["duplicate_groups"] == 1


def test_buckets_follow_values_of_any_size(spark):
    values = [-1e300, -5e4, -1.0, -1e-9, 0.0, 1e-9, 0.5, 326.0, 1e5, 1.01e5, 1.5e5, 9e5, 1.6e9, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(running.value_bucket(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) >= len(values) - 1
    assert len({r[0] for r in spark.range(100_000, 200_000).select(running.value_bucket(F.col("id").cast("double"))).collect()}) >= 64


def test_tails(spark, monkeypatch):
    monkeypatch.setattr(kernels, "EXACT", 5)  # the normal distribution from six rows on
    one = spark.range(1)
    got = one.select(*[kernels.t_tails(F.lit(t), F.lit(n)).alias(f"t{i}") for i, (t, n) in enumerate([(12.706, 1), (4.303, 2), (-2.262, 9), (2.228, 10), (0.0, 5)])]).first()
    assert [round(v, 3) for v in got] == [0.05, 0.05, 0.05, 0.05, 1.0]
    # 95 % quantiles of chi square, odd and even degrees of freedom.
    got = one.select(*[kernels.chi2_tail(F.lit(x), n).alias(f"c{n}") for n, x in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (5, 11.070498), (6, 12.591587))]).first()
    assert all(abs(v - 0.05) < 1e-5 for v in got)
    assert abs(periods.SHIFTS[0.25] - 0.95387255) < 1e-7
    rows = [(f, d) for f, d in enumerate([1.0, 2.0, 3.0, -4.0, 5.0, 6.0])]
    w = kernels.wilcoxon(spark.createDataFrame(rows, "f int, d double"), [], "d", "f").first()
    assert (w["n"], w["w"]) == (6, 17.0) and abs(w["p"] - 2 * 0.5 * math.erfc((17 - 10.5) / math.sqrt(6 * 7 * 13 / 24) / math.sqrt(2))) < 1e-6


def test_grouped_numbers_are_one(spark):
    docs = spark.createDataFrame([(1, "1,234,567 and 12,345 but 1,2 and 3.5")], "k int, t string")
    assert sorted(r.number for r in numbers(docs, "k", "t").collect()) == ["1", "12345", "1234567", "2", "3.5"]


def test_bootstraps_drawn_again_are_as_many_as_asked(spark):
    units = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(60)], "unit_id long, y int")
    got = resampling.bootstrap_redrawn(units, 9, 7).groupBy("rep").agg(F.sum(F.col("y") * F.col("mult")).alias("p"), F.sum("mult").alias("n")).collect()
    assert sorted(r.rep for r in got) == list(range(9)) and all(r.p >= 7 and r.n == 60 for r in got)
    with pytest.raises(ValueError):
        resampling.bootstrap_redrawn(units.withColumn("y", F.lit(0)), 3, 1)
    folds = resampling.fold_replicates(units, 5, 2).groupBy("rep").count().collect()
    assert sorted(r.rep for r in folds) == list(range(10)) and sum(r["count"] for r in folds) == 2 * 4 * 60


def verdicts(spark, importance, support, groups=(), **changes):
    ranked = spark.createDataFrame(list(importance.items()), "sensor_id int, importance double")
    clusters = spark.createDataFrame(list(groups), "sensor_id int, cluster_id int")
    votes = spark.createDataFrame([(s, v, v) for s, v in support.items()], "sensor_id int, stability double, stability_top double")
    return loop.Report(loop.Config(**changes), [r.asDict() for r in loop.verdicts(ranked, clusters, votes, loop.Config(**changes)).orderBy("place").collect()])


def test_verdicts(spark):
    imp, sup = {1: 0.5, 2: 0.4, 3: 0.3, 4: 0.2, 5: 0.0, 6: -0.1}, {1: 0.9, 2: 0.95, 3: 0.6, 4: 0.2}
    rep = verdicts(spark, imp, sup, [(1, 1), (2, 1)])
    assert rep.selected == [1, 3] and rep.reported == [1, 3] and not rep.fallback and rep.ranking() == [1, 3, 2, 4, 5, 6]
    assert "sensor_001" in rep.markdown() and rep.null_record()["n_merit"] == 2
    silent = verdicts(spark, imp, {}, report_tau=0.9)
    assert silent.fallback and silent.selected == [1, 2, 3, 4] and silent.reported == [] and silent.markdown().startswith("No sensor")
    assert silent.null_record()["n_merit"] == 0 and silent.null_record()["fallback_fired"]
    bad = verdicts(spark, {1: -0.1, 2: 0.0, 3: -0.2}, {}, top_k=2)
    assert bad.selected == [1, 2] and bad.fallback  # never empty
    reported = [set(verdicts(spark, imp, sup, report_tau=t).reported) for t in (0.1, 0.5, 0.92, 1.0)]
    assert all(b <= a for a, b in zip(reported, reported[1:])) and reported[0] == {1, 2, 3, 4} and not reported[-1]
    chosen = [verdicts(spark, imp, sup, report_tau=t).selected for t in (None, 0.1, 0.99)]
    assert chosen[0] == chosen[1] == chosen[2]  # the threshold touches no prediction
    assert verdicts(spark, imp, sup, max_select=1).selected == [1]


def test_tally_counts_positive_importance_at_each_depth(spark):
    votes = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5), (0, 3, -0.1), (1, 2, 0.7), (1, 1, 0.2), (1, 3, 0.0)], "rep int, sensor_id int, importance double")
    got = {r.sensor_id: (r.deep, r.top) for r in loop.tally(votes, 4, {"deep": 5, "top": 1}).collect()}
    assert got == {1: (0.5, 0.25), 2: (0.5, 0.25)}


def test_loop_recovers_planted_causes(spark):
    x = graph.checkpointed(synthetic(spark, 400, 12, 2, 0.25, 0.05, 1))
    cfg = loop.Config(base="logreg", screen="univariate", attribution="model", n_screen=12, n_screen_boot=8, select_k=4, n_boot=3, n_inner=1)
    rep = loop.run(x, cfg)
    assert set(causes(12, 2)) <= set(rep.selected) and rep.ranking()[0] in causes(12, 2)
    scored = rep.predict(x)
    assert kernels.roc_auc(scored, [], "s").first()["auc"] > 0.75 and {r[0] for r in scored.select("predicted").distinct().collect()} <= {0, 1}


def test_permuted_labels_are_not_predicted(spark):
    """Fitted on training folds alone, arms score permuted labels like chance, and all arms see the same folds."""
    x = graph.checkpointed(synthetic(spark, 300, 8, 2, 0.3, 0.05, 2))
    units = x.select("unit_id", "y").distinct()
    moved = resampling.permuted_labels(units, 1, "canary").select("unit_id", "y")
    x = graph.checkpointed(x.drop("y").join(moved, "unit_id"))
    roles = evaluation.fold_roles(resampling.stratified_folds(moved, 3), 3)
    arms = {a: models.arms()[a] for a in ("majority", "logreg_missind")}
    recs = evaluation.records(models.cross_validated(x, roles, arms, ["rep", "fold"]), ["arm", "rep", "fold"]).collect()
    mean = sum(r.auc for r in recs if r.arm == "logreg_missind") / 3
    assert 0.38 < mean < 0.62 and all(r.auc == 0.5 for r in recs if r.arm == "majority")
    assert len(recs) == 6 and len({(r.fold, r.n_test, r.n_fail) for r in recs}) == 3


def test_family_verdicts(spark):
    f = lambda *n: spark.createDataFrame(list(enumerate(n)), "rep int, n int")
    assert stability.family_verdict(f(3, 3, 3), f(2, 2, 2)) == "more"
    assert stability.family_verdict(f(3, 3), f(3, 3)) == "not told apart"
    assert stability.family_verdict(f(1, 5, 1, 5), f(3, 4, 3, 4)) == "not told apart"
