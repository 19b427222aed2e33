"""Tiny exact cases and canaries of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from lotwise.functions.hashing import digest, normal
from lotwise.operators import cleaning, evaluation, graph, kernels, periods, reporting, resampling, stability
from lotwise.operators.running import tiles
from lotwise.sources import adapters, runs


def readings(spark, columns, y=None):
    rows = [(u, (y or [0] * len(columns[0]))[u], s, None if v is None else float(v)) for s, c in enumerate(columns) for u, v in enumerate(c)]
    return spark.createDataFrame(rows, "unit_id long, y int, sensor_id int, value double")


def test_cleaner(spark):
    got = {r.sensor_id: r.reason for r in cleaning.cleaner(readings(spark, [[1.0, 2, 3], [5.0, 5, 5], [1.0, 2, 3], [2.0, 9, 4], [None] * 3, [0.0, 1, 2], [-0.0, 1, 2]])).collect()}
    assert got == {0: None, 1: "constant", 2: "duplicate_of_0", 3: None, 4: "all_missing", 5: None, 6: None}


def test_constant_in_training_only_is_dropped(spark):
    x = readings(spark, [list(map(float, range(10))), [1.0] * 5 + [2.0, 3, 4, 5, 6]])
    assert {r.sensor_id: r.reason for r in cleaning.cleaner(x.filter("unit_id < 5")).collect()} == {0: None, 1: "constant"}


@pytest.mark.parametrize("s, want", [([0.1, 0.2, 0.3, 0.4], 1.0), ([0.4, 0.3, 0.2, 0.1], 0.0), ([0.5] * 4, 0.5)])
def test_auc(spark, s, want):
    x = readings(spark, [s], [0, 0, 1, 1])
    assert kernels.roc_auc(x, ["sensor_id"]).first().auc == want


def test_auc_of_one_class(spark):
    x = readings(spark, [[1.0, 2.0]], [1, 1])
    assert kernels.roc_auc(x, ["sensor_id"]).first().auc == 0.5
    assert kernels.auc_with_error(x, ["sensor_id"]).first().se is None


def test_bh(spark):
    p = spark.createDataFrame(list(enumerate([0.001, 0.008, 0.039, 0.041, 0.042])) + [(9, None)], "sensor_id int, p double")
    got = {r.sensor_id: r.p_adj for r in kernels.bh_adjust(p, []).collect()}
    assert math.isclose(got[0], 0.005) and math.isclose(got[4], 0.042) and got[9] == 1.0
    assert [got[i] for i in range(5)] == sorted(got[i] for i in range(5))


def test_cochran_q(spark):
    e = spark.createDataFrame([(0, b, 0.6, 0.05) for b in range(3)] + [(1, 0, 0.6, 0.05)], "sensor_id int, block int, auc double, se double")
    got = {r.sensor_id: r for r in kernels.cochran_q(e, ["sensor_id"]).collect()}
    assert abs(got[0].q) < 1e-20 and math.isclose(got[0]["mean"], 0.6) and got[0].df == 2 and got[1].q is None


def test_intervals(spark):
    x = spark.createDataFrame([(v,) for v in (0.70, 0.72, 0.74, 0.76, 0.78, float("nan"))], "v double")
    r = kernels.mean_ci(x, [], "v").first()
    assert r.n == 5 and math.isclose(r["mean"], 0.74) and math.isclose(r.high - r["mean"], 2.7764451 * r.sd / math.sqrt(5), rel_tol=1e-6)


def test_folds(spark):
    u = spark.createDataFrame([(i, int(i < 10)) for i in range(100)], "unit_id long, y int")
    got = resampling.stratified_folds(u).collect()
    assert len({r.unit_id for r in got}) == 100 and all(sum(r.y for r in got if r.fold == f) == 2 for f in range(5))


def test_bootstrap_and_permutation_keep_sizes(spark):
    u = spark.createDataFrame([(i, int(i < 30)) for i in range(100)], "unit_id long, y int")
    assert [r[1] for r in resampling.bootstrap(u, 3).groupBy("rep").agg(F.sum("mult")).collect()] == [100] * 3
    assert [r[1] for r in resampling.permuted_labels(u, 3).groupBy("rep").agg(F.sum("y")).collect()] == [30] * 3


def test_chronological(spark):
    u = spark.sql("SELECT id AS unit_id, 0 AS y, timestamp_seconds(86400 * (100 - id)) AS ts FROM range(100)")
    got = resampling.chronological(u).groupBy("role").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    got = {r.role: r for r in got.collect()}
    assert got["train"].n == 70 and got["test"].n == 30 and got["train"].z <= got["test"].a
    assert sorted(r[1] for r in tiles(u, 7, F.unix_date(F.to_date("ts")), ["ts", "unit_id"]).groupBy("block").count().collect()) == [14] * 5 + [15] * 2


def test_overlap(spark):
    def sets(*lists):
        return spark.createDataFrame([(i, s) for i, x in enumerate(lists) for s in x], "rep int, sensor_id int")

    for other, want in ((range(5), 1.0), (range(5, 10), 0.0), ((0, 1, 2, 8, 9), 0.6)):
        assert math.isclose(stability.pairwise_overlap(sets(range(5), other), 5).first()["mean"], want)


def test_components_and_stars(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a int, b int")
    got = {r.sensor_id: r.cluster_id for r in graph.components(spark.range(10).select(F.col("id").cast("int").alias("sensor_id")), e).collect()}
    assert got[3] == 1 and got[8] == 7 and got[5] == 5
    pairs = spark.createDataFrame([(1, 2, 0.8), (2, 3, 0.9)], "a int, b int, r double")
    assert graph.greedy_stars(pairs, [1, 2, 3]) == [[1, 2], [3]]


def test_permuted_labels_carry_no_signal(spark):
    x = adapters.embedding_readings(spark, "/root/testdata/sf0.001").filter("sensor_id < 8").drop("y")
    null = resampling.permuted_labels(adapters.embedding_units(spark, "/root/testdata/sf0.001"), 1).select("unit_id", "y")
    assert all(0.3 < r.auc < 0.7 for r in kernels.roc_auc(x.join(null, "unit_id"), ["sensor_id"]).collect())


def test_planted_break_is_found(spark):
    """Sensor 0 separates in the first period only; of six sensors of noise few may look as uneven by chance."""
    u = spark.sql("SELECT id AS unit_id, CAST(id % 4 = 0 AS INT) AS y, timestamp_seconds(3600 * id) AS ts FROM range(900)")
    broken = (F.col("unit_id") < 300) & (F.col("y") == 1) & (F.col("sensor_id") == 0)
    x = u.withColumn("sensor_id", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("value", normal(digest("t", F.col("sensor_id"), F.col("unit_id"))) + F.when(broken, 3.0).otherwise(0.0))
    got = {r.sensor_id: (r.p, r.q) for r in periods.invariance(x.drop("ts"), u, 3, 19).collect()}
    assert got[0][0] == 0.05 and sum(got[s][0] > 0.05 for s in range(1, 7)) >= 4
    assert got[0][1] > 5 * max(got[s][1] for s in range(1, 7))


def test_text(spark, tmp_path):
    assert reporting.markdown_table(["a"], [["x|y"]]).endswith("| x\\|y |")
    doc = "a <!-- BEGIN:t -->old<!-- END:t --> z"
    assert reporting.stale(doc, {"t": "new"}) and not reporting.stale(reporting.inject(doc, {"t": "new"}), {"t": "new"})
    d = spark.createDataFrame([(1, "seen 12 and 1,234 on 2024-01-02 in x9 ```77```"), (2, None)], "k int, t string")
    assert sorted(r.number for r in reporting.numbers(d, "k", "t").collect()) == ["12", "1234"]
    c = spark.createDataFrame([("12",)], "number string")
    assert [r.number for r in reporting.unclaimed(d, c, "k", "t").collect()] == ["1234"]


def test_raw_files(spark, tmp_path):
    (tmp_path / "x").write_text("1 NaN 3\n\n4 5 6\n")
    (tmp_path / "y").write_text('-1 "19/07/2008 11:55:00"\n1 "19/07/2008 12:32:00"\n')
    got = adapters.load_both(spark, str(tmp_path / "x"), str(tmp_path / "y")).orderBy("unit_id", "sensor_id").collect()
    assert [r.value for r in got] == [1, None, 3, 4, 5, 6] and [r.y for r in got] == [0] * 3 + [1] * 3 and got[0].ts.day == 19


def test_run_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "ranker string, v int")
    runs.save_part(df.filter("ranker = 'a'"), str(tmp_path / "r"), "ranker")
    assert runs.missing_parts(spark, str(tmp_path / "r"), "ranker", ["a", "b"]) == ["b"]
    runs.save_json(df, str(tmp_path / "j"))
    assert runs.load_json(spark, str(tmp_path / "j"), "ranker string, v int").count() == 2
    assert runs.load_json(spark, str(tmp_path / "none"), "v int").count() == 0


def test_same_folds_guard(spark):
    a = spark.createDataFrame([(0, 0), (0, 1)], "rep int, fold int")
    assert evaluation.same_folds(a, a, ["rep", "fold"]) and not evaluation.same_folds(a, a.limit(1), ["rep", "fold"])
