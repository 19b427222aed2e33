"""p-values of rank tests against all outcomes, and replicates against single ones."""

from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from lotwise.operators import cleaning, graph, kernels, resampling, stability


def test_signed_ranks_against_all_signs(spark):
    rows = [(n, i, (1 if (i * 7 + n) % 3 else -1) * (i + 0.5) * 1.1) for n in range(1, 13) for i in range(n)]
    got = {r.k: r for r in kernels.wilcoxon(spark.createDataFrame(rows, "k int, f int, d double"), ["k"], "d", "f").collect()}
    for n in range(1, 13):
        w = sum(i + 1 for k, i, d in rows if k == n and d > 0)
        sums = [sum(s) for s in product(*((0, i + 1) for i in range(n)))]
        tail = min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums)
        assert got[n].w == w and abs(got[n].p - min(1, 2 * tail)) < 1e-12
    # 25 differences, one sign against all others
    p = kernels.wilcoxon(spark.createDataFrame([(i, float(i) if i > 1 else -1.0) for i in range(1, 26)], "f int, d double"), [], "d", "f").first()["p"]
    assert abs(p - 2 * 2 / 2**25) < 1e-15


@pytest.mark.parametrize("n1, n0", [(1, 1), (3, 4), (5, 7), (2, 10), (9, 3)])
def test_rank_sums_against_all_choices(spark, n1, n0):
    values = [((i * 37) % 101 + 0.25) for i in range(n1 + n0)]
    rows = [(v, int(i < n1)) for i, v in enumerate(values)]
    got = kernels.mann_whitney(spark.createDataFrame(rows, "v double, g int"), [], "v", "g").first()
    order = sorted(values)
    rank = {v: i for i, v in enumerate(order)}
    u = lambda own: sum(rank[v] for v in own) - n1 * (n1 - 1) // 2
    every = [u(c) for c in combinations(values, n1)]
    assert got.u == u(values[:n1]) and abs(got.p - sum(x >= got.u for x in every) / len(every)) < 1e-12


def test_ties_stay_normal(spark):
    got = kernels.wilcoxon(spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 2.0), (3, -3.0)], "f int, d double"), [], "d", "f").first()
    assert 0.5 < got.p <= 1 and got.n == 4


@pytest.mark.parametrize("at_once", [4096, 2])
def test_replicates_are_those_of_single_ones(spark, monkeypatch, at_once):
    """Ties, missing values, a year of seconds, a sensor of one value; in one pass or several."""
    monkeypatch.setattr(stability, "AT_ONCE", at_once)
    rows = [(u, int(u % 7 == 0), s, [float(u % 5), None if u % 3 else u / 10, 1.7e9 + 5000.0 * ((u * 37) % 200), 3.0, float((u * 7919) % 997)][s]) for u in range(200) for s in range(5)]
    x = graph.checkpointed(spark.createDataFrame(rows, "unit_id long, y int, sensor_id int, value double"))
    w = graph.checkpointed(resampling.bootstrap(x.select("unit_id", "y").distinct(), 5, 1).selectExpr("rep", "unit_id", "y", "mult"))
    keys = ["rep", "sensor_id", "n1", "n0", "auc", "score"]
    want = cleaning.univariate(x.drop("y").join(w, "unit_id"), ["rep"], weight="mult", imputed=True).select(keys)
    got = stability.replicate_aucs(x.drop("y"), w, ["rep"]).select(keys)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 25


def test_pieces_follow_the_data(spark, monkeypatch):
    """A year of seconds lies in as many pieces as there are, none with much more than its share."""
    x = spark.range(20_000).select(F.col("id").alias("unit_id"), F.lit(0).alias("sensor_id"), (1.7e9 + F.col("id") * 1577).alias("value"))
    units = x.select("unit_id", F.lit(b"\x01").alias("w"))
    n = [len(r["n"]) and int.from_bytes(r["n"], "little") for r in stability.won(x, units, 1).collect()]
    assert len(n) == stability.PIECES and sum(n) == 20_000 and max(n) < 3 * 20_000 / stability.PIECES
