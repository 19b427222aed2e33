"""Sequential permutation tests against all permutations one by one."""

import pytest
from pyspark.sql import functions as F

from lotwise.operators import graph, periods, resampling
from lotwise.plans import timed
from lotwise.sources import adapters
from lotwise.sources.synthetic import causes, synthetic

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("batch", [7, 200])
def test_sensors_leave_at_the_stop_th_exceedance(spark, batch):
    x = graph.checkpointed(synthetic(spark, 150, 5, 1, 0.3, 0.05, 4))
    units = x.select("unit_id", "y").distinct()
    ranks = periods.MeanRanks(x)
    real = {r["sensor_id"]: r["z"] for r in ranks.real().collect()}
    every = {}
    for r in ranks.null(units, 60).collect():
        every.setdefault(r["sensor_id"], {})[r["rep"]] = r["z"]
    got = {r["sensor_id"]: r for r in periods.sequential_association(x, units, 60, 3, batch).collect()}
    assert set(got) == set(real)
    for s, z in real.items():
        hits = [rep for rep in range(60) if every[s][rep] >= z]
        want = (hits[2] + 1, 3, 3 / (hits[2] + 1)) if len(hits) >= 3 else (60, len(hits), (len(hits) + 1) / 61)
        assert (got[s]["n_perms"], got[s]["hits"], got[s]["p"]) == want
    whole = {r["sensor_id"]: r["p"] for r in periods.association(x, units, 60).collect()}
    assert all(abs(whole[s] - r["p"]) < 1e-12 for s, r in got.items() if r["n_perms"] == 60 and r["hits"] < 3)
    assert got[causes(5, 1)[0]]["n_perms"] == 60 and got[causes(5, 1)[0]]["hits"] == 0


def test_blocks_that_differ_see_many_permutations(spark):
    """A sensor that goes with failures in the first period only is told from one that does so in all."""
    cells = [(u, int(u % 3 == 0), s, (1.5 if u % 3 == 0 and (s == 1 or u < 60) else 0.0) + ((u * 7919 + s * 31) % 101) / 100) for u in range(180) for s in range(2)]
    x = graph.checkpointed(spark.createDataFrame(cells, "unit_id long, y int, sensor_id int, value double"))
    units = x.select("unit_id", "y").distinct().withColumn("ts", (F.lit(1_700_000_000) + F.col("unit_id") * 3600).cast("timestamp"))
    got = {r["sensor_id"]: r for r in periods.sequential_invariance(x, graph.checkpointed(units), 3, 100, 4, 8).collect()}
    assert got[0]["p"] < 0.05 and got[0]["n_perms"] == 100 and got[1]["p"] > got[0]["p"]


def test_permuted_heterogeneity_is_that_of_each_permutation(spark):
    units = adapters.event_units(spark, SF)
    readings = adapters.event_readings(spark, SF).drop("ts")
    rows = lambda df: {(r["rep"], r["sensor_id"]): (r["k"], round(r["q"], 9)) for r in df.collect()}
    expected = rows(periods.heterogeneity(readings, resampling.permuted_blocks(units, 5, 2, start=3), ["rep"]))
    assert rows(periods.permuted_heterogeneity(readings, units, 5, 2, 3)) == expected and len(expected) == 8


def test_gate_has_no_plan_of_the_readings(spark):
    gate = timed.invariance_gate(spark, SF)
    assert len(gate._jdf.queryExecution().optimizedPlan().toString()) < 30_000


def test_a_batch_deals_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(periods, "AT_ONCE", 1000)
    asked = []

    def null(n, start, sensors):
        asked.append(n)
        return spark.createDataFrame([(r, s, 0.0) for r in range(start, start + n) for s in sensors], "rep int, sensor_id int, x double")

    real = spark.createDataFrame([(1, 1.0)], "sensor_id int, x double")
    assert [tuple(r) for r in periods.sequential_p(real, null, 40, 3, 16, 100).collect()] == [(1, 40, 0, 1 / 41)]
    assert asked == [10, 10, 10, 10]
