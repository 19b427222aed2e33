"""Built sensors and their permutations against plain ones."""

import inspect

import numpy as np
from pyspark.sql import functions as F

from lotwise.operators import graph, periods, power
from lotwise.plans import timed

SF = "/root/testdata/sf0.001"


def units_of(spark, n=700):
    u = spark.range(n).select((F.col("id") * 13 % n).alias("unit_id"))
    return graph.checkpointed(u.select("unit_id", (F.col("unit_id") * 7 % 10 < 3).cast("int").alias("y"), (F.lit(1_700_000_000) + F.col("unit_id") * 40_000).cast("timestamp").alias("ts")))


def test_built_sensors_are_tested_as_readings_are(spark, monkeypatch):
    """Q over blocks of time as heterogeneity() has it, p by the permutations; the same whatever the pieces and tasks."""
    units = units_of(spark)
    y, blocks = power.failures(units), power.blocks_of(700, 5)
    assert y.tolist() == [u * 7 % 10 < 3 for u in range(700)]
    shifts, found = {0.05: 0.2, 0.25: 1.0}, []
    for slab, places in ((power.SLAB, power.PLACES), (200, 700)):
        monkeypatch.setattr(power, "SLAB", slab)
        monkeypatch.setattr(power, "PLACES", places)
        found.append({r.sensor_id: (r.delta, round(r.q, 9), round(r.i2, 9), r.p) for r in power.built(units, 5, 3, 60, shifts).collect()})
    assert found[0] == found[1] and len(found[0]) == 6
    value = [power.values([0.2, 1.0][s // 3], y, blocks, 0, 700, np.random.default_rng([power.SEED, s])) for s in range(6)]
    cells = [(u, int(y[u]), s, float(value[s][u])) for s in range(6) for u in range(700)]
    x = graph.checkpointed(spark.createDataFrame(cells, "unit_id long, y int, sensor_id int, value double"))
    plain = lambda b: {r.sensor_id: (round(r.q, 9), round(r.i2, 9)) for r in periods.heterogeneity(x, spark.createDataFrame(list(enumerate(map(int, b))), "unit_id long, block int")).collect()}
    assert plain(blocks) == {s: v[1:3] for s, v in found[0].items()}
    null = [plain(np.random.default_rng([power.SEED, 6, rep]).permutation(blocks)) for rep in range(1, 4)]
    few = {r.sensor_id: r.p for r in power.built(units, 5, 3, 3, shifts).collect()}
    assert few == {s: (1 + sum(n[s][0] >= v[1] for n in null)) / 4 for s, v in found[0].items()}


def test_the_ladder_has_all_its_sensors_and_permutations(spark):
    """A p of 0.05 over four sensors can be reached, and large breaks are seen more often than small ones."""
    own = inspect.signature(power.ladder).parameters
    assert own["n_sensors"].default == 200 and own["n_perms"].default == 2000
    got = timed.power_ladder(spark, SF).orderBy("delta").collect()
    assert [r.delta for r in got] == [0.05, 0.10, 0.15, 0.20, 0.25] and {r.n_sensors for r in got} == {200}
    assert got[-1].power > got[0].power and got[-1].power_family > 0 and got[-1].median_p < got[0].median_p
    assert all(r.power_family <= r.power for r in got)
