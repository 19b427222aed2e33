"""Exact quantiles by counting, and running sums in levels of buckets."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import cleaning, kernels, running, selection

HARD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1 / 3, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0), 2.0**40, math.nextafter(2.0**40, 0), 1e9 + 0.5, -1.5, 1.7976931348623157e308, math.inf, -math.inf]


def test_order_keys_are_the_bits(spark):
    rng = np.random.default_rng(1)
    values = [*HARD, *(float(x) for x in rng.integers(0, 2**63 - 2**52, 500, dtype=np.int64).view(np.float64) if np.isfinite(x)), *(2.0**e for e in range(-1074, 1024, 7))]
    got = selection.with_order_key(spark.createDataFrame([(v,) for v in values], "v double"), "v", "k").collect()
    bits = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (1 if v >= 0 else -1)
    assert [r.k for r in got] == [bits(r.v) for r in got]


def spread(kind: str, n: int = 3000) -> list[float]:
    rng = np.random.default_rng(7)
    return {
        "normal": lambda: rng.normal(size=n), "times": lambda: 1.7e9 + rng.integers(0, 31_536_000, n), "close": lambda: 1.0 + rng.integers(0, 50, n) * 2.0**-52,
        "ties": lambda: rng.integers(0, 3, n).astype(float), "wide": lambda: rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-300, 300, n),
    }[kind]().tolist()


@pytest.mark.parametrize("few", [1 << 16, 1])
def test_quantiles_are_exact(spark, monkeypatch, few):
    """With few = 1 every pass is made, as for groups of any size."""
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "SMALL", 10 if few == 1 else 100_000)
    kinds = ["normal", "times", "close", "ties", "wide"]
    rows = [(i, v) for i, k in enumerate(kinds) for v in spread(k)] + [(5, None), (5, float("nan")), (6, 4.0), (6, None), (7, 1.0), (7, 2.0)]
    x = spark.createDataFrame(rows, "sensor_id int, value double").repartition(8)
    for share in (0.5, 0.975):
        got = {r.sensor_id: r.value for r in selection.quantiles(x, ["sensor_id"], "value", share).collect()}
        for i, k in enumerate(kinds):
            assert got[i] == pytest.approx(np.quantile(spread(k), share), rel=1e-14), k
        assert got[5] is None and got[6] == 4.0 and got[7] == 1 + share
    assert selection.quantiles(x.filter("sensor_id < 0"), ["sensor_id"], "value", 0.5).count() == 0
    assert selection.quantiles(x.filter("sensor_id = 1"), [], "value", 0.5).first().value == np.quantile(spread("times"), 0.5)


def test_weights_are_multiplicities(spark):
    x = spark.createDataFrame([(0, 1.0, 1), (0, 2.0, 5), (0, 9.0, 0), (0, 10.0, 2)], "sensor_id int, value double, times int")
    assert selection.quantiles(x, ["sensor_id"], "value", 0.5, "times").first().value == 2.0
    assert selection.quantiles(x, ["sensor_id"], "value", 1.0, "times").first().value == 10.0


def test_borders_part_equally(spark):
    values = spread("close") + spread("times")
    x = spark.createDataFrame([(v,) for v in values], "value double")
    cut = selection.borders(x, [], "value", 16).first().borders
    want = sorted(values)
    assert cut == sorted({want[i * len(want) // 16] for i in range(1, 16)})


@pytest.mark.parametrize("held", [1 << 18, 1])
def test_medians_fill_sensors_without_values(spark, monkeypatch, held):
    monkeypatch.setattr(selection, "HELD", held)
    x = spark.createDataFrame([(0, 1, 1.0), (0, 1, 4.0), (0, 2, None)], "rep int, sensor_id int, value double")
    assert {(r.sensor_id, r.med) for r in cleaning.medians(x, ["rep"]).collect()} == {(1, 2.5), (2, 0.0)}


def test_times_and_ids_spread_over_buckets(spark):
    n = lambda df: df.select(running.value_bucket(F.col("v"))).distinct().count()
    assert n(spark.range(1_700_000_000, 1_731_536_000, 1000).select(F.col("id").cast("double").alias("v"))) >= 1000
    assert n(spark.range(10**9, 10**9 + 10**6, 10).select(F.col("id").cast("double").alias("v"))) >= 64


def test_sums_in_levels_are_those_of_one_window(spark):
    values = spread("times", 400) + spread("wide", 400) + spread("ties", 400)
    x = spark.createDataFrame([(i % 2, i % 3 == 0, v) for i, v in enumerate(values)], "sensor_id int, pos boolean, value double").withColumn("y", F.col("pos").cast("int"))
    got = kernels.cumulated(x, ["sensor_id"], "value", "y").collect()
    for s in range(2):
        own = [(v, i % 3 == 0) for i, v in enumerate(values) if i % 2 == s]
        mine = [r for r in got if r.sensor_id == s]
        assert len(mine) == len({v for v, _ in own})
        assert all(r.cp == sum(p for v, p in own if v <= r.v) and r.cn == sum(not p for v, p in own if v <= r.v) for r in mine)
