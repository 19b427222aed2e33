"""Null worlds drawn in blocks against those drawn as rows."""

import numpy as np

from lotwise.operators import calibration, fits, graph, resampling


def test_worlds_drawn_in_blocks_are_those_drawn_as_rows(spark, monkeypatch):
    """With ties, missing and absent readings, a unit without any and replicates of too few failures; in blocks no
    replicate is a row a unit."""
    rng = np.random.default_rng(8)
    units = graph.checkpointed(spark.createDataFrame([(f"u{u}", int(u % 9 == 0)) for u in range(90)], "unit_id string, y int"))
    rows = [(f"u{u}", s, None if u % 7 == s else float(rng.integers(0, 5)) if s < 2 else float(rng.normal())) for u in range(89) for s in range(5) if s != 3 or u % 3]
    readings = graph.checkpointed(spark.createDataFrame(rows, "unit_id string, sensor_id int, value double"))
    found, calls, bootstrap = [], [], resampling.bootstrap
    monkeypatch.setattr(resampling, "bootstrap", lambda *a, **k: calls.append(1) or bootstrap(*a, **k))
    for large in (fits.LARGE, 89):
        monkeypatch.setattr(fits, "LARGE", large)
        got = calibration.worlds_by_depth(units, readings, 5, 3, 4, (1, 3), 10)
        found.append((len(calls), sorted(map(tuple, got.select("world", "permuted", "sensor_id", "hits", "n_eff", "support", "depth").collect()))))
    assert found[0][1] == found[1][1] and found[0][0] == 0 < found[1][0]
    assert any(0 < r[4] < 4 for r in found[0][1]) and {r[0] for r in found[0][1]} > {0, 7}
