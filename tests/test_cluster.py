"""Trees are the same wherever they are grown: from values in a block, from bins in a block, and by the cluster."""

import numpy as np

from lotwise.operators import cluster, fits, graph, trees


def rows_of(spark, n=900, p=5):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, p))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(size=n) > 0.8).astype(int)
    x[:, 3] = np.round(x[:, 3])
    x[rng.random((n, p)) < 0.1] = np.nan
    cells = [(u, s, None if np.isnan(v) else float(v)) for u in range(n) for s, v in enumerate(x[u])]
    members = [(d, u, int(y[u]), 1 + (u + d) % 2, u % 4 != d) for d in range(2) for u in range(n)]
    wide = graph.checkpointed(fits.wide(spark.createDataFrame(cells, "unit_id long, sensor_id int, value double")))
    return wide, graph.checkpointed(spark.createDataFrame(members, "data int, unit_id long, y int, times int, train boolean"))


def test_results_do_not_depend_on_where_trees_are_grown(spark, monkeypatch):
    """Scores, those of moved values and importances; not one cut differs, though values are many more than bins."""
    wide, members = rows_of(spark)
    plans = {0: fits.Plan(0, trees.Forest(6, 1), (0, 1, 2, 3, 4)), 1: fits.Plan(0, trees.Boosted(7), (0, 1, 2, 3, 4)), 2: fits.Plan(0, trees.Boosted(4, 0.1, 7), (0, 1, 2, 3, 4))}
    monkeypatch.setattr(cluster, "KEPT", 3)
    monkeypatch.setattr(fits.spread, "estimator", lambda *a: 1 / 0)
    found = []
    for large, most in ((fits.LARGE, fits.CODED), (100, fits.CODED), (100, 100)):
        monkeypatch.setattr(fits, "LARGE", large)
        monkeypatch.setattr(fits, "CODED", most)
        scores = {(r.fit, r.swap, r.rep, r.unit_id): round(r.s, 9) for r in fits.scores(wide, members, plans, 1).collect()}
        found.append((scores, {(r.fit, r.sensor_id): round(r.importance, 9) for r in fits.importances(wide, members, plans).collect()}))
    assert len(found[0][0]) == 3 * 6 * 225 and len(set(found[0][0].values())) > 50
    for scores, gains in found[1:]:
        assert scores == found[0][0] and gains == found[0][1]


def test_histograms_by_feature_are_those_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    codes, y = rng.integers(0, 256, (3000, 4)).astype(np.uint8), rng.integers(0, 2, 3000)
    once = trees.boost(codes, y, np.ones(3000), trees.Boosted(6))
    monkeypatch.setattr(trees, "PLACED", 0)
    again = trees.boost(codes, y, np.ones(3000), trees.Boosted(6))
    assert once[1] == again[1] and all((a == b).all() for s, t in zip(once[0], again[0], strict=True) for a, b in zip(s, t, strict=True))
    order = rng.permutation(3000)
    other = trees.boost(codes[order], y[order], np.ones(3000), trees.Boosted(6))
    assert all((a == b).all() for s, t in zip(once[0], other[0], strict=True) for a, b in zip(s, t, strict=True))
