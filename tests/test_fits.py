"""Batched fits against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import fits, graph, kernels, trees


def table(n=400, p=6, gaps=0.0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1) + 5
    y = (x[:, 0] + 0.4 * x[:, 1] + rng.normal(size=n) > 7.2).astype(int)
    x[rng.random((n, p)) < gaps] = np.nan
    return x, y


def frames(spark, x, y, roles):
    cells = [(i, int(y[i]), j, None if np.isnan(v) else float(v)) for i in range(len(x)) for j, v in enumerate(x[i])]
    readings = spark.createDataFrame(cells, "unit_id long, y int, sensor_id int, value double")
    members = spark.createDataFrame([(d, i, int(y[i]), t, w) for d, own in roles.items() for i, t, w in own], "data int, unit_id long, y int, times int, train boolean")
    return graph.checkpointed(fits.wide(readings)), graph.checkpointed(members)


def plain_logistic(x, y, times, c, gap_columns=()):
    """Newton on one dense matrix, to the end."""
    rows = np.repeat(np.arange(len(x)), times)
    fill = np.nanmedian(x[rows], axis=0)
    gone = np.isnan(x)
    z = np.where(gone, fill, x)
    z = np.concatenate([z, gone[:, gap_columns]], 1)
    z = (z - z[rows].mean(0)) / np.where(z[rows].std(0) > 0, z[rows].std(0), 1)
    z1 = np.concatenate([z, np.ones((len(z), 1))], 1)
    n, n1 = len(rows), y[rows].sum()
    w = times * np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    b, penalty = np.zeros(z1.shape[1]), np.r_[np.ones(z.shape[1]), 0]
    for _ in range(100):
        q = 1 / (1 + np.exp(-z1 @ b))
        b = b - np.linalg.solve(c * z1.T @ (z1 * (w * q * (1 - q))[:, None]) + np.diag(penalty), c * z1.T @ (w * (q - y)) + penalty * b)
    return b, 1 / (1 + np.exp(-z1 @ b))


def test_newton_is_that_of_single_fits(spark):
    x, y = table(gaps=0.1)
    rng = np.random.default_rng(1)
    times = {d: rng.integers(0, 3, len(x)) for d in range(3)}
    roles = {d: [(i, int(t), True) for i, t in enumerate(ts) if t] + [(i, 1, False) for i in range(0, len(x), 7)] for d, ts in times.items()}
    w, m = frames(spark, x, y, roles)
    plans = {k: fits.Plan(d, fits.Logistic(c, least_missing=least), tuple(range(6))) for k, (d, c, least) in enumerate([(0, 0.003, None), (0, 0.3, None), (1, 0.03, 0.01), (2, 5.0, None)])}
    made = fits.newton(w, m, plans)
    got = {(r["fit"], r["unit_id"]): r["s"] for r in fits.scores(w, m, plans).collect()}
    for k, plan in plans.items():
        b, s = plain_logistic(x, y, times[plan.data], plan.spec.c, range(6) if plan.spec.least_missing else ())
        assert np.abs(made[k][1] - b).max() < 1e-6
        assert max(abs(got[k, i] - s[i]) for i in range(0, len(x), 7)) < 1e-6
    weights = {r["sensor_id"]: r["importance"] for r in fits.importances(w, m, plans).filter("fit = 1").collect()}
    assert np.allclose([weights[j] for j in range(6)], np.abs(made[1][1][:6]))


def plain_tree_purity(codes, y, times, leaf):
    """The best first cut by trying all."""
    n1, n = (times * y).sum(), times.sum()
    w = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1))) * times
    best = -1.0
    for j in range(codes.shape[1]):
        for c in range(codes[:, j].max()):
            low = codes[:, j] <= c
            if min((times[low] > 0).sum(), (times[~low] > 0).sum()) >= leaf:
                best = max(best, sum(((w * (y == k))[s].sum()) ** 2 / w[s].sum() for s in (low, ~low) for k in (0, 1)))
    return best


@pytest.mark.parametrize("leaf", [1, 7])
def test_trees_cut_where_it_is_best_and_end_in_leaves(leaf):
    x, y = table(300, 2)
    x = x[:, :1]
    codes = trees.binned(x, [trees.borders(c) for c in x.T], trees.medians(x))
    seeds = trees.Forest(seed=3).tree_seeds(0, 5)
    times = trees.drawn(np.arange(300, dtype=np.uint64), seeds)
    assert abs(times.mean() - 1) < 0.1
    w0, w1 = trees.class_weights(times.sum(1, dtype=np.int64), (times * y).sum(1))
    made = trees.grown(codes, y, times, seeds, w0, w1, leaf)
    for t in range(5):
        n, n1 = times[t].sum(), (times[t] * y).sum()
        before = n / 2  # both classes weigh half, so that the purity of the root is n / 2
        assert np.isclose(made.gain[t] + before, plain_tree_purity(codes, y, times[t].astype(int), leaf)) and 0 < n1 < n
        node = np.full(300, t)
        while (made.feature[node] >= 0).any():
            inner = made.feature[node] >= 0
            node = np.where(inner, np.where(codes[np.arange(300), np.maximum(made.feature[node], 0)] <= made.cut[node], made.left[node], made.right[node]), node)
        for leaf_node in np.unique(node):
            own = (node == leaf_node) & (times[t] > 0)
            assert own.sum() >= leaf
            if leaf == 1:
                assert len(np.unique(y[own])) == 1 or len(np.unique(codes[own], axis=0)) == 1
        assert np.allclose(made.score(codes)[t], made.value[node])
    # cells by counting and by sorting are the same
    key = np.random.default_rng(0).integers(0, 50, 400)
    draws, ones = np.ones(400, np.int64) * 2, (key % 3).astype(np.int64)
    assert all((a == b).all() for a, b in zip(trees.cells(key, draws, ones, 50), trees.cells(key, draws, ones, 10**7), strict=True))


def auc(y, s):
    rank = np.argsort(np.argsort(s)) + 1
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_forests_and_boosted_trees_side_by_side(spark):
    """Held-out scores; the same whatever the number of partitions and tasks."""
    x, y = table(700, 6, 0.05, 2)
    roles = {d: [(i, 1, i % 3 != d) for i in range(len(x))] for d in range(2)}
    w, m = frames(spark, x, y, roles)
    plans = {0: fits.Plan(0, trees.Forest(60), (0, 1, 2, 3, 4, 5)), 1: fits.Plan(1, trees.Forest(60, 1), (0, 1)), 2: fits.Plan(0, trees.Boosted(40), (0, 1, 2)), 3: fits.Plan(1, fits.Majority(), (0,)), 4: fits.Plan(0, fits.Logistic(), (0, 1))}
    got = fits.scores(w, m, plans)
    rows = {(r["fit"], r["unit_id"]): r["s"] for r in got.collect()}
    found = {r["fit"]: r["auc"] for r in kernels.roc_auc(got, ["fit"], "s").collect()}
    assert found[3] == 0.5 and min(found[k] for k in (0, 1, 2, 4)) > 0.75, found
    again = {(r["fit"], r["unit_id"]): r["s"] for r in fits.scores(w.repartition(7), m.repartition(3), {0: plans[0]}).collect()}
    assert all(abs(rows[k] - s) < 1e-12 for k, s in again.items()) and len(again) == len([k for k in rows if k[0] == 0])
    gains = {(r["fit"], r["sensor_id"]): r["importance"] for r in fits.importances(w, m, plans).collect()}
    assert max(range(6), key=lambda j: gains[0, j]) == 0 and abs(sum(gains[0, j] for j in range(6)) - 1) < 1e-9
    plain = kernels.roc_auc(fits.scores(w, m, plans, swaps=1), ["fit", "swap", "rep"], "s", weight="times")
    inside = {(r["fit"], r["swap"]): r["auc"] for r in fits.aucs(w, m, plans | {k: plans[4] for k in range(5, 40)}, swaps=1).collect()}
    assert all(abs(inside[r["fit"], r["swap"]] - r["auc"]) < 1e-12 for r in plain.collect()) and inside[39, -1] == inside[4, -1]
    swapped = kernels.roc_auc(fits.scores(w, m, {0: plans[0], 4: plans[4]}, swaps=2), ["fit", "swap", "rep"], "s", weight="times").groupBy("fit", "swap").agg(F.avg("auc").alias("auc")).collect()
    fall = {(r["fit"], r["swap"]): r["auc"] for r in swapped}
    assert fall[0, -1] - fall[0, 0] > 0.1 and fall[4, -1] - fall[4, 0] > 0.1 and abs(fall[0, -1] - fall[0, 5]) < 0.05


def test_boosted_trees_use_what_is_missing():
    """A value that is missing more often in failures tells them apart, and each tree has at most so many leaves."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 1500)
    x = rng.normal(size=(1500, 2))
    x[rng.random(1500) < np.where(y == 1, 0.6, 0.1), 0] = np.nan
    codes = trees.binned(x, [trees.borders(c) for c in x.T], None)
    made, start = trees.boost(codes[:1000], y[:1000], np.ones(1000), trees.Boosted(30))
    assert auc(y[1000:], trees.boosted_scores(codes[1000:], made, start)) > 0.7
    assert all((t[0] < 0).sum() <= 15 for t in made) and any((t[0] < 0).sum() == 15 for t in made)
    # a plain model of one split a round: the gain and the side of what is missing against all candidates
    g, h = 0.5 - y[:1000], np.full(1000, 0.25)
    found = trees.best_split(trees.histogram(codes[:1000], np.arange(1000), (g, h)), 20, 1.0)
    best = 0.0
    for j in range(2):
        for c in range(255):
            for side in (False, True):
                low = np.where(codes[:1000, j] == 255, side, codes[:1000, j] <= c)
                if min(low.sum(), (~low).sum()) >= 20:
                    best = max(best, sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + 1))
    assert np.isclose(found[0], best)


def test_cells_of_a_node_are_the_same_counted_and_sorted():
    """Rows, draws and draws of class 1 up to each bin, for dense nodes and for small ones."""
    rng = np.random.default_rng(7)
    n, width = 40, 16
    q, code = np.sort(rng.integers(0, n, 20_000)), rng.integers(0, width, 20_000).astype(np.uint8)
    q[:n] = np.arange(n)
    draws, ones = rng.integers(1, 9, 20_000), rng.integers(0, 2, 20_000)
    number = np.arange(32)
    worth = trees.packed(np.ones_like(number), number >> 1, (number >> 1) * (number & 1))
    token, size = (2 * draws + ones).astype(np.uint8), np.bincount(q, minlength=n)
    counted = trees.lows(q, code, token, worth, size, width)
    few = rng.permutation(20_000)[:300]
    few = np.concatenate([few, np.arange(n)])
    other = trees.lows(q[few], code[few], token[few], worth, np.bincount(q[few], minlength=n), width)
    for (node, at, low), own in ((counted, np.arange(20_000)), (other, few)):
        for i, j, total in zip(node.tolist(), at.tolist(), low, strict=True):
            here = own[(q[own] == i) & (code[own] <= j)]
            assert [int(x) for x in trees.unpacked(total)] == [len(here), draws[here].sum(), (draws * ones)[here].sum()]
        assert len(node) == len(set(zip(q[own].tolist(), code[own].tolist(), strict=True)))
