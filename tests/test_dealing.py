"""Trees that are grown together, in parts or on arrays that are used again, against plain ones."""

import numpy as np
import pytest

from lotwise.operators import fits, trees


@pytest.mark.parametrize("leaves", [(1, 5, 10), (1, 2), (3,)])
def test_forests_of_several_leaves_are_those_grown_alone(leaves):
    """Few bins, ties, rows that are missing from a tree and labels without a signal, so that cuts part early and late."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, [2, 7, 255, 30, 255], (700, 5)).astype(np.uint8)
    y = (codes[:, 2] + rng.normal(0, 90, 700) > 150).astype(np.int64)
    seeds = trees.Forest().tree_seeds(0, 6)
    times = trees.drawn(trees.mixed(np.arange(700, dtype=np.uint64)), seeds)
    w0, w1 = trees.class_weights(times.sum(1, dtype=np.int64), (times * y).sum(1))
    together = trees.grown_alike(codes, y, times, seeds, w0, w1, leaves)
    for leaf, found in zip(leaves, together, strict=True):
        alone = trees.grown(codes, y, times, seeds, w0, w1, leaf)
        for name in ("feature", "cut", "left", "right", "value", "gain", "tree"):
            np.testing.assert_array_equal(getattr(found, name), getattr(alone, name))
        # every leaf has at least so many rows
        scores = found.score(codes)
        for tree, drawn in zip(scores, times, strict=True):
            assert all((drawn[tree == v] > 0).sum() >= leaf for v in np.unique(tree))
    assert len({len(t.feature) for t in together}) == len(leaves)


def test_no_core_has_a_forest_to_itself():
    """Forests beside many small fits are cut by what there is to do, with all their trees, and grids are made together."""
    sizes = {d: 20_000 * (d + 1) for d in range(4)}
    specs = [fits.Majority(), fits.Logistic(), trees.Forest(500, 5), fits.Logistic(0.3), trees.Forest(500, 1)]
    plans = {i: fits.Plan(i % 4, specs[i // 4], (0, 1, 2, 3)) for i in range(20)}
    tasks = fits.tree_tasks(plans, sizes, 24)
    whole = sum(e for *_, e in tasks.values())
    assert max(e for *_, e in tasks.values()) <= whole / 24
    for f, p in plans.items():
        own = sorted((first, n) for alike, first, n, _ in tasks.values() if f in alike)
        assert sum(n for _, n in own) == (500 if isinstance(p.spec, trees.Forest) else 1)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    assert {alike for alike, *_ in tasks.values()} >= {(8, 16), (9, 17), (10, 18), (11, 19)}
    blocks = fits.dealt({t: (plans[alike[0]].data, plans[alike[0]].sensors, e) for t, (alike, _, _, e) in tasks.items()}, sizes, 24, 100_000)
    assert sorted(t for own in blocks.values() for t in own) == sorted(tasks)
    assert max(sum(tasks[t][3] for t in own) for own in blocks.values()) <= 2 * whole / 24


@pytest.mark.parametrize("kept", [True, False])
def test_cuts_of_histograms_that_share_arrays(monkeypatch, kept):
    """Of one node after another, with missing values and without, the best cut is that of all cuts tried one by one."""
    monkeypatch.setattr(trees, "PLACED", 1 << 23 if kept else 0)
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 12, (300, 4)).astype(np.uint8)
    codes[rng.random(codes.shape) < 0.2] = trees.MISSING
    codes[:, 1] = rng.integers(0, 255, 300)
    g, h = rng.normal(size=300) + (codes[:, 2] > 5), rng.random(300) + 0.1
    spec = trees.Boosted(least=15)
    shared = trees.Histograms(codes, spec)
    assert (shared.places is not None) == kept
    for rows in (np.arange(300), np.flatnonzero(codes[:, 0] < 6), np.flatnonzero(codes[:, 1] > 100), np.arange(20)):
        sums, counts = shared.of(rows, g, h)
        assert (counts.sum(1) == len(rows)).all()
        score = lambda own: g[own].sum() ** 2 / (h[own].sum() + spec.l2)
        best = 0.0
        for j in range(4):
            for cut in range(trees.MISSING):
                for missing_left in (False, True):
                    low = np.where(codes[rows, j] == trees.MISSING, missing_left, codes[rows, j] <= cut)
                    if min(low.sum(), (~low).sum()) >= spec.least:
                        best = max(best, score(rows[low]) + score(rows[~low]) - score(rows))
        gain, j, cut, missing_left = shared.best(sums, counts)
        assert gain == pytest.approx(best)
        if j >= 0:
            low = np.where(codes[rows, j] == trees.MISSING, missing_left, codes[rows, j] <= cut)
            assert score(rows[low]) + score(rows[~low]) - score(rows) == pytest.approx(best)
