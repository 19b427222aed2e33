"""What blocks find side by side against plain jobs of one data number."""

import numpy as np
from pyspark.sql import functions as F

from lotwise.operators import cleaning, fits, graph, loop, models, trees


def odd_readings(spark):
    """Missing values, absent readings, constants, copies that hold on some rows only, and -0.0 beside 0.0."""
    rng = np.random.default_rng(4)
    rows = []
    for u in range(240):
        a = float(rng.normal())
        cells = [a, a if u < 160 else a + 1, 3.0 if u < 80 else a, None if u < 160 else 1.0 * (u % 3), a if u % 4 else None, a * a + 0.01 * float(rng.normal()), 0.0 if u % 2 else 1.0, -0.0 if u % 2 else 1.0, float(rng.integers(0, 3))]
        rows += [(u, s, v) for s, v in enumerate(cells) if s != 8 or u % 5]
    return graph.checkpointed(spark.createDataFrame(rows, "unit_id long, sensor_id int, value double"))


def members_of(spark):
    rng = np.random.default_rng(5)
    rows = [(d, u, int((u * 7 + d) % 5 == 0), int(rng.integers(1, 4)), u % 6 != d) for d, own in enumerate((range(80), range(160), range(240), range(60, 240))) for u in own]
    return graph.checkpointed(spark.createDataFrame(rows, "data int, unit_id long, y int, times int, train boolean"))


def test_cleaning_ranking_and_groups_are_those_of_plain_jobs(spark, monkeypatch):
    x, members = odd_readings(spark), members_of(spark)
    suspects = spark.createDataFrame([(d, s) for d in range(4) for s in (0, 1, 2, 4, 5, 8)], "data int, sensor_id int")
    found = []
    for large in (fits.LARGE, 200, 1):  # in blocks, some of them, none of them
        monkeypatch.setattr(fits, "LARGE", large)
        kept = models.kept_sensors(x, members)
        scores = {(r.data, r.sensor_id): r.score for r in models.univariate_of(x, members, kept).collect()}
        groups = {(r.data, r.sensor_id): r.cluster_id for r in loop.groups_of(x, members, suspects, 0.6).collect()}
        found.append((kept, models.kept_sensors(x, members, 0.8), scores, groups, models.best_sensors(x, members, kept, 3)))
    assert found[0] == found[1] == found[2]
    kept, _, scores, groups, _ = found[0]
    assert kept[0] != kept[2] and len(scores) == sum(len(s) for s in kept.values()) and groups[0, 1] == 0 and len(groups) == 24


def test_a_unit_moves_once_a_block(spark, monkeypatch):
    """However many fits a unit is in: blocks have its values once, so that rows don't grow with the fits."""
    seen, placed = [], fits.placed

    def look(*args):
        seen.append(graph.checkpointed(placed(*args)))
        return seen[-1]

    monkeypatch.setattr(fits, "placed", look)
    x, members = odd_readings(spark), members_of(spark)
    wide = graph.checkpointed(fits.wide(x))
    plans = {i: fits.Plan(i % 4, fits.Logistic(0.01 * (i + 1)) if i % 2 else trees.Boosted(2), (0, 4, 5)) for i in range(400)}
    assert fits.aucs(wide, members, plans).count() == 400
    rows = seen[0].groupBy("block").agg(F.count("*").alias("n"), F.count_distinct("unit_id").alias("k")).collect()
    assert all(r.n == r.k for r in rows) and sum(r.n for r in rows) <= 240 * (fits.BLOCKS_A_CORE * 8 + 1)
    assert len(rows) <= fits.BLOCKS_A_CORE * 8 + 1


def test_swapped_scores_are_those_of_swapped_rows():
    """Only ways that meet the column are gone again; what comes out is the score of the whole row."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 70))
    x[rng.random(x.shape) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 66]) + rng.normal(size=500) > 0.5).astype(int)
    cuts, fill = [trees.borders(c) for c in x.T], trees.medians(x)
    seeds = trees.Forest().tree_seeds(0, 7)
    times = trees.drawn(np.arange(500, dtype=np.uint64), seeds)
    forest = trees.Scorer(cuts, fill, [trees.grown(trees.binned(x, cuts, fill), y, times, seeds, *trees.class_weights(times.sum(1, dtype=np.int64), (times * y).sum(1)), 3)])
    made, start = trees.boost(trees.binned(x, cuts, None), y, np.ones(500), trees.Boosted(20))
    boosted = trees.Scorer(cuts, None, [trees.flat(made)], start)
    assert np.allclose(next(boosted.scores(x, []))[2], trees.boosted_scores(trees.binned(x, cuts, None), made, start), atol=1e-12)
    for scorer in (forest, boosted):
        moves = [(j, j, rep, rng.permutation(500)) for j in (0, 2, 66) for rep in range(2)]
        for (j, _, _, order), (_, _, s) in zip(moves, list(scorer.scores(x, moves))[1:], strict=True):
            other = x.copy()
            other[:, j] = x[order, j]
            assert (next(scorer.scores(other, []))[2] == s).all()


def test_bootstraps_drawn_in_blocks_are_those_drawn_as_rows(spark, monkeypatch):
    """Multiplicities, and all that a loop by models finds, with units that count several times."""
    x, members = odd_readings(spark), members_of(spark)
    wide, again = graph.checkpointed(fits.wide(x)), fits.Again("loop")

    def work(data, block, place):
        parts = [(data * 256 + rep, *again.drawn(block, data * 256 + rep)) for rep in range(6)]
        rows = [(n, block.unit[int(r)].as_py(), int(y), int(t)) for n, row, ys, times, _ in parts for r, y, t in zip(row, ys, times, strict=True)]
        return dict(zip(("data", "unit_id", "y", "times"), map(list, zip(*rows, strict=True)), strict=True))

    drawn = fits.by_data(wide, members.filter("train"), "data long, unit_id long, y long, times long", work)
    plain = loop.drawn_again(members, 6, "loop").select("data", "unit_id", "y", "times")
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, plain.collect()))
    assert loop.good_draws(wide, members, 6, again) == sorted(r[0] for r in plain.select("data").distinct().collect())
    for base, screen in (("logreg", "multivariate"), ("rf", "model")):
        monkeypatch.setitem(models.BASES, "rf", trees.Forest(8))
        cfg = loop.Config(base=base, screen=screen, attribution="model", n_screen=4, n_screen_boot=3, n_boot=4)
        kept = models.kept_sensors(x, members)
        first, votes, boots = loop.ranked_by_models(wide, members, kept, cfg)
        key = lambda rows, *names: {tuple(r[n] for n in names): round(r.importance, 7) for r in rows.collect()}
        assert key(first, "data", "sensor_id") == key(loop.ranked(x, wide, members, kept, cfg, 4, 3, 3, "loop"), "data", "sensor_id")
        rows = graph.checkpointed(loop.drawn_again(members, 4, "loop"))
        assert boots == sorted(r[0] for r in rows.select("data").distinct().collect())
        other = loop.ranked(x, wide, rows, {b: kept[b // 256] for b in boots}, cfg, 3, 1, 2, "loopb")
        other = other.select(F.floor(F.col("data") / 256).alias("data"), (F.col("data") % 256).alias("rep"), "sensor_id", "importance")
        assert key(votes, "data", "rep", "sensor_id") == key(other, "data", "rep", "sensor_id")


def test_configurations_of_a_sweep_are_scored_together(spark, tmp_path, monkeypatch):
    """One job of base models for all that share their evidence, each with its own records."""
    x = odd_readings(spark)
    units = spark.range(240).select(F.col("id").alias("unit_id"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    x = graph.checkpointed(x.join(units, "unit_id"))
    roles = graph.checkpointed(units.select(F.lit(0).alias("fold"), "unit_id", F.when(F.col("unit_id") % 3 == 0, "test").otherwise("train").alias("role")))
    base = {"base": "logreg", "attribution": "model", "n_boot": 2}
    configs = [loop.Config(**base, corr_threshold=c, max_select=m) for c in (0.6, 1.01) for m in (1, 6)]
    calls, scores = [], fits.scores
    monkeypatch.setattr(fits, "scores", lambda *a, **k: calls.append(1) or scores(*a, **k))
    got = {r.config: r for r in loop.sweep(x, roles, configs, f"{tmp_path}/sweep", ["fold"]).collect()}
    assert len(calls) == 1 and set(got) == {loop.key_of(c) for c in configs}
    assert [got[loop.key_of(c)].n_selected for c in configs][::2] == [1, 1] and got[loop.key_of(configs[3])].n_selected >= got[loop.key_of(configs[1])].n_selected
