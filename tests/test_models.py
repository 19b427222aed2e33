"""The model queries on the smallest tables: every sensor, every fold, and what comes out. Grids are made smaller here."""

import pytest
from pyspark.sql import functions as F

from lotwise.operators import evaluation, fits, graph, loop, models, resampling, spread, trees
from lotwise.plans import compared, decided
from lotwise.sources.synthetic import causes, synthetic

SF = "/root/testdata/sf0.001"


def test_defaults_are_whole():
    assert models.forest() == trees.Forest(500, 5) and models.boosted() == trees.Boosted(200, 0.05, 15, 20, 1.0)
    assert {s.leaf for s in models.FORESTS.values()} == {1, 5, 10} and {s.trees for s in models.FORESTS.values()} == {500}
    assert {(s.rate, s.leaves, s.rounds) for s in models.BOOSTED.values()} == {(r, k, 200) for r in (0.03, 0.05, 0.1) for k in (7, 15, 31)}


@pytest.mark.parametrize("name", ["perm_importance", "logreg_screen"])
def test_model_queries_take_every_sensor(spark, name):
    got = getattr(compared, name)(spark, SF).collect()
    assert [r.rnk for r in got] == list(range(1, len(got) + 1)) and len(got) == (64 if name == "perm_importance" else 20)
    assert all(a.score >= b.score for a, b in zip(got, got[1:]))


def test_adversarial_validation_scores_every_unit(spark, monkeypatch):
    """Late events that differ are told from early ones, events at random aren't; both in all folds."""
    monkeypatch.setattr(models, "FORESTS", {f"leaf_{k}": trees.Forest(20, k) for k in (1, 10)})
    seen, aucs = [], fits.aucs

    def look(wide, members, plans, swaps=0):
        out = aucs(wide, members, plans, swaps)
        seen.append((plans, members))
        return out

    monkeypatch.setattr(fits, "aucs", look)
    got = {r.labels: r for r in compared.adversarial_validation(spark, SF).collect()}
    assert {k: r.n_folds for k, r in got.items()} == {"era": 15, "control": 15} and abs(got["control"].auc - 0.5) < 0.1
    (inner, _), (outer, members) = seen
    assert len(inner) == 30 * 3 * 2 and len(outer) == 30
    units = spark.read.parquet(f"{SF}/events.parquet").count()
    assert members.filter("not train").count() == 6 * units  # once a repetition and labelling


def test_held_out_aucs_find_a_shift(spark, monkeypatch):
    x = graph.checkpointed(synthetic(spark, 300, 6, 2, 0.3, 0.05, 3))
    labels = x.select("unit_id", "y").distinct().selectExpr("'real' AS world", "unit_id", "y")
    moved = resampling.permuted_labels(labels.select("unit_id", "y"), 1).selectExpr("'random' AS world", "unit_id", "y")
    got = models.held_out_aucs(x.drop("y"), graph.checkpointed(labels.unionByName(moved)), {"a": trees.Forest(30, 1), "b": trees.Forest(30, 10)}, 3, 2).collect()
    mean = {w: sum(r.auc for r in got if r.world == w) / 6 for w in ("real", "random")}
    assert len(got) == 12 and mean["real"] > 0.7 and 0.35 < mean["random"] < 0.65


def test_tuning_takes_the_best(spark):
    x = graph.checkpointed(synthetic(spark, 300, 6, 2, 0.3, 0.05, 3))
    best, made, means = models.tuned(x, {"none": trees.Forest(3, 200), "some": trees.Forest(40, 5)})
    assert best == "some" and means["none"] == 0.5 < means["some"] and made.spec == trees.Forest(40, 5)
    found = {r["unit_id"]: r["s"] for r in made.score(x).collect()}
    assert len(found) == 300 and models.auc_of(made.score(x)) > 0.8
    assert max(made.importance(), key=made.importance().get) in causes(6, 2)
    assert all(a > 0.6 for a in models.cv_auc(x, models.logistic(), 3))


def test_arms_of_loops_and_grids_see_the_same_folds(spark, monkeypatch):
    """Tuned arms and arms of the loop; on permuted labels they score like chance."""
    x = graph.checkpointed(synthetic(spark, 240, 8, 2, 0.3, 0.05, 2))
    units = x.select("unit_id", "y").distinct()
    small = loop.Config(base="logreg", screen="univariate", n_screen=8, n_screen_boot=8, select_k=3, n_boot=3, n_inner=3)
    arms = {"tuned": models.tuned_arm(models.LOGISTICS), "agent": models.Arm(models.logistic(), loop=small), "top": models.Arm(models.logistic(), top=2), "majority": models.arms()["majority"]}
    folds = evaluation.fold_roles(resampling.stratified_folds(units, 3), 3)
    got = evaluation.records(loop.cross_validated(x, folds, arms, ["rep", "fold"]), ["arm", "rep", "fold"]).collect()
    assert len(got) == 12 and len({(r.fold, r.n_test, r.n_fail) for r in got}) == 3
    assert all(r.auc > 0.7 for r in got if r.arm in ("tuned", "agent", "top"))
    moved = resampling.permuted_labels(units, 1, "canary").select("unit_id", "y")
    y = graph.checkpointed(x.drop("y").join(moved, "unit_id"))
    null = evaluation.records(loop.cross_validated(y, evaluation.fold_roles(resampling.stratified_folds(moved, 3), 3), {"agent": arms["agent"]}, ["rep", "fold"]), ["arm"]).first()
    assert 0.35 < null.auc < 0.65


def test_rankers_agree_over_resamples(spark):
    x = graph.checkpointed(synthetic(spark, 300, 10, 2, 0.3, 0.05, 2))
    boots = resampling.bootstrap(x.select("unit_id", "y").distinct(), 4)
    members = graph.checkpointed(boots.selectExpr("rep AS data", "unit_id", "y", "CAST(mult AS INT) AS times", "true AS train"))
    cfg = loop.Config(base="logreg", screen="univariate", n_screen=6, n_screen_boot=6, select_k=3, n_boot=2, n_inner=1)
    names = ["univariate", "logreg_coef", "perm_only", "agent", "agent_no_corr", "agent_model"]
    got = {r.ranker: r for r in loop.ranker_stability(x, members, names, 2, cfg).collect()}
    assert set(got) == set(names) and all(r.n_pairs == 6 and r["mean"] > 0.5 for r in got.values())


def test_large_fits_are_left_to_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(fits, "LARGE", 100)
    monkeypatch.setattr(fits.spread, "DEPTH", 8)
    x = graph.checkpointed(synthetic(spark, 300, 4, 1, 0.3, 0.05, 3))
    for spec in (trees.Forest(10), trees.Boosted(5)):
        made = models.fit(x, spec)
        assert models.auc_of(made.score(x)) > 0.7 and abs(sum(made.importance().values()) - 1) < 1e-6


def test_large_fits_have_permutation_importances(spark, monkeypatch):
    """Beyond the rows of a group: a cause's fall of AUC is found, and values change places without getting lost."""
    monkeypatch.setattr(fits, "LARGE", 100)
    monkeypatch.setattr(fits.spread, "DEPTH", 8)
    x = graph.checkpointed(synthetic(spark, 300, 4, 1, 0.3, 0.05, 3))
    for spec in (trees.Forest(10), trees.Boosted(5)):
        found = models.permutation_importance(x, spec, [0, 1, 2, 3], 2, 2)
        assert set(found) == {0, 1, 2, 3} and max(found, key=found.get) in causes(4, 1) and max(found.values()) > 0.05
    wide, members = fits.wide(x), models.everyone(x).withColumn("train", F.col("unit_id") % 3 > 0)
    _, rest = spread.fitted(wide, members, fits.Plan(0, trees.Boosted(2), (0, 2, 3)))
    rest = graph.checkpointed(rest)
    before = [(r.unit_id, list(r.features)) for r in rest.collect()]
    after = spread.swapped(rest, (0, 2, 3), 2).collect()
    assert len(after) == 6 * len(before)
    for j, sensor in enumerate((0, 2, 3)):
        for rep in range(2):
            own = {r.unit_id: list(r.features) for r in after if r.swap == sensor and r.rep == rep}
            assert sorted(v[j] for v in own.values()) == sorted(v[j] for _, v in before)
            assert sum(own[u][j] != v[j] for u, v in before) > len(before) / 2
            assert all(own[u][i] == v[i] for u, v in before for i in range(3) if i != j)


def test_headline_arms_are_registered():
    every = models.arms() | loop.arms()
    assert set(decided.HEADLINE) <= set(every) and set(decided.CV_ARMS) <= set(every)
    assert every["rf_all"].grid and every["agent_rf"].loop.base == "rf"


def test_sweeps_go_on_where_they_were(spark, tmp_path, monkeypatch):
    x = graph.checkpointed(synthetic(spark, 200, 6, 2, 0.3, 0.05, 2))
    roles = graph.checkpointed(evaluation.fold_roles(resampling.stratified_folds(x.select("unit_id", "y").distinct(), 2), 2))
    base = {"base": "logreg", "screen": "univariate", "attribution": "model", "n_screen": 6, "n_screen_boot": 6, "n_boot": 2, "n_inner": 1}
    configs = [loop.Config(**base, select_k=k, stability_min=s) for k in (2, 3) for s in (0.3, 0.6)]
    made, evidence = [], loop.evidence

    def look(readings, members, cfg, *rest):
        made.append(sorted(r[0] for r in members.select("data").distinct().collect()))
        return evidence(readings, members, cfg, *rest)

    monkeypatch.setattr(loop, "evidence", look)
    key = lambda rows: sorted(tuple(r) for r in rows.collect())
    first = key(loop.sweep(x, roles.filter("fold = 0"), configs[:3], f"{tmp_path}/sweep", ["rep", "fold"]))
    assert len(first) == 3 and made == [[0]]  # three configurations share their fits
    whole = key(loop.sweep(x, roles, configs, f"{tmp_path}/sweep", ["rep", "fold"]))
    assert len(whole) == 8 and set(first) <= set(whole) and made[1:] == [[0, 1]]
    assert key(loop.sweep(x, roles, configs, f"{tmp_path}/sweep", ["rep", "fold"])) == whole and len(made) == 2


def test_forests_of_many_rows_are_those_of_few(spark, monkeypatch):
    """Grown from bins beyond the rows that a block holds as values: the same trees, scores and falls, none by pyspark.ml."""
    x = synthetic(spark, 300, 4, 1, 0.3, 0.05, 3).filter("sensor_id <> 2 or unit_id % 3 > 0")
    x = graph.checkpointed(x.withColumn("value", F.round("value", 1)))  # few values, so that cuts are exact
    wide = graph.checkpointed(fits.wide(x))
    filled = graph.checkpointed(x.select("unit_id", "y").distinct().select(F.explode(F.array(F.lit(0), F.lit(1))).alias("data"), "unit_id", "y"))
    members = graph.checkpointed(filled.select("data", "unit_id", "y", (1 + F.col("unit_id") % 2).cast("int").alias("times"), (F.col("unit_id") % 4 > F.col("data")).alias("train")))
    plans = {0: fits.Plan(0, trees.Forest(20), (0, 1, 3)), 1: fits.Plan(1, trees.Forest(20, 1), (0, 1)), 2: fits.Plan(0, trees.Forest(9), (3,))}
    monkeypatch.setattr(fits.spread, "fitted", lambda *a: 1 / 0)
    found = []
    for large in (fits.LARGE, 100):
        monkeypatch.setattr(fits, "LARGE", large)
        scores = {(r.fit, r.swap, r.rep, r.unit_id): round(r.s, 9) for r in fits.scores(wide, members, plans, 1).collect()}
        found.append((scores, {(r.fit, r.sensor_id): round(r.importance, 9) for r in fits.importances(wide, members, plans).collect()}))
    assert found[0][1] == found[1][1] and len(found[0][1]) == 6
    assert found[0][0] == found[1][0] and {k[0] for k in found[0][0]} == {0, 1, 2} and len({k[1] for k in found[0][0]}) == 4
