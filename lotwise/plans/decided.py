"""Queries over what is decided: verdicts of the loop, null records, ladders of variants, designs, claims and arms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotwise.operators import calibration, cleaning, evaluation, graph, loop, models, periods, reporting, resampling, stability
from lotwise.plans import calibrated, sql
from lotwise.plans.basics import COMP, CUT, ORACLES, correlated, query, r
from lotwise.plans.calibrated import CLUSTER, CLUSTERS, DEPTHS, SUP, supports
from lotwise.plans.compared import ARMS, PAIRS, SCORES, T9, fold_records
from lotwise.plans.timed import BPERMS, HET, INV, TB
from lotwise.sources import adapters, runs

BOOTS, CHOOSE, FIRST = 12, 10, 5
CFG = loop.Config(stability_min=0.5, select_k=CHOOSE, top_k=FIRST, max_select=6, report_tau=0.75)

ORACLES["support_histogram"] = f"WITH {SUP} SELECT permuted, CAST(least(floor(support / (1e0 / 6)), 5) AS INTEGER) AS bin, count(*) AS n FROM su GROUP BY ALL"


@query(f"""WITH {sql.F1U}, o AS (SELECT unit_id, y, row_number() OVER (ORDER BY md5(concat_ws(':', 'order', unit_id)), unit_id) AS i, count(*) OVER () AS n FROM u),
dr AS (SELECT rep, {sql.draw("concat_ws(':', 'boot', rep, i)", "n")} + 1 AS i FROM o CROSS JOIN (SELECT unnest(range(200)) AS rep)), b0 AS (SELECT rep, unit_id, y, count(*) AS mult FROM dr JOIN o USING (i) GROUP BY rep, unit_id, y),
g AS (SELECT rep, row_number() OVER (ORDER BY rep) - 1 AS k FROM (SELECT rep FROM b0 GROUP BY rep HAVING sum(y * mult) >= (SELECT sum(y) FROM u)))
SELECT CAST(k AS INTEGER) AS rep, unit_id, y, mult FROM b0 JOIN g USING (rep) WHERE k < 8""")
def bootstrap_redrawn(spark, d):
    """Eight bootstraps with at least as many failures as there are: about half of the draws are rejected."""
    units = adapters.embedding_units(spark, d)
    return resampling.bootstrap_redrawn(units, 8, units.agg(F.sum("y")).first()[0])


@query(f"""WITH {SCORES}, rk AS (SELECT rep * 5 + fold AS rep, sensor_id FROM bs WHERE rnk <= 5), {calibrated.OVERLAP.format(t="rk", k=5)}""")
def fold_overlap(spark, d):
    """How far the first five sensors of training folds agree."""
    w = resampling.fold_replicates(adapters.embedding_units(spark, d), 5, 2)
    return stability.pairwise_overlap(stability.replicate_rankings(adapters.embedding_readings(spark, d), w, 5, ["rep"]), 5).select("n_pairs", r("mean"), r("sd", 7))


LOOP = f"""{sql.F1U}, {sql.F1R}, {sql.boot(BOOTS, 5)}, wr AS (SELECT b.rep, b.y, b.mult, r.sensor_id, r.value FROM r JOIN b USING (unit_id)), {sql.wauc("wa", "wr", "rep, sensor_id")},
vt AS (SELECT rep, sensor_id, row_number() OVER (PARTITION BY rep ORDER BY round(abs(auc - 0.5), 12) DESC, sensor_id) AS rnk FROM wa WHERE round(abs(auc - 0.5), 12) > 0), ne AS (SELECT count(DISTINCT rep) AS n FROM b),
tl AS (SELECT sensor_id, count_if(rnk <= {CHOOSE}) / CAST(any_value(n) AS DOUBLE) AS stability, count_if(rnk <= {FIRST}) / CAST(any_value(n) AS DOUBLE) AS stability_top FROM vt CROSS JOIN ne GROUP BY sensor_id), {CLUSTERS}, {sql.auc("ia", "r", "sensor_id")},
im AS (SELECT sensor_id, round(abs(auc - 0.5), 12) - 0.01e0 AS importance FROM ia),
i1 AS (SELECT *, row_number() OVER (ORDER BY importance DESC, sensor_id) AS place, (SELECT count(*) FROM im WHERE importance > 0) AS good FROM im),
i2 AS (SELECT sensor_id, importance, place, CASE WHEN good > 0 THEN importance > 0 AND place <= {3 * CFG.max_select} ELSE place <= {FIRST} END AS suspect FROM i1),
i3 AS (SELECT i2.*, cl.cluster_id, coalesce(tl.stability, 0) AS stability, coalesce(tl.stability_top, 0) AS stability_top FROM i2 JOIN cl USING (sensor_id) LEFT JOIN tl USING (sensor_id)),
i4 AS (SELECT *, suspect AND place = (SELECT min(z.place) FROM i3 z WHERE z.suspect AND z.cluster_id = i3.cluster_id) AS representative, CASE WHEN suspect THEN (SELECT count(*) FROM i3 z WHERE z.suspect AND z.cluster_id = i3.cluster_id) END AS n_members FROM i3),
i5 AS (SELECT *, (SELECT count(*) FROM i4 WHERE representative AND stability >= {CFG.stability_min}) = 0 AS fallback FROM i4),
i6 AS (SELECT *, representative AND (fallback OR stability >= {CFG.stability_min}) AS able FROM i5),
i7 AS (SELECT *, able AND (SELECT count(*) FROM i6 z WHERE z.able AND z.place <= i6.place) <= CASE WHEN fallback THEN 5 ELSE {CFG.max_select} END AS selected FROM i6)"""


@query(f"""WITH RECURSIVE {LOOP} SELECT sensor_id, round(importance, 9) AS importance, cluster_id, n_members, round(stability, 9) AS stability, round(stability_top, 9) AS stability_top, CAST(place AS INTEGER) AS place, suspect, representative, selected,
 representative AND stability >= {CFG.report_tau} AS reported, fallback FROM i7""")
def loop_verdicts(spark, d):
    """The loop's decisions on importances by |AUC - 0.5| less 0.01, with votes of bootstraps ranked alike."""
    x, units = adapters.embedding_readings(spark, d), adapters.embedding_units(spark, d)
    w = resampling.bootstrap(units, BOOTS, 5)
    votes = stability.replicate_rankings(x, w, 64, ["rep"]).select("rep", "sensor_id", F.col("score").alias("importance"))
    n = w.select("rep").distinct().count()
    support = loop.tally(votes, n, {"stability": CFG.select_k, "stability_top": CFG.top_k})
    ranked = cleaning.univariate(x).select("sensor_id", (F.col("score") - 0.01).alias("importance"))
    found = loop.verdicts(graph.checkpointed(ranked), graph.correlation_clusters(x, CLUSTER), graph.checkpointed(support), CFG)
    return found.select("sensor_id", r("importance"), "cluster_id", "n_members", r("stability"), r("stability_top"), "place", "suspect", "representative", "selected", "reported", "fallback")


@query(f"""WITH {SUP} SELECT world, permuted, CAST(count_if(support >= 0.5 - 1e-12) AS BIGINT) AS n_merit, CAST(count_if(support >= 0.8 - 1e-12) AS BIGINT) AS n_reported, round(max(support), 9) AS max_stability, count_if(support >= 0.5 - 1e-12) = 0 AS fallback_fired FROM su GROUP BY ALL""")
def loop_null(spark, d):
    return calibration.null_records(supports(spark, d), 0.5, 0.8).withColumn("max_stability", F.round("max_stability", 9))


LADDER = SUP.split("rk AS (SELECT world, rep, sensor_id FROM")[0] + f"""dp AS (SELECT CAST(unnest({list(DEPTHS)}) AS INTEGER) AS depth),
rk AS (SELECT depth, world, rep, sensor_id FROM (SELECT *, row_number() OVER (PARTITION BY world, rep ORDER BY round(abs(auc - 0.5), 12) DESC, sensor_id) AS rnk FROM wa) JOIN dp ON rnk <= depth), ne AS (SELECT world, count(*) AS n_eff FROM gd GROUP BY world),
su AS (SELECT depth, world, world < {calibrated.NULL} AS permuted, sensor_id, CAST(count(*) AS DOUBLE) / n_eff AS support FROM rk JOIN ne USING (world) GROUP BY depth, world, sensor_id, n_eff), mx AS (SELECT depth, world, permuted, max(support) AS m FROM su GROUP BY ALL),
ta AS (SELECT depth, quantile_cont(m, 0.9) AS tau FROM mx WHERE permuted GROUP BY depth),
lr AS (SELECT depth, tau, avg(CASE WHEN permuted THEN CAST(m < tau - 1e-12 AS DOUBLE) END) AS control, avg(CASE WHEN NOT permuted THEN CAST(m >= tau - 1e-12 AS DOUBLE) END) AS real FROM mx JOIN ta USING (depth) GROUP BY depth, tau)"""


@query(f"WITH {LADDER} SELECT depth, round(tau, 9) AS tau, round(control, 9) AS control, round(real, 9) AS real, round(control + real - 1, 9) AS separation FROM lr")
def variant_ladder(spark, d):
    return calibration.ladder(calibrated.support_ladder(spark, d), "depth", 0.1).select("depth", r("tau"), r("control"), r("real"), r("separation"))


@query(f"WITH {LADDER} SELECT (SELECT depth FROM lr ORDER BY round(control + real - 1, 12) DESC, depth LIMIT 1) AS separating, (SELECT depth FROM lr ORDER BY round(control, 12) DESC, depth LIMIT 1) AS controlled")
def best_variants(spark, d):
    return calibration.best_variants(calibration.ladder(calibrated.support_ladder(spark, d), "depth", 0.1), "depth")


@query(f"""WITH RECURSIVE {COMP.split(", ed AS")[0]}, th AS (SELECT unnest([0.13e0, 0.2e0, 0.9e0]) AS threshold), ed AS (SELECT threshold, a, b FROM co JOIN th ON round(abs(r), 9) >= threshold UNION ALL SELECT threshold, b, a FROM co JOIN th ON round(abs(r), 9) >= threshold),
reach(threshold, node, other) AS (SELECT DISTINCT threshold, sensor_id, sensor_id FROM f CROSS JOIN th UNION SELECT reach.threshold, reach.node, ed.b FROM reach JOIN ed ON reach.other = ed.a AND reach.threshold = ed.threshold),
cl AS (SELECT threshold, node, min(other) AS c FROM reach GROUP BY threshold, node), g AS (SELECT threshold, c, count(*) AS m FROM cl GROUP BY threshold, c)
SELECT threshold, CAST(sum(m) AS BIGINT) AS n_sensors, count(*) AS n_clusters, max(m) AS largest, CAST(coalesce(sum(CASE WHEN m > 1 THEN m END), 0) AS BIGINT) AS in_multi FROM g GROUP BY threshold""")
def cluster_thresholds(spark, d):
    """Sizes of the groups of correlated sensors at several thresholds, all cut from one spanning forest."""
    found = graph.clusters_at(graph.checkpointed(correlated(spark, d)), [CUT, 0.2, 0.9])
    g = found.groupBy("threshold", "cluster_id").agg(F.count("*").alias("m"))
    return g.groupBy("threshold").agg(F.sum("m").alias("n_sensors"), F.count("*").alias("n_clusters"), F.max("m").alias("largest"), F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m"))), F.lit(0)).cast("bigint").alias("in_multi"))


GATE_PERMS, GATE_ALPHA = 20, 0.2
GATE = f"""{INV}, ak AS (SELECT unit_id, sensor_id, y, rank() OVER (PARTITION BY sensor_id ORDER BY value) + (count(*) OVER (PARTITION BY sensor_id, value) - 1) / 2e0 AS rk FROM r WHERE value IS NOT NULL), am AS (SELECT sensor_id, count(*) AS m FROM ak GROUP BY sensor_id),
ax AS (SELECT CAST(unnest(range({GATE_PERMS})) AS INTEGER) AS rep), ao AS (SELECT y, row_number() OVER (ORDER BY md5(concat_ws(':', 'order', unit_id)), unit_id) AS i FROM u),
pu AS (SELECT rep, unit_id FROM (SELECT rep, unit_id, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws(':', 'perm', rep, unit_id)), unit_id) AS i FROM u CROSS JOIN ax) JOIN ao USING (i) WHERE y = 1),
z0 AS (SELECT -1 AS rep, sensor_id, count(*) AS n1, sum(rk) AS s FROM ak WHERE y = 1 GROUP BY sensor_id UNION ALL SELECT rep, sensor_id, count(*), sum(rk) FROM ak JOIN pu USING (unit_id) GROUP BY rep, sensor_id),
z1 AS (SELECT rep, sensor_id, n1, m - n1 AS n0, (s - n1 * (n1 + 1) / 2) / (CAST(n1 AS DOUBLE) * (m - n1)) AS auc FROM z0 JOIN am USING (sensor_id)), z3 AS (SELECT rep, sensor_id, round(abs(auc - 0.5) / {sql.hanley()}, 9) AS z FROM z1),
aq AS (SELECT a.sensor_id, (1 + count_if(b.z >= a.z)) / CAST({GATE_PERMS + 1} AS DOUBLE) AS p FROM z3 a JOIN z3 b ON a.sensor_id = b.sensor_id AND b.rep >= 0 WHERE a.rep = -1 GROUP BY a.sensor_id),
ab AS (SELECT sensor_id, least(min(p * m / i) OVER (ORDER BY p DESC, i DESC ROWS UNBOUNDED PRECEDING), 1) AS p_assoc FROM (SELECT *, row_number() OVER (ORDER BY p, sensor_id) AS i, count(*) OVER () AS m FROM aq)),
ib AS (SELECT sensor_id, least(min(p * m / i) OVER (ORDER BY p DESC, i DESC ROWS UNBOUNDED PRECEDING), 1) AS p_inv FROM (SELECT iv.sensor_id, iv.p, row_number() OVER (ORDER BY iv.p, iv.sensor_id) AS i, count(*) OVER () AS m FROM iv JOIN ab USING (sensor_id) WHERE p_assoc < {GATE_ALPHA})),
gt AS (SELECT sensor_id, p_assoc, p_assoc < {GATE_ALPHA} AS associated, p_inv, p_assoc < {GATE_ALPHA} AND coalesce(p_inv, 1) >= {GATE_ALPHA} AS invariant FROM ab LEFT JOIN ib USING (sensor_id)),
fo AS (SELECT unit_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', 'fold', 0, unit_id)), unit_id) - 1) % 5 AS INTEGER) AS own FROM u), kf AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold),
ft AS (SELECT fold, r.sensor_id, r.y, coalesce(r.value, 0) AS value FROM r JOIN fo USING (unit_id) JOIN kf ON fold <> own), {sql.auc("fa", "ft", "fold, sensor_id")},
fs AS (SELECT fold, sensor_id FROM fa QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(abs(auc - 0.5), 12) DESC, sensor_id) <= 2),
st AS (SELECT gt.*, coalesce(n, 0) AS folds, CAST(row_number() OVER (ORDER BY coalesce(n, 0) DESC, round(p_assoc, 12), sensor_id) AS INTEGER) AS place FROM gt LEFT JOIN (SELECT sensor_id, count(DISTINCT fold) AS n FROM fs GROUP BY sensor_id) USING (sensor_id))"""
ORACLES["invariance_gate"] = f"WITH {GATE} SELECT sensor_id, p_assoc, associated, p_inv, invariant FROM gt"


def gate_table(spark, d):
    x, u = adapters.event_readings(spark, d).drop("ts"), adapters.event_units(spark, d)
    gate = periods.gated(periods.association(x, u, GATE_PERMS), periods.invariance(x, u, 5, BPERMS), GATE_ALPHA)
    folds = resampling.stratified_folds(u.select("unit_id", "y")).select("unit_id", F.col("fold").alias("own"))
    train = x.join(folds, "unit_id").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("fold <> own")
    return periods.sensor_table(gate, cleaning.univariate_top(train, 2, ["fold"]))


@query(f"WITH {GATE} SELECT sensor_id, folds, round(p_assoc, 9) AS p_assoc, associated, round(p_inv, 9) AS p_inv, invariant, place FROM st")
def invariance_table(spark, d):
    return gate_table(spark, d).select("sensor_id", "folds", r("p_assoc"), "associated", r("p_inv"), "invariant", "place")


@query(f"""WITH {GATE}, gm AS (SELECT 'all' AS grp, * FROM st UNION ALL SELECT 'consensus', * FROM st WHERE place <= 2 AND folds > 0 UNION ALL SELECT 'half_of_folds', * FROM st WHERE folds >= 2.5 UNION ALL SELECT 'any_fold', * FROM st WHERE folds > 0
 UNION ALL SELECT 'associated_unselected', * FROM st WHERE associated AND folds = 0) SELECT grp, count(*) AS n, CAST(count_if(associated) AS BIGINT) AS n_associated, CAST(count_if(invariant) AS BIGINT) AS n_invariant FROM gm GROUP BY grp""")
def invariance_groups(spark, d):
    return periods.described(gate_table(spark, d), 5, 2)


DESIGN = {"top1": ("bare", "few"), "top5": ("loop", "few"), "top25": ("bare", "many"), "all": ("loop", "many")}
DESIGN_SQL = "ds AS (SELECT unnest(['top1', 'top5', 'top25', 'all']) AS arm, unnest(['bare', 'loop', 'bare', 'loop']) AS path, unnest(['few', 'few', 'many', 'many']) AS pool)"


@query(f"""WITH {SCORES}, {DESIGN_SQL}, c AS (SELECT path, avg(CASE WHEN pool = 'few' THEN auc END) AS few, avg(CASE WHEN pool = 'many' THEN auc END) AS many FROM re JOIN ds USING (arm) GROUP BY path), e AS (SELECT *, many - few AS difference FROM c),
dx AS (SELECT * FROM e UNION ALL SELECT 'difference', l.few - b.few, l.many - b.many, l.difference - b.difference FROM e l JOIN e b ON l.path = 'loop' AND b.path = 'bare') SELECT path, round(few, 9) AS few, round(many, 9) AS many, round(difference, 9) AS difference FROM dx""")
def design_2x2(spark, d):
    """Means of a 2 x 2 design of arms and what each factor adds."""
    design = spark.createDataFrame([(a, *x) for a, x in DESIGN.items()], "arm string, path string, pool string")
    t = reporting.two_by_two(fold_records(spark, d).join(F.broadcast(design), "arm"), "path", "pool", "auc", ("bare", "loop"), ("few", "many"))
    return t.select("path", r("few"), r("many"), r("difference"))


@query(f"""WITH {PAIRS}, e AS (SELECT arm || '-' || other AS name, round(abs(avg(d)), 12) AS s FROM dl GROUP BY arm, other), h AS (SELECT s FROM e WHERE name = 'all-top1')
SELECT count(*) AS n, CAST(count_if(e.s > h.s) + 1 AS BIGINT) AS rank, round(any_value(h.s), 9) AS headline, round(list_sort(list(e.s))[count(*) // 2 + 1], 9) AS median FROM e CROSS JOIN h""")
def effect_rank(spark, d):
    p = evaluation.paired(fold_records(spark, d), ["rep", "fold"]).select(F.concat_ws("-", "arm", "other").alias("name"), "mean")
    return reporting.effect_rank(p, "name", "mean", "all-top1").select("n", "rank", r("headline"), r("median"))


@query(f"""WITH {PAIRS}, s AS (SELECT arm, other AS match, count(*) AS n, CAST(count_if(d > 0) AS BIGINT) AS above, CAST(count_if(d < 0) AS BIGINT) AS below, median(d) AS median FROM dl GROUP BY arm, other),
z AS (SELECT * FROM (VALUES ('top1', 'top5'), ('top5', 'top1'), ('top25', 'top5'), ('all', 'top25')) AS t(arm, match)) SELECT s.arm, s.match, n, above, below, round(median, 9) AS median FROM s JOIN z ON s.arm = z.arm AND s.match = z.match""")
def sign_counts(spark, d):
    arms = spark.createDataFrame(list(ARMS.items()), "arm string, n_sensors int")
    return evaluation.sign_counts(fold_records(spark, d), ["rep", "fold"], evaluation.matched(arms, arms)).select("arm", "match", "n", "above", "below", r("median"))


@query(f"WITH {SCORES}, b AS (SELECT rep, fold, arm FROM re QUALIFY row_number() OVER (PARTITION BY rep, fold ORDER BY round(auc, 12) DESC, arm) = 1) SELECT arm, count(*) AS n_folds FROM b GROUP BY arm")
def pick_histogram(spark, d):
    return evaluation.picks(fold_records(spark, d), ["rep", "fold"])


@query(f"WITH {SCORES} SELECT arm, count(*) AS n_folds, avg(n_sensors) AS n_sensors, CAST(sum(n1 + n0) AS BIGINT) AS n_test, CAST(sum(n1) AS BIGINT) AS n_fail, round(avg(auc), 9) AS auc, round(avg(ap), 9) AS ap FROM re JOIN (SELECT arm AS arm2, rep AS rep2, fold AS fold2, n1, n0 FROM sa) z ON arm = arm2 AND rep = rep2 AND fold = fold2 GROUP BY arm")
def arm_ledger(spark, d):
    return evaluation.ledger(fold_records(spark, d)).select("arm", "n_folds", "n_sensors", "n_test", "n_fail", r("auc"), r("ap"))


TARGETS = {"auc": 0.75, "auc_best": 0.80}


@query(f"WITH {SCORES}, c AS (SELECT avg(auc) AS m FROM re GROUP BY arm) SELECT 'auc' AS kpi, round(median(m), 9) AS value, 0.75e0 AS target, median(m) >= 0.75 AS met FROM c UNION ALL SELECT 'auc_best', round(max(m), 9), 0.8e0, max(m) >= 0.8 FROM c")
def kpi_scorecard(spark, d):
    m = fold_records(spark, d).groupBy("arm").agg(F.avg("auc").alias("m")).agg(F.median("m").alias("auc"), F.max("m").alias("auc_best"))
    rows = m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).alias("value"), F.lit(t).alias("target")) for k, t in TARGETS.items()])).alias("x")).select("x.*")
    return rows.groupBy("kpi", "value", "target").agg(F.first(F.col("value") >= F.col("target")).alias("met")).withColumn("value", F.round("value", 9))


CLAIMS = [("sensors of the embedding table", "n_sensors", 64.0), ("share of failures", "fail_rate", 0.1), ("kinds of events", "n_kinds", 5.0), ("a source that has no value", "n_wafers", 1567.0)]


@query("""WITH c AS (SELECT * FROM (VALUES ('sensors of the embedding table', 'n_sensors', 64e0), ('share of failures', 'fail_rate', 0.1e0), ('kinds of events', 'n_kinds', 5e0), ('a source that has no value', 'n_wafers', 1567e0)) AS t(label, source, expected)),
m AS (SELECT 'n_sensors' AS source, CAST(max(len(embedding)) AS DOUBLE) AS value FROM embeddings UNION ALL SELECT 'fail_rate', avg(CAST(label = 3 AS DOUBLE)) FROM embeddings UNION ALL SELECT 'n_kinds', CAST(count(DISTINCT event_type) AS DOUBLE) FROM events)
SELECT label, source, expected, round(value, 9) AS value, coalesce(round(expected, 3) = round(value, 3), false) AS ok FROM c LEFT JOIN m USING (source)""")
def claims(spark, d):
    """A registry of claims against what the tables say."""
    e = adapters.table(spark, d, "embeddings").agg(F.max(F.size("embedding")).cast("double").alias("n_sensors"), F.avg((F.col("label") == 3).cast("double")).alias("fail_rate"))
    k = adapters.table(spark, d, "events").agg(F.count_distinct("event_type").cast("double").alias("n_kinds"))
    pairs = lambda t: t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("value")) for c in t.columns])).alias("x")).select("x.*")
    measured = pairs(e).unionByName(pairs(k))
    return reporting.checked_claims(spark.createDataFrame(CLAIMS, "label string, source string, expected double"), measured).withColumn("value", F.round("value", 9))


INTERVAL = "%.3f [%.3f, %.3f]"
#: Claims about the runs that run_claims writes, and about one that isn't there.
RUN_CLAIMS = [
    *[(f"AUC of {a}", "arms", [f"$.per_arm.{a}.{v}" for v in ("mean", "low", "high")], INTERVAL, 1.0, None, None, None) for a in ("top1", "top25", "all")],
    ("folds better than chance", "arms", ["$.auc"], "%.0f folds", 1.0, "$.records", "$.better", "count"),
    ("best fold", "arms", ["$.auc"], "%.3f", 1.0, "$.records", None, "max"), ("failures", "profile", ["$.fail_rate"], "%.1f%%", 100.0, None, None, None),
    ("units", "profile", ["$.n_units"], "%,.0f units", 1.0, None, None, None), ("a field that isn't there", "profile", ["$.n_wafers"], "%.0f", 1.0, None, None, None),
    ("a run that isn't there", "wafers", ["$.n"], "%.0f", 1.0, None, None, None),
]


@query(f"""WITH {SCORES}, c AS (SELECT arm, round(avg(auc), 6) AS m, round(avg(auc) - {T9} * stddev_samp(auc) / sqrt(10), 6) AS lo, round(avg(auc) + {T9} * stddev_samp(auc) / sqrt(10), 6) AS hi FROM re GROUP BY arm),
tx AS (SELECT arm, printf('%.3f [%.3f, %.3f]', m, lo, hi) AS t FROM c), un AS (SELECT format('{{:,}} units', count(*)) AS units, printf('%.1f%%', 100 * avg(CAST(label = 3 AS DOUBLE))) AS share FROM embeddings),
doc AS (SELECT (SELECT string_agg('| ' || arm || ' | ' || t || ' |', chr(10) ORDER BY arm) FROM tx WHERE arm <> 'all') || chr(10) || (SELECT units FROM un) AS doc),
cl AS (SELECT 'AUC of ' || arm AS label, 'arms' AS source, t AS text FROM tx WHERE arm <> 'top5' UNION ALL SELECT 'folds better than chance', 'arms', count_if(auc > 0.5) || ' folds' FROM re UNION ALL SELECT 'best fold', 'arms', printf('%.3f', round(max(auc), 6)) FROM re
UNION ALL SELECT 'failures', 'profile', share FROM un UNION ALL SELECT 'units', 'profile', units FROM un UNION ALL SELECT 'a field that isn''t there', 'profile', NULL UNION ALL SELECT 'a run that isn''t there', 'wafers', NULL)
SELECT label, source, text, CASE WHEN source = 'wafers' THEN 'no run' WHEN text IS NULL THEN 'no value' WHEN contains(doc, text) THEN 'ok' ELSE 'absent' END AS status FROM cl CROSS JOIN doc""")
def run_claims(spark, d):
    """Claims read from run documents of different schemas, against a report that has no row of the arm ``all``."""
    folder = f"{graph.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    recs = fold_records(spark, d)
    c = graph.checkpointed(evaluation.summary(recs, ["rep", "fold"]).select("arm", *[F.round(x, 6).alias(x) for x in ("mean", "low", "high")]))
    per_arm = c.agg(F.map_from_entries(F.collect_list(F.struct("arm", F.struct("mean", "low", "high")))).alias("per_arm"))  # a row an arm
    every = recs.agg(F.collect_list(F.struct("arm", "rep", "fold", F.round("auc", 6).alias("auc"), (F.col("auc") > 0.5).alias("better"))).alias("records"))  # a row an arm and fold
    runs.save_run(per_arm.crossJoin(every), F.struct("per_arm", "records"), folder, "arms")
    profile = cleaning.profile(adapters.embedding_readings(spark, d))
    runs.save_run(profile, F.struct(*profile.columns), folder, "profile")
    rows = [(x["arm"], x["t"]) for x in c.filter("arm <> 'all'").select("arm", reporting.interval(*(F.col(x) for x in ("mean", "low", "high"))).alias("t")).orderBy("arm").collect()]
    report = reporting.markdown_table(["arm", "AUC"], rows) + f"\n{adapters.embedding_units(spark, d).count():,} units"
    claims = spark.createDataFrame(RUN_CLAIMS, reporting.CLAIM)
    return reporting.audited(reporting.texts_of_claims(claims, runs.load_runs(spark, folder)), report)


CV_ARMS = ("majority", "logreg", "logreg_missind", "univar_top25_rf", "rf", "hgb")
#: The arms of the headline comparison.
HEADLINE = ("majority", "univar_top25_rf", "logreg_all", "rf_all", "hgb_all", "agent_rf", "agent_logreg")


def fitted_records(spark, d, names, n_reps):
    """Records of fitted arms over 5 common folds in each of n_reps repetitions."""
    x = graph.checkpointed(adapters.embedding_readings(spark, d))
    roles = evaluation.fold_roles(resampling.stratified_folds(adapters.embedding_units(spark, d), 5, n_reps), 5)
    every = models.arms() | loop.arms()
    return evaluation.records(loop.cross_validated(x, roles, {a: every[a] for a in names}, ["rep", "fold"]), ["arm", "rep", "fold"])


@query()
def cv_arms(spark, d):
    """Records of untuned arms over 25 common folds."""
    return fitted_records(spark, d, CV_ARMS, 5)


@query()
def headline_plain(spark, d):
    """Records over 25 common folds of the headline's arms with a forest or a logistic fit."""
    return fitted_records(spark, d, HEADLINE[:4], 5)


@query()
def headline_boosted(spark, d):
    """Records over 25 common folds of tuned boosted trees."""
    return fitted_records(spark, d, HEADLINE[4:5], 5)


@query()
def headline_loop(spark, d):
    """Records over 25 common folds of the arms whose sensors the loop selects."""
    return fitted_records(spark, d, HEADLINE[5:], 5)


def event_records(spark, d, roles, names, keys):
    x = graph.checkpointed(adapters.event_readings(spark, d).drop("ts"))
    every = models.arms() | loop.arms()
    return evaluation.records(loop.cross_validated(x, roles, {a: every[a] for a in names}, keys), ["arm", *keys])


@query()
def chronological_arms(spark, d):
    """Records of fitted arms trained on the first 70 % in time and tested on the rest."""
    roles = resampling.chronological(adapters.event_units(spark, d)).withColumn("origin", F.lit(0))
    return event_records(spark, d, roles, ("majority", "logreg", "rf", "hgb", "rf_all", "agent_logreg"), ["origin"])


@query()
def rolling_arms(spark, d):
    """Records of fitted arms with rolling origins: the blocks so far train, the next one tests."""
    roles = resampling.rolling_origin(adapters.event_units(spark, d), 5)
    return event_records(spark, d, roles, ("majority", "logreg", "rf", "hgb", "agent_logreg"), ["origin"])


#: The rungs of the sweep, from sparse to no drop at all, with either way of attribution.
RUNGS = {
    "sparse": {"n_screen": 150, "select_k": 20, "stability_min": 0.5, "max_select": 25}, "operating": {"n_screen": 150, "select_k": 40, "stability_min": 0.3, "max_select": 25},
    "few": {"n_screen": 150, "select_k": 10, "stability_min": 0.5, "max_select": 10}, "ungrouped": {"n_screen": 150, "select_k": 20, "stability_min": 0.5, "max_select": 25, "corr_threshold": 1.01},
    "wide": {"n_screen": 150, "select_k": 60, "stability_min": 0.2, "max_select": 60}, "no_drop": {"n_screen": 150, "select_k": 474, "stability_min": 0.0, "max_select": 474},
}
SWEEP_CONFIGS = {f"{name}_{how}": loop.Config(base="logreg", attribution=how, **own) for name, own in RUNGS.items() for how in ("permutation", "model")}


@query()
def loop_sweep(spark, d):
    """Twelve configurations of the loop over 10 folds, as a run table: mean AUC and how many sensors each selects."""
    x = graph.checkpointed(adapters.embedding_readings(spark, d))
    roles = evaluation.fold_roles(resampling.stratified_folds(adapters.embedding_units(spark, d), 5, 2), 5)
    found = loop.sweep(x, roles, list(SWEEP_CONFIGS.values()), f"{graph.shared_folder(spark)}/sweep-{uuid.uuid4().hex}", ["rep", "fold"])
    names = spark.createDataFrame([(loop.key_of(c), n) for n, c in SWEEP_CONFIGS.items()], "config string, name string")
    return found.join(F.broadcast(names), "config").groupBy("name").agg(F.count("*").alias("n"), F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("sd"), F.avg("n_selected").alias("n_selected"), F.avg("n_reported").alias("n_reported"))


NULL_LOOPS, REAL_LOOPS = 200, 40
NULL_CONFIG = loop.Config(base="logreg", attribution="model")


@query()
def loop_null_records(spark, d):
    """The loop itself on 200 worlds of permuted labels and 40 of resampled real ones: what each world is judged by."""
    x = graph.checkpointed(adapters.embedding_readings(spark, d))
    units = adapters.embedding_units(spark, d)
    null = resampling.permuted_labels(units, NULL_LOOPS).select(F.col("rep").alias("data"), "unit_id", "y", F.lit(1).alias("times"))
    real = resampling.bootstrap_redrawn(units, REAL_LOOPS, loop.LEAST_POSITIVES).select((F.col("rep") + NULL_LOOPS).alias("data"), "unit_id", "y", F.col("mult").cast("int").alias("times"))
    members = graph.checkpointed(null.unionByName(real).withColumn("train", F.lit(True)))
    return loop.null_records(loop.runs(x, members, NULL_CONFIG)).withColumn("permuted", F.col("data") < NULL_LOOPS).withColumnRenamed("data", "world")


@query()
def ranker_overlap(spark, d):
    """How far the first five sensors of the named rankers agree over 12 bootstraps and 25 folds."""
    x = graph.checkpointed(adapters.embedding_readings(spark, d))
    units = adapters.embedding_units(spark, d)
    boots = resampling.bootstrap_redrawn(units, 12, loop.LEAST_POSITIVES)
    folds = resampling.fold_replicates(units, 5, 5).withColumn("rep", F.col("rep") + 1000)
    members = boots.select("rep", "unit_id", "y", "mult").unionByName(folds.select("rep", "unit_id", "y", "mult"))
    members = graph.checkpointed(members.select(F.col("rep").cast("int").alias("data"), "unit_id", "y", F.col("mult").cast("int").alias("times"), F.lit(True).alias("train")))
    sets = graph.checkpointed(loop.first_sets(x, members, ["univariate", "logreg_coef", "rf_impurity", "agent_model"], 5, RANKER_CONFIG))
    parts = [stability.pairwise_overlap(sets.filter((F.col("ranker") == n) & ((F.col("rep") >= 1000) == on)).select("rep", "sensor_id"), 5).select(F.lit(n).alias("ranker"), F.lit("folds" if on else "bootstraps").alias("over"), "n_pairs", r("mean"), r("sd", 7)) for n in ("univariate", "logreg_coef", "rf_impurity", "agent_model") for on in (False, True)]
    return models.together(parts)


RANKER_CONFIG = loop.Config(base="logreg", attribution="model", n_screen=150, n_screen_boot=60, select_k=40, stability_min=0.3)


@query()
def plain_path(spark, d):
    """The plain path's survivors, with their groups."""
    rep = loop.quick_report(graph.checkpointed(adapters.embedding_readings(spark, d)))
    rows = [(s, i, float(rep["importance"][s]), float(rep["stability"][s])) for i, g in enumerate(rep["groups"]) for s in g]
    return spark.createDataFrame(rows, "sensor_id int, family int, importance double, stability double")
