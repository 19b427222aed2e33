"""Queries over arms, folds, reports, synthetic causes and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import cleaning, evaluation, kernels, loop, models, periods, reporting, resampling
from lotwise.operators.graph import checkpointed
from lotwise.plans import sql
from lotwise.plans.basics import query, r
from lotwise.plans.calibrated import supports
from lotwise.sources import adapters
from lotwise.sources.synthetic import causes, synthetic

ARMS = {"top1": 1, "top5": 5, "top25": 25, "all": 64}
T9 = 2.2621571627982  # 97.5 % quantile of Student's t for 9 degrees of freedom
SCORES = f"""{sql.F1U}, {sql.F1R}, x AS (SELECT CAST(unnest(range(2)) AS INTEGER) AS rep), fo AS (SELECT rep, unit_id, y, CAST((row_number() OVER (PARTITION BY rep, y ORDER BY md5(concat_ws(':', 'fold', rep, unit_id)), unit_id) - 1) % 5 AS INTEGER) AS own FROM u CROSS JOIN x),
kf AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold), tr AS (SELECT rep, fold, r.* FROM r JOIN fo USING (unit_id) JOIN kf ON fold <> own), {sql.auc("ta", "tr", "rep, fold, sensor_id")},
bs AS (SELECT rep, fold, sensor_id, CASE WHEN auc >= 0.5 THEN 1e0 ELSE -1e0 END AS sign, row_number() OVER (PARTITION BY rep, fold ORDER BY round(abs(auc - 0.5), 12) DESC, sensor_id) AS rnk FROM ta),
ar AS (SELECT unnest(['top1', 'top5', 'top25', 'all']) AS arm, CAST(unnest([1, 5, 25, 64]) AS INTEGER) AS n_sensors),
sc AS (SELECT arm, n_sensors, bs.rep, fold, r.unit_id, r.y, round(sum(sign * value), 9) AS value FROM bs JOIN fo ON fo.rep = bs.rep AND fo.own = bs.fold JOIN r ON r.unit_id = fo.unit_id AND r.sensor_id = bs.sensor_id JOIN ar ON rnk <= n_sensors GROUP BY ALL),
{sql.auc("sa", "sc", "arm, n_sensors, rep, fold")}, pv AS (SELECT arm, rep, fold, value, sum(y) AS p, count(*) AS m FROM sc GROUP BY ALL),
pc AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS al, sum(p) OVER (PARTITION BY arm, rep, fold) AS np FROM pv WINDOW w AS (PARTITION BY arm, rep, fold ORDER BY value DESC ROWS UNBOUNDED PRECEDING)),
pa AS (SELECT arm, rep, fold, sum(CAST(p AS DOUBLE) / np * tp / al) AS ap FROM pc GROUP BY ALL), re AS (SELECT arm, n_sensors, rep, fold, n1 + n0 AS n_test, n1 AS n_fail, auc, ap FROM sa JOIN pa USING (arm, rep, fold))"""


def fold_records(spark, d):
    folds = resampling.stratified_folds(adapters.embedding_units(spark, d), 5, 2)
    s = evaluation.signed_sums(adapters.embedding_readings(spark, d), evaluation.fold_roles(folds, 5), ARMS, ["rep", "fold"])
    return checkpointed(evaluation.records(checkpointed(s), ["arm", "n_sensors", "rep", "fold"]))  # a row an arm and fold, used many times


@query(f"WITH {SCORES} SELECT arm, n_sensors, rep, fold, n_test, n_fail, round(auc, 9) AS auc, round(ap, 9) AS ap FROM re")
def arm_records(spark, d):
    return fold_records(spark, d).select("arm", "n_sensors", "rep", "fold", "n_test", "n_fail", r("auc"), r("ap"))


@query(f"WITH {SCORES} SELECT arm, count(*) AS n, round(avg(auc), 9) AS mean, round(stddev_samp(auc), 7) AS sd, round(avg(auc) - {T9} * stddev_samp(auc) / sqrt(10), 6) AS low, round(avg(auc) + {T9} * stddev_samp(auc) / sqrt(10), 6) AS high FROM re GROUP BY arm")
def arm_summary(spark, d):
    return evaluation.summary(fold_records(spark, d), ["rep", "fold"]).select("arm", "n", r("mean"), r("sd", 7), r("low", 6), r("high", 6))


PAIRS = f"{SCORES}, dl AS (SELECT a.arm, b.arm AS other, a.rep, a.fold, round(a.auc - b.auc, 12) AS d FROM re a JOIN re b ON a.rep = b.rep AND a.fold = b.fold AND a.arm <> b.arm)"


# Of 10 differences: how many choices of signs have each rank sum from 0 to 55; and the two tails of Student's t for 9 degrees of freedom.
SIGNS = "sg(k, c) AS (SELECT 0, list_transform(range(56), lambda s: CASE WHEN s = 0 THEN 1 ELSE 0 END) UNION ALL SELECT k + 1, list_transform(range(1, 57), lambda i: c[i] + CASE WHEN i > k + 1 THEN c[i - k - 1] ELSE 0 END) FROM sg WHERE k < 10)"
T9_TAILS = "(SELECT 1 - 2 / pi() * (a + sin(a) * cos(a) * (1 + 2 / 3e0 * cos(a) ** 2 + 8 / 15e0 * cos(a) ** 4 + 16 / 35e0 * cos(a) ** 6)) FROM (SELECT atan(abs({t}) / 3) AS a))"


@query(f"""WITH RECURSIVE {PAIRS}, {SIGNS}, wk AS (SELECT arm, other, d, rank() OVER (PARTITION BY arm, other ORDER BY abs(d)) + (count(*) OVER (PARTITION BY arm, other, abs(d)) - 1) / 2e0 AS rk FROM dl WHERE d <> 0),
w AS (SELECT arm, other, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w, count(*) AS k, count(DISTINCT abs(d)) AS u FROM wk GROUP BY arm, other),
pw AS (SELECT arm, other, w, CASE WHEN k = 10 AND u = 10 THEN least(1e0, 2 * list_sum((SELECT c FROM sg WHERE k = 10)[1 : CAST(least(w, 55 - w) AS BIGINT) + 1]) / 1024e0) END AS p_w FROM w),
st AS (SELECT dl.arm, dl.other, count(*) AS n, avg(d) AS m, stddev_samp(d) AS s, CAST(count_if(d > 0) AS BIGINT) AS wins, CAST(count_if(d < 0) AS BIGINT) AS losses FROM dl GROUP BY dl.arm, dl.other), tt AS (SELECT *, m / (s / sqrt(10)) AS t FROM st)
SELECT tt.arm, tt.other, n, round(m, 9) AS mean, round(s, 7) AS sd, round(m - {T9} * s / sqrt(10), 6) AS low, round(m + {T9} * s / sqrt(10), 6) AS high, wins, losses, round(t, 5) AS t, round({T9_TAILS.format(t="t")}, 7) AS p_t, w, round(p_w, 9) AS p_w
FROM tt LEFT JOIN pw ON pw.arm = tt.arm AND pw.other = tt.other""")
def paired_delta(spark, d):
    p = evaluation.paired(fold_records(spark, d), ["rep", "fold"])
    return p.select("arm", "other", "n", r("mean"), r("sd", 7), r("low", 6), r("high", 6), "wins", "losses", r("t", 5), r("p_t", 7), "w", r("p_w"))


@query(f"WITH {SCORES} SELECT round(regr_slope(auc, n_sensors), 9) AS slope, round(regr_intercept(auc, n_sensors), 9) AS intercept, round(corr(auc, n_sensors), 9) AS r FROM re")
def sparsity_slope(spark, d):
    return evaluation.slope(fold_records(spark, d), "n_sensors", "auc").select(r("slope"), r("intercept"), r("r"))


@query(f"WITH {SCORES}, m AS (SELECT arm, avg(auc) AS auc, avg(ap) AS ap FROM re GROUP BY arm) SELECT count(*) AS pairs, CAST(count_if((b.auc - a.auc) * (b.ap - a.ap) > 0) AS BIGINT) AS concordant FROM m a JOIN m b ON a.arm < b.arm")
def concordant_pairs(spark, d):
    return kernels.concordant(fold_records(spark, d).groupBy("arm").agg(F.avg("auc").alias("auc"), F.avg("ap").alias("ap")), [], "arm", "auc", "ap")


@query(f"WITH {SCORES}, a AS (SELECT DISTINCT arm, n_sensors AS n FROM re), j AS (SELECT x.arm, z.arm AS match, CAST(abs(x.n - z.n) AS INTEGER) AS gap FROM a x JOIN a z ON x.arm <> z.arm) SELECT arm, match, gap FROM j QUALIFY row_number() OVER (PARTITION BY arm ORDER BY gap, match) = 1")
def matched_control(spark, d):
    arms = checkpointed(fold_records(spark, d).select("arm", "n_sensors").distinct())
    return evaluation.matched(arms, arms)


SWEEP = f"""{sql.F3U}, {sql.F3R}, bc AS (SELECT CAST(unnest([3, 5]) AS INTEGER) AS blocks), tb AS (SELECT 3 AS blocks, unit_id, y, ntile(3) OVER (ORDER BY ts, unit_id) AS block FROM u UNION ALL SELECT 5, unit_id, y, ntile(5) OVER (ORDER BY ts, unit_id) FROM u),
ro AS (SELECT tb.blocks, CAST(origin AS INTEGER) AS origin, unit_id, CASE WHEN block <= origin THEN 'train' ELSE 'test' END AS role FROM tb JOIN (SELECT unnest([3, 3, 5, 5, 5, 5]) AS blocks, unnest([1, 2, 1, 2, 3, 4]) AS origin) o ON tb.blocks = o.blocks AND block <= origin + 1),
tr AS (SELECT ro.blocks, origin, r.* FROM r JOIN ro USING (unit_id) WHERE role = 'train'), {sql.auc("ta", "tr", "blocks, origin, sensor_id")},
bs AS (SELECT blocks, origin, sensor_id, CASE WHEN auc >= 0.5 THEN 1e0 ELSE -1e0 END AS sign, row_number() OVER (PARTITION BY blocks, origin ORDER BY round(abs(auc - 0.5), 12) DESC, sensor_id) AS rnk FROM ta),
ar AS (SELECT unnest(['one', 'all']) AS arm, CAST(unnest([1, 4]) AS INTEGER) AS n_sensors),
sc AS (SELECT arm, n_sensors, bs.blocks, bs.origin, r.unit_id, r.y, round(sum(sign * value), 9) AS value FROM bs JOIN ro ON ro.blocks = bs.blocks AND ro.origin = bs.origin AND role = 'test' JOIN r ON r.unit_id = ro.unit_id AND r.sensor_id = bs.sensor_id JOIN ar ON rnk <= n_sensors GROUP BY ALL),
{sql.auc("sa", "sc", "arm, n_sensors, blocks, origin")}"""


@query(f"WITH {SWEEP} SELECT arm, n_sensors, CAST(blocks AS INTEGER) AS blocks, origin, n1 + n0 AS n_test, n1 AS n_fail, round(auc, 9) AS auc FROM sa")
def rolling_sweep(spark, d):
    s = evaluation.rolling_sweep(adapters.event_readings(spark, d).drop("ts"), adapters.event_units(spark, d), [3, 5], {"one": 1, "all": 4})
    return s.select("arm", "n_sensors", "blocks", "origin", "n_test", "n_fail", r("auc"))


@query(f"WITH {SWEEP}, m AS (SELECT CAST(blocks AS INTEGER) AS blocks, arm, avg(auc) AS mean FROM sa GROUP BY blocks, arm) SELECT blocks, arm, round(mean, 9) AS mean FROM m QUALIFY row_number() OVER (PARTITION BY blocks ORDER BY round(m.mean, 12) DESC, arm) = 1")
def best_arm(spark, d):
    s = evaluation.rolling_sweep(adapters.event_readings(spark, d).drop("ts"), adapters.event_units(spark, d), [3, 5], {"one": 1, "all": 4})
    return evaluation.best_arm(checkpointed(s), ["blocks"]).select("blocks", "arm", r("mean"))


@query(f"WITH {SCORES}, c AS (SELECT arm, round(avg(auc), 6) AS m, round(avg(auc) - {T9} * stddev_samp(auc) / sqrt(10), 6) AS lo, round(avg(auc) + {T9} * stddev_samp(auc) / sqrt(10), 6) AS hi FROM re GROUP BY arm) SELECT arm, printf('%.3f [%.3f, %.3f]', m, greatest(lo, 0), least(hi, 1)) AS auc, CASE WHEN lo > 0.5 THEN 'higher' WHEN hi < 0.5 THEN 'lower' ELSE 'not told apart' END AS than_chance FROM c")
def report_table(spark, d):
    c = evaluation.summary(fold_records(spark, d), ["rep", "fold"])
    m, lo, hi = (F.round(c, 6) for c in ("mean", "low", "high"))
    return c.select("arm", reporting.interval(m, lo, hi, True).alias("auc"), reporting.verdict(lo - 0.5, hi - 0.5).alias("than_chance"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '```[^`]*```', ' ', 'g'), '[0-9]{4}-[0-9]{2}-[0-9]{2}', ' ', 'g'), '[A-Za-z_]+[0-9]+[A-Za-z_0-9]*', ' ', 'g'), '([0-9]),([0-9]{3})', '\\1\\2', 'g'), '([0-9]),([0-9]{3})', '\\1\\2', 'g') AS t FROM documents),
n AS (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)?')) AS number FROM t), c AS (SELECT DISTINCT CAST(n_chars AS VARCHAR) AS number FROM documents)
SELECT doc_id, number, count(*) AS times FROM n WHERE number NOT IN (SELECT number FROM c) GROUP BY doc_id, number""")
def number_provenance(spark, d):
    docs = adapters.table(spark, d, "documents")
    return reporting.unclaimed(docs, docs.select(F.col("n_chars").cast("string").alias("number")), "doc_id", "text")


def support_histogram(spark, d):
    return reporting.histogram(supports(spark, d), ["permuted"], "support", 0.0, 1.0, 6)


query()(support_histogram)


def synthetic_recovery(spark, d):
    """Recall and precision of the univariate ranking on causes planted in the units of the embeddings, for a few seeds."""
    out, units = None, adapters.embedding_units(spark, d)
    for seed in range(3):
        x = checkpointed(synthetic(spark, 0, 60, 3, 0.12, 0.04, seed, units))
        top = cleaning.univariate_top(x, 5).withColumn("seed", F.lit(seed))
        out = top if out is None else out.unionByName(top)
    planted = spark.createDataFrame([(c,) for c in causes(60, 3)], "sensor_id int")
    return evaluation.recovery(out, planted, 5, ["seed"])


query()(synthetic_recovery)


def cleaned(spark, d):
    """The embedding readings of every sensor that the cleaner keeps, for queries that fit models many times."""
    x = adapters.embedding_readings(spark, d)
    return checkpointed(cleaning.kept_readings(x, cleaning.cleaner(x)))


@query()
def rf_importance(spark, d):
    return models.ranking(spark, models.fit(adapters.embedding_readings(spark, d), models.forest()).importance())


@query()
def boosted_importance(spark, d):
    """The share of what the splits of boosted trees gain, a sensor."""
    return models.ranking(spark, models.fit(adapters.embedding_readings(spark, d), models.boosted()).importance())


@query()
def logreg_screen(spark, d):
    x = checkpointed(adapters.embedding_readings(spark, d))
    made = models.fit(x, models.logistic(0.05))
    return models.ranking(spark, made.importance(), 20)


@query()
def perm_importance(spark, d):
    x = cleaned(spark, d)
    found = models.permutation_importance(x, models.logistic(), sorted(r[0] for r in x.select("sensor_id").distinct().collect()))
    return models.ranking(spark, found)


@query()
def tuned_forest(spark, d):
    best, made, mean = models.tuned(cleaned(spark, d), models.FORESTS)
    return spark.createDataFrame([(k, v, k == best) for k, v in mean.items()], "config string, auc double, chosen boolean")


def loop_rows(spark, rep: loop.Report):
    return spark.createDataFrame([(v["sensor_id"], v["importance"], v["stability"], v["selected"], v["reported"]) for v in rep.verdicts], "sensor_id int, importance double, stability double, selected boolean, reported boolean")


@query()
def agent_loop(spark, d):
    return loop_rows(spark, loop.run(checkpointed(adapters.embedding_readings(spark, d))))


@query()
def predict_all_report_few(spark, d):
    """A tuned forest on all cleaned sensors, scored on the three tenths of the units that neither it nor the loop has
    seen, with the number of sensors that the loop reports."""
    x = checkpointed(adapters.embedding_readings(spark, d))
    roles = checkpointed(resampling.shuffle_split(adapters.embedding_units(spark, d), 1, 0.3))
    part = lambda role: checkpointed(x.join(roles.filter(F.col("role") == role).select("unit_id"), "unit_id", "left_semi"))
    made, rep = loop.predict_all_report_few(part("train"))
    return kernels.roc_auc(made.score(part("test")), [], "s").select("n1", "n0", "auc", F.lit(len(rep.reported)).alias("n_reported"))


@query()
def adversarial_validation(spark, d):
    """How well a tuned forest tells late events from early ones, and from events at random (the control)."""
    units = checkpointed(adapters.event_units(spark, d))
    era = checkpointed(periods.era(units).select("unit_id", "y"))
    shuffled = resampling.permuted_labels(era, 1).select("unit_id", "y")
    labels = era.withColumn("world", F.lit("era")).unionByName(shuffled.withColumn("world", F.lit("control")))
    aucs = models.held_out_aucs(checkpointed(adapters.event_readings(spark, d).drop("ts", "y")), checkpointed(labels), models.FORESTS, 5, 3)
    return aucs.groupBy(F.col("world").alias("labels")).agg(F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("sd"), F.count("*").cast("int").alias("n_folds"))
