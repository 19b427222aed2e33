"""Queries over bootstrap support, null worlds and calibrated thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import calibration, graph, kernels, resampling, stability
from lotwise.plans import sql
from lotwise.plans.basics import query, r
from lotwise.sources import adapters

B, K, CLUSTER = 12, 5, 0.13
NULL, REAL, VOTES, TOP = 12, 4, 6, 5
DEPTHS = (1, 3, 5)


def rankings(spark, d):
    w = resampling.bootstrap(adapters.embedding_units(spark, d), B, 5)
    return graph.checkpointed(stability.replicate_rankings(adapters.embedding_readings(spark, d), w, K, ["rep"])), w


RANK = f"""{sql.F1U}, {sql.F1R}, {sql.boot(B, 5)}, wr AS (SELECT b.rep, b.y, b.mult, r.sensor_id, r.value FROM r JOIN b USING (unit_id)), {sql.wauc("wa", "wr", "rep, sensor_id")},
rk AS (SELECT rep, sensor_id FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY round(abs(auc - 0.5), 12) DESC, sensor_id) AS rnk FROM wa) WHERE rnk <= {K})"""
OVERLAP = """n AS (SELECT count(DISTINCT rep) AS b FROM {t}), pr AS (SELECT x.rep AS a, z.rep AS b FROM (SELECT DISTINCT rep FROM {t}) x JOIN (SELECT DISTINCT rep FROM {t}) z ON x.rep < z.rep),
ov AS (SELECT pr.a, pr.b, CAST(count(s2.sensor_id) AS DOUBLE) / {k} AS o FROM pr JOIN {t} s1 ON s1.rep = pr.a LEFT JOIN {t} s2 ON s2.rep = pr.b AND s2.sensor_id = s1.sensor_id GROUP BY pr.a, pr.b)
SELECT count(*) AS n_pairs, round(avg(o), 9) AS mean, round(stddev_samp(o), 7) AS sd FROM ov"""


@query(f"WITH {RANK}, ne AS (SELECT count(DISTINCT rep) AS n_eff FROM b) SELECT sensor_id, count(*) AS hits, n_eff, round(count(*) / n_eff, 9) AS support FROM rk CROSS JOIN ne GROUP BY sensor_id, n_eff")
def bootstrap_support(spark, d):
    ranked, w = rankings(spark, d)
    return stability.support(ranked, w.select("rep"), []).withColumn("support", F.round("support", 9))


@query(f"WITH {RANK}, " + OVERLAP.format(t="rk", k=K))
def pairwise_overlap(spark, d):
    return stability.pairwise_overlap(rankings(spark, d)[0], K).select("n_pairs", r("mean"), r("sd", 7))


@query(f"""WITH {RANK}, c AS (SELECT sensor_id, count(DISTINCT rep) AS hits FROM rk GROUP BY sensor_id), n AS (SELECT count(DISTINCT rep) AS b FROM rk)
SELECT sensor_id, hits, CAST(row_number() OVER (ORDER BY hits DESC, sensor_id) AS INTEGER) AS rnk, round(hits / b, 9) AS frequency FROM c CROSS JOIN n QUALIFY rnk <= {K}""")
def consensus_topk(spark, d):
    return stability.consensus(rankings(spark, d)[0], K).select("sensor_id", "hits", "rnk", r("frequency"))


@query(f"""WITH {RANK}, c AS (SELECT sensor_id, count(DISTINCT rep) AS hits FROM rk GROUP BY sensor_id), n AS (SELECT count(DISTINCT rep) AS b FROM rk), t AS (SELECT hits FROM c ORDER BY hits DESC, sensor_id LIMIT {K})
SELECT round(sum(hits) / any_value(b) / {K}, 9) AS consensus, (SELECT count(*) FROM c) AS n_distinct, any_value(b) AS n_replicates FROM t CROSS JOIN n""")
def consensus_summary(spark, d):
    return stability.consensus_summary(rankings(spark, d)[0], K).select(r("consensus"), "n_distinct", "n_replicates")


CLUSTERS = f"""co AS (SELECT x.sensor_id AS a, z.sensor_id AS b, corr(x.value, z.value) AS r FROM r x JOIN r z ON x.unit_id = z.unit_id AND x.sensor_id < z.sensor_id GROUP BY ALL),
ed AS (SELECT a, b FROM co WHERE round(abs(r), 9) >= {CLUSTER} UNION ALL SELECT b, a FROM co WHERE round(abs(r), 9) >= {CLUSTER}),
reach(node, other) AS (SELECT DISTINCT sensor_id, sensor_id FROM r UNION SELECT reach.node, ed.b FROM reach JOIN ed ON reach.other = ed.a), cl AS (SELECT node AS sensor_id, min(other) AS cluster_id FROM reach GROUP BY node)"""


@query(f"WITH RECURSIVE {RANK}, {CLUSTERS}, rc AS (SELECT DISTINCT rep, cluster_id AS sensor_id FROM rk JOIN cl USING (sensor_id)), " + OVERLAP.format(t="rc", k=K))
def cluster_overlap(spark, d):
    clusters = graph.correlation_clusters(adapters.embedding_readings(spark, d), CLUSTER)
    return stability.pairwise_overlap(stability.as_clusters(rankings(spark, d)[0], clusters), K).select("n_pairs", r("mean"), r("sd", 7))


@query(f"""WITH RECURSIVE {RANK}, {CLUSTERS}, f AS (SELECT rep, count(DISTINCT cluster_id) AS n FROM rk JOIN cl USING (sensor_id) GROUP BY rep)
SELECT count(*) AS n, round(avg(n), 9) AS mean, round(stddev_samp(n), 9) AS sd, round(stddev_samp(n) / sqrt(count(*)), 9) AS se, min(n) AS least, max(n) AS most FROM f""")
def families_in_top(spark, d):
    clusters = graph.correlation_clusters(adapters.embedding_readings(spark, d), CLUSTER)
    f = stability.as_clusters(rankings(spark, d)[0], clusters).groupBy("rep").agg(F.count("*").alias("n"))
    return f.agg(F.count("*").alias("c"), F.round(F.avg("n"), 9).alias("mean"), F.round(F.stddev_samp("n"), 9).alias("sd"), F.round(F.stddev_samp("n") / F.sqrt(F.count("*")), 9).alias("se"), F.min("n").alias("least"), F.max("n").alias("most")).withColumnRenamed("c", "n")


def support_ladder(spark, d):
    """supports() for several numbers of votes a replicate, under ``depth``, from one ranking."""
    units, readings = adapters.embedding_units(spark, d), adapters.embedding_readings(spark, d)
    return graph.checkpointed(calibration.worlds_by_depth(units, readings, NULL, REAL, VOTES, DEPTHS))


def supports(spark, d):
    # A row a world and named sensor, used many times: the plan starts anew from here.
    return graph.checkpointed(calibration.worlds(adapters.embedding_units(spark, d), adapters.embedding_readings(spark, d), NULL, REAL, VOTES, TOP))


SUP = f"""{sql.F1U}, {sql.F1R}, {sql.boot((NULL + REAL) * VOTES, 0)},
oo AS (SELECT unit_id, y, row_number() OVER (ORDER BY md5(concat_ws(':', 'order', unit_id)), unit_id) AS i FROM u), x AS (SELECT unnest(range({NULL})) AS world),
pm AS (SELECT world, unit_id, row_number() OVER (PARTITION BY world ORDER BY md5(concat_ws(':', 'perm', world, unit_id)), unit_id) AS i FROM u CROSS JOIN x),
lb AS (SELECT pm.world, pm.unit_id, oo.y FROM pm JOIN oo USING (i) UNION ALL SELECT {NULL} + unnest(range({REAL})), unit_id, y FROM u),
wm AS (SELECT lb.world, b.rep, b.unit_id, lb.y, b.mult FROM b JOIN lb ON lb.world = b.rep // {VOTES} AND lb.unit_id = b.unit_id),
gd AS (SELECT world, rep FROM wm GROUP BY world, rep HAVING sum(y * mult) >= 5),
wr AS (SELECT wm.world, wm.rep, wm.y, wm.mult, r.sensor_id, r.value FROM wm SEMI JOIN gd USING (world, rep) JOIN r USING (unit_id)), {sql.wauc("wa", "wr", "world, rep, sensor_id")},
rk AS (SELECT world, rep, sensor_id FROM (SELECT *, row_number() OVER (PARTITION BY world, rep ORDER BY round(abs(auc - 0.5), 12) DESC, sensor_id) AS rnk FROM wa) WHERE rnk <= {TOP}),
ne AS (SELECT world, count(*) AS n_eff FROM gd GROUP BY world),
su AS (SELECT CAST(world AS INTEGER) AS world, world < {NULL} AS permuted, sensor_id, count(*) AS hits, n_eff, CAST(count(*) AS DOUBLE) / n_eff AS support FROM rk JOIN ne USING (world) GROUP BY world, sensor_id, n_eff),
mx AS (SELECT world, permuted, max(support) AS max_support, CAST(count_if(support >= 0.5) AS BIGINT) AS n_half FROM su GROUP BY ALL),
tq0 AS (SELECT quantile_cont(max_support, [0.9, 0.95, 0.99]) AS q FROM mx WHERE permuted), ta AS (SELECT unnest([0.1e0, 0.05e0, 0.01e0]) AS alpha, unnest(q) AS tau FROM tq0)"""


@query(f"WITH {SUP} SELECT world, permuted, round(max_support, 9) AS max_support, n_half FROM mx")
def label_permutation_null(spark, d):
    return calibration.maxima(supports(spark, d)).select("world", "permuted", r("max_support"), "n_half")


@query(f"WITH {SUP} SELECT alpha, round(tau, 9) AS tau FROM ta")
def null_tau(spark, d):
    return calibration.taus(calibration.maxima(supports(spark, d))).select("alpha", r("tau"))


@query()
def null_tau_whole(spark, d):
    """Thresholds and what they report, from 200 worlds of permuted labels and 40 real ones of 12 bootstraps each."""
    found = graph.checkpointed(calibration.worlds(adapters.embedding_units(spark, d), adapters.embedding_readings(spark, d), 200, 40, 12, TOP))
    over = calibration.over(found, calibration.taus(calibration.maxima(found)))
    return over.groupBy("alpha", "tau", "permuted").agg(F.count("*").alias("n_worlds"), F.avg("n_over").alias("n_over"), F.avg((F.col("n_over") == 0).cast("double")).alias("silent"))


@query(f"WITH {SUP} SELECT alpha, round(tau, 9) AS tau, world, permuted, CAST(count_if(support >= tau - 1e-12) AS BIGINT) AS n_over FROM su CROSS JOIN ta GROUP BY ALL")
def suspects_over_tau(spark, d):
    s = supports(spark, d)
    return calibration.over(s, calibration.taus(calibration.maxima(s))).select("alpha", r("tau"), "world", "permuted", "n_over")


@query(f"""WITH {SUP}, sp AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS split), nw AS (SELECT world, max_support FROM mx WHERE permuted),
hv AS (SELECT split, world, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws(':', 'half', split, world)), world) <= {NULL} // 2 AS first FROM nw CROSS JOIN sp),
pt AS (SELECT split, dir, world, first = (dir = 0) AS cal FROM hv CROSS JOIN (SELECT unnest([0, 1]) AS dir)),
t0 AS (SELECT split, dir, quantile_cont(max_support, [0.9, 0.95, 0.99]) AS q FROM pt JOIN nw USING (world) WHERE cal GROUP BY split, dir), tt AS (SELECT split, dir, unnest([0.1e0, 0.05e0, 0.01e0]) AS alpha, unnest(q) AS tau FROM t0),
kp AS (SELECT tt.alpha, tt.split, tt.dir, tt.tau, su.world, su.permuted, count_if(support >= tau - 1e-12) AS n FROM su CROSS JOIN tt GROUP BY ALL),
nu AS (SELECT alpha, k.split, k.dir, tau, avg(CAST(n = 0 AS DOUBLE)) AS na, avg(n) AS nr FROM kp k JOIN pt ON pt.split = k.split AND pt.dir = k.dir AND pt.world = k.world AND NOT cal GROUP BY ALL),
re AS (SELECT alpha, split, dir, avg(CAST(n = 0 AS DOUBLE)) AS ra, avg(n) AS rr FROM kp WHERE NOT permuted GROUP BY ALL)
SELECT alpha, round(avg(tau), 9) AS tau_mean, round(stddev_samp(tau), 7) AS tau_sd, round(min(tau), 9) AS tau_min, round(max(tau), 9) AS tau_max, round(avg(na), 9) AS null_abstention, round(avg(nr), 9) AS null_reported, round(avg(ra), 9) AS real_abstention, round(avg(rr), 9) AS real_reported
FROM nu JOIN re USING (alpha, split, dir) GROUP BY alpha""")
def split_half_calibration(spark, d):
    s = calibration.split_half(supports(spark, d), 20)
    return s.select("alpha", r("tau_mean"), r("tau_sd", 7), r("tau_min"), r("tau_max"), r("null_abstention"), r("null_reported"), r("real_abstention"), r("real_reported"))


GRID = f"gr AS (SELECT k, 1 - avg(CAST(max_support * {VOTES} >= k - 1e-9 AS DOUBLE)) AS control FROM mx CROSS JOIN (SELECT unnest(range(1, {VOTES} + 1)) AS k) WHERE permuted GROUP BY k), oc AS (SELECT control AS oracle FROM gr ORDER BY round(abs(control - 0.9), 12), control DESC LIMIT 1)"


@query(f"WITH {SUP}, {GRID} SELECT DISTINCT round(control, 9) AS control FROM gr")
def attainable_grid(spark, d):
    return calibration.attainable(calibration.maxima(supports(spark, d)), VOTES).select(r("control")).distinct()


@query(f"WITH {SUP}, {GRID} SELECT round(oracle, 9) AS oracle, round(0.9e0 - oracle, 9) AS grid_gap FROM oc")
def oracle_control(spark, d):
    return calibration.oracle_control(calibration.maxima(supports(spark, d)), VOTES, 0.9).select(r("oracle"), r("grid_gap"))


@query(f"""WITH {SUP}, {GRID}, rp AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS rep), ms AS (SELECT CAST(unnest([4, 8]) AS INTEGER) AS m),
sh AS (SELECT m, rep, world, max_support, row_number() OVER (PARTITION BY m, rep ORDER BY md5(concat_ws(':', 'curve', m, rep, world)), world) AS i FROM mx CROSS JOIN rp CROSS JOIN ms WHERE permuted),
tq AS (SELECT m, rep, quantile_cont(max_support, 0.9) AS tau FROM sh WHERE i <= m GROUP BY m, rep),
ev AS (SELECT m, rep, avg(CAST(max_support < tau - 1e-12 AS DOUBLE)) AS c, count(*) AS n FROM sh JOIN tq USING (m, rep) WHERE i > m GROUP BY m, rep)
SELECT m, round(avg(c), 9) AS control_mean, round(stddev_samp(c), 7) AS control_sd, max(n) AS n_heldout, round(any_value(oracle) - avg(c), 9) AS loss FROM ev CROSS JOIN oc GROUP BY m""")
def calibration_curve(spark, d):
    c = calibration.calibration_curve(calibration.maxima(supports(spark, d)), VOTES, [4, 8], 20, 0.1)
    return c.select("m", r("control_mean"), r("control_sd", 7), "n_heldout", r("loss"))


@query(f"WITH {SUP} SELECT round(avg(CAST(max_support >= 1 - 1e-12 AS DOUBLE)), 9) AS saturated, round(avg(CAST(max_support < 1 - 1e-12 AS DOUBLE)), 9) AS max_attainable FROM mx WHERE permuted")
def null_saturation(spark, d):
    return calibration.saturation(calibration.maxima(supports(spark, d))).select(r("saturated"), r("max_attainable"))


@query(f"WITH {SUP} SELECT alpha, max_support < 0.5 AS fired, max_support >= tau - 1e-12 AS reached, count(*) AS n FROM mx CROSS JOIN ta WHERE permuted GROUP BY ALL")
def fallback_reach(spark, d):
    s = supports(spark, d)
    return calibration.fallback_reach(s, 0.5, calibration.taus(calibration.maxima(s)))


@query(f"""WITH {SUP}, s AS (SELECT avg(CASE WHEN a.max_support > z.max_support THEN 1e0 WHEN a.max_support = z.max_support THEN 0.5e0 ELSE 0e0 END) AS effect FROM mx a CROSS JOIN mx z WHERE NOT a.permuted AND z.permuted)
SELECT round(effect, 9) AS effect FROM s""")
def prob_real_exceeds_null(spark, d):
    m = calibration.maxima(supports(spark, d)).withColumn("real", (~F.col("permuted")).cast("int"))
    return kernels.roc_auc(m, [], "max_support", "real").select(r("auc").alias("effect"))


@query(f"""WITH {SUP}, k AS (SELECT NOT permuted AS real, rank() OVER (ORDER BY max_support) + (count(*) OVER (PARTITION BY max_support) - 1) / 2e0 AS rk FROM mx),
t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM mx GROUP BY max_support)),
s AS (SELECT CAST(count_if(real) AS BIGINT) AS n1, CAST(count_if(NOT real) AS BIGINT) AS n0, sum(CASE WHEN real THEN rk END) AS s FROM k)
SELECT n1, n0, round(s - n1 * (n1 + 1) / 2, 9) AS u, round((s - n1 * (n1 + 1) / 2 - n1 * n0 / 2 - 0.5e0) / sqrt(n1 * n0 / 12e0 * (n1 + n0 + 1 - t / (CAST(n1 + n0 AS DOUBLE) * (n1 + n0 - 1)))), 7) AS z FROM s CROSS JOIN t""")
def mann_whitney_u(spark, d):
    m = calibration.maxima(supports(spark, d)).withColumn("real", (~F.col("permuted")).cast("int"))
    return kernels.mann_whitney(m, [], "max_support", "real").select("n1", "n0", r("u"), r("z", 7))


@query(f"""WITH {SUP}, s AS (SELECT world, sensor_id FROM su WHERE permuted AND support >= 0.3), z AS (SELECT world, count(*) AS n FROM s GROUP BY world),
pr AS (SELECT a.world AS a, b.world AS b, a.n AS na, b.n AS nb FROM z a JOIN z b ON a.world < b.world), j AS (SELECT pr.*, (SELECT count(*) FROM s x JOIN s y ON x.sensor_id = y.sensor_id WHERE x.world = pr.a AND y.world = pr.b) AS c FROM pr)
SELECT count(*) AS n_pairs, round(avg(c / (na + nb - c)), 9) AS mean FROM j""")
def null_structure(spark, d):
    s = supports(spark, d).filter("permuted and support >= 0.3")
    return stability.jaccard(s.select(F.col("world").alias("rep"), "sensor_id")).select("n_pairs", r("mean"))


@query(f"""WITH {SUP} SELECT permuted, count(*) AS n, round(median(n_half), 9) AS median_half, min(n_half) AS least_half, max(n_half) AS most_half, round(avg(max_support), 9) AS mean_max, round(quantile_cont(max_support, 0.95), 9) AS q95 FROM mx GROUP BY permuted""")
def null_summary(spark, d):
    m = calibration.maxima(supports(spark, d))
    return m.groupBy("permuted").agg(F.count("*").alias("n"), F.round(F.median("n_half"), 9).alias("median_half"), F.min("n_half").alias("least_half"), F.max("n_half").alias("most_half"), F.round(F.avg("max_support"), 9).alias("mean_max"), F.round(F.percentile("max_support", 0.95), 9).alias("q95"))
