"""Queries over single statistics, cleaning, correlation and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import cleaning, graph, kernels, resampling
from lotwise.plans import sql
from lotwise.sources import adapters

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def r(c: str, digits: int = 9):
    return F.round(c, digits).alias(c)


MED = "med AS (SELECT sensor_id, coalesce(quantile_cont(value, 0.5), 0) AS med FROM r GROUP BY sensor_id), f AS (SELECT r.unit_id, r.y, r.sensor_id, coalesce(r.value, med.med) AS value FROM r JOIN med USING (sensor_id))"


@query(f"""WITH {sql.F1R}, {MED}, {sql.auc("a", "f", "sensor_id")},
t AS (SELECT sensor_id, n1, n0, auc, round(abs(auc - 0.5), 12) AS score FROM a)
SELECT sensor_id, n1, n0, round(auc, 9) AS auc, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, sensor_id) AS INTEGER) AS rnk FROM t QUALIFY rnk <= 20""")
def sensor_auc_rank(spark, d):
    return cleaning.univariate_top(adapters.embedding_readings(spark, d), 20).select("sensor_id", "n1", "n0", r("auc"), r("score"), "rnk")


@query(f"""WITH {sql.F2R}, {sql.auc("a", "r", "sensor_id", "NULL")}
SELECT sensor_id, n1, n0, round(auc, 9) AS auc, round({sql.hanley()}, 9) AS se FROM a""")
def sensor_auc_hanley(spark, d):
    return kernels.auc_with_error(adapters.day_readings(spark, d), ["sensor_id"]).select("sensor_id", "n1", "n0", r("auc"), r("se"))


@query(f"""WITH {sql.F5R}, {sql.auc("a", "r", "sensor_id", "NULL")} SELECT sensor_id, n1, n0, round(auc, 9) AS auc FROM a""")
def sensor_auc_ties(spark, d):
    return kernels.roc_auc(adapters.order_readings(spark, d), ["sensor_id"], one_class=None).select("sensor_id", "n1", "n0", r("auc"))


@query(f"""WITH {sql.F3R}, v AS (SELECT sensor_id, value, sum(y) AS p, count(*) AS m FROM r GROUP BY sensor_id, value),
c AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS all_, sum(p) OVER (PARTITION BY sensor_id) AS n1 FROM v WINDOW w AS (PARTITION BY sensor_id ORDER BY value DESC ROWS UNBOUNDED PRECEDING))
SELECT sensor_id, round(sum(CAST(p AS DOUBLE) / n1 * tp / all_), 9) AS ap FROM c GROUP BY sensor_id""")
def avg_precision_by_sensor(spark, d):
    return kernels.average_precision(adapters.event_readings(spark, d), ["sensor_id"]).select("sensor_id", r("ap"))


@query(f"""WITH {sql.F6R}, q AS (SELECT unit_id, max(y) AS y, max(CAST(value IS NULL AS INTEGER)) AS gap FROM r GROUP BY unit_id),
s AS (SELECT sensor_id, count(*) AS n, count(value) AS o, min(value) AS lo, max(value) AS hi, md5(string_agg(coalesce(CAST(value AS VARCHAR), '-'), ',' ORDER BY unit_id)) AS sig FROM r GROUP BY sensor_id),
g AS (SELECT sig, count(*) AS c FROM s GROUP BY sig)
SELECT (SELECT count(*) FROM q) AS n_units, (SELECT CAST(sum(y) AS BIGINT) FROM q) AS n_fail, (SELECT CAST(sum(gap) AS BIGINT) FROM q) AS rows_with_any_missing, count(*) AS n_sensors,
 round(sum(n - o) / sum(n), 9) AS missing_frac_overall, CAST(count_if(o < n) AS BIGINT) AS sensors_any_missing, CAST(count_if((n - o) / n > 0.2) AS BIGINT) AS sensors_over_20, CAST(count_if((n - o) / n > 0.5) AS BIGINT) AS sensors_over_50, CAST(count_if(o = 0) AS BIGINT) AS sensors_all_missing,
 round(max((n - o) / n), 9) AS max_missing_frac, CAST(count_if(o = 0 OR lo = hi) AS BIGINT) AS constant_sensors, (SELECT count(*) FROM g WHERE c > 1) AS duplicate_groups, (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM g WHERE c > 1) AS duplicate_sensors_removable,
 (SELECT round(avg(y), 9) FROM q) AS fail_rate, (SELECT round((count(*) - sum(y)) / greatest(sum(y), 1), 9) FROM q) AS imbalance_ratio FROM s""")
def sensor_profile(spark, d):
    p = cleaning.profile(adapters.faulty_readings(spark, d))
    return p.select(*[r(c) if k == "double" else c for c, k in p.dtypes])


@query(f"""WITH {sql.F3U}, o AS (SELECT *, lag(ts) OVER (ORDER BY unit_id) AS prev FROM u)
SELECT min(ts) AS first_ts, max(ts) AS last_ts, coalesce(bool_and(ts >= prev), true) AS monotone FROM o""")
def time_span(spark, d):
    return cleaning.time_span(adapters.event_units(spark, d))


REASONS = f"""{sql.F6R}, s AS (SELECT sensor_id, count(*) AS n, count(value) AS o, min(value) AS lo, max(value) AS hi, md5(string_agg(coalesce(CAST(value AS VARCHAR), '-'), ',' ORDER BY unit_id)) AS sig FROM r GROUP BY sensor_id),
e AS (SELECT sensor_id, sig, CASE WHEN o = 0 THEN 'all_missing' WHEN lo = hi THEN 'constant' WHEN o / n < 0.1 THEN 'too_sparse' END AS early FROM s),
c AS (SELECT sensor_id, coalesce(early, CASE WHEN min(sensor_id) OVER (PARTITION BY sig, early IS NULL) < sensor_id THEN 'duplicate_of_' || min(sensor_id) OVER (PARTITION BY sig, early IS NULL) END) AS reason FROM e)"""


@query(f"WITH {REASONS} SELECT sensor_id, reason FROM c")
def cleaner_reasons(spark, d):
    return cleaning.cleaner(adapters.faulty_readings(spark, d), min_observed=0.1)


@query(f"WITH {REASONS} SELECT regexp_replace(reason, '_of_.*', '') AS reason, count(*) AS n_sensors FROM c WHERE reason IS NOT NULL GROUP BY ALL")
def cleaner_counts(spark, d):
    return cleaning.drop_counts(cleaning.cleaner(adapters.faulty_readings(spark, d), min_observed=0.1))


@query(f"WITH {REASONS} SELECT r.sensor_id, count(*) AS n, round(sum(value), 6) AS total FROM r JOIN c USING (sensor_id) WHERE reason IS NULL GROUP BY r.sensor_id")
def cleaned_readings(spark, d):
    x = adapters.faulty_readings(spark, d)
    return cleaning.kept_readings(x, cleaning.cleaner(x, min_observed=0.1)).groupBy("sensor_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"""WITH {sql.F2R}, m AS (SELECT sensor_id FROM r GROUP BY sensor_id HAVING avg(CAST(value IS NULL AS DOUBLE)) >= 0.01)
SELECT unit_id, 'miss_' || sensor_id AS name, CAST(value IS NULL AS INTEGER) AS value FROM r SEMI JOIN m USING (sensor_id)""")
def missing_indicators(spark, d):
    return cleaning.missing_indicators(adapters.day_readings(spark, d))


@query(f"""WITH {sql.F2R}, {MED}, z AS (SELECT sensor_id, avg(value) AS m, stddev_pop(value) AS s FROM f GROUP BY sensor_id)
SELECT unit_id, sensor_id, round(value, 6) AS value, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM f JOIN z USING (sensor_id)""")
def impute_standardise(spark, d):
    x = adapters.day_readings(spark, d)
    filled = cleaning.impute(x, cleaning.medians(x))
    return cleaning.standardise(filled, filled).select("unit_id", "sensor_id", r("value", 6), r("z", 6))


FOLDS = "fo AS (SELECT unit_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', 'fold', 0, unit_id)), unit_id) - 1) % 5 AS INTEGER) AS fold FROM u)"


@query(f"""WITH {sql.F1U}, {sql.F1R}, {FOLDS}, tr AS (SELECT k.fold, r.* FROM r JOIN fo USING (unit_id) JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold) k ON k.fold <> fo.fold),
{sql.auc("a", "tr", "fold, sensor_id")}, t AS (SELECT *, round(abs(auc - 0.5), 12) AS score FROM a)
SELECT fold, sensor_id, round(auc, 9) AS auc, CAST(row_number() OVER (PARTITION BY fold ORDER BY score DESC, sensor_id) AS INTEGER) AS rnk FROM t QUALIFY rnk <= 5""")
def univariate_topk_train_only(spark, d):
    folds = resampling.stratified_folds(adapters.embedding_units(spark, d)).select("unit_id", F.col("fold").alias("own"))
    train = adapters.embedding_readings(spark, d).join(folds, "unit_id").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("fold <> own")
    return cleaning.univariate_top(train, 5, ["fold"]).select("fold", "sensor_id", r("auc"), "rnk")


CORR = f"""{REASONS}, kept AS (SELECT r.* FROM r JOIN c USING (sensor_id) WHERE reason IS NULL OR reason LIKE 'dup%'),
med AS (SELECT sensor_id, coalesce(quantile_cont(value, 0.5), 0) AS med FROM kept GROUP BY sensor_id), f AS (SELECT unit_id, y, sensor_id, coalesce(value, med) AS value FROM kept JOIN med USING (sensor_id)),
co AS (SELECT x.sensor_id AS a, z.sensor_id AS b, CASE WHEN min(x.value) = max(x.value) OR min(z.value) = max(z.value) THEN 0 ELSE corr(x.value, z.value) END AS r FROM f x JOIN f z ON x.unit_id = z.unit_id AND x.sensor_id < z.sensor_id GROUP BY ALL)"""
CUT = 0.13


def correlated(spark, d):
    """Sensors of the faulty table but for constant and missing ones, imputed."""
    x = adapters.faulty_readings(spark, d)
    good = cleaning.cleaner(x, min_observed=0.1).filter("reason is null or reason like 'dup%'").select("sensor_id")
    x = x.join(F.broadcast(good), "sensor_id", "left_semi")
    return cleaning.impute(x, cleaning.medians(x))


@query(f"WITH {CORR} SELECT a, b, round(r, 7) AS r FROM co")
def pearson_pairs(spark, d):
    return graph.pearson(correlated(spark, d)).select("a", "b", r("r", 7))


COMP = f"""{CORR}, ed AS (SELECT a, b FROM co WHERE round(abs(r), 9) >= {CUT} UNION ALL SELECT b, a FROM co WHERE round(abs(r), 9) >= {CUT}),
reach(node, other) AS (SELECT DISTINCT sensor_id, sensor_id FROM f UNION SELECT reach.node, ed.b FROM reach JOIN ed ON reach.other = ed.a),
cl AS (SELECT node AS sensor_id, min(other) AS cluster_id FROM reach GROUP BY node)"""


@query(f"WITH RECURSIVE {COMP} SELECT sensor_id, cluster_id FROM cl")
def correlation_components(spark, d):
    return graph.correlation_clusters(correlated(spark, d), CUT)


@query(f"""WITH RECURSIVE {COMP}, {sql.auc("sa", "f", "sensor_id")}, t AS (SELECT sensor_id, cluster_id, round(abs(auc - 0.5), 12) AS score, count(*) OVER (PARTITION BY cluster_id) AS n_members FROM cl JOIN sa USING (sensor_id))
SELECT cluster_id, sensor_id, round(score, 9) AS score, n_members FROM t QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY t.score DESC, sensor_id) = 1""")
def cluster_reps(spark, d):
    x = correlated(spark, d)
    return graph.representatives(graph.correlation_clusters(x, CUT), cleaning.univariate(x, imputed=True)).select("cluster_id", "sensor_id", r("score"), "n_members")


@query(f"""WITH RECURSIVE {COMP}, g AS (SELECT cluster_id, count(*) AS c FROM cl GROUP BY cluster_id)
SELECT count(*) AS n_clusters, max(c) AS largest, CAST(coalesce(sum(CASE WHEN c > 1 THEN c END), 0) AS BIGINT) AS in_multi FROM g""")
def cluster_sizes(spark, d):
    g = graph.correlation_clusters(correlated(spark, d), CUT).groupBy("cluster_id").agg(F.count("*").alias("c"))
    return g.agg(F.count("*").alias("n_clusters"), F.max("c").alias("largest"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).cast("bigint").alias("in_multi"))


@query(f"WITH {sql.F4U} SELECT unit_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', 'fold', 0, unit_id)), unit_id) - 1) % 5 AS INTEGER) AS fold FROM u")
def stratified_folds(spark, d):
    return resampling.stratified_folds(adapters.document_units(spark, d)).drop("rep")


@query(f"""WITH {sql.F4U}, x AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS rep)
SELECT rep, unit_id, y, CAST((row_number() OVER (PARTITION BY rep, y ORDER BY md5(concat_ws(':', 'fold', rep, unit_id)), unit_id) - 1) % 5 AS INTEGER) AS fold FROM u CROSS JOIN x""")
def repeated_folds(spark, d):
    return resampling.stratified_folds(adapters.document_units(spark, d), n_reps=5)


@query(f"""WITH {sql.F4U}, x AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS rep),
o AS (SELECT rep, unit_id, y, row_number() OVER (PARTITION BY rep, y ORDER BY md5(concat_ws(':', 'split', rep, unit_id)), unit_id) AS i, count(*) OVER (PARTITION BY rep, y) AS n FROM u CROSS JOIN x)
SELECT rep, unit_id, y, CASE WHEN i <= round(n * 0.3e0) THEN 'test' ELSE 'train' END AS role FROM o""")
def shuffle_split(spark, d):
    return resampling.shuffle_split(adapters.document_units(spark, d), 3, 0.3)


@query(f"WITH {sql.F1U}, {sql.boot(8, 50)} SELECT CAST(rep AS INTEGER) AS rep, unit_id, y, mult FROM b")
def bootstrap_draws(spark, d):
    return resampling.bootstrap(adapters.embedding_units(spark, d), 8, 50)


@query(f"""WITH {sql.F4U}, x AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS rep), o AS (SELECT unit_id, y, row_number() OVER (ORDER BY md5(concat_ws(':', 'order', unit_id)), unit_id) AS i FROM u),
p AS (SELECT rep, unit_id, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws(':', 'perm', rep, unit_id)), unit_id) AS i FROM u CROSS JOIN x)
SELECT p.rep, p.unit_id, o.y FROM p JOIN o USING (i)""")
def permuted_labels(spark, d):
    return resampling.permuted_labels(adapters.document_units(spark, d), 3)


@query(f"""WITH {sql.F4U}, x AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS rep)
SELECT rep, unit_id, CAST(ntile(5) OVER (PARTITION BY rep ORDER BY md5(concat_ws(':', 'block', rep, unit_id)), unit_id) AS INTEGER) AS block FROM u CROSS JOIN x""")
def permuted_blocks(spark, d):
    return resampling.permuted_blocks(adapters.document_units(spark, d), 5, 3)


@query(f"""WITH {sql.F2R}, o AS (SELECT sensor_id, value, row_number() OVER (PARTITION BY sensor_id ORDER BY md5(concat_ws(':', 'order', unit_id)), unit_id) AS i FROM r), x AS (SELECT CAST(unnest(range(2)) AS INTEGER) AS rep),
p AS (SELECT rep, sensor_id, unit_id, row_number() OVER (PARTITION BY rep, sensor_id ORDER BY md5(concat_ws(':', 'column', rep, sensor_id, unit_id)), unit_id) AS i FROM r CROSS JOIN x)
SELECT p.rep, p.sensor_id, p.unit_id, round(o.value, 9) AS value FROM p JOIN o USING (sensor_id, i)""")
def permuted_column(spark, d):
    return resampling.permuted_column(adapters.day_readings(spark, d), 2).withColumn("value", F.round("value", 9))


@query(f"WITH {sql.F3U} SELECT unit_id, y, ts, CASE WHEN row_number() OVER (ORDER BY ts, unit_id) <= round_even(count(*) OVER () * 0.7e0, 0) THEN 'train' ELSE 'test' END AS role FROM u")
def chronological_split(spark, d):
    return resampling.chronological(adapters.event_units(spark, d))


@query(f"""WITH {sql.F3U}, b AS (SELECT *, ntile(5) OVER (ORDER BY ts, unit_id) AS block FROM u), o AS (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS origin)
SELECT origin, CASE WHEN block <= origin THEN 'train' ELSE 'test' END AS role, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_fail, min(ts) AS first_ts, max(ts) AS last_ts FROM b JOIN o ON block <= origin + 1 GROUP BY ALL""")
def rolling_origin(spark, d):
    return resampling.rolling_origin(adapters.event_units(spark, d), 5).groupBy("origin", "role").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("n_fail"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
