"""Fragments of the DuckDB SQL that checks the queries: the fixtures as CTEs, and kernels written another way."""

from __future__ import annotations

F1U = "u AS (SELECT vec_id AS unit_id, CAST(label = 3 AS INTEGER) AS y FROM embeddings)"
F1R = "r AS (SELECT vec_id AS unit_id, CAST(label = 3 AS INTEGER) AS y, CAST(unnest(range(len(embedding))) AS INTEGER) AS sensor_id, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
F6R = """w AS (SELECT vec_id AS unit_id, CAST(label = 3 AS INTEGER) AS y, list_concat(CAST(embedding AS DOUBLE[]),
 [CAST(7 AS DOUBLE), CAST(embedding[1] AS DOUBLE), CAST(NULL AS DOUBLE), CASE WHEN vec_id % 20 = 0 THEN CAST(embedding[2] AS DOUBLE) END]) AS v FROM embeddings),
r AS (SELECT unit_id, y, CAST(unnest(range(len(v))) AS INTEGER) AS sensor_id, unnest(v) AS value FROM w)"""
F2R = """e AS (SELECT *, user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS unit_id FROM events),
l AS (SELECT unit_id, max(CAST(event_type = 'error' AS INTEGER)) AS y FROM e GROUP BY unit_id),
s AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type, CAST(unnest(range(5)) AS INTEGER) AS sensor_id),
r AS (SELECT l.unit_id, l.y, s.sensor_id, avg(e.value) AS value FROM l CROSS JOIN s LEFT JOIN e ON e.unit_id = l.unit_id AND e.event_type = s.event_type GROUP BY l.unit_id, l.y, s.sensor_id)"""
F3U = "u AS (SELECT event_id AS unit_id, CAST(event_type = 'error' AS INTEGER) AS y, ts FROM events)"
F3R = """r AS (SELECT event_id AS unit_id, CAST(event_type = 'error' AS INTEGER) AS y, ts, CAST(unnest(range(4)) AS INTEGER) AS sensor_id,
 unnest([value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), CAST(hour(ts) AS DOUBLE), CAST(user_id % 97 AS DOUBLE)]) AS value FROM events)"""
F4U = "u AS (SELECT doc_id AS unit_id, CAST(quality = 0 AS INTEGER) AS y FROM labels)"
F5R = """r AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(epoch(l_shipdate) AS BIGINT)) AS unit_id, CAST(l_returnflag = 'R' AS INTEGER) AS y,
 CAST(unnest(range(4)) AS INTEGER) AS sensor_id, unnest([l_quantity, l_discount, l_tax, l_extendedprice]) AS value FROM lineitem)"""


def auc(name: str, source: str, keys: str, one_class: str = "0.5") -> str:
    """CTEs name_k (mean ranks) and name (keys, n1, n0, auc) by the rank-sum formula."""
    return f"""{name}_k AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2e0 AS rk FROM {source} WHERE value IS NOT NULL),
{name} AS (SELECT {keys}, CAST(sum(y) AS BIGINT) AS n1, CAST(count(*) - sum(y) AS BIGINT) AS n0,
 CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN rk ELSE 0e0 END) - sum(y) * (sum(y) + 1) / 2e0) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))) ELSE CAST({one_class} AS DOUBLE) END AS auc FROM {name}_k GROUP BY {keys})"""


def hanley(a: str = "auc", n1: str = "n1", n0: str = "n0") -> str:
    return f"CASE WHEN {a} IS NOT NULL THEN sqrt(greatest(({a} * (1 - {a}) + ({n1} - 1) * ({a} / (2 - {a}) - {a} * {a}) + ({n0} - 1) * (2 * {a} * {a} / (1 + {a}) - {a} * {a})) / (CAST({n1} AS DOUBLE) * {n0}), 1e-12)) END"


def draw(text: str, n: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 12)) AS BIGINT) % {n}"


def boot(n_reps: int, least: int, source: str = "u") -> str:
    """CTEs o (units in hashed order) and b (rep, unit_id, y, mult)."""
    return f"""o AS (SELECT unit_id, y, row_number() OVER (ORDER BY md5(concat_ws(':', 'order', unit_id)), unit_id) AS i, count(*) OVER () AS n FROM {source}),
dr AS (SELECT rep, {draw("concat_ws(':', 'boot', rep, i)", "n")} + 1 AS i FROM o CROSS JOIN (SELECT unnest(range({n_reps})) AS rep)),
b0 AS (SELECT rep, unit_id, y, count(*) AS mult FROM dr JOIN o USING (i) GROUP BY rep, unit_id, y),
b AS (SELECT * FROM b0 WHERE rep IN (SELECT rep FROM b0 GROUP BY rep HAVING sum(y * mult) >= {least}))"""


def wauc(name: str, source: str, keys: str) -> str:
    """AUC of rows with a multiplicity mult: mean rank = weight below + (own weight + 1) / 2."""
    return f"""{name}_v AS (SELECT {keys}, value, CAST(sum(mult * y) AS DOUBLE) AS p, CAST(sum(mult) AS DOUBLE) AS m FROM {source} WHERE value IS NOT NULL GROUP BY {keys}, value),
{name}_c AS (SELECT *, sum(m) OVER (PARTITION BY {keys} ORDER BY value ROWS UNBOUNDED PRECEDING) - m AS below FROM {name}_v),
{name} AS (SELECT {keys}, sum(p) AS n1, sum(m) - sum(p) AS n0, (sum(p * (below + (m + 1) / 2)) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * (sum(m) - sum(p))) AS auc FROM {name}_c GROUP BY {keys})"""
