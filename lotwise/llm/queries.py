"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import brown, decontaminate, htmltext, jaccard, linededup, mixing, negatives, periodic, quality, sharding, substring, tiff, warc
from lotwise.llm.tables import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each time that the mixture takes a document of ``documents``, with its place among its source's blocks."""
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` before and after repeated ones are dropped, with the digest of what stays."""
    documents = read(spark, sf_dir, "documents")
    state = linededup.line_state(documents)
    return linededup.without_repeated_lines(documents, state).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` before and after repeated spans of 50 words are removed, with the digest of what stays."""
    return substring.without_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ``documents`` in which items of ``benchmark`` are found, copied or edited."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ``documents`` within their language's threshold, the model trained on trusted ``labels``."""
    found = quality.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).filter("kept")
    return found.select("doc_id", "lang", "n_symbols", F.exp("score").alias("perplexity"), F.exp("threshold").alias("threshold"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ``pages``, written to archives, read back and merged by URL key and time."""
    return warc.captures(read(spark, sf_dir, "pages")).drop("archive", "offset", "length", "url")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of ``documents`` with the size of its shingle set and its component of near copies."""
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link between different shingle sets of ``documents``."""
    return jaccard.near_links(read(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of each row of ``pages``."""
    return htmltext.visible_text(read(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of each document of ``documents``."""
    return sharding.shards_of(read(spark, sf_dir, "documents"))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` stored as TIFF, read back, with their features."""
    return tiff.stored_features(tiff.store_texts(read(spark, sf_dir, "documents")))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in each text of ``documents``, a tenth of which get a periodic tail first."""
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periodic.run_digests(periodic.periodic_runs(read(spark, sf_dir, "documents"), seed=seed))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors of ``embeddings``, the rows whose vec_id is divisible by 100."""
    rows = negatives.quantised(read(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a class model that learns from four in five of them."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return brown.scored(read(spark, sf_dir, "documents").withColumn("held_out", held_out))


QUERIES = {"op1_mixing": op1_mixing, "op2_line_dedup": op2_line_dedup, "op3_substring": op3_substring, "op4_decontaminate": op4_decontaminate, "op5_quality": op5_quality, "op6_warc": op6_warc, "op7_jaccard": op7_jaccard, "op7_links": op7_links, "op8_html": op8_html, "op9_sharding": op9_sharding, "op10_tiff": op10_tiff, "op11_periodic": op11_periodic, "op12_negatives": op12_negatives, "op13_brown": op13_brown}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The CRC-32 of a decimal doc_id, bit by bit.
CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"
ORACLES: dict[str, str] = {
    "op2_line_dedup": rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UPPER}', '{LOWER}') AS line_key FROM l),
h AS (SELECT line_key AS hot, max(doc_id) AS keeper FROM k WHERE length(line_key) >= 40 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, hot IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN h ON line_key = hot)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id""",
    "op3_substring": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i, len(words) AS n FROM w),
s AS (SELECT p.doc_id, p.i, md5(array_to_string(w.words[p.i : p.i + 49], ' ')) AS h FROM p JOIN w ON p.doc_id = w.doc_id WHERE p.i + 49 <= p.n),
o AS (SELECT h, min(doc_id) AS owner FROM s GROUP BY h HAVING count(*) > 1),
d AS (SELECT DISTINCT s.doc_id, s.i FROM s JOIN o ON s.h = o.h WHERE s.doc_id > owner),
c AS (SELECT p.doc_id, p.i, p.word, max(d.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM p LEFT JOIN d ON p.doc_id = d.doc_id AND p.i = d.i),
g AS (SELECT doc_id, count(*) AS n_words, CAST(count_if(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON w.doc_id = g.doc_id""",
    "op7_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS MATERIALIZED (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [md5(array_to_string(words, ' '))]
      ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: md5(array_to_string(words[i : i + 4], ' ')))) END AS shingles FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS size, md5(array_to_string(list_sort(shingles), ' ')) AS digest FROM t),
class AS MATERIALIZED (SELECT digest, min(doc_id) AS class_id, any_value(size) AS size FROM n WHERE size > 0 GROUP BY digest),
s AS MATERIALIZED (SELECT t.doc_id, unnest(shingles) AS shingle FROM t JOIN class ON t.doc_id = class_id),
pair AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN class x ON a = x.class_id JOIN class y ON b = y.class_id WHERE 100 * common >= 80 * (x.size + y.size - common)),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, other) AS (SELECT class_id, class_id FROM class UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT n.doc_id, n.size AS n_shingles, coalesce(comp.component_id, n.doc_id) AS component_id, coalesce(class.class_id, n.doc_id) AS class_id
FROM n LEFT JOIN class ON n.digest = class.digest AND n.size > 0 LEFT JOIN comp ON class.class_id = comp.node""",
}
ORACLES["op11_periodic"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM d),
e AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) END AS w FROM g),
x AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM e),
m AS (SELECT y.doc_id, y.i, z.i - y.i AS q FROM x y JOIN x z ON y.doc_id = z.doc_id AND y.word = z.word WHERE z.i > y.i AND 2 * (z.i - y.i) <= y.n),
o AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
c AS MATERIALIZED (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM o GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, 12 - q)),
r AS MATERIALIZED (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.doc_id = c.doc_id AND z.q < c.q AND z.start <= c.start AND z.start + z.length >= c.start + c.length)),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', q, chr(10)), '' ORDER BY start, q) AS lines FROM r GROUP BY doc_id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS text FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i WHERE gone.i IS NULL GROUP BY x.doc_id)
SELECT e.doc_id, n AS n_words, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, 1000 * length // q AS exponent_milli
FROM e LEFT JOIN t ON t.doc_id = e.doc_id LEFT JOIN b ON b.doc_id = e.doc_id LEFT JOIN kept ON kept.doc_id = e.doc_id"""
ORACLES["op12_negatives"] = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""
# The links from which the SQL of op7_jaccard makes its components.
ORACLES["op7_links"] = ORACLES["op7_jaccard"].split("\nboth_ways AS")[0].rstrip(",") + "\nSELECT a, b FROM link"
