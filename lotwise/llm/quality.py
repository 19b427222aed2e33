"""Operator 5, quality classifier: an interpolated modified Kneser-Ney model of byte 5-grams.

The model is trained on trusted text, the documents that labels call good, but for one in HELD of them, which are held
out. Documents are dealt into blocks of some megabytes by a hash of doc_id. A block gives each of its distinct 5-grams
once, with how often trusted text of the block has it. These rows, a small part of the text, meet the count tables:
joins on n-gram, context and suffix, order by order, give the probability of every distinct 5-gram of the corpus after
Chen and Goodman, and a last join takes the costs back to the blocks that asked. No table is collected or broadcast,
and no n-gram moves once an occurrence. The texts move twice, once to be counted and once to be scored.

A document's score is its cost in nats a byte, shrunk to the mean of trusted text by PRIOR bytes, as a few words prove
little; its perplexity is exp(score). It is kept if the score is at most its language's threshold: the QUANTILE of the
scores of held-out trusted documents, in steps of a thousandth, plus MARGIN.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import text as words
from lotwise.llm.tables import drop, joined, written

ORDER, SYMBOLS = 5, 256
QUANTILE, MARGIN, PRIOR, TRUSTED_LEAST, HELD = 0.995, 0.05, 100, 20, 5
BLOCK_BYTES = 32 << 20


def codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 5-gram that ends at each byte, as 40 bits; before a row stand line ends."""
    x = data.astype(np.int64)
    out = x.copy()
    place = np.arange(len(x)) - np.repeat(at[:-1], np.diff(at))
    for back in range(1, ORDER):
        before = np.full(len(x), 10, np.int64)
        before[back:] = x[:-back]
        before[place < back] = 10
        out += before << (8 * back)
    return out


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of parts (codes, counts) with their counts added up."""
    value, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return value, np.bincount(place, np.concatenate([n for _, n in parts]), len(value)).astype(np.int64)


def in_blocks(documents: DataFrame, n: int) -> DataFrame:
    """(block, doc_id, lang, text_id, text) dealt into n blocks; rows with one doc_id are in one block, those without
    any are dealt by text."""
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("text_id"), "text")
    return own.withColumn("block", block_of(n)).repartition(n, "block")


def block_of(n: int, otherwise: str = "text_id") -> Column:
    return F.pmod(F.when(F.col("doc_id").isNull(), F.col(otherwise)).otherwise(F.xxhash64("doc_id")), F.lit(n)).cast("long")


def block_grams(blocks: DataFrame, training: DataFrame) -> DataFrame:
    """(block, code, n): the distinct 5-grams of each block, n times in documents of training(doc_id)."""

    def run(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
        ids = docs.column("doc_id").combine_chunks()
        wanted = np.isin(ids.fill_null(0).to_numpy(), marks.column("doc_id").to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for low, high, data, at in words.chunks(docs.column("text")) if len(ids) else []:
            found, mine = codes(data, at), np.repeat(wanted[low:high], np.diff(at))
            parts.append(np.unique(found[mine], return_counts=True))
            other = np.unique(found[~mine])
            parts.append((other, np.zeros(len(other), np.int64)))
            if len(parts) > 32:
                parts = [added(parts)]
        value, n = added(parts)
        return pa.table({"block": pa.array(np.full(len(value), key[0].as_py(), np.int64)), "code": pa.array(value), "n": pa.array(n)})

    texts = blocks.select("block", "doc_id", "text").groupBy("block")
    return texts.cogroup(training.groupBy("block")).applyInArrow(run, "block bigint, code bigint, n bigint")


def discounts(counts: DataFrame) -> list[float]:
    """Chen and Goodman's three discounts of counts(n); a half where counts of counts are missing, as in tiny corpora."""
    n1, n2, n3, n4 = counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 and n4 else None]
    return [0.5 if v is None else min(max(v, 0.05), k - 0.05) for k, v in enumerate(out, 1)]


def probabilities(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(code, p) of each of asked(code) under the model of counts(code, n), n occurrences in training text.

    Under the highest order n is the number of different symbols seen before an n-gram. A context that was never seen
    leaves all to the shorter one; under the shortest stand SYMBOLS equal symbols.
    """
    tables, made = [], []
    for size in range(ORDER, 0, -1):
        less = discounts(counts)
        c = counts.withColumn("context", F.shiftright("code", 8)).withColumn("d", F.when(F.col("n") == 1, less[0]).when(F.col("n") == 2, less[1]).otherwise(less[2]))
        contexts = c.groupBy("context").agg(F.sum("n").cast("double").alias("all"), F.sum("d").alias("free"))
        tables.append((asked, c.select("code", (F.col("n") - F.col("d")).alias("seen")), contexts))
        suffix = F.col("code").bitwiseAND((1 << 8 * (size - 1)) - 1).alias("code")
        if size > 1:
            asked = written(asked.select(suffix).distinct(), "quality-asked")
            counts = written(counts.groupBy(suffix).agg(F.count("*").alias("n")), "quality-counts")
            made += [asked, counts]
    below = tables[-1][0].select("code", F.lit(1.0 / SYMBOLS).alias("p"))
    for size, (own, seen, contexts) in enumerate(reversed(tables), 1):
        down = F.col("code").bitwiseAND((1 << 8 * (size - 1)) - 1) if size > 1 else F.col("code")
        rows = own.withColumn("context", F.shiftright("code", 8)).withColumn("down", down)
        rows = rows.join(seen.hint("merge"), "code", "left").join(contexts.hint("merge"), "context", "left")
        rows = rows.join(below.withColumnsRenamed({"code": "down", "p": "lower"}).hint("merge"), "down")
        p = F.when(F.col("all").isNull(), F.col("lower")).otherwise((F.coalesce("seen", F.lit(0.0)) + F.col("free") * F.col("lower")) / F.col("all"))
        below, last = written(rows.select("code", p.alias("p")), "quality-order"), below
        if size > 1:
            drop(last)
    for table in made:
        drop(table)
    return below


SCORES = "doc_id bigint, lang string, text_id bigint, n_symbols bigint, score double"


def block_scores(blocks: DataFrame, costs: DataFrame, mean: float) -> DataFrame:
    """SCORES a row of blocks, whose 5-grams all have a cost in costs(block, code, cost)."""

    def run(key: tuple, docs: pa.Table, table: pa.Table) -> pa.Table:
        code, cost = table.column("code").to_numpy(), table.column("cost").to_numpy()
        order = np.argsort(code)
        code, cost = code[order], cost[order].astype(float)
        n, total = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows)
        for low, high, data, at in words.chunks(docs.column("text")) if docs.num_rows else []:
            found = codes(data, at)
            i = np.minimum(np.searchsorted(code, found), len(code) - 1)
            if (code[i] != found).any():
                raise ValueError("a 5-gram without a cost: the documents changed between two readings")
            n[low:high] = size = np.diff(at)
            some = np.flatnonzero(size)
            if len(some):
                total[low + some] = np.add.reduceat(cost[i], at[some])
        return docs.select(["doc_id", "lang", "text_id"]).append_column("n_symbols", pa.array(n)).append_column("score", pa.array((total + PRIOR * mean) / (n + PRIOR)))

    return blocks.select("block", "doc_id", "lang", "text_id", "text").groupBy("block").cogroup(costs.groupBy("block")).applyInArrow(run, SCORES)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, held) of each document that labels call good."""
    ids = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return ids.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD)) == 0)


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """SCORES a row of documents, by the model of the trusted documents that are not held out; without any such text
    all symbols cost the same."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    training = trusted_ids(labels).filter("not held").withColumn("block", block_of(n, "doc_id")).select("block", "doc_id")
    grams = written(block_grams(in_blocks(documents, n), training), "quality-grams")
    totals = written(grams.groupBy("code").agg(F.sum("n").alias("n")), "quality-totals")
    p = probabilities(totals.select("code"), totals.filter("n > 0"))
    cost = written(totals.join(p.hint("merge"), "code").select("code", "n", (-F.log("p")).cast("float").alias("cost")), "quality-costs")
    drop(p)
    drop(totals)
    all_, spent = cost.agg(F.sum("n"), F.sum(F.col("n") * F.col("cost"))).first()
    asked = grams.select("block", "code").join(cost.select("code", "cost").hint("merge"), "code")
    out = written(block_scores(in_blocks(documents, n), asked, spent / all_ if all_ else float(np.log(SYMBOLS))), "quality-scores")
    for table in (grams, cost):
        drop(table)
    return out


def thresholds(found: DataFrame, quantile: float, margin: float) -> DataFrame:
    """(lang, threshold) of found(lang, score), for languages with at least TRUSTED_LEAST rows, and for all together
    under a null lang. Scores are counted in steps of a thousandth, a table bounded for each language."""
    each = found.groupBy("lang", F.ceil(F.col("score") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    bins = each.filter("lang is not null").unionByName(each.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n"))
    own = Window.partitionBy("lang")
    through = bins.withColumn("through", F.sum("n").over(own.orderBy("bin"))).withColumn("docs", F.sum("n").over(own))
    reached = through.filter(F.col("through") >= F.col("docs") * quantile).groupBy("lang").agg((F.min("bin") / 1000 + margin).alias("threshold"), F.first("docs").alias("docs"))
    return reached.filter((F.col("docs") >= TRUSTED_LEAST) | F.col("lang").isNull()).select("lang", "threshold")


def judged(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, text_id, n_symbols, score, threshold, kept) a row of documents; text_id is xxhash64 of the text.

    Trusted are the documents with a label quality = 1. The held-out ones of a language decide its threshold; a null
    language, or one with fewer than TRUSTED_LEAST of them, has the threshold of all held-out text. Null and empty
    texts score the mean and are kept. Without held-out or without training text nothing is rejected: threshold is
    null. Further columns play no part; repeated rows and rows without doc_id have rows of their own.
    """
    found = scores(documents, labels)
    ids = trusted_ids(labels)
    # Labels grow with the documents, so that they are never broadcast, at no size.
    held = found.filter("n_symbols > 0").join(ids.filter("held").hint("merge"), "doc_id", "left_semi")
    limits = written(thresholds(held.select("lang", "score"), quantile, margin), "quality-limits")
    overall = limits.filter("lang is null").first()
    trained = ids.filter("not held").join(found.filter("n_symbols > 0").select("doc_id").hint("merge"), "doc_id", "left_semi").head(1)
    total = F.lit(overall["threshold"] if overall and trained else None).cast("double")
    if not overall or not trained:
        out = found.withColumn("threshold", total)
    else:
        times = found.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n_rows")).join(limits.filter("lang is not null"), "lang", "left")
        own = joined(found.filter("lang is not null"), written(times, "quality-languages"), ["lang"], found.count()).drop("n_rows")
        out = own.unionByName(found.filter("lang is null").withColumn("threshold", F.lit(None).cast("double"))).withColumn("threshold", F.coalesce("threshold", total))
    kept = (F.col("n_symbols") == 0) | F.col("threshold").isNull() | (F.col("score") <= F.col("threshold"))
    return out.select("doc_id", "lang", "text_id", "n_symbols", "score", "threshold", kept.alias("kept"))


def kept(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """documents without those that the classifier rejects, with all their columns."""
    gone = judged(documents, labels, **how).filter("not kept").select(F.col("doc_id").alias("_doc"), F.col("lang").alias("_lang"), F.col("text_id").alias("_text")).distinct().hint("merge")
    same = documents["doc_id"].cast("bigint").eqNullSafe(F.col("_doc")) & documents["lang"].cast("string").eqNullSafe(F.col("_lang")) & (F.xxhash64(documents["text"]) == F.col("_text"))
    return documents.join(gone, same, "left_anti")
