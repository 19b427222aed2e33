"""Operator 1, mixing sources to target weights by temperature.

Token shares p of the sources become weights p^a / sum p^a. The exponent a is bisected between 1 (the corpus as it is)
and 0 (all sources alike): the largest a whose weights reach the target entropy, raised as far as needed to keep the
most repeated source within the repetition limit. A source's budget is its weight times the token budget, rounded down,
so that neither it nor the limit is exceeded. It is realised as block permutations: documents are dealt into blocks by
hash, each epoch orders the source's blocks anew by a keyed hash, whole epochs are taken while the budget lasts, and of
the last epoch the blocks up to the budget; of the block at its edge, the documents that still fit.

Sums over sources are Spark aggregates, 63 exponents a pass (six bisections at once), so that nothing depends on how
many sources there are. The windows run over a source's blocks, at most BLOCKS, and over the documents of edge blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import text as words
from lotwise.llm.tables import written

TARGET, REPEATS, BLOCKS, BLOCK_TOKENS, PASSES = 0.97, 3.0, 1024, 20_000, 5
#: Four units in the last place, so that a share of all tokens that is whole stays whole when rounded down.
EXACT = 1 + 2.0**-50


def source_tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, source, tokens) a row of documents; a null source counts as the source ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in words.chunks(batch.column(2)):
                tokens = pa.array(np.diff(words.Words(data, at).first).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), tokens], ["doc_id", "source", "tokens"])

    own = documents.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    return own.mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def exponent(sources: DataFrame, target: float = TARGET, repeats: float = REPEATS, budget_share: float = 1.0) -> float:
    """The exponent for sources(source, tokens): entropy at least target * ln(sources) if a >= 0 can give it, and no
    source taken more than ``repeats`` times from a budget of budget_share of all tokens, if a <= 1 can give that."""
    head = sources.filter("tokens > 0").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("tokens").alias("least")).first()
    if not head["n"] or head["n"] == 1:
        return 1.0
    p = F.col("tokens") / F.lit(float(head["t"]))

    def measured(points: list[float]) -> list[tuple[float, float]]:
        """Entropy and most repetitions at each exponent."""
        sums = sources.filter("tokens > 0").agg(*[F.sum(F.pow(p, F.lit(a))) for a in points], *[F.sum(F.pow(p, F.lit(a)) * F.log(p)) for a in points]).first()
        least, n = head["least"] / head["t"], len(points)
        return [(np.log(sums[i]) - a * sums[n + i] / sums[i], budget_share * max(least ** (a - 1), 1.0) / sums[i]) for i, a in enumerate(points)]

    def bisected(good) -> tuple[float, float]:
        """The end of the range of exponents, from 0 on, in which good() holds: the last known in it, and one beyond."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = [low + (high - low) * k / 64 for k in range(1, 64)]
            holds = [good(m) for m in measured(points)]
            k = holds.index(False) if False in holds else 63
            low, high = ([low, *points, high][k], [low, *points, high][k + 1])
        return low, high

    (h0, r0), (h1, r1) = measured([0.0, 1.0])
    goal = target * float(np.log(head["n"]))
    by_entropy = 1.0 if h1 >= goal else 0.0 if h0 < goal else bisected(lambda m: m[0] >= goal)[0]
    by_repeats = 0.0 if r0 <= repeats else 1.0 if r1 > repeats else bisected(lambda m: m[1] > repeats)[1]
    return max(by_entropy, by_repeats)


def mixed(documents: DataFrame, target: float = TARGET, repeats: float = REPEATS, budget_share: float = 1.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, tokens, epoch, block, block_rank, weight, exponent): a row for each time a document is taken.

    Rows with equal doc_id and source are one unit, whose tokens add up. Documents without words have no tokens to
    budget: they are taken once with their block in the first epoch. Rows without doc_id are one unit a source. An
    empty table gives no rows.
    """
    units = written(source_tokens(documents).groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens")), "mix-units")
    sources = written(units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("units")), "mix-sources")
    a = exponent(sources, target, repeats, budget_share)
    total, z = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(a)))), F.lit(1.0))).first()
    weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(a)) / F.lit(float(z))).otherwise(F.lit(0.0))
    plan = sources.select(
        "source", weight.alias("weight"), F.col("tokens").alias("source_tokens"), F.floor(weight * F.lit(total * budget_share * EXACT)).cast("bigint").alias("budget"),
        F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS)))).cast("int").alias("n_blocks"),
    )
    plan = plan.withColumn("whole", F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.col("source_tokens"))).otherwise(F.lit(1)).cast("int"))
    plan = plan.withColumn("rest", F.when(F.col("source_tokens") > 0, F.col("budget") - F.col("whole") * F.col("source_tokens")).otherwise(F.lit(0)))
    plan = written(plan, "mix-plan")
    units = units.join(plan.select("source", "n_blocks"), "source").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int")).drop("n_blocks")
    blocks = written(units.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens")), "mix-blocks")
    key = lambda *c: F.md5(F.concat_ws(":", F.lit(seed), *[F.col(x).cast("string") for x in c]))
    order = Window.partitionBy("source", "epoch").orderBy(key("source", "epoch", "block"), "block")
    ranked = blocks.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    ranked = ranked.withColumn("block_rank", F.row_number().over(order) - 1).withColumn("through", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.col("epoch") == F.col("whole")
    left = F.col("rest") - (F.col("through") - F.col("block_tokens"))
    part = F.when(~last | (F.col("through") <= F.col("rest")) & (F.col("rest") > 0), "whole").when(last & (left > 0), "edge")
    ranked = written(ranked.select("source", "epoch", "block", "block_rank", "weight", left.alias("left"), part.alias("part")).filter("part is not null"), "mix-order")
    whole = units.join(ranked.filter("part = 'whole'"), ["source", "block"])
    inside = Window.partitionBy("source", "epoch", "block").orderBy(key("source", "epoch", "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = units.join(ranked.filter("part = 'edge'"), ["source", "block"]).withColumn("through", F.sum("tokens").over(inside)).filter(F.col("through") <= F.col("left"))
    empty = (F.col("tokens") > 0) | (F.col("epoch") == 0)
    out = ["doc_id", "source", "tokens", "epoch", "block", "block_rank", "weight"]
    return whole.select(*out).unionByName(edge.select(*out)).filter(empty).withColumn("exponent", F.lit(a))


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """documents with each row as often as the mixture takes it; not at all if that is 0 times."""
    times = mixed(documents, **how).groupBy("source", "doc_id").agg(F.count("*").cast("int").alias("_times")).withColumnsRenamed({"source": "_source", "doc_id": "_doc"})
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_doc")) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("_source"))
    return documents.join(times, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*documents.columns)
