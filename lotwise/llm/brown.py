"""Operator 13, scores of a class-based bigram model after Brown et al. (1992), with classes from exchange clustering.

The text is read once: rows are packed into chunks, each with its own vocabulary and its tokens as numbers of it; all
later steps read these. A token is a word, A-Z lower-cased, or the end of a text; what precedes a text counts as an end.

Clustered are the frequent words, of which each makes up at least one in SHARE of the training tokens, so that there
are SHARE of them at most at any size. The most frequent start with a class each. In each round half of the words are
taken out of their class and put to the class that raises the likelihood of the class bigrams most, by the counts at
the round's start (distributed exchange, Uszkoreit and Brants 2008). A round counts, for these words, the classes before
and after them: each task adds up its chunks, a tree of groups adds up the tasks, a slice of words at a time. Of the
rarer words each occurrence votes for the class that its two neighbours make likeliest. Words seen once stand for all
words that are yet to come: they share the class NEW with unknown words, half of its mass for each.

A text's score is the sum of log10 P(class | class before) + log10 P(word | class). Transitions are discounted and
interpolated with the frequencies of classes; counts of all training text go into them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import text as words
from lotwise.llm.tables import drop, written

CLASSES, SHARE, LEAST, ROUNDS = 64, 1 << 17, 2, 8
CHUNK, SLICE, FAN = 16 << 20, 4096, 32
END, NEW, FIRST = 0, 1, 2
END_WORD = np.int64(0)
DISCOUNT, PSEUDO = 0.5, 0.5

CHUNKS = "chunk bigint, docs array<struct<doc_id: bigint, held_out: boolean, n: bigint>>, vocabulary binary, tokens binary"


def packed(documents: DataFrame) -> DataFrame:
    """CHUNKS of documents(doc_id, held_out, text), of CHUNK bytes of text or one text. vocabulary: 64-bit hashes of the
    chunk's words, the most frequent first; tokens: numbers of them, 32 bits each, text after text with its end."""

    def flush(number: int, docs: list[tuple], held: list[np.ndarray]) -> pa.RecordBatch:
        value, place, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        order = np.lexsort((value, -n))
        new = np.empty(len(order), np.int32)
        new[order] = np.arange(len(order))
        row = {"chunk": (TaskContext.get().partitionId() << 32) + number, "docs": docs, "vocabulary": value[order].tobytes(), "tokens": new[place].tobytes()}
        return pa.RecordBatch.from_pylist([row], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, held, size = 0, [], [], 0
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high, data, at in words.chunks(batch.column(2)):
                if held and size + len(data) > CHUNK:
                    yield flush(number, docs, held)
                    number, docs, held, size = number + 1, [], [], 0
                w = words.Words(data, at, lower=True)
                n = np.diff(w.first)
                tokens = np.full(len(w) + len(n), END_WORD)
                tokens[np.arange(len(w)) + w.row] = w.hashes().view(np.int64)
                held.append(tokens)
                docs += [{"doc_id": i, "held_out": o, "n": k} for i, o, k in zip(ids[low:high], out[low:high], (n + 1).tolist(), strict=True)]
                size += len(data)
        if held:
            yield flush(number, docs, held)

    doc = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64())])
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(doc)), ("vocabulary", pa.binary()), ("tokens", pa.binary())])
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, CHUNKS)


class Chunk:
    """A row of CHUNKS as arrays; ``train`` are the tokens of its training texts."""

    def __init__(self, docs: pa.StructArray, vocabulary: pa.Scalar, tokens: pa.Scalar):
        self.n = docs.field("n").to_numpy()
        self.held_out = docs.field("held_out").to_numpy(zero_copy_only=False).astype(bool)
        self.ids = docs.field("doc_id")
        self.vocabulary, self.tokens = np.frombuffer(vocabulary.as_buffer(), np.int64), np.frombuffer(tokens.as_buffer(), np.int32)

    @property
    def train(self) -> np.ndarray:
        return self.tokens[np.repeat(~self.held_out, self.n)]


def each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """The chunks of batches(docs, vocabulary, tokens)."""
    for batch in batches:
        docs, vocabulary, tokens = (batch.column(batch.schema.get_field_index(c)) for c in ("docs", "vocabulary", "tokens"))
        for i in range(batch.num_rows):
            yield Chunk(docs[i].values, vocabulary[i], tokens[i])


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, n) of the training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in each_chunk(batches):
            n = np.bincount(c.train, minlength=len(c.vocabulary))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(c.vocabulary[some]), pa.array(n[some])], ["word", "n"])

    return chunks.select("docs", "vocabulary", "tokens").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Classes:
    """The frequent words, sorted, with their rank by frequency, and the class of each rank."""

    def __init__(self, word: np.ndarray, n: np.ndarray):
        rank = np.lexsort((word, -n))
        self.by_rank = word[rank]
        order = np.argsort(self.by_rank)
        self.sorted, self.rank = self.by_rank[order], order.astype(np.int32)
        self.of_rank = np.full(len(word), NEW, np.uint8)
        self.of_rank[: CLASSES - FIRST] = np.arange(FIRST, CLASSES)[: len(word)]

    def ranks(self, vocabulary: np.ndarray) -> np.ndarray:
        """The rank of each word of a vocabulary, -1 if it isn't frequent."""
        if not len(self.sorted):
            return np.full(len(vocabulary), -1, np.int32)
        at = np.minimum(np.searchsorted(self.sorted, vocabulary), len(self.sorted) - 1)
        return np.where(self.sorted[at] == vocabulary, self.rank[at], -1)

    def of(self, vocabulary: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The class of each word, NEW if it isn't frequent."""
        return np.where(vocabulary == END_WORD, END, np.append(self.of_rank, np.uint8(NEW))[rank]).astype(np.uint8)


def frequent_words(counts: DataFrame, total: int) -> Classes:
    """At most SHARE words, by what frequent means; they fit the driver and every task."""
    some = counts.filter((F.col("n") * SHARE >= total) & (F.col("n") >= LEAST) & (F.col("word") != int(END_WORD))).toArrow()
    return Classes(some.column("word").to_numpy(), some.column("n").to_numpy())


PARTIAL = "slice int, source int, place binary, n binary"


def sparse(counts: np.ndarray) -> dict:
    some = np.flatnonzero(counts)
    return {"place": some.astype(np.int32).tobytes(), "n": counts[some].tobytes()}


def added(key: tuple, table: pa.Table, cells: int) -> pa.Table:
    """The sum of up to FAN partial counts."""
    out = np.zeros(cells, np.int64)
    for place, n in zip(table.column("place").to_pylist(), table.column("n").to_pylist(), strict=True):
        out[np.frombuffer(place, np.int32)] += np.frombuffer(n, np.int64)
    row = {"slice": key[0].as_py(), "source": int(key[1].as_py())} | sparse(out)
    return pa.Table.from_pylist([row], pa.schema([("slice", pa.int32()), ("source", pa.int32()), ("place", pa.binary()), ("n", pa.binary())]))


def neighbours(chunks: DataFrame, classes: Classes, sources: int, share: int | None) -> DataFrame:
    """PARTIAL with a row a slice: before (first half) and after (second half) each frequent word of the round's share,
    how often each class stands; slice -1 has the class bigrams."""
    known = chunks.sparkSession.sparkContext.broadcast(classes)
    n_words = len(classes.of_rank)
    cells = 2 * SLICE * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs = known.value, np.zeros(CLASSES**2, np.int64)
        sides = np.zeros((2, n_words * CLASSES), np.int64)
        seen = False
        for c in each_chunk(batches):
            seen = True
            rank = own.ranks(c.vocabulary)
            train = c.train
            now = own.of(c.vocabulary, rank)[train].astype(np.int64)
            before = np.concatenate([[END], now[:-1]])[: len(now)]
            pairs += np.bincount(before * CLASSES + now, minlength=CLASSES**2)
            of = rank[train]
            some = np.flatnonzero((of >= 0) & (of % 2 == share) if share is not None else of >= 0)
            key = of[some].astype(np.int64) * CLASSES
            sides[0] += np.bincount(key + before[some], minlength=n_words * CLASSES)
            sides[1] += np.bincount(key + now[some + 1], minlength=n_words * CLASSES)  # a word is never the last token
        if not seen:
            return
        source = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"slice": -1, "source": source} | sparse(pairs)], schema)
        for s in range(-(-n_words // SLICE)):
            cut = slice(s * SLICE * CLASSES, (s + 1) * SLICE * CLASSES)
            part = np.zeros((2, SLICE * CLASSES), np.int64)
            part[:, : sides[:, cut].shape[1]] = sides[:, cut]
            yield pa.RecordBatch.from_pylist([{"slice": s, "source": source} | sparse(part.ravel())], schema)

    schema = pa.schema([("slice", pa.int32()), ("source", pa.int32()), ("place", pa.binary()), ("n", pa.binary())])
    out = chunks.select("docs", "vocabulary", "tokens").mapInArrow(run, PARTIAL)
    while sources > 1:
        out = out.withColumn("source", F.floor(F.col("source") / FAN).cast("int")).groupBy("slice", "source").applyInArrow(lambda key, table: added(key, table, cells), PARTIAL)
        sources = -(-sources // FAN)
    return out


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_classes(pairs: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each word, of class own and with so many neighbours of each class, the class in which it raises most
    sum f(n(a, b)) - sum f(n(a, .)) - sum f(n(., b)), f(x) = x log x, once it is taken out of its own."""
    out = np.empty(len(own), np.int64)
    left, right = pairs.sum(1), pairs.sum(0)
    f = xlogx(pairs)
    for low in range(0, len(own), 128):
        a, lo, hi = own[low : low + 128], before[low : low + 128].astype(float), after[low : low + 128].astype(float)
        gain = (xlogx(pairs[None] + hi[:, None, :]) - f[None]).sum(2)
        gain += (xlogx(pairs.T[None] + lo[:, None, :]) - f.T[None]).sum(2)
        n, m = hi.sum(1)[:, None], lo.sum(1)[:, None]
        gain -= xlogx(left[None] + n) - xlogx(left)[None] + xlogx(right[None] + m) - xlogx(right)[None]
        i = np.arange(len(a))  # back to its own class: what taking it out loses
        row, column = np.maximum(pairs[a] - hi, 0), np.maximum(pairs[:, a].T - lo, 0)
        stay = (f[a] - xlogx(row)).sum(1) + (f[:, a].T - xlogx(column)).sum(1)
        stay -= xlogx(left[a]) - xlogx(np.maximum(left[a] - n[:, 0], 0)) + xlogx(right[a]) - xlogx(np.maximum(right[a] - m[:, 0], 0))
        gain[i, a] = stay
        gain[:, :FIRST] = -np.inf
        out[low : low + 128] = gain.argmax(1)
    return out


def exchanged(slices: DataFrame, classes: Classes, pairs: np.ndarray, share: int | None) -> DataFrame:
    """(rank, class) of each frequent word of the round's share."""
    known = slices.sparkSession.sparkContext.broadcast(classes.of_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                of_rank = known.value
                first = row["slice"] * SLICE
                rank = np.arange(first, min(first + SLICE, len(of_rank)))
                counts = np.zeros(2 * SLICE * CLASSES, np.int64)
                counts[np.frombuffer(row["place"], np.int32)] = np.frombuffer(row["n"], np.int64)
                before, after = counts.reshape(2, SLICE, CLASSES)[:, : len(rank)]
                some = np.flatnonzero(rank % 2 == share) if share is not None else np.flatnonzero(of_rank[rank] == NEW)
                to = best_classes(pairs, of_rank[rank[some]].astype(np.int64), before[some], after[some])
                yield pa.RecordBatch.from_arrays([pa.array(rank[some].astype(np.int32)), pa.array(to.astype(np.int32))], ["rank", "class"])

    return slices.filter("slice >= 0").mapInArrow(run, "rank int, class int")


def square(slices: DataFrame) -> np.ndarray:
    out = np.zeros(CLASSES**2)
    for row in slices.filter("slice = -1").collect():
        out[np.frombuffer(row["place"], np.int32)] = np.frombuffer(row["n"], np.int64)
    return out.reshape(CLASSES, CLASSES)


def likelihood(pairs: np.ndarray) -> float:
    """The part of the class bigrams' likelihood that hangs on the classes."""
    return float(xlogx(pairs).sum() - xlogx(pairs.sum(0)).sum() - xlogx(pairs.sum(1)).sum())


def clustered(chunks: DataFrame, classes: Classes, rounds: int = ROUNDS) -> tuple[Classes, np.ndarray, list[float]]:
    """The classes after exchange, the class bigrams and the likelihood of each round. First all words without a class
    move, then the words of even and of odd rank in turn; the round with the highest likelihood is kept."""
    sources = (chunks.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    found, history = None, []
    for turn in range(rounds + 1):
        share = None if turn == 0 else turn % 2
        slices = written(neighbours(chunks, classes, sources, share), "brown-round")
        pairs = square(slices)
        if turn != 0:
            history.append(likelihood(pairs))
            if found is None or history[-1] > found[0]:
                found = (history[-1], classes.of_rank.copy(), pairs)
        if turn == rounds:
            drop(slices)
            break
        moved = exchanged(slices, classes, pairs, share).toArrow()
        drop(slices)
        before = classes.of_rank
        classes.of_rank = before.copy()
        classes.of_rank[moved.column("rank").to_numpy()] = moved.column("class").to_numpy()
        if turn > 1 and (before == classes.of_rank).all():
            break
    if found is not None:
        classes.of_rank, pairs = found[1], found[2]
    return classes, pairs, history


def smoothed(pairs: np.ndarray) -> np.ndarray:
    """P(second class | first class): discounted, the rest shared out by the classes' frequencies."""
    some = (pairs.sum(0) + PSEUDO) / (pairs.sum() + PSEUDO * CLASSES)
    n = pairs.sum(1, keepdims=True)
    free = DISCOUNT * (pairs > 0).sum(1, keepdims=True)
    known = (np.maximum(pairs - DISCOUNT, 0) + free * some[None]) / np.maximum(n, 1)
    return np.where(n > 0, known, some[None])


def votes(chunks: DataFrame, classes: Classes, pairs: np.ndarray) -> DataFrame:
    """(word, class): of each training word that isn't frequent, the class that most of its occurrences vote for, ties
    to the least one."""
    p = np.log(smoothed(pairs))
    between = (p[:, None, FIRST:] + p[FIRST:].T[None]).argmax(2) + FIRST  # [class before, class after]
    known = chunks.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in each_chunk(batches):
            rank = known.value.ranks(c.vocabulary)
            train, rare = c.train, (rank < 0) & (c.vocabulary != END_WORD)
            now = known.value.of(c.vocabulary, rank)[train]
            some = np.flatnonzero(rare[train])
            vote = between[np.concatenate([[END], now])[some], now[some + 1]]
            key, n = np.unique(train[some].astype(np.int64) * CLASSES + vote, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.vocabulary[key // CLASSES]), pa.array((key % CLASSES).astype(np.int32)), pa.array(n)], ["word", "class", "n"])

    each = chunks.select("docs", "vocabulary", "tokens").mapInArrow(run, "word bigint, class int, n bigint").groupBy("word", "class").agg(F.sum("n").alias("n"))
    return each.groupBy("word").agg((-F.max(F.struct("n", (-F.col("class")).alias("c")))["c"]).alias("class"))


CODED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emission double, classes binary"


def coded(chunks: DataFrame, table: DataFrame, total: int, n_words: int, mass: np.ndarray) -> DataFrame:
    """CODED: a row a document with its unigram score, the log10 probability of its words given their classes, and the
    classes. table(word, n, class): the training words; mass: the training tokens of each class."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), batch.column(0)[i].as_py())), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["chunk", "place", "word"])

    def run(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        (c,) = each_chunk(own.to_batches())
        n, of = np.zeros(len(c.vocabulary), np.int64), np.full(len(c.vocabulary), NEW, np.uint8)
        at = answers.column("place").to_numpy()
        n[at], of[at] = answers.column("n").to_numpy(), answers.column("class").to_numpy()
        of[c.vocabulary == END_WORD] = END
        new = np.log10(0.5) if mass[NEW] else 0.0
        emission = np.log10(np.maximum(n, 1) / np.maximum(mass[of], 1))
        emission[of == NEW] = np.where(n[of == NEW] > 0, new - np.log10(max(mass[NEW], 1)), new)
        emission[of == END] = 0.0
        base = np.log10((n + PSEUDO) / (total + PSEUDO * (n_words + 1)))
        cut = np.concatenate([[0], np.cumsum(c.n)])
        sums = lambda x: np.add.reduceat(x[c.tokens], cut[:-1]) if len(c.n) else np.zeros(0, x.dtype)
        classes = of[c.tokens].tobytes()
        parts = pa.array([classes[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())
        return pa.table([c.ids, pa.array(c.held_out), pa.array(c.n), pa.array(sums((n > 0).astype(np.int64))), pa.array(sums(base)), pa.array(sums(emission)), parts], [x.split()[0] for x in CODED.split(", ")])

    wanted = chunks.select("chunk", "vocabulary").mapInArrow(asked, "chunk bigint, place int, word bigint")
    answers = wanted.join(table.hint("merge"), "word").select("chunk", "place", "n", "class")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, CODED)


def transitions(rows: DataFrame) -> np.ndarray:
    """How often each class follows each in training text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CLASSES**2, np.int64)
        for batch in batches:
            now = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            out += np.bincount(np.concatenate([[END], now[:-1]])[: len(now)] * CLASSES + now, minlength=CLASSES**2)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(out[some])], ["cell", "n"])

    each = rows.filter("not held_out").select("classes").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES**2)
    for r in each.collect():  # a row a pair of classes
        out[r["cell"]] = r["n"]
    return out.reshape(CLASSES, CLASSES)


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def with_scores(rows: DataFrame, p: np.ndarray) -> DataFrame:
    log = np.log10(p).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            emission, sums = batch.column(5).to_numpy(), np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                now = np.frombuffer(batch.column(6)[i].as_buffer(), np.uint8).astype(np.int64)
                sums[i] = log[np.concatenate([[END], now[:-1]]) * CLASSES + now].sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(emission + sums)], [x.split()[0] for x in SCORED.split(", ")])

    return rows.mapInArrow(run, SCORED)


def scored(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) a row of documents.

    The model learns from the rows of which held_out isn't true; further columns but doc_id, held_out and text play no
    part. Null and empty texts have one token, the end. n_known: tokens that training text has; train_tokens: all
    training tokens; base_score: log10 probability by a unigram model with PSEUDO added to each count and one unknown
    word; score: by the class model, over the same events; perplexity: a token, by score. Repeated rows count each time
    and have a row each; rows without doc_id, too. Without training text all words are unknown.
    """
    own = documents.select("doc_id", F.coalesce(F.col("held_out"), F.lit(False)).alias("held_out"), "text")
    chunks = written(packed(own), "brown-chunks")
    counts = written(word_counts(chunks), "brown-words")
    n_words, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes, pairs, _ = clustered(chunks, frequent_words(counts, total), rounds)
    frequent = pa.table({"word": pa.array(classes.by_rank, pa.int64()), "own": pa.array(classes.of_rank.astype(np.int32))})
    frequent = F.broadcast(documents.sparkSession.createDataFrame(frequent))  # at most SHARE rows
    elected = counts.join(votes(chunks, classes, pairs).hint("merge"), "word", "left").join(frequent, "word", "left")
    of = F.when(F.col("word") == int(END_WORD), END).when(F.col("n") < LEAST, NEW).otherwise(F.coalesce("own", "class"))
    table = written(elected.select("word", "n", of.cast("int").alias("class")), "brown-table")
    drop(counts)
    mass = np.zeros(CLASSES)
    for r in table.groupBy("class").agg(F.sum("n").alias("n")).collect():
        mass[r["class"]] = r["n"]
    rows = written(coded(chunks, table, total, n_words, mass), "brown-coded")
    drop(chunks)
    drop(table)
    out = with_scores(rows, smoothed(transitions(rows)))
    out = out.withColumn("train_tokens", F.lit(total).cast("bigint")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
