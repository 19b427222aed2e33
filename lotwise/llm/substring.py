"""Operator 3, substring dedup: a compacted De Bruijn graph of token k-mers.

Windows of 50 words are to be found twice. Nodes of the graph are anchors: the k-mers of 12 words that are the least by
hash of the 39 in some window, so that each window has one and equal windows have equal ones at the same offset. Edges
are longer k-mers: the 51 words that end with a node's words lead into it, the 51 that start with them lead out of it
(fewer where a document starts or ends), far enough to hold the next node as well. A node's degrees are the numbers of
its different edges, over all documents.

Nodes of one document alone end the search for most of the text. Of the others, those with one edge in and one out are
unbranched: all occurrences run from one such node to the next, and chains of them are compacted by joins, each of
which doubles how far a node sees back (pointer doubling), into paths. Every document that enters a path runs through
it whole, so that its head tells where the long repeated span lies in each document. At a branching node a pair of
edges that two documents share gives such a span as well, and the smallest document of each pair gives rows for its
single windows, as copies part there and windows of different pairs may be equal.

Spans are then verified on the words at their source coordinates: each document takes a 128-bit digest of the words that
it really has there, and only those whose digests agree are copies of the smallest document among them. Windows have 128
bits of their own. The result is exact for every window.

Joins see each key at most as often as documents hold it; least documents come from partial aggregates. Keys of very
many rows are joined by broadcast (at most HOT_KEYS of them), so that they stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import text as words
from lotwise.llm.tables import drop, joined, written

WINDOW, ANCHOR = 50, 12
ROUNDS = 40
OTHER, LEFT, RIGHT = 0x51ED270B, words.U64(0xA24BAED4963EE407), words.U64(0x9FB21C651E98DF25)


def edge_key(node: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return words.mix(node * words.U64(3) + words.mix(left * words.U64(5) + right))


class Anchors:
    """Anchors of a chunk: ``at`` (word index) and ``h`` of each, their edges ``left`` and ``right``, the anchor ``next``
    to each in its document (0 for none); ``key`` tells anchors with other edges apart."""

    def __init__(self, w: words.Words, window: int = WINDOW, k: int = ANCHOR):
        reach = window - k + 1
        self.spans = words.Spans(h := w.hashes())
        n = len(h)
        a = np.arange(max(0, n - k + 1))
        grams = self.spans.hash(a, a + k)
        whole = w.gram_ok(window) if n >= window else np.zeros(0, bool)
        self.starts = np.flatnonzero(whole)
        least = words.sliding(grams, reach)  # entry s: of the window that starts at s
        self.least = least[self.starts]
        if len(self.starts):
            pad = np.zeros(reach - 1, words.U64)
            most = words.sliding(np.concatenate([pad, np.where(whole, least, words.U64(0)), pad]), reach, np.maximum)
            self.at = np.flatnonzero(most == grams)
        else:
            self.at = np.zeros(0, np.int64)
        self.h = grams[self.at]
        self.row = w.row[self.at] if n else self.at
        low = np.maximum(self.at - reach, w.first[self.row])
        high = np.minimum(self.at + reach + k, w.first[self.row + 1])
        self.left = words.mix(self.spans.hash(low, self.at + k) ^ LEFT)
        self.right = words.mix(self.spans.hash(self.at, high) ^ RIGHT)
        self.next = np.zeros(len(self.at), words.U64)
        if len(self.at):
            same = self.row[1:] == self.row[:-1]
            self.next[:-1][same] = self.h[1:][same]
        self.key = edge_key(self.h, self.left, self.right)

    def of_windows(self) -> np.ndarray:
        """The anchor (by index) to which each window of ``starts`` belongs: the first least one in it."""
        values = np.unique(self.h)
        long = int(self.at[-1]) + 1
        place = np.searchsorted(values, self.h) * long + self.at
        order = np.argsort(place)
        asked = np.searchsorted(values, self.least) * long + self.starts
        return order[np.searchsorted(place[order], asked)]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


NODES = "node bigint, left bigint, right bigint, next bigint, doc_id bigint"


def anchor_rows(documents: DataFrame, window: int, k: int) -> DataFrame:
    """NODES: a row for each different node with its edges of each document with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, _, data, at in words.chunks(batch.column(1)):
                found = Anchors(words.Words(data, at), window, k)
                once = np.lexsort((found.key, found.row))  # a document that repeats itself gives each row once
                once = once[np.r_[True, (np.diff(found.row[once]) > 0) | (found.key[once][1:] != found.key[once][:-1])]] if len(once) else once
                columns = [signed(x[once]) for x in (found.h, found.left, found.right, found.next)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids[found.row[once] + low])], ["node", "left", "right", "next", "doc_id"])

    return documents.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(run, NODES)


def shared_nodes(anchors: DataFrame) -> DataFrame:
    """(node, n_rows, straight, next) of the nodes that two documents or more hold: straight if of degree one both ways."""
    one = lambda c: F.min(c) == F.max(c)
    found = anchors.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("largest"), F.count("*").alias("n_rows"), (one("left") & one("right")).alias("straight"), F.min("next").alias("next"))
    return found.filter("least <> largest").drop("least", "largest")


def compacted(nodes: DataFrame) -> DataFrame:
    """(head, length) of the nonbranching paths of nodes(node, straight, next), lone straight nodes included.

    Each round joins every node's furthest known predecessor with that one's own, so that a path of n nodes takes
    log2(n) rounds. A ring of nodes, which only a clash of hashes can make, stays as it is: a path for each node.
    """
    straight = nodes.filter("straight")
    before = straight.filter("next <> 0").select(F.col("next").alias("node"), F.col("node").alias("back"))
    # The predecessor of a straight node is unique but for clashes, which the least one settles.
    before = before.groupBy("node").agg(F.min("back").alias("back"))
    start = straight.select("node").join(before, "node", "left")
    now = written(start.select("node", F.coalesce("back", "node").alias("back"), F.when(F.col("back").isNull(), 0).otherwise(1).cast("long").alias("steps")), "substring-path")
    for _ in range(ROUNDS):
        far = now.select(F.col("node").alias("back"), F.col("back").alias("further"), F.col("steps").alias("more"))
        step = now.join(far, "back").select("node", F.col("further").alias("back"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved"))
        after = written(step, "substring-path")
        drop(now)
        now = after.drop("moved")
        if not after.filter("moved").head(1):
            return now.groupBy(F.col("back").alias("node")).agg((F.max("steps") + 1).alias("length"))
    ring = now.alias("a").join(now.filter("steps = 0").select(F.col("node").alias("back")), "back", "left_semi")
    whole = ring.groupBy(F.col("back").alias("node")).agg((F.max("steps") + 1).alias("length"))
    return whole.unionByName(now.join(ring.select("node"), "node", "left_anti").select("node", F.lit(1).cast("long").alias("length")))


def decided(anchors: DataFrame) -> DataFrame:
    """(doc_id, marks): of each document the nodes that matter to it, as (node, left, right, length, open).

    length > 0: a span that other documents have too starts with this node, over so many nodes. open: the document is
    the smallest with these edges at a branching node, and gives rows for its windows.
    """
    nodes = written(shared_nodes(anchors), "substring-nodes")
    heads = compacted(nodes)
    chosen = nodes.filter("straight").join(heads, "node").select("node", "n_rows", "length").unionByName(nodes.filter("not straight").select("node", "n_rows", F.lit(0).cast("long").alias("length")))
    total = anchors.count()
    held = written(joined(anchors.drop("next"), chosen, ["node"], total).drop("n_rows"), "substring-shared")
    edges = ["node", "left", "right"]
    parted = held.filter("length = 0").drop("length")
    pairs = parted.groupBy(*edges).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("largest"), F.count("*").alias("n_rows"))
    parted = joined(parted, written(pairs, "substring-pairs"), edges, total)
    parted = parted.select("doc_id", *edges, F.when(F.col("least") < F.col("largest"), 1).otherwise(0).cast("long").alias("length"), (F.col("least") == F.col("doc_id")).alias("open")).filter("open or length > 0")
    both = held.filter("length > 0").select("doc_id", *edges, "length", F.lit(False).alias("open")).unionByName(parted)
    return both.groupBy("doc_id").agg(F.collect_set(F.struct(*edges, "length", "open")).alias("marks"))


def span_digest(data: np.ndarray, w: words.Words, a: int, b: int) -> bytes:
    """128 bits of the words a to b - 1, joined by one space."""
    return hashlib.blake2b(b" ".join(data[w.starts[a] : w.ends[b - 1]].tobytes().split()), digest_size=16).digest()


def edge_rows(marked: DataFrame, window: int, k: int) -> DataFrame:
    """(h, h2, doc_id, text_id, start, size) from documents with their marks: 128 bits of the words of each span that
    another document may hold, of a window or longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "h2", "doc_id", "text_id", "start", "size"]
        for batch in batches:
            ids, texts = (batch.column(i).to_numpy() for i in (0, 1))
            marks = batch.column(3)
            node, left, right, length, open_ = (marks.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(5))
            cut = marks.offsets.to_numpy()
            cut = cut - cut[0]
            key = edge_key(*(x.view(words.U64) for x in (node, left, right)))
            for low, high, data, at in words.chunks(batch.column(2)):
                w = words.Words(data, at)
                found = Anchors(w, window, k)
                if not len(found.starts):
                    continue
                n = len(found.at)
                spans, windows = np.zeros(n, np.int64), np.zeros(n, bool)
                edges = np.searchsorted(found.row, np.arange(high - low + 1))
                for r in range(high - low):
                    mark, mine = slice(cut[low + r], cut[low + r + 1]), slice(edges[r], edges[r + 1])
                    known = key[mark]
                    if mine.start == mine.stop or not len(known):
                        continue
                    order = np.argsort(known)
                    i = order[np.minimum(np.searchsorted(known[order], found.key[mine]), len(known) - 1)]
                    hit = known[i] == found.key[mine]
                    spans[mine] = np.where(hit, length[mark][i], 0)
                    windows[mine] = hit & open_[mark][i]
                of = found.of_windows()
                heads = np.flatnonzero(spans)
                ends = np.minimum(heads + spans[heads], edges[found.row[heads] + 1])
                a, b = np.searchsorted(of, heads), np.searchsorted(of, ends)
                a, b = a[b > a], b[b > a]
                first, end = found.starts[a], found.starts[b - 1] + window
                digests = np.frombuffer(b"".join(span_digest(data, w, x, y) for x, y in zip(first, end, strict=True)), np.int64).reshape(-1, 2)
                other = words.Spans(w.hashes(), OTHER)
                p = found.starts[windows[of]]
                bits = [np.concatenate([x.hash(p, p + window).view(np.int64), digests[:, j]]) for j, x in enumerate((found.spans, other))]
                start, size = np.concatenate([p, first]), np.concatenate([np.full(len(p), window), end - first])
                own = w.row[start]
                yield pa.RecordBatch.from_arrays([*map(pa.array, bits), pa.array(ids[own + low]), pa.array(texts[own + low]), pa.array((start - w.first[own]).astype(np.int32)), pa.array(size.astype(np.int32))], names)

    return marked.select("doc_id", "text_id", "text", "marks").mapInArrow(run, "h bigint, h2 bigint, doc_id bigint, text_id int, start int, size int")


def repeated_spans(documents: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc_id, text_id, start, size): words that a window covers which also starts in a smaller doc_id; may overlap.

    documents needs doc_id, text and text_id, a hash of the text that tells rows of one doc_id apart.
    """
    anchors = written(anchor_rows(documents, window, k), "substring-anchors")
    marked = documents.select("doc_id", "text_id", "text").join(decided(anchors), "doc_id")
    edges = written(edge_rows(marked, window, k), "substring-edges")
    drop(anchors)
    owners = edges.groupBy("h", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("largest"), F.count("*").alias("n_rows")).filter("owner <> largest").drop("largest")
    twice = joined(edges, written(owners, "substring-owners"), ["h", "h2"], edges.count()).filter("doc_id > owner")
    return twice.select("doc_id", "text_id", "start", "size")


KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string"


def without_repeats(documents: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text): each row of documents without the words that repeat.

    Removed is each word that lies in a window of ``window`` words whose sequence also starts in a document with a
    smaller doc_id, judged on the input. What stays is joined by one space. Null and empty texts, and those with
    fewer words than a window, lose nothing. Rows without doc_id neither take nor lose words. Of rows with one doc_id
    none takes from another. Columns other than doc_id and text play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in KEPT.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                own = (text.as_py() or b"").split()
                n, spans = len(own), spans.as_py()
                if spans:
                    gone = bytearray(n)
                    for s in spans:
                        gone[s["start"] : s["start"] + s["size"]] = b"\1" * s["size"]
                    own = [x for x, g in zip(own, gone, strict=True) if not g]
                kept = b" ".join(own)
                rows.append((doc, n, n - len(own), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)

    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.hash("text").alias("text_id"))
    spans = repeated_spans(own, window, k).groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    return own.join(spans, ["doc_id", "text_id"], "left").select("doc_id", "text", "spans").mapInArrow(run, KEPT)
