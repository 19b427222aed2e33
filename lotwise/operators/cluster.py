"""Forests and boosted trees of more rows than a group may hold, grown by the cluster: the trees of trees.py, node for node.

Rows are bins, a byte a sensor. Tasks add up histograms as whole numbers, or as gradients whose sums are exact (trees.PART),
so that a cut doesn't hang on how rows lie. Of a forest the upper nodes are cut so, level by level, until a node has no
more rows than a group; such a node's rows meet in a group, which grows the rest and scores the rows that come there.
Boosted trees are cut so to their leaves, all that wait in one pass; their few nodes are what the driver holds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators import trees
from lotwise.operators.graph import checkpointed
from lotwise.operators.running import numbered

#: Trees that grow together, rows that a task looks at together, nodes of a pass, rounds between two scores that are kept.
TREES, ROWS, NODES, KEPT = 16, 1 << 16, 1 << 10, 10


def buffered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def codes_of(table: pa.Table, p: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint8).reshape(-1, p)


def copies(table: pa.Table, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, y, hashes) of training rows, each as often as it counts."""
    times = table.column("times").to_numpy()
    own = np.repeat(np.arange(len(times)), times)
    copy = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
    unit = trees.mixed(table.column("h").to_numpy().view(np.uint64)[own] + copy.astype(np.uint64))
    return codes_of(table, p)[own], table.column("y").to_numpy()[own].astype(np.int64), unit


def moved(test: DataFrame, sensors: tuple[int, ...], fit: int, swaps: int) -> DataFrame:
    """test(unit_id, y, times, h, cells) with swap and rep: as it is, and once for each sensor and repetition with the sensor's
    bins dealt anew, by the permutations that a group draws; values are joined by the row that they come from."""
    plain = test.select(F.lit(-1).alias("swap"), F.lit(0).alias("rep"), "unit_id", "y", "times", "cells")
    if not swaps:
        return plain
    rows = checkpointed(numbered(test, [], [F.shiftright("h", 56), F.shiftright("h", 48)], ["h", "unit_id"]).withColumn("row", F.col("row") - 1))
    n = rows.count()
    drawn = [(j, s, rep) for j, s in enumerate(sensors) for rep in range(swaps)]

    def orders(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                j, s, rep = drawn[i]
                order = np.random.default_rng([fit, s, rep]).permutation(n)
                for a in range(0, n, ROWS):
                    k = len(order[a : a + ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, x, np.int32)) for x in (j, s, rep)] + [pa.array(np.arange(a, a + k)), pa.array(order[a : a + k])], ["j", "swap", "rep", "row", "at"])

    order = test.sparkSession.range(0, len(drawn), 1, len(drawn)).mapInArrow(orders, "j int, swap int, rep int, row bigint, at bigint")
    taken = order.join(rows.select("row", "unit_id", "y", "times", "cells"), "row").join(rows.select(F.col("row").alias("at"), F.col("cells").alias("other")), "at")
    part = lambda c, a, k: F.substring(F.col(c), a, k)
    cells = F.concat(part("cells", F.lit(1), F.col("j")), part("other", F.col("j") + 1, F.lit(1)), part("cells", F.col("j") + 2, F.lit(len(sensors))))
    return plain.unionByName(taken.select("swap", "rep", "unit_id", "y", "times", cells.alias("cells")))


# Forests


@dataclass
class Tops:
    """The upper nodes of several trees; the first ones are the roots. slot: the place among nodes that wait to be cut, part:
    the number of a node that a group grows on; -1 where it is neither."""

    seeds: np.ndarray
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    tree: list[int] = field(default_factory=list)
    part: list[int] = field(default_factory=list)
    way: list[np.uint64] = field(default_factory=list)
    weights: dict[int, tuple[float, float]] = field(default_factory=dict)

    def add(self, tree: int, way) -> int:
        for own, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0), (self.tree, tree), (self.part, -1), (self.way, way)):
            own.append(x)
        return len(self.feature) - 1


@dataclass
class Way:
    """What rows need to find their node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def node(self, codes: np.ndarray, node: np.ndarray, row: np.ndarray) -> np.ndarray:
        return trees.way(self, codes, node, row, None, None)[0]


def way_of(t: Tops) -> Way:
    return Way(*(np.array(x, np.int64) for x in (t.feature, t.cut, t.left, t.right)))


def best_of(sums: np.ndarray, w0: float, w1: float, leaf: int) -> tuple[float, int, int]:
    """(purity, place, cut) of sums(place, bin, (rows, draws, draws of class 1)); -inf where nothing can be cut."""
    best, place, cut = -np.inf, -1, -1
    for s, own in enumerate(sums):
        low = own.cumsum(0)
        whole = low[-1]
        able = np.flatnonzero((low[:, 0] >= leaf) & (low[:, 0] <= whole[0] - leaf))
        if not len(able):
            continue
        parts = []
        for side in (low[able], whole - low[able]):
            b, a = w0 * (side[:, 1] - side[:, 2]), w1 * side[:, 2]
            parts.append((a * a + b * b) / (a + b))
        purity = parts[0] + parts[1]
        i = int(purity.argmax())
        if purity[i] > best:
            best, place, cut = float(purity[i]), s, int(able[i])
    return best, place, cut


def node_sums(train: DataFrame, t: Tops, p: int, m: int, asked: list[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """place in asked(node, features) to sums(feature, bin, 3)."""
    slot = np.full(len(t.feature), -1)
    slot[[n for n, _ in asked]] = np.arange(len(asked))
    features = np.full((len(asked), m), -1)
    for i, (_, f) in enumerate(asked):
        features[i, : len(f)] = f
    known = train.sparkSession.sparkContext.broadcast((way_of(t), t.seeds, slot, features))

    def run(batches):
        way, seeds, slot, features = known.value
        size = len(features) * m * 256
        total = np.zeros((3, size), np.int64)
        for table in buffered(batches):
            codes, y, unit = copies(table, p)
            times = trees.drawn(unit, seeds)
            at, row = np.nonzero(times)
            place = slot[way.node(codes, at, row)]
            some = np.flatnonzero(place >= 0)
            at, row, place = at[some], row[some], place[some]
            draws = times[at, row].astype(np.int64)
            for s in range(m):
                f = features[place, s]
                own = np.flatnonzero(f >= 0)
                key = (place[own] * m + s) * 256 + codes[row[own], f[own]]
                for into, w in zip(total, (None, draws[own], draws[own] * y[row[own]]), strict=True):
                    into += np.bincount(key, w, size).astype(np.int64)
        cells = total.reshape(3, len(features), m * 256)
        for i in np.flatnonzero(cells[0].any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([cells[:, i].tobytes()], pa.binary())], ["item", "sums"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())
        return pa.table({"item": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    found = train.mapInArrow(run, "item int, sums binary").groupBy("item").applyInArrow(added, "item int, sums binary")
    return {r["item"]: np.frombuffer(r["sums"], np.int64).reshape(3, m, 256).transpose(1, 2, 0) for r in found.toLocalIterator()}


def tops(train: DataFrame, p: int, spec: trees.Forest, first: int, n: int, small: int) -> Tops:
    """The nodes of n trees above those of at most ``small`` rows."""
    t, m, n_parts = Tops(spec.tree_seeds(first, n)), max(1, int(p**0.5)), 0
    waiting = [(t.add(i, t.seeds[i]), 0) for i in range(n)]
    while waiting:
        now, waiting = waiting[:NODES], waiting[NODES:]
        asked = [(node, trees.feature_order(np.array([t.way[node]], np.uint64), p)[0, k : k + m]) for node, k in now]
        found = node_sums(train, t, p, m, asked)
        for i, (node, k) in enumerate(now):
            sums, features = found[i][: len(asked[i][1])], asked[i][1]
            r, d, d1 = (int(x) for x in sums[0].sum(0))
            tree = t.tree[node]
            if node < n and k == 0:
                w = trees.class_weights(np.array([d]), np.array([d1]))
                t.weights[tree] = float(w[0][0]), float(w[1][0])
            w0, w1 = t.weights[tree]
            a1, a0 = w1 * d1, w0 * (d - d1)
            t.value[node] = a1 / max(a1 + a0, 1e-300)
            if not (0 < d1 < d and r >= 2 * spec.leaf):
                continue
            purity, place, cut = best_of(sums, w0, w1, spec.leaf)
            if place < 0:
                if k + m < p:
                    waiting.append((node, k + m))
                continue
            t.feature[node], t.cut[node] = int(features[place]), cut
            t.gain[node] = purity - (a1**2 + a0**2) / (a1 + a0)
            low = sums[place, : cut + 1].sum(0)
            for side, salt in ((low, trees.LEFT), (sums[place].sum(0) - low, trees.RIGHT)):
                child = t.add(tree, trees.mixed(np.array([t.way[node] ^ salt], np.uint64))[0])
                (t.left if salt == trees.LEFT else t.right)[node] = child
                r, d, d1 = (int(x) for x in side)
                a1, a0 = w1 * d1, w0 * (d - d1)
                t.value[child] = a1 / max(a1 + a0, 1e-300)
                if 0 < d1 < d and r >= 2 * spec.leaf:
                    if r <= small:
                        t.part[child], n_parts = n_parts, n_parts + 1
                    else:
                        waiting.append((child, 0))
    return t


PIECE = "part int, kind int, ids binary, cells binary, y binary, draws binary"


def parted(rows: DataFrame, t: Tops, p: int, test: bool) -> DataFrame:
    """PIECE: the rows of each part, those of a task and part together; test rows that end in a leaf above have its value."""
    known = rows.sparkSession.sparkContext.broadcast((way_of(t), t.seeds, np.array(t.part), np.array(t.value)))
    n_parts = max(t.part) + 1

    def piece(part: int, kind: int, ids=b"", cells=b"", y=b"", draws=b"") -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"part": part, "kind": kind, "ids": ids, "cells": cells, "y": y, "draws": draws}], pa.schema([("part", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("ids", "cells", "y", "draws")]]))

    def run(batches):
        way, seeds, part, value = known.value
        for number, table in enumerate(buffered(batches)):
            if test:
                codes, ids = codes_of(table, p), table.column("id").to_numpy()
                at, row = (x.ravel() for x in np.indices((len(seeds), len(codes))))
            else:
                codes, y, unit = copies(table, p)
                times = trees.drawn(unit, seeds)
                at, row = np.nonzero(times)
            node = way.node(codes, at, row)
            own = part[node]
            order = np.argsort(own, kind="stable")
            start = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]]) if len(order) else np.zeros(0, np.int64)
            for some in np.split(order, start[1:]) if len(order) else ():
                k, r = int(own[some[0]]), row[some]
                if k >= 0 and test:
                    yield piece(k, 1, ids[r].tobytes(), codes[r].tobytes())
                elif k >= 0:
                    yield piece(k, 0, cells=codes[r].tobytes(), y=y[r].astype(np.uint8).tobytes(), draws=times[at[some], r].tobytes())
                elif test:
                    yield piece(n_parts + number % 64, 2, ids[r].tobytes(), value[node[some]].tobytes())

    return rows.mapInArrow(run, PIECE)


def grown_parts(pieces: DataFrame, t: Tops, p: int, leaf: int, schema: str, work) -> DataFrame:
    """work(tree, Trees or None, pieces of test rows) of each part, grown from its rows."""
    at = {k: i for i, k in enumerate(t.part) if k >= 0}
    known = pieces.sparkSession.sparkContext.broadcast({k: (t.tree[i], t.way[i], *t.weights[t.tree[i]]) for k, i in at.items()})

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        part, made, tree = key[0].as_py(), None, -1
        if part in known.value:
            tree, way, w0, w1 = known.value[part]
            own = [r for r in rows if r["kind"] == 0]
            codes, y, draws = (np.frombuffer(b"".join(r[c] for r in own), np.uint8) for c in ("cells", "y", "draws"))
            made = trees.grown(codes.reshape(-1, p), y.astype(np.int64), draws[None], np.array([way], np.uint64), np.array([w0]), np.array([w1]), leaf)
        return work(tree, made, [r for r in rows if r["kind"]])

    return pieces.groupBy("part").applyInArrow(run, schema)


def forest_scores(train: DataFrame, test: DataFrame, p: int, spec: trees.Forest, small: int) -> DataFrame:
    """(id, s) of test(id, cells): the mean over all trees."""

    def work(tree: int, made, rows: list) -> pa.Table:
        ids, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for r in rows:
            ids.append(np.frombuffer(r["ids"], np.int64))
            values.append(np.frombuffer(r["cells"], float) if r["kind"] == 2 else made.score(np.frombuffer(r["cells"], np.uint8).reshape(-1, p))[0])
        return pa.table({"id": np.concatenate(ids), "s": np.concatenate(values)})

    out = None
    for first in range(0, spec.trees, TREES):
        t = tops(train, p, spec, first, min(TREES, spec.trees - first), small)
        pieces = parted(train, t, p, False).unionByName(parted(test, t, p, True))
        own = grown_parts(pieces, t, p, spec.leaf, "id bigint, s double", work)
        out = own if out is None else out.unionByName(own)
    return out.groupBy("id").agg((F.sum("s") / spec.trees).alias("s"))


def forest_gains(train: DataFrame, p: int, spec: trees.Forest, small: int) -> np.ndarray:
    """The mean over all trees of each feature's share in what splits gain."""

    def work(tree: int, made, rows: list) -> pa.Table:
        inner = made.feature >= 0
        gain = np.bincount(made.feature[inner], made.gain[inner], p) if inner.any() else np.zeros(p)
        return pa.table({"tree": pa.array(np.full(p, tree, np.int32)), "feature": pa.array(np.arange(p, dtype=np.int32)), "gain": gain.astype(float)})

    total = np.zeros(p)
    for first in range(0, spec.trees, TREES):
        n = min(TREES, spec.trees - first)
        t = tops(train, p, spec, first, n, small)
        gains = np.zeros((n, p))
        for i, f in enumerate(t.feature):
            if f >= 0:
                gains[t.tree[i], f] += t.gain[i]
        rows = grown_parts(parted(train, t, p, False), t, p, spec.leaf, "tree int, feature int, gain double", work)
        for r in rows.groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect():  # a row a tree and feature
            gains[r["tree"], r["feature"]] += r["gain"]
        total += (gains / np.maximum(gains.sum(1, keepdims=True), 1e-300)).sum(0)
    return total / spec.trees


# Boosted trees


class Growing:
    """One boosted tree on the driver, as trees.boost() grows it from the sums of its nodes."""

    def __init__(self, spec: trees.Boosted, p: int):
        self.spec, self.found = spec, trees.Histograms(np.empty((0, p), np.uint8), spec)
        self.nodes, self.sums, self.waiting, self.leaves = [[-1, 0, False, 0, 0, 0.0, 0.0]], [None], [], 1
        self.children: dict[int, tuple] = {}

    def offer(self, i: int) -> None:
        sums, counts = self.sums[i]
        if counts[0].sum() < 2 * self.spec.least:
            return
        best = self.found.best(sums, counts)
        if best[1] >= 0:
            heapq.heappush(self.waiting, (-best[0], i, best))

    def root(self, sums: tuple) -> None:
        self.sums[0] = sums
        self.offer(0)

    def asked(self) -> list[tuple[int, int, int, bool]]:
        """(node, feature, cut, missing left) of nodes whose left sides are wanted, none if the tree is done."""
        while self.waiting and self.leaves < self.spec.leaves:
            i = self.waiting[0][1]
            if i not in self.children:
                return [(i, *best[1:]) for _, i, best in self.waiting if i not in self.children]
            _, i, (gain, feature, cut, missing_left) = heapq.heappop(self.waiting)
            left, whole = self.children[i], self.sums[i]
            self.nodes[i][:5] = feature, cut, missing_left, len(self.nodes), len(self.nodes) + 1
            self.nodes[i][6] = gain
            self.sums[i] = None
            for own in (left, (whole[0] - left[0], whole[1] - left[1])):
                self.nodes.append([-1, 0, False, 0, 0, 0.0, 0.0])
                self.sums.append(own)
                if self.leaves + 1 < self.spec.leaves:
                    self.offer(len(self.nodes) - 1)
            self.leaves += 1
        return []

    def made(self) -> tuple:
        for node, sums in zip(self.nodes, self.sums, strict=True):
            if node[0] < 0:
                node[5] = trees.leaf_value(sums[0], self.spec)
        return tuple(np.array(c) for c in zip(*self.nodes, strict=True))


def leaf_of(tree: tuple, codes: np.ndarray) -> np.ndarray:
    t = trees.flat([tree])
    return trees.way(t, codes, np.zeros(len(codes), np.int64), np.arange(len(codes)), None, None)[0]


def boosted(train: DataFrame, p: int, specs: list[trees.Boosted]) -> list[tuple[list[tuple], float]]:
    """(trees, start) of each of specs, round by round side by side: a pass adds up the left sides of all nodes that wait."""
    n, n1 = train.agg(F.sum("times"), F.sum(F.col("times") * F.col("y"))).first()
    w = trees.class_weights(np.array([n]), np.array([n1]))
    w0, w1 = float(w[0][0]), float(w[1][0])
    start = trees.boosted_start(w1 * n1, w1 * n1 + w0 * (n - n1))
    out: list[list[tuple]] = [[] for _ in specs]
    sc = train.sparkSession.sparkContext

    def raws(table: pa.Table, codes: np.ndarray, pending: list[list[tuple]]) -> np.ndarray:
        raw = np.frombuffer(b"".join(table.column("raw").to_pylist()), float).reshape(-1, len(specs)).copy()
        for i, own in enumerate(pending):
            for tree in own:
                raw[:, i] += tree[5][leaf_of(tree, codes)]
        return raw

    def kept(rows: DataFrame, pending: list[list[tuple]]) -> DataFrame:
        known = sc.broadcast(pending)

        def run(batches):
            for table in buffered(batches):
                raw = raws(table, codes_of(table, p), known.value)
                yield from table.set_column(table.column_names.index("raw"), "raw", pa.array([r.tobytes() for r in raw], pa.binary())).to_batches()

        return rows.mapInArrow(run, rows.schema)

    def passed(rows: DataFrame, pending: list[list[tuple]], wanted: list[tuple[int, tuple, list]]) -> dict[tuple[int, int], tuple]:
        """(spec, node) to the sums of its left side, or of all rows for node -1."""
        known = sc.broadcast((pending, wanted))

        def run(batches):
            pending, wanted = known.value
            total = {i: (np.zeros((2, len(own), p, 256)), np.zeros((len(own), p, 256), np.int64)) for i, _, own in wanted}
            for table in buffered(batches):
                codes = codes_of(table, p)
                raw, y, times = raws(table, codes, pending), table.column("y").to_numpy(), table.column("times").to_numpy()
                weight = np.where(y == 1, w1, w0)
                for i, tree, own in wanted:
                    g, c = trees.slopes(raw[:, i], y, weight)
                    node = leaf_of(tree, codes) if tree is not None else None
                    sums, counts = total[i]
                    for k, (at, feature, cut, missing_left) in enumerate(own):
                        if at < 0:
                            some = np.arange(len(codes))
                        else:
                            some = np.flatnonzero(node == at)
                            v = codes[some, feature]
                            some = some[np.where(v == trees.MISSING, missing_left, v <= cut)]
                        t = times[some]
                        for j in range(p):
                            key = codes[some, j]
                            sums[0, k, j] += np.bincount(key, g[some] * t, 256)
                            sums[1, k, j] += np.bincount(key, c[some] * t, 256)
                            counts[k, j] += np.bincount(key, t, 256).astype(np.int64)
            for i, (sums, counts) in total.items():
                for k in range(len(counts)):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([k], pa.int32()), pa.array([sums[:, k].tobytes()], pa.binary()), pa.array([counts[k].tobytes()], pa.binary())], ["spec", "k", "sums", "counts"])

        def added(key: tuple, table: pa.Table) -> pa.Table:
            sums, counts = (sum(np.frombuffer(x, kind) for x in table.column(c).to_pylist()) for c, kind in (("sums", float), ("counts", np.int64)))
            return pa.table({"spec": key[:1], "k": key[1:], "sums": pa.array([sums.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

        schema = "spec int, k int, sums binary, counts binary"
        found, of = {}, {i: own for i, _, own in wanted}
        for r in rows.mapInArrow(run, schema).groupBy("spec", "k").applyInArrow(added, schema).toLocalIterator():
            g, c = np.frombuffer(r["sums"], float).reshape(2, p, 256)
            found[r["spec"], of[r["spec"]][r["k"]][0]] = g + 1j * c, np.frombuffer(r["counts"], np.int64).reshape(p, 256)
        return found

    first = np.full(len(specs), start).tobytes()
    rows = train.withColumn("raw", F.lit(first))
    held, done = None, 0
    for number in range(max((s.rounds for s in specs), default=0)):
        if number and number % KEPT == 0:
            after = kept(rows, [own[done:] for own in out]).persist(StorageLevel.DISK_ONLY)
            after.count()
            if held is not None:
                held.unpersist()
            rows, held, done = after, after, number
        pending = [own[done:] for own in out]
        live = [i for i, s in enumerate(specs) if number < s.rounds]
        growing = {i: Growing(specs[i], p) for i in live}
        for (i, _), sums in passed(rows, pending, [(i, None, [(-1, 0, 0, False)]) for i in live]).items():
            growing[i].root(sums)
        while wanted := [(i, tuple(np.array(c) for c in zip(*g.nodes, strict=True)), own) for i, g in growing.items() if (own := g.asked())]:
            for (i, node), sums in passed(rows, pending, wanted).items():
                growing[i].children[node] = sums
        for i, g in growing.items():
            out[i].append(g.made())
    if held is not None:
        held.unpersist()
    return [(own, start) for own in out]


def boosted_scores(test: DataFrame, p: int, made: list[tuple], start: float) -> DataFrame:
    """(id, s) of test(id, cells)."""
    known = test.sparkSession.sparkContext.broadcast((made, start))

    def run(batches):
        made, start = known.value
        scorer = trees.Scorer(None, None, [trees.flat(made)], start)
        for table in buffered(batches):
            _, _, s = next(scorer.scores(codes_of(table, p), []))
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array(s)], ["id", "s"])

    return test.select("id", "cells").mapInArrow(run, "id bigint, s double")


def boosted_gains(made: list[tuple], p: int) -> np.ndarray:
    gains = np.zeros(p)
    for feature, *_, gain in made:
        np.add.at(gains, feature[feature >= 0], gain[feature >= 0])
    return gains / max(gains.sum(), 1e-300)
