"""Forests and boosted trees on binned rows: the kernels that a task runs for a fit, or for a node of one.

Both choose splits by histograms: sums by (tree, node, feature, bin). Many trees of a forest grow at once, level by
level, so that a level of all of them is a few passes over arrays. A node's features hang on a hash of its way from the
root, and a row's multiplicity in a tree on a hash of its unit: grown in one piece or from sums that many tasks
have added up, a tree is the same.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
BINS, MISSING = 255, 255
LEFT, RIGHT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
# Poisson(1) as cumulative shares of 2^64
_POISSON = np.array([int(sum(np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)[: k + 1]) * 2.0**53) << 11 for k in range(8)], U64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def borders(values: np.ndarray) -> np.ndarray:
    """Cuts between the values of a feature, at most BINS - 1: between all of them, or at quantiles."""
    seen = np.unique(values[~np.isnan(values)])
    if len(seen) > BINS:
        seen = np.unique(np.quantile(values[~np.isnan(values)], np.linspace(0, 1, BINS), method="nearest"))
    return (seen[1:] + seen[:-1]) / 2


def binned(x: np.ndarray, cuts: list[np.ndarray], fill: np.ndarray | None) -> np.ndarray:
    """x as bins, feature by feature; what is missing takes the value in fill, or has the bin MISSING."""
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        v = x[:, j] if fill is None else np.where(np.isnan(x[:, j]), fill[j], x[:, j])
        out[:, j] = np.where(np.isnan(v), MISSING, np.searchsorted(c, v))
    return out


def medians(x: np.ndarray) -> np.ndarray:
    """Of each feature, 0 where there is no value."""
    some = ~np.isnan(x).all(0)
    out = np.zeros(x.shape[1])
    out[some] = np.nanmedian(x[:, some], axis=0)
    return out


def drawn(unit: np.ndarray, tree_seeds: np.ndarray) -> np.ndarray:
    """(tree, row): how often each row is in the bootstrap of each tree."""
    h = mixed(mixed(unit[None, :] + RIGHT) ^ tree_seeds[:, None])
    return np.searchsorted(_POISSON, h.ravel(), "right").astype(np.uint8).reshape(h.shape)


@dataclass(frozen=True)
class Forest:
    trees: int = 500
    leaf: int = 5
    seed: int = 0

    def tree_seeds(self, first: int, n: int) -> np.ndarray:
        return mixed(np.arange(first, first + n, dtype=U64) + mixed(np.full(1, self.seed, U64)))


@dataclass
class Trees:
    """Nodes of several trees; the first ``roots`` are the roots. feature is -1 at a leaf."""

    roots: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    tree: np.ndarray

    def score(self, codes: np.ndarray) -> np.ndarray:
        """(root, row): the value of the leaf that each row comes to."""
        n = len(codes)
        node = np.repeat(np.arange(self.roots), n)
        row, now = np.tile(np.arange(n), self.roots), np.arange(self.roots * n)
        while len(now):
            at = node[now]
            f = self.feature[at]
            inner = f >= 0
            now, at, f = now[inner], at[inner], f[inner]
            node[now] = np.where(codes[row[now], f] <= self.cut[at], self.left[at], self.right[at])
        return self.value[node].reshape(self.roots, n)

    def importance(self, p: int) -> np.ndarray:
        """(root, feature): the share of each feature in what its tree's splits gain."""
        inner = self.feature >= 0
        out = np.bincount(self.tree[inner] * p + self.feature[inner], self.gain[inner], self.roots * p).reshape(self.roots, p)
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


#: Rows, draws and draws of class 1 as one whole number, FIELD bits each: sums of sums are a subtraction.
FIELD = 21
MOST = (1 << FIELD) - 1


def packed(r: np.ndarray, n: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return r + (n << FIELD) + (n1 << 2 * FIELD)


def unpacked(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return sums & MOST, (sums >> FIELD) & MOST, sums >> 2 * FIELD


def lows(q: np.ndarray, code: np.ndarray, token: np.ndarray, worth: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, bin, packed sums of the node up to that bin) of the distinct pairs of node and bin, in order. q: the node of
    each row, token: what it adds, as a place in worth; size: the rows of each node.

    They are counted where they are dense. Else rows are sorted as one small number each, its token in the last bits.
    """
    bits, token_bits, n = width.bit_length() - 1, len(worth).bit_length() - 1, len(size)
    if n * width <= len(q):
        _, draws, ones = unpacked(worth)
        cell, *sums = cells((q << bits) + code, draws[token], ones[token], n * width)
        total = np.cumsum(packed(*sums))
        start = np.append(0, total)[np.searchsorted(cell, np.arange(n) << bits)]
    else:
        kind = np.uint32 if n << (bits + token_bits) < 1 << 32 else np.uint64
        key = q.astype(kind)
        for more, part in ((bits, code), (token_bits, token)):
            key <<= kind(more)
            key |= part
        key.sort()
        total, key = np.cumsum(worth[key & kind(len(worth) - 1)]), key >> kind(token_bits)
        start = np.append(0, total)[np.cumsum(size) - size]
        end = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        cell, total = key[end].astype(np.int64), total[end]
    return cell >> bits, cell & (width - 1), total - start[cell >> bits]


def best_cuts(node: np.ndarray, low: np.ndarray, whole: np.ndarray, w0: np.ndarray, w1: np.ndarray, leaves: tuple[int, ...], want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, purity), a row for each of leaves, from small to large: the best cut of each node, which lies after that cell;
    the purity is -inf where there is none or want(leaf, node) is false.

    Cells are sorted by node and bin; low is the packed sums up to them, whole those of each node, w0 and w1 each node's
    class weights. The best cut leaves at least that many rows on both sides and has the greatest weighted purity. If the
    best cut for a small leaf leaves enough rows for a larger one, it is the best for that too.
    """
    n = len(whole)
    cell, most = np.zeros((len(leaves), n), np.int64), np.full((len(leaves), n), -np.inf)
    least = np.full(n, MOST)
    for leaf, own in zip(leaves[::-1], want[::-1], strict=True):
        least[own] = leaf
    r = low & MOST
    if len(leaves) == 1:
        able = np.flatnonzero((r >= leaves[0]) & (r <= (whole & MOST)[node] - leaves[0]))
    else:
        side = np.minimum(r, (whole & MOST)[node] - r)
        able = np.flatnonzero(side >= least[node])
    if not len(able):
        return cell, most
    node, low = node[able], low[able]
    v0, v1 = w0[node], w1[node]
    parts = []
    for part in (low, whole[node] - low):
        a, b = part >> 2 * FIELD, (part >> FIELD) & MOST
        b = v0 * (b - a)
        a = v1 * a
        parts.append((a * a + b * b) / (a + b))
    purity = parts[0] + parts[1]
    at, hit, found = firsts(node, purity)
    if len(leaves) == 1:
        cell[0, at], most[0, at] = able[hit], found
        return cell, most
    side, reach = side[able], np.zeros(n, np.int64)
    reach[at] = side[hit]
    for i, leaf in enumerate(leaves):
        fits = want[i, at] & (reach[at] >= leaf)
        cell[i, at[fits]], most[i, at[fits]] = able[hit[fits]], found[fits]
        again = want[i] & (reach > 0) & (reach < leaf)
        if again.any():
            some = np.flatnonzero(again[node] & (side >= leaf))
            if len(some):
                own, h, f = firsts(node[some], purity[some])
                cell[i, own], most[i, own] = able[some[h]], f
    return cell, most


def firsts(node: np.ndarray, purity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, place, purity) of the first cell with the greatest purity of each node."""
    heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    most = np.maximum.reduceat(purity, heads)
    hit = np.flatnonzero(purity == np.repeat(most, np.diff(np.append(heads, len(node)))))
    return node[heads], hit[np.r_[True, node[hit[1:]] != node[hit[:-1]]]], most


def cells(key: np.ndarray, draws: np.ndarray, ones: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, rows, draws, ones) of the distinct keys, in order: by counting where they are dense, else by sorting."""
    if size <= 4 * len(key):
        r = np.bincount(key, minlength=size)
        some = np.flatnonzero(r)
        both = np.bincount(key, draws + ones * float(1 << 26), size)[some].astype(np.int64)
        return some, r[some], both & ((1 << 26) - 1), both >> 26
    bits = max(1, int(len(key) - 1).bit_length())
    order = np.sort((key << bits) | np.arange(len(key)))
    at, value = order & ((1 << bits) - 1), order >> bits
    start = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    return value[start], np.diff(np.append(start, len(key))), np.add.reduceat(draws[at], start), np.add.reduceat(ones[at], start)


def feature_order(way: np.ndarray, p: int) -> np.ndarray:
    """(node, place): the features in the order in which a node tries them."""
    return np.argsort(mixed(way[:, None] ^ mixed(np.arange(1, p + 1, dtype=U64))[None, :]), axis=1).astype(np.int32)


def class_weights(n: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights that make both classes of each tree's draws count the same."""
    return n / (2.0 * np.maximum(n - n1, 1)), n / (2.0 * np.maximum(n1, 1))


def grown(codes: np.ndarray, y: np.ndarray, times: np.ndarray, way: np.ndarray, w0: np.ndarray, w1: np.ndarray, leaf: int) -> Trees:
    """Trees (or subtrees), one for each row of times(tree, row), grown until leaves are pure or small.

    A node tries the square root of the number of features, and further ones only where none of these can be cut.
    """
    return grown_alike(codes, y, times, way, w0, w1, (leaf,))[0]


def grown_alike(codes: np.ndarray, y: np.ndarray, times: np.ndarray, way: np.ndarray, w0: np.ndarray, w1: np.ndarray, leaves: tuple[int, ...]) -> list[Trees]:
    """grown() for each of leaves, from small to large. Trees that differ in their least leaf alone are one as long as they
    are cut alike: such a node is sorted once, and its rows part where the cuts do."""
    p, kinds = codes.shape[1], range(len(leaves))
    m = max(1, int(p**0.5))
    width = 1 << max(1, int(codes.max(initial=0)).bit_length())
    at, row = np.nonzero(times)
    draws, ones = times[at, row].astype(np.int64), y[row].astype(np.int64)
    n_nodes = len(times)
    # rows, draws and draws of class 1 of each node
    state = packed(*(np.bincount(at, w, n_nodes).astype(np.int64) for w in (None, draws, draws * ones)))
    # what a row adds, as a small number
    token = (2 * draws + ones).astype(np.uint8 if times.max(initial=0) < 128 else np.uint16)
    token_bits = max(1, int(token.max(initial=0)).bit_length())
    number = np.arange(1 << token_bits)
    worth = packed(np.ones_like(number), number >> 1, (number >> 1) * (number & 1))
    flat, row = codes.ravel(), row * p
    tree, made = np.arange(n_nodes), [0 for _ in kinds]
    # whose node it is
    whose = np.ones((len(leaves), n_nodes), bool)
    out: list[list[list[np.ndarray]]] = [[[] for _ in range(7)] for _ in kinds]
    while n_nodes:
        r, n, n1 = unpacked(state)
        a1, a0 = w1[tree] * n1, w0[tree] * (n - n1)
        shape = (len(leaves), n_nodes)
        feature, cut, gain, low = np.full(shape, -1, np.int32), np.zeros(shape, np.uint8), np.zeros(shape), np.zeros(shape, np.int64)
        opens = whose & (n1 > 0) & (n1 < n) & (r >= 2 * np.array(leaves)[:, None])
        open_ = opens.any(0)
        own = np.flatnonzero(open_)
        place = np.where(open_, np.cumsum(open_) - 1, -1)
        q = place[at]
        if len(own) < n_nodes:
            keep = np.flatnonzero(q >= 0)
            at, row, token, q = at[keep], row[keep], token[keep], q[keep]
        order = feature_order(way[own], p).astype(np.int64)
        pending, mine, t = np.arange(len(own)), row, token
        wanted = opens[:, own]
        for k in range(0, p, m):
            if not len(pending):
                break
            if k:
                number = np.full(len(own), -1)
                number[pending] = np.arange(len(pending))
                q = number[place[at]]
                some = np.flatnonzero(q >= 0)
                q, mine, t = q[some], row[some], token[some]
            nodes, want = own[pending], wanted[:, pending]
            whole, v0, v1 = state[nodes], w0[tree[nodes]], w1[tree[nodes]]
            best = np.full(want.shape, -np.inf)
            for s in range(k, min(k + m, p)):
                f = order[pending, s]
                node, code, sums = lows(q, flat[mine + f[q]], t, worth, whole & MOST, width)
                cell, purity = best_cuts(node, sums, whole, v0, v1, leaves, want)
                for i in kinds:
                    found = np.flatnonzero(purity[i] > best[i])
                    c, to = cell[i, found], nodes[found]
                    best[i, found] = purity[i, found]
                    feature[i, to], cut[i, to], low[i, to] = f[found], code[c], sums[c]
            done = best > -np.inf
            for i in kinds:
                to = nodes[done[i]]
                gain[i, to] = best[i, done[i]] - (a1[to] ** 2 + a0[to] ** 2) / (a1[to] + a0[to])
            wanted[:, pending] &= ~done
            pending = pending[wanted[:, pending].any(0)]
        value = a1 / np.maximum(a1 + a0, 1e-300)
        # the first of leaves with the same cut
        leader = np.zeros(shape, np.int64)
        for i in kinds:
            own_nodes = np.flatnonzero(whose[i])
            splits = feature[i, own_nodes] >= 0
            left, right = np.zeros(len(own_nodes), np.int32), np.zeros(len(own_nodes), np.int32)
            left[splits] = made[i] + len(own_nodes) + 2 * np.arange(splits.sum())
            right[splits] = left[splits] + 1
            for parts, x in zip(out[i], (feature[i, own_nodes], cut[i, own_nodes], left, right, value[own_nodes], gain[i, own_nodes], tree[own_nodes]), strict=True):
                parts.append(x)
            made[i] += len(own_nodes)
            leader[i] = i
            for j in range(i - 1, -1, -1):
                leader[i] = np.where((feature[i] == feature[j]) & (cut[i] == cut[j]), leader[j], leader[i])
        leads = (feature >= 0) & (leader == np.arange(len(leaves))[:, None])
        parent, kind = np.nonzero(leads.T)
        numbers = np.full(shape, -1)
        numbers[kind, parent] = 2 * np.arange(len(parent))
        moved = []
        for i in kinds:
            number = numbers[i]
            if i and not leads[i].any():
                continue
            now = number[at]
            a, o, t = at, row, token
            if i or not leads[i, own].all():
                keep = np.flatnonzero(now >= 0)
                a, o, t, now = at[keep], row[keep], token[keep], now[keep]
            moved.append((now + (flat[o + feature[i].astype(np.int64)[a]] > cut[i][a]), o, t))
        at, row, token = moved[0] if len(moved) == 1 else (np.concatenate(x) for x in zip(*moved, strict=True))
        whose = np.repeat((leader[:, parent] == kind) & (feature[:, parent] >= 0), 2, axis=1)
        state = np.stack([low[kind, parent], state[parent] - low[kind, parent]], 1).ravel()
        tree, n_nodes = np.repeat(tree[parent], 2), 2 * len(parent)
        way = np.stack([mixed(way[parent] ^ LEFT), mixed(way[parent] ^ RIGHT)], 1).ravel()
    return [Trees(len(times), *(np.concatenate(x) if x else np.zeros(0) for x in own)) for own in out]


@dataclass(frozen=True)
class Boosted:
    rounds: int = 200
    rate: float = 0.05
    leaves: int = 15
    least: int = 20
    l2: float = 1.0


#: Gradients are whole multiples of a part of 1, so that their sums are exact: the same in whatever order they are added up.
PART = float(1 << 26)
#: The most cells whose places are kept for all rounds.
PLACED = 1 << 23


class Histograms:
    """Sums by (feature, bin) of a fit's rows, and the best cut that they allow, in arrays that are used again."""

    def __init__(self, codes: np.ndarray, spec: Boosted):
        self.codes, self.p, self.spec = codes, codes.shape[1], spec
        self.places = self.placed(codes) if codes.size <= PLACED else None
        self.sums = np.empty((self.p, 256), complex)
        self.a, self.b, self.more, self.gain = (np.empty((self.p, MISSING)) for _ in range(4))
        self.gradient_low, self.curve_low = (np.empty((self.p, MISSING)) for _ in range(2))

    def placed(self, codes: np.ndarray) -> np.ndarray:
        return codes + np.arange(self.p) * 256

    def counts(self, rows: np.ndarray) -> np.ndarray:
        if self.places is None:
            return np.stack([np.bincount(self.codes[rows, j], minlength=256) for j in range(self.p)])
        key = self.places[rows].ravel()
        return np.bincount(key, minlength=self.p * 256).reshape(self.p, 256)

    def of(self, rows: np.ndarray, gradient: np.ndarray, curve: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(gradients and curvatures as complex numbers, rows) a feature and bin."""
        if self.places is None:
            return self.by_feature(rows, gradient, curve, counts)
        key = (self.places if len(rows) == len(self.places) else self.places[rows]).ravel()
        out = np.empty((self.p, 256), complex)
        for part, own in ((out.real, gradient), (out.imag, curve)):
            part[:] = np.bincount(key, np.repeat(own[rows], self.p), self.p * 256).reshape(self.p, 256)
        return out, np.bincount(key, minlength=self.p * 256).reshape(self.p, 256) if counts is None else counts

    def by_feature(self, rows: np.ndarray, gradient: np.ndarray, curve: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """of() for many codes, of which only a column is held as whole numbers at a time."""
        out, number = np.empty((self.p, 256), complex), np.empty((self.p, 256), np.int64)
        g, c = gradient[rows], curve[rows]
        for j in range(self.p):
            key = self.codes[rows, j]
            out.real[j], out.imag[j] = np.bincount(key, g, 256), np.bincount(key, c, 256)
            if counts is None:
                number[j] = np.bincount(key, minlength=256)
        return out, number if counts is None else counts

    def best(self, sums: np.ndarray, counts: np.ndarray) -> tuple[float, int, int, bool]:
        """(gain, feature, cut, whether missing values go left); the gain is 0 if nothing can be split."""
        least, l2, best = self.spec.least, self.spec.l2, (0.0, -1, -1, False)
        n = int(counts[0].sum())
        gradient, curve = sums.real.sum(1, keepdims=True), sums.imag.sum(1, keepdims=True)
        whole = gradient[0, 0] ** 2 / (curve[0, 0] + l2)
        np.cumsum(sums, axis=1, out=self.sums)
        self.gradient_low[:], self.curve_low[:] = self.sums.real[:, :MISSING], self.sums.imag[:, :MISSING]
        rows_low = np.cumsum(counts[:, :MISSING], axis=1)
        for missing_left in (False, True) if counts[:, MISSING].any() else (False,):
            a, c, rows = self.gradient_low, self.curve_low, rows_low
            if missing_left:
                a, c, rows = a + sums.real[:, MISSING:], c + sums.imag[:, MISSING:], rows + counts[:, MISSING:]
            good = (rows >= least) & (rows <= n - least)
            good &= c >= 1e-3
            np.subtract(curve, c, out=self.b)
            good &= self.b >= 1e-3
            self.b += l2
            np.subtract(gradient, a, out=self.more)
            self.more *= self.more
            self.more /= self.b
            np.add(c, l2, out=self.a)
            np.multiply(a, a, out=self.gain)
            self.gain /= self.a
            self.gain += self.more
            self.gain -= whole
            self.gain *= good
            at = int(self.gain.argmax())
            if self.gain.flat[at] > best[0] + 1e-12:
                best = (float(self.gain.flat[at]), at // MISSING, at % MISSING, missing_left)
        return best


def histogram(codes: np.ndarray, rows: np.ndarray, sums: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return Histograms(codes, Boosted()).of(rows, *sums)


def best_split(h: tuple[np.ndarray, np.ndarray], least: int, l2: float) -> tuple[float, int, int, bool]:
    return Histograms(np.empty((0, len(h[1])), np.uint8), Boosted(least=least, l2=l2)).best(*h)


def slopes(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, curvature) of the logistic loss, in whole PARTs."""
    chance = 1 / (1 + np.exp(-raw))
    return np.rint(w * (chance - y) * PART) / PART, np.rint(w * chance * (1 - chance) * PART) / PART


def boosted_start(positive: float, total: float) -> float:
    share = min(max(positive / max(total, 1e-300), 1e-6), 1 - 1e-6)
    return round(float(np.log(share / (1 - share))), 9)


def leaf_value(sums: np.ndarray, spec: Boosted) -> float:
    return float(-spec.rate * sums.real[0].sum() / (sums.imag[0].sum() + spec.l2))


def boost(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, spec: Boosted) -> tuple[list[tuple], float]:
    """(trees, start) from the rows of positive weight: each tree grows from its best leaf on until it has spec.leaves,
    with values that are missing sent to the side where they gain more. A tree is (feature, cut, missing left, left,
    right, value, gain) a node."""
    train = np.flatnonzero(weight > 0)
    codes, y, w = codes[train], y[train], weight[train]
    start = boosted_start((w * y).sum(), w.sum())
    raw, out, every = np.full(len(codes), start), [], np.arange(len(codes))
    columns, found = np.ascontiguousarray(codes.T), Histograms(codes, spec)
    counts = found.counts(every)
    for _ in range(spec.rounds):
        gradient, curve = slopes(raw, y, w)
        nodes, rows_of, hists, waiting = [[-1, 0, False, 0, 0, 0.0, 0.0]], [every], [found.of(every, gradient, curve, counts)], []

        def offer(i: int) -> None:
            if len(rows_of[i]) < 2 * spec.least:  # noqa: B023
                return
            best = found.best(*hists[i])  # noqa: B023
            if best[1] >= 0:
                heapq.heappush(waiting, (-best[0], i, best))  # noqa: B023

        offer(0)
        n_leaves = 1
        while waiting and n_leaves < spec.leaves:
            _, i, (gain, feature, cut, missing_left) = heapq.heappop(waiting)
            nodes[i][6] = gain
            own = columns[feature][rows_of[i]]
            low = np.where(own == MISSING, missing_left, own <= cut)
            sides = rows_of[i][low], rows_of[i][~low]
            small = int(len(sides[1]) < len(sides[0]))
            h = found.of(sides[small], gradient, curve)
            pair = [h, h]
            pair[1 - small] = (hists[i][0] - h[0], hists[i][1] - h[1])
            nodes[i][:5] = feature, cut, missing_left, len(nodes), len(nodes) + 1
            hists[i] = None
            for side, own_h in zip(sides, pair, strict=True):
                nodes.append([-1, 0, False, 0, 0, 0.0, 0.0])
                rows_of.append(side)
                hists.append(own_h)
                if n_leaves + 1 < spec.leaves:
                    offer(len(nodes) - 1)
            n_leaves += 1
        for node, rows, h in zip(nodes, rows_of, hists, strict=True):
            if node[0] < 0:
                node[5] = leaf_value(h[0], spec)
                raw[rows] += node[5]
        out.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
    return out, start


def boosted_scores(codes: np.ndarray, made: list[tuple], start: float) -> np.ndarray:
    raw = np.full(len(codes), start)
    for feature, cut, missing_left, left, right, value, _ in made:
        node, now = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while True:
            now = now[feature[node[now]] >= 0]
            if not len(now):
                break
            at = node[now]
            own = codes[now, feature[at]]
            node[now] = np.where(np.where(own == MISSING, missing_left[at], own <= cut[at]), left[at], right[at])
        raw += value[node]
    return 1 / (1 + np.exp(-raw))


@dataclass
class Flat:
    """Boosted trees as nodes of one forest; the first ``roots`` of at are their roots."""

    at: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def flat(made: list[tuple]) -> Flat:
    start = np.cumsum([0, *(len(t[0]) for t in made)])[:-1]
    feature, cut, missing_left, left, right, value, _ = ([np.asarray(t[i]) for t in made] for i in range(7))
    moved = lambda parts: np.concatenate([p + s for p, s in zip(parts, start, strict=True)])
    return Flat(start, np.concatenate(feature), np.concatenate(cut), np.concatenate(missing_left).astype(bool), moved(left), moved(right), np.concatenate(value))


@dataclass
class Scorer:
    """Scores of trees that are added up: of a forest in parts, or of boosted trees from ``start`` on as probabilities.
    Without cuts, rows are bins."""

    cuts: list[np.ndarray] | None
    fill: np.ndarray | None
    parts: list
    start: float | None = None

    def scores(self, x: np.ndarray, moves: list[tuple]):
        """(swap, rep, scores) of rows as they are, and after each move (column, swap, rep, order) of a column's values.

        What a tree says of a row changes only where its way meets the column, so that few ways are gone again.
        """
        codes = x if self.cuts is None else binned(x, self.cuts, self.fill)
        sums = np.zeros((1 + len(moves), len(x)))
        bits = (U64(1) << (np.arange(codes.shape[1]) % 64).astype(U64)) if moves else None
        for t in self.parts:
            roots = t.at if isinstance(t, Flat) else np.arange(t.roots)
            size = max(1, (1 << 18) // len(roots)) if len(roots) else 1
            for low in range(0, len(x), size):
                own = codes[low : low + size]
                n = len(own)
                leaf, met = way(t, own, np.repeat(roots, n), np.tile(np.arange(n), len(roots)), None, bits)
                value = t.value[leaf].reshape(len(roots), n)
                sums[0, low : low + n] += value.sum(0)
                for i, (j, _, _, order) in enumerate(moves, 1):
                    again = np.flatnonzero(met & bits[j])
                    column = codes[order[low : low + n], j]
                    row = again % n
                    differ = column[row] != own[row, j]
                    again, row = again[differ], row[differ]
                    now = value.ravel().copy()
                    now[again] = t.value[way(t, own, roots[again // n], row, (j, column), None)[0]]
                    sums[i, low : low + n] += now.reshape(value.shape).sum(0)
        if self.start is not None:
            sums = 1 / (1 + np.exp(-(sums + self.start)))
        yield -1, 0, sums[0]
        for (_, swap, rep, _), s in zip(moves, sums[1:], strict=True):
            yield swap, rep, s


def way(t, codes: np.ndarray, node: np.ndarray, row: np.ndarray, moved: tuple | None, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """The leaf that each row comes to from its node, and the columns that it meets as bits. moved: a column and what
    it holds instead."""
    node, now, p = node.copy(), np.arange(len(node)), codes.shape[1]
    met = np.zeros(len(node), U64) if bits is not None else None
    all_codes = codes.ravel()
    while True:
        at = node[now]
        f = t.feature[at]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return node, met
        if len(inner) < len(now):
            now, at, f = now[inner], at[inner], f[inner]
        if met is not None:
            met[now] |= bits[f]
        r = row[now]
        own = all_codes[r * p + f]
        if moved is not None:
            own = np.where(f == moved[0], moved[1][r], own)
        low = own <= t.cut[at]
        if isinstance(t, Flat):
            low = np.where(own == MISSING, t.missing_left[at], low)
        node[now] = np.where(low, t.left[at], t.right[at])
