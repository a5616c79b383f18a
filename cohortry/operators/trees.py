"""Growing class-weighted, monotone-constrained trees from histograms: the arithmetic, without Spark (M3).

A row is a byte per column. A column is one binned feature, or a bundle of features of which a row has at most one (the levels of a
category): byte 0 for none, k for the k-th, so a category costs one column whatever the number of its levels. Sums of gradients per (node,
byte of any column) are all that a split needs; they add up over rows, so any number of tasks can contribute.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np

#: Rows looked at together, and groups of equal rows.
CHUNK, SPAN = 1 << 14, 1 << 17
#: Trees after which the odds of rows come from their margins again.
RENEW = 25


@dataclass(frozen=True)
class BoostParams:
    """M3 defaults."""

    n_trees: int = 200
    learning_rate: float = 0.05
    max_depth: int = 4
    min_child_weight: float = 3.0
    row_share: float = 0.8
    column_share: float = 0.8
    alpha: float = 1.0
    lam: float = 1.0
    gamma: float = 0.1
    pos_weight: float = 1.0
    max_bins: int = 64
    base_margin: float = 0.0
    seed: int = 42
    monotone: dict[str, int] = field(default_factory=dict)

    def with_(self, **changes) -> BoostParams:
        return replace(self, **changes)


@dataclass
class Node:
    """One node of a tree; children of node i are 2i and 2i + 1, the root is 1."""

    value: float
    cover: float
    feature: int = -1
    bin: int = 0
    cut: float = 0.0
    gain: float = 0.0


class Layout:
    """Where features stand in the columns of a binned table, and every split that can be made.

    ``column`` and ``code`` per feature: its column, and its byte there if it is one of a bundle, else -1. ``sizes``: bytes in use per
    column. A row goes left when its byte is at most the bin of the split, or, in a bundle, not the feature's.
    """

    def __init__(self, features: Sequence[str], cuts: Sequence[np.ndarray], column: Sequence[int], code: Sequence[int], sizes: Sequence[int]):
        self.features, self.cuts = list(features), list(cuts)
        self.column, self.code = np.asarray(column, np.int64), np.asarray(code, np.int64)
        self.sizes = np.asarray(sizes, np.int64)
        self.offset = np.cumsum(self.sizes) - self.sizes
        self.total = int(self.sizes.sum())
        splits = [(f, b) for f, cut in enumerate(self.cuts) for b in range(len(cut))]
        self.split_feature = np.array([f for f, _ in splits], np.int64)
        self.split_bin = np.array([b for _, b in splits], np.int64)
        of = self.column[self.split_feature] if splits else np.zeros(0, np.int64)
        self.bundled = self.code[self.split_feature] >= 0 if splits else np.zeros(0, bool)
        self.place = self.offset[of] + np.where(self.bundled, self.code[self.split_feature], self.split_bin) if splits else np.zeros(0, np.int64)
        self.before = self.offset[of] if splits else np.zeros(0, np.int64)

    @property
    def width(self) -> int:
        return len(self.sizes)


class Tree:
    """A tree while it grows, as arrays over node numbers."""

    def __init__(self, layout: Layout, params: BoostParams, drawn: np.ndarray):
        size = 2 << params.max_depth
        self.layout, self.params, self.depth = layout, params, 0
        self.feature, self.bin = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.value, self.cover, self.gain = np.zeros(size), np.zeros(size), np.zeros(size)
        self.low, self.high = np.full(size, -np.inf), np.full(size, np.inf)
        self.known = np.zeros(size, bool)
        self.open = np.array([1], np.int64)
        self.allowed = np.isin(layout.split_feature, drawn)
        self.signs = np.array([params.monotone.get(f, 0) for f in layout.features], np.int64)

    def absorb(self, nodes: np.ndarray, found: dict[str, np.ndarray]) -> None:
        """Take the best split of each open node; its children are open next."""
        if self.depth == 0 and len(nodes):
            self.value[1], self.cover[1], self.known[1] = found["value"][0], found["h"][0], True
        split = found["gain"] > 1e-12
        at, layout = nodes[split], self.layout
        chosen = found["split"][split]
        f = layout.split_feature[chosen]
        self.feature[at], self.bin[at], self.gain[at] = f, layout.split_bin[chosen], found["gain"][split]
        left, right = 2 * at, 2 * at + 1
        wl, wr = found["wl"][split], found["wr"][split]
        self.value[left], self.value[right] = wl, wr
        self.cover[left], self.cover[right] = found["hl"][split], found["hr"][split]
        self.known[left] = self.known[right] = True
        middle, sign = (wl + wr) / 2, self.signs[f]
        low, high = self.low[at], self.high[at]
        self.low[left], self.high[left] = np.where(sign < 0, middle, low), np.where(sign > 0, middle, high)
        self.low[right], self.high[right] = np.where(sign > 0, middle, low), np.where(sign < 0, middle, high)
        self.depth += 1
        self.open = np.sort(np.concatenate([left, right])) if self.depth < self.params.max_depth else np.zeros(0, np.int64)

    #: What the growing changes.
    STATE = ("depth", "feature", "bin", "value", "low", "high", "open", "allowed")

    def state(self) -> dict[str, object]:
        """What a task needs besides layout and parameters, to sum over rows and to choose splits."""
        return {name: getattr(self, name) for name in self.STATE}

    @classmethod
    def of(cls, layout: Layout, params: BoostParams, state: dict[str, object]) -> Tree:
        tree = cls(layout, params, np.zeros(0, np.int64))
        vars(tree).update(state)
        return tree

    def step(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows at a node that has been split go on to its children."""
        layout, f = self.layout, self.feature[at]
        c = layout.column[f]
        b = bins.reshape(-1)[np.arange(len(at)) * layout.width + c]
        code = layout.code[f]
        right = np.where(code < 0, b > self.bin[at], b == code)
        return np.where(f >= 0, 2 * at + right, at)

    def walk(self, bins: np.ndarray) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        for _ in range(self.depth):
            at = self.step(bins, at)
        return at

    def nodes(self) -> dict[int, Node]:
        """The finished tree, its values by the learning rate."""
        out = {}
        for i in np.flatnonzero(self.known).tolist():
            f, b = int(self.feature[i]), int(self.bin[i])
            cut = float(self.layout.cuts[f][b]) if f >= 0 else 0.0
            out[i] = Node(float(self.value[i] * self.params.learning_rate), float(self.cover[i]), f, b if f >= 0 else 0, cut, float(self.gain[i]))
        return out


def gradients(margin: np.ndarray, y: np.ndarray, pos_weight: float) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(y == 1, pos_weight, 1.0)
    return w * (p - y), w * p * (1 - p)


def drawn_rows(h: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Rows drawn for a tree: a mix of the row hash and the seed, so a recomputed task draws the same rows."""
    out = np.ones(len(h), dtype=bool)
    if share >= 1.0:
        return out
    least, most = 0, 2**64 - 1  # the least number whose share of 2**64, as a double, is not below ``share``
    while least < most:
        middle = (least + most) // 2
        least, most = (middle + 1, most) if float(middle) / 2.0**64 < share else (least, middle)
    start, limit = np.uint64((seed % 2**32 + 1) * 0x9E3779B97F4A7C15 % 2**64), np.uint64(least)
    for begin in range(0, len(h), CHUNK):
        z = h[begin: begin + CHUNK].view(np.uint64) + start
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        np.less(z, limit, out=out[begin: begin + CHUNK])
    return out


def sums(tree: Tree, places: np.ndarray, at: np.ndarray, used: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Gradient sums ``(2, open nodes, bytes of all columns)`` over the used rows at open nodes; ``places``: bytes plus their column's offset."""
    layout, slots = tree.layout, len(tree.open)
    slot_of = np.full(len(tree.feature), -1, np.int64)
    slot_of[tree.open] = np.arange(slots)
    slot = slot_of[at]
    rows = np.flatnonzero((slot >= 0) & used)
    out = np.zeros((2, slots * layout.total))
    for begin in range(0, len(rows), CHUNK):
        part = rows[begin: begin + CHUNK]
        cell = (places[part] + slot[part][:, None] * layout.total).ravel()
        for s, weights in enumerate((g, h)):
            out[s] += np.bincount(cell, np.repeat(weights[part], layout.width), slots * layout.total)
    return out.reshape(2, slots, layout.total)


def _shrink(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_weight(g, h, p: BoostParams, low, high):
    return np.clip(-_shrink(g, p.alpha) / (h + p.lam), low, high)


def _quality(g, h, w, p: BoostParams):
    """Twice the loss removed by weight ``w``; T(G)^2 / (H + lambda) when no bound cuts the weight."""
    return -(2 * g * w + (h + p.lam) * w * w + 2 * p.alpha * np.abs(w))


def choose(tree: Tree, nodes: np.ndarray, both: np.ndarray) -> dict[str, np.ndarray]:
    """The best allowed split of each node from its sums ``(2, nodes, bytes)``; the first of equally good ones."""
    layout, p = tree.layout, tree.params
    low, high = tree.low[nodes][:, None], tree.high[nodes][:, None]
    upto = np.zeros((2, len(nodes), layout.total + 1))
    np.cumsum(both, axis=2, out=upto[:, :, 1:])
    whole = upto[:, :, layout.sizes[0]: layout.sizes[0] + 1] if layout.width else np.zeros((2, len(nodes), 1))
    left = np.where(layout.bundled, whole - both[:, :, layout.place], upto[:, :, layout.place + 1] - upto[:, :, layout.before])
    (gl, hl), (gr, hr), (g, h) = left, whole - left, whole
    weight = leaf_weight(g, h, p, low, high)
    out = {"value": weight[:, 0], "h": h[:, 0]}
    if not len(layout.place):
        return out | {"gain": np.full(len(nodes), -np.inf), "split": np.zeros(len(nodes), np.int64)} | {k: np.zeros(len(nodes)) for k in ("wl", "wr", "hl", "hr")}
    wl, wr = leaf_weight(gl, hl, p, low, high), leaf_weight(gr, hr, p, low, high)
    gain = 0.5 * (_quality(gl, hl, wl, p) + _quality(gr, hr, wr, p) - _quality(g, h, weight, p)) - p.gamma
    fits = tree.allowed & (hl >= p.min_child_weight) & (hr >= p.min_child_weight) & (tree.signs[layout.split_feature] * (wr - wl) >= 0)
    gain = np.where(fits, gain, -np.inf)
    best = gain.argmax(axis=1)
    rows = np.arange(len(nodes))
    return out | {"gain": gain[rows, best], "split": best} | {k: v[rows, best] for k, v in (("wl", wl), ("wr", wr), ("hl", hl), ("hr", hr))}


class Draws:
    """The features drawn for each tree, one after another."""

    def __init__(self, layout: Layout, params: BoostParams):
        self.rng = np.random.default_rng(params.seed)
        self.width = len(layout.features)
        self.count = max(1, int(round(params.column_share * self.width)))

    def next(self) -> np.ndarray:
        return np.sort(self.rng.choice(self.width, self.count, replace=False))


class Merged:
    """Rows held by one task, those that are equal in all bytes and the label as one: ``bins, y``, how many of them are ``inside`` (learned
    from) and ``outside``, and the hashes ``h`` of the inside ones, group after group. Groups with rows inside come first."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, inside: np.ndarray, outside: np.ndarray, h: np.ndarray):
        self.bins, self.y, self.inside, self.outside, self.h = bins, y, inside, outside, h
        self.known, self.ends = int(np.count_nonzero(inside)), np.cumsum(inside)

    @classmethod
    def of(cls, bins: np.ndarray, y: np.ndarray, h: np.ndarray, inside: np.ndarray) -> Merged:
        if not len(y):
            return cls(bins, y.astype(np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), h)
        padded = np.zeros((len(y), -(-(bins.shape[1] + 1) // 8) * 8), np.uint8)
        padded[:, 0], padded[:, 1: bins.shape[1] + 1] = y, bins
        words = padded.view(np.uint64)
        order = np.lexsort(words.T)
        words = words[order]
        first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
        learned = inside[order]
        count = np.add.reduceat(learned.astype(np.int64), first)
        outside = np.diff(first, append=len(y)) - count
        rank = np.argsort(count == 0, kind="stable")
        some = order[first[rank]]
        return cls(bins[some], y[some].astype(np.uint8), count[rank], outside[rank], h[order[learned]])

    def drawn(self, seed: int, share: float) -> np.ndarray:
        """How many of the inside rows of each group are drawn for a tree."""
        if share >= 1.0:
            return self.inside.astype(float)
        out, used = np.zeros(len(self.y)), drawn_rows(self.h, seed, share)
        if self.known == len(used):
            out[: self.known] = used
        elif self.known:
            out[: self.known] = np.diff(np.cumsum(used)[self.ends[: self.known] - 1], prepend=0)
        return out


class Joint:
    """Columns in sets whose bytes together are one number, so that a row adds to one sum a set and not to one a column.

    Sets grow to at most ``cells`` numbers; the sums of a column are those of its set, added over the others.
    """

    def __init__(self, layout: Layout, cells: int):
        self.layout, self.sets = layout, []
        sizes: list[int] = []
        for c in np.argsort(-layout.sizes, kind="stable").tolist():
            size = int(layout.sizes[c])
            fits = [i for i, n in enumerate(sizes) if n * size <= min(cells, 1 << 16)]
            if fits:
                best = max(fits, key=lambda i: sizes[i])
                self.sets[best].append(c)
                sizes[best] *= size
            else:
                self.sets.append([c])
                sizes.append(size)
        self.sizes = sizes
        self.set_of = {c: i for i, columns in enumerate(self.sets) for c in columns}

    def places(self, bins: np.ndarray) -> np.ndarray:
        """``(set, row)``: the number of a row in each set."""
        out = np.zeros((len(self.sets), len(bins)), np.uint16)
        for i, columns in enumerate(self.sets):
            for c in columns:
                out[i] *= np.uint16(self.layout.sizes[c] & 0xFFFF)
                out[i] += bins[:, c]
        return out

    def spread(self, i: int) -> list[np.ndarray]:
        """The byte of each column of a set, for every number."""
        return list(np.indices([int(self.layout.sizes[c]) for c in self.sets[i]]).reshape(len(self.sets[i]), -1))

    def apart(self, joint: list[np.ndarray], nodes: int) -> np.ndarray:
        """``(2, nodes, bytes of all columns)`` from the sums ``(2, nodes, numbers)`` of each set."""
        layout = self.layout
        out = np.zeros((2, nodes, layout.total))
        for columns, sums in zip(self.sets, joint, strict=True):
            shaped = sums.reshape(2, nodes, *[int(layout.sizes[c]) for c in columns])
            for k, c in enumerate(columns):
                others = tuple(2 + m for m in range(len(columns)) if m != k)
                out[:, :, layout.offset[c]: layout.offset[c] + layout.sizes[c]] = shaped.sum(axis=others)
        return out


def _next_slots(joint: Joint, tree: Tree, nodes: np.ndarray, rows: int) -> tuple[list[int], tuple]:
    """The nodes at which rows are after those of ``nodes`` that could be split, and how a row gets there: where its number stands that counts,
    where the numbers of its node begin in a table, and that table of the place of its next node."""
    layout, after, size = joint.layout, [], 0
    which, begin, table = [], [], []
    for node in nodes.tolist():
        f = int(tree.feature[node])
        begin.append(size)
        if f < 0:
            which.append(len(joint.sets) - 1)
            table.append(np.full(joint.sizes[-1], len(after)))
            after.append(node)
        else:
            c = int(layout.column[f])
            which.append(joint.set_of[c])
            byte = joint.spread(which[-1])[joint.sets[which[-1]].index(c)]
            table.append(len(after) + (byte == layout.code[f] if layout.code[f] >= 0 else byte > tree.bin[node]))
            after += [2 * node, 2 * node + 1]
        size += len(table[-1])
    return after, (np.array(which) * rows, np.array(begin), np.concatenate(table))


def _follow(way: tuple, places: np.ndarray, slot: np.ndarray, b: int, e: int) -> None:
    """Rows go on to the place of their next node."""
    which, begin, table = way
    rows = places.shape[1]
    if (which == which[0]).all():
        number = places[which[0] // rows, b:e]
    else:
        at = which.take(slot[b:e], mode="clip")
        at += np.arange(b, e)
        number = places.reshape(-1).take(at, mode="clip")
    if len(begin) > 1:
        number = begin.take(slot[b:e], mode="clip") + number
    table.take(number, out=slot[b:e], mode="clip")


def grow_here(layout: Layout, rows: Merged, params: BoostParams) -> tuple[list[dict[int, Node]], np.ndarray]:
    """All trees of one fit on the inside rows that one task holds, and the margins of all its groups."""
    n, known = len(rows.y), rows.known
    joint = Joint(layout, max(1, min(1 << 12, n >> (params.max_depth + 1))))
    places, y = joint.places(rows.bins), rows.y.astype(float)
    weight = np.where(y == 1, params.pos_weight, 1.0)
    margin, odds = np.full(n, float(params.base_margin)), np.empty(n)  # odds: exp(-margin)
    out, draws = [], Draws(layout, params)
    g, hess, slot = np.empty(n), np.empty(n), np.zeros(n, np.int64)
    spans, chunks = ([(b, min(b + size, n)) for b in range(0, n, size)] for size in (SPAN, CHUNK))
    for t in range(params.n_trees):
        tree = Tree(layout, params, draws.next())
        count = rows.drawn(params.seed + t, params.row_share)
        for b, e in chunks:
            if t % RENEW == 0:
                np.exp(-margin[b:e], out=odds[b:e])
            p = 1.0 / (1.0 + odds[b:e])
            w = weight[b:e] * count[b:e]
            np.multiply(p - y[b:e], w, out=g[b:e])
            w *= p
            np.multiply(1.0 - p, w, out=hess[b:e])
        slot[:] = 0
        at, way = [1], None
        while len(tree.open):
            sums = [np.zeros((2, len(at) * size)) for size in joint.sizes]
            for b, e in spans:
                if way is not None:
                    _follow(way, places, slot, b, e)
                e = min(e, known)
                for i, size in enumerate(joint.sizes if b < e else ()):
                    cell = slot[b:e] * size
                    cell += places[i, b:e]
                    for s, what in enumerate((g, hess)):
                        sums[i][s] += np.bincount(cell, what[b:e], len(at) * size)
            nodes = tree.open
            opened = [at.index(node) for node in nodes.tolist()]
            both = joint.apart([x.reshape(2, len(at), -1)[:, opened] for x in sums], len(nodes))
            tree.absorb(nodes, choose(tree, nodes, both))
            at, way = _next_slots(joint, tree, np.array(at), n)
        out.append(tree.nodes())
        step = tree.value[at] * params.learning_rate
        turn = np.exp(-step)
        for b, e in spans:
            if way is not None:
                _follow(way, places, slot, b, e)
            margin[b:e] += step.take(slot[b:e], mode="clip")
            odds[b:e] *= turn.take(slot[b:e], mode="clip")
    return out, margin


def auc(score: np.ndarray, y: np.ndarray, count: np.ndarray | None = None) -> float | None:
    """Area under the ROC curve by trapezoids, of rows that each stand for ``count``; None without both classes."""
    count = np.ones(len(y)) if count is None else count
    order = np.argsort(score)
    last = np.append(score[order][1:] != score[order][:-1], True) if len(score) else np.zeros(0, bool)
    pos, neg = np.cumsum((y * count)[order])[last], np.cumsum(((1 - y) * count)[order])[last]
    if not len(pos) or not pos[-1] or not neg[-1]:
        return None
    p, n = np.diff(pos, prepend=0), np.diff(neg, prepend=0)
    return float((p * (neg - n / 2)).sum() / (float(pos[-1]) * float(neg[-1])))
