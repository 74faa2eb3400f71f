"""Boosted trees by histograms, for pairs by the million: NumPy over blocks of binned rows, all folds at once.

A row is read as doubles twice or three times (medians and bins, then its bins); from then on it is a few 16-bit numbers. A level
of a tree is one pass over the blocks for all folds, which returns sums by bin; the trees are grown of them on the
driver. Gradients and weights are whole multiples of a power of two, so their sums, and with them the trees, don't depend
on the order of rows or their partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
#: Rows of a block, and cells of the features that share a number.
BLOCK, CELLS = 1 << 16, 1 << 10
#: Rows of a partition of blocks.
PART = 2_000_000
#: Distinct values that a summary holds exactly, and points that it keeps of more.
EXACT, POINTS = 8192, 1024
_K = np.uint64(0x03F79D71B4CB0A89)
_AT = np.zeros(64, np.uint8)
for _i in range(64):
    _AT[((0x03F79D71B4CB0A89 << _i) & 0xFFFFFFFFFFFFFFFF) >> 58] = _i


def doubles(column: pa.Array) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return np.asarray(column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False), np.float64)


# Medians and bins ------------------------------------------------------------------------------------------------


def condensed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Distinct values with their counts; beyond EXACT of them POINTS, each for the values down to the one before."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    values, counts = values[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(values) <= EXACT:
        return values, counts, True
    upto = np.cumsum(counts)
    at = np.unique(np.r_[0, np.searchsorted(upto, np.linspace(0, upto[-1], POINTS + 1)[1:]).clip(0, len(values) - 1)])
    return values[at], np.diff(np.r_[0, upto[at]]), False


def summaries(df: DataFrame, columns: list[str], brackets: dict[int, tuple[float, float]]) -> dict[int, tuple]:
    """By column: rows below its bracket, missing ones, and those within as (values, counts, whether exact)."""
    asked = sorted(brackets)

    def read(batches):
        kept = {i: ([], [], True) for i in asked}
        below, missing, held = dict.fromkeys(asked, 0), dict.fromkeys(asked, 0), 0

        def fold():
            for i in asked:
                v, c, exact = kept[i]
                if len(v) > 1:
                    v, c, now = condensed(np.concatenate(v), np.concatenate(c))
                    kept[i] = ([v], [c], exact and now)

        for batch in batches:
            for at, i in enumerate(asked):
                x = doubles(batch.column(at))
                nan = np.isnan(x)
                missing[i] += int(nan.sum())
                lo, hi = brackets[i]
                below[i] += int((x < lo).sum())
                x = np.sort(x[(x >= lo) & (x <= hi)])
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
                kept[i][0].append(x[first])
                kept[i][1].append(np.diff(np.r_[first, len(x)]))
            held += batch.num_rows
            if held >= 4 * BLOCK:
                held = 0
                fold()
        for i in asked:
            kept[i][0].append(np.zeros(0))
            kept[i][1].append(np.zeros(0, np.int64))
            kept[i][0].append(np.zeros(0))
            kept[i][1].append(np.zeros(0, np.int64))
        fold()
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(asked, pa.int32()), "below": pa.array([below[i] for i in asked], pa.int64()), "missing": pa.array([missing[i] for i in asked], pa.int64()),
            "v": pa.array([kept[i][0][0].tobytes() for i in asked], pa.binary()), "n": pa.array([kept[i][1][0].astype(np.int64).tobytes() for i in asked], pa.binary()), "exact": pa.array([kept[i][2] for i in asked], pa.bool_()),
        })

    rows = df.select(*[F.col(f"`{columns[i]}`").cast("double").alias(f"c{i}") for i in asked])
    most = 4 * df.sparkSession.sparkContext.defaultParallelism  # a summary for each task comes to the driver
    found = rows.coalesce(most).mapInArrow(read, "i int, below long, missing long, v binary, n binary, exact boolean").collect()
    out = {}
    for i in asked:
        own = [r for r in found if r["i"] == i]
        values = np.concatenate([np.frombuffer(r["v"], np.float64) for r in own] or [np.zeros(0)])
        counts = np.concatenate([np.frombuffer(r["n"], np.int64) for r in own] or [np.zeros(0, np.int64)])
        order = np.argsort(values, kind="stable")
        out[i] = (sum(r["below"] for r in own), sum(r["missing"] for r in own), values[order], counts[order], all(r["exact"] for r in own))
    return out


def medians_and_edges(df: DataFrame, columns: list[str]) -> tuple[dict[str, float], list[np.ndarray], int]:
    """Exact medians (missing values and NaN left out; 0 without any), the bins' upper edges, and how many rows.

    A first pass summarises each column; where a summary isn't exact, narrower brackets around the median are read
    until they are.
    """
    first = summaries(df, columns, {i: (-np.inf, np.inf) for i in range(len(columns))})
    middles, open_ = {}, {}
    for i, found in first.items():
        n = int(found[3].sum())
        if not n:
            middles[i] = 0.0
        elif found[4]:
            upto = np.cumsum(found[3])
            middles[i] = float((found[2][np.searchsorted(upto, (n + 1) // 2)] + found[2][np.searchsorted(upto, n // 2 + 1)]) / 2)
        else:
            open_[i] = (n, (-np.inf, np.inf), found)
    while open_:
        asked = {}
        for i, (n, (lo, hi), (below, _, values, counts, _)) in open_.items():
            upto, slack = below + np.cumsum(counts), max(2, int(counts.sum()) // 256)
            a, b = np.searchsorted(upto, (n + 1) // 2 - slack), np.searchsorted(upto, n // 2 + 1 + slack)
            asked[i] = (float(values[a - 1]) if a > 0 else lo, float(values[b]) if b < len(values) else hi)
        for i, found in summaries(df, columns, asked).items():
            n, before, last = open_[i]
            below, _, values, counts, exact = found
            upto = below + np.cumsum(counts)
            low, high = (n + 1) // 2, n // 2 + 1
            if not len(values) or below >= low or upto[-1] < high:
                # The bracket missed the median: all that the last one held on that side is read.
                wide = (before[0], asked[i][1]) if below >= low else (asked[i][0], before[1])
                found = summaries(df, columns, {i: wide})[i]
                below, _, values, counts, exact = found
                upto = below + np.cumsum(counts)
                asked[i] = wide
            if exact:
                middles[i] = float((values[np.searchsorted(upto, low)] + values[np.searchsorted(upto, high)]) / 2)
                del open_[i]
            else:
                open_[i] = (n, asked[i], found)
    edges = []
    for i in range(len(columns)):
        _, missing, values, counts, _ = first[i]
        values, counts = np.r_[values, [middles[i]]], np.r_[counts, [missing]]
        order = np.argsort(values[counts > 0], kind="stable")
        values, counts = values[counts > 0][order], counts[counts > 0][order]
        distinct = np.unique(values)
        if len(distinct) <= BINS:
            edges.append((distinct[1:] + distinct[:-1]) / 2)
        else:
            upto = np.cumsum(counts)
            cut = np.unique(values[np.searchsorted(upto, np.arange(1, BINS) * upto[-1] / BINS)])
            edges.append(cut[cut < distinct[-1]])
    return {c: middles[i] for i, c in enumerate(columns)}, edges, int(first[0][3].sum() + first[0][1]) if columns else 0


# Trees -----------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in heap order; feature -1 is a leaf. A row goes left if its bin is at most the node's."""

    depth: int
    weight: float
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    total: list[float] = field(default_factory=list)

    def masks(self, bins: list[int], levels: int | None = None) -> dict[int, np.ndarray]:
        """By feature and bin the places of the last level that its nodes leave: those of all features have the row's
        place as their lowest bit."""
        levels, out = self.depth if levels is None else levels, {}
        for node, f in enumerate(self.feature[: 2**levels - 1]):
            if f >= 0:
                level = (node + 1).bit_length() - 1
                width = 1 << (levels - level)
                start = (node + 1 - (1 << level)) * width
                left = ((1 << (width // 2)) - 1) << start
                table = out.setdefault(f, np.full(bins[f], 0xFFFFFFFFFFFFFFFF, np.uint64))
                table[self.bin[node] + 1 :] &= np.uint64(0xFFFFFFFFFFFFFFFF ^ left)
        return out

    def leaves(self) -> np.ndarray:
        """The value of each place of the last level."""
        out = np.zeros(1 << self.depth)
        for place in range(1 << self.depth):
            node = 0
            for level in reversed(range(self.depth)):
                if self.feature[node] < 0:
                    break
                node = 2 * node + 1 + (place >> level & 1)
            out[place] = self.value[node]
        return out


def places(masks: np.ndarray) -> np.ndarray:
    """The lowest bit that is set."""
    return _AT[((masks & (~masks + np.uint64(1))) * _K) >> np.uint64(58)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


@dataclass
class Forest:
    """Trees of each fold with the two numbers that calibrate their sum, and how features are binned."""

    features: list[str]
    values: dict[str, float]
    edges: list[np.ndarray]
    folds: list[list[Tree]] = field(default_factory=list)
    calibration: list[tuple[float, float]] = field(default_factory=list)

    @property
    def bins(self) -> list[int]:
        return [len(e) + 1 for e in self.edges]

    def codes(self, i: int, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.values[self.features[i]], x)
        return np.searchsorted(self.edges[i], x, "left").astype(np.uint8)

    def used(self) -> list[int]:
        return sorted({f for trees in self.folds for t in trees for f in t.feature if f >= 0})

    def score(self, codes: dict[int, np.ndarray], n: int) -> np.ndarray:
        total = np.zeros(n)
        for trees, (a, b) in zip(self.folds, self.calibration, strict=True):
            margin = np.zeros(n)
            for tree in trees:
                left = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
                for f, table in tree.masks(self.bins).items():
                    left &= table[codes[f]]
                margin += tree.weight * tree.leaves()[places(left)]
            total += sigmoid(a * margin + b)
        return total / len(self.folds)

    def importances(self) -> np.ndarray:
        """Gain of the splits by each feature, as shares, mean of the folds."""
        out = np.zeros(len(self.features))
        for trees in self.folds:
            one = np.zeros(len(self.features))
            for t in trees:
                for f, g in zip(t.feature, t.gain, strict=True):
                    if f >= 0:
                        one[f] += g
            out += one / max(one.sum(), 1e-300) / len(self.folds)
        return out

    def state(self) -> dict:
        return {"edges": [e.tolist() for e in self.edges], "folds": [[vars(t) for t in trees] for trees in self.folds], "calibration": [list(c) for c in self.calibration]}

    @classmethod
    def of(cls, features: list[str], values: dict[str, float], state: dict) -> Forest:
        folds = [[Tree(**t) for t in trees] for trees in state["folds"]]
        return cls(features, values, [np.array(e, np.float64) for e in state["edges"]], folds, [tuple(c) for c in state["calibration"]])


# Fitting ---------------------------------------------------------------------------------------------------------


def shared(bins: list[int]) -> list[list[tuple[int, int]]]:
    """Features that share a number of at most CELLS values, each with its step; those of one bin are left out."""
    groups: list[list[tuple[int, int]]] = []
    sizes: list[int] = []
    for f in sorted((f for f, n in enumerate(bins) if n > 1), key=lambda f: (-bins[f], f)):
        g = next((g for g, size in enumerate(sizes) if size * bins[f] <= CELLS), None)
        if g is None:
            g = len(groups)
            groups.append([])
            sizes.append(1)
        groups[g].append((f, sizes[g]))
        sizes[g] *= bins[f]
    return groups


def packed(df: DataFrame, forest: Forest, label: str, fold: str, parts: int):
    """An RDD of blocks: (numbers by group and row, labels, where each fold's rows begin, margins by fold and row)."""
    bins, groups, n_folds = forest.bins, shared(forest.bins), len(forest.folds)

    def read(batches):
        waiting, n = [], 0

        def block():
            codes, y, fold = (np.concatenate(x, axis=-1) for x in zip(*waiting, strict=True))
            order = np.argsort(fold, kind="stable")
            starts = np.searchsorted(fold[order], np.arange(n_folds + 1))
            return pa.RecordBatch.from_pydict({"codes": pa.array([codes[:, order].tobytes()], pa.binary()), "y": pa.array([y[order].tobytes()], pa.binary()), "starts": pa.array([starts.tolist()], pa.list_(pa.int64()))})

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros((len(groups), batch.num_rows), np.uint16)
            for g, members in enumerate(groups):
                for f, step in members:
                    codes[g] += forest.codes(f, doubles(batch.column(f))).astype(np.uint16) * np.uint16(step)
            waiting.append((codes, doubles(batch.column(len(bins))).astype(np.int8), doubles(batch.column(len(bins) + 1)).astype(np.int8)))
            n += batch.num_rows
            if n >= BLOCK:
                yield block()
                waiting, n = [], 0
        if n:
            yield block()

    rows = df.select(*[F.col(f"`{c}`").cast("double") for c in forest.features], F.col(label).cast("double"), F.col(fold).cast("double"))

    def begin(r):
        y = np.frombuffer(r["y"], np.int8)
        return np.frombuffer(r["codes"], np.uint16).reshape(len(groups), len(y)), y, list(r["starts"]), np.zeros((n_folds, len(y)), np.float32)

    return rows.coalesce(parts).mapInArrow(read, "codes binary, y binary, starts array<long>").rdd.map(begin)


def joined(tables: dict[int, np.ndarray], groups, bins: list[int]) -> dict[int, np.ndarray]:
    """Tables by feature and bin as tables by group and number."""
    out = {}
    for g, members in enumerate(groups):
        cells = np.arange(int(np.prod([bins[f] for f, _ in members])))
        for f, step in members:
            if f in tables:
                one = tables[f][cells // step % bins[f]]
                out[g] = out[g] & one if g in out else one
    return out


def reached(codes: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
    left = np.full(codes.shape[1], 0xFFFFFFFFFFFFFFFF, np.uint64)
    for g, table in tables.items():
        left &= table[codes[g]]
    return places(left)


def sums(blocks, groups, bins, plans, weights, unit):
    """(gradients, weights) by fold, counted node, feature and bin. A plan: the tables of the tree so far, the slot of each
    place (-1: not counted) and the number of slots; None: the fold has no more to grow."""
    widths = [int(np.prod([bins[f] for f, _ in members])) for members in groups]
    found = [None if p is None else [(np.zeros(p[2] * w), np.zeros(p[2] * w)) for w in widths] for p in plans]
    for codes, y, starts, margins in blocks:
        sign = np.where(y > 0, np.float32(1), np.float32(-1))
        of = weights[(y > 0).astype(np.int8)]
        for m, plan in enumerate(plans):
            if plan is None:
                continue
            tables, slots, n_slots = plan
            for a, b in ((0, starts[m]), (starts[m + 1], len(y))):
                if a == b:
                    continue
                own, w, s = codes[:, a:b], of[a:b], sign[a:b]
                g = np.rint(w * (2 * s / (1 + np.exp(2 * s * margins[m, a:b]))).astype(np.float64) / unit)
                base = None
                if tables:
                    slot = slots[reached(own, tables)]
                    at = np.flatnonzero(slot >= 0)
                    own, w, g, base = own[:, at], w[at], g[at], slot[at]
                for c, width in enumerate(widths):
                    where = own[c].astype(np.int64) if base is None else base * width + own[c]
                    found[m][c][0][:] += np.bincount(where, g, n_slots * width)
                    found[m][c][1][:] += np.bincount(where, w, n_slots * width)
    out = []
    for m, plan in enumerate(plans):
        if plan is None:
            out.append(None)
            continue
        flat = np.zeros((2, plan[2], sum(bins)))
        begin = np.r_[0, np.cumsum(bins)]
        for c, members in enumerate(groups):
            for f, step in members:
                for k in range(2):
                    cube = found[m][c][k].reshape(plan[2], widths[c] // (step * bins[f]), bins[f], step)
                    flat[k, :, begin[f] : begin[f + 1]] = cube.sum(axis=(1, 3))
        out.append(flat)
    yield out


def added(blocks, trees: list[Tree], groups, bins):
    """Blocks with one more tree of each fold in their margins."""
    ready = [(joined(t.masks(bins), groups, bins), (t.weight * t.leaves()).astype(np.float32)) for t in trees]
    for codes, y, starts, margins in blocks:
        new = np.stack([margins[m] + values[reached(codes, tables)] for m, (tables, values) in enumerate(ready)])
        yield codes, y, starts, new


def best_split(flat: np.ndarray, bins: list[int]) -> tuple[float, int, int]:
    """(gain, feature, bin) of one node by its sums of gradients and weights; gain 0: none."""
    best, begin = (0.0, -1, -1), 0
    for f, n in enumerate(bins):
        g, w = flat[0, begin : begin + n].cumsum(), flat[1, begin : begin + n].cumsum()
        begin += n
        if n < 2 or w[-1] <= 0:
            continue
        gl, wl, gr, wr = g[:-1], w[:-1], g[-1] - g[:-1], w[-1] - w[:-1]
        ok = (wl > 0) & (wr > 0)
        gain = np.where(ok, gl * gl / np.where(ok, wl, 1) + gr * gr / np.where(ok, wr, 1) - g[-1] ** 2 / w[-1], 0)
        at = int(gain.argmax())
        if gain[at] > best[0] + 1e-12 * w[-1]:
            best = (float(gain[at]), f, at)
    return best


def fit(df: DataFrame, forest: Forest, n: int, n_folds: int, n_trees: int, depth: int, rate: float, weights: tuple[float, float], label: str, fold: str) -> Forest:
    """Grows the forest's trees: fold m's of the rows of all other folds, its calibration of its own rows."""
    if not 1 <= depth <= 6:
        raise ValueError("trees have 1 to 6 levels")
    spark = df.sparkSession.sparkContext
    bins, groups = forest.bins, shared(forest.bins)
    cores = spark.defaultParallelism
    parts = -(-max(1, -(-n // PART)) // cores) * cores
    forest.folds, forest.calibration = [[] for _ in range(n_folds)], []
    # Sums of whole numbers below 2^52 are exact in doubles.
    step = 2.0 ** np.ceil(np.log2(max(weights)) + np.log2(max(n, 2)) - 50)
    w = np.rint(np.array(weights) / step) * step
    begin = np.r_[0, np.cumsum(bins)]
    state = packed(df, forest, label, fold, parts).persist(StorageLevel.MEMORY_AND_DISK)
    widest, last = int(np.argmax(bins)), None
    try:
        for t in range(n_trees):
            trees = [Tree(depth, 1.0 if t == 0 else rate, *([x] * (2 ** (depth + 1) - 1) for x in (-1, -1, 0.0, 0.0, 0.0))) for _ in range(n_folds)]
            nodes: list[dict[int, np.ndarray]] = [{} for _ in range(n_folds)]  # sums of the nodes of the last level
            for level in range(depth):
                plans, counted = [], []
                for m, tree in enumerate(trees):
                    if level == 0:
                        plans.append(({}, None, 1))
                        counted.append([0])
                        continue
                    # Of two children the lighter is counted; the other is what that leaves of the parent.
                    mine = []
                    for node, flat in nodes[m].items():
                        if tree.feature[node] >= 0:
                            a = begin[tree.feature[node]]
                            cut = flat[1, a : a + bins[tree.feature[node]]].cumsum()
                            mine.append(2 * node + 1 + int(cut[tree.bin[node]] * 2 > cut[-1]))
                    counted.append(mine)
                    slots = np.full(1 << level, -1, np.int64)
                    for k, node in enumerate(mine):
                        slots[node + 1 - (1 << level)] = k
                    plans.append((joined(tree.masks(bins, level), groups, bins), slots, len(mine)) if mine else None)
                if not any(counted):
                    break
                one = state.mapPartitions(lambda rows, plans=plans: sums(rows, groups, bins, plans, w, step)).collect()
                if last is not None:
                    last.unpersist()  # what followed it is there now
                    last = None
                for m, tree in enumerate(trees):
                    if plans[m] is None:
                        nodes[m] = {}
                        continue
                    total, now = sum(p[m] for p in one), {}
                    total[0] *= step
                    for k, node in enumerate(counted[m]):
                        now[node] = total[:, k]
                        if level:
                            parent = (node - 1) // 2
                            now[4 * parent + 3 - node] = nodes[m][parent] - total[:, k]
                    nodes[m] = now
                    for node, flat in now.items():
                        g, ws = flat[:, begin[widest] : begin[widest + 1]].sum(axis=1)
                        if level == 0:
                            tree.value[0], tree.total[0] = (g / ws if ws > 0 else 0.0), ws
                        gain, f, at = best_split(flat, bins)
                        if f < 0:
                            continue
                        tree.feature[node], tree.bin[node], tree.gain[node] = f, at, gain
                        gs, wsum = flat[:, begin[f] : begin[f + 1]].cumsum(axis=1)
                        for child, cg, cw in ((2 * node + 1, gs[at], wsum[at]), (2 * node + 2, gs[-1] - gs[at], wsum[-1] - wsum[at])):
                            tree.value[child], tree.total[child] = float(cg / cw), float(cw)
            for m, tree in enumerate(trees):
                tree.value, tree.total = [float(x) for x in tree.value], [float(x) for x in tree.total]
                forest.folds[m].append(tree)
            last, state = state, state.mapPartitions(lambda rows, trees=trees: added(rows, trees, groups, bins)).persist(StorageLevel.MEMORY_AND_DISK)
        forest.calibration = calibrated(state, n_folds)
    finally:
        for rdd in (last, state):
            if rdd is not None:
                rdd.unpersist()
    return forest


def calibrated(state, n_folds: int) -> list[tuple[float, float]]:
    """Slope and offset of the likeliest sigmoid of each fold's own margins, by Newton's steps."""

    def measured(at):
        def read(blocks):
            out = np.zeros((n_folds, 6))
            for _, y, starts, margins in blocks:
                for m, (a, b) in enumerate(at):
                    x, one = margins[m, starts[m] : starts[m + 1]].astype(np.float64), (y[starts[m] : starts[m + 1]] > 0).astype(np.float64)
                    z = a * x + b
                    p = sigmoid(z)
                    d, h = p - one, p * (1 - p)
                    out[m] += (np.logaddexp(0, z) - one * z).sum(), (d * x).sum(), d.sum(), (h * x * x).sum(), (h * x).sum(), h.sum()
            yield out

        return sum(state.mapPartitions(read).collect())

    now, found, step = np.zeros((n_folds, 2)), None, np.zeros((n_folds, 2))
    tried, moving = now.copy(), np.ones(n_folds, bool)
    for _ in range(60):
        seen = measured([tuple(x) for x in tried])
        if found is None:
            found = seen
        for m in np.flatnonzero(moving):
            worse = seen[m, 0] > found[m, 0] * (1 + 1e-12)
            if worse:
                step[m] /= 2
            else:
                moving[m] = not step[m].any() or found[m, 0] - seen[m, 0] > 1e-7 * max(found[m, 0], 1e-300)
                now[m], found[m] = tried[m], seen[m]
                _, ga, gb, aa, ab, bb = found[m]
                ridge = 1e-9 * (aa + bb) + 1e-12
                step[m] = -np.linalg.solve([[aa + ridge, ab], [ab, bb + ridge]], [ga, gb])
            tried[m] = now[m] + (step[m] if moving[m] else 0)
        if not moving.any():
            break
    return [(float(a), float(b)) for a, b in now]
