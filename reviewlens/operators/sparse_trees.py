"""Decision trees, random forests and boosted trees over sparse rows.

``pyspark.ml`` bins every row into one number per feature of the vocabulary, so
its rows and its statistics grow with rows times words.  Here only the cells
that a row holds are kept, and a level of all growing trees is one pass: tasks
walk their rows to the open nodes and add up the cells, Spark sums them per
(node, feature, bin) and takes the best split of each node.  What a feature has
at zero is the node's total less its cells.  A forest over at most ``HERE`` cells
(counted first) is grown a tree a task instead, over the packed cells of all rows,
with the same draws and sums, so it has the same trees.

Splits are those of ``pyspark.ml``: up to 32 bins by its rule, gini gain (variance
for boosted trees), ties to the first feature and threshold, leaves of one class
merged.  A forest draws its Poisson counts from a hash of (row, tree), and
a node's features (the square root of all, in expectation) from one of (tree, node,
feature).  Values must not be negative.  A fitted tree is held by the driver and
shipped to the tasks, as in ``pyspark.ml``.
"""

from __future__ import annotations

import math
import threading

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SPLIT_SEED
from ..session import materialize, row_name

BINS = 32
#: values of a feature read for its thresholds, as many as ``pyspark.ml`` reads rows
SAMPLED = 10_000
#: cells added up at a time in a task, and cells of a written partition
CELLS = 1 << 20
#: cells of a forest whose tasks hold all of them (five bytes each) and grow whole trees
HERE, STEP = 1 << 24, 1 << 15
LEARNING_RATE = 0.1


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(*parts) -> np.ndarray:
    """A number in [0, 1) from a hash of whole numbers."""
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = _mix(h + np.asarray(p).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)) * 2.0 ** -53


def _drawn(of_node: np.ndarray, idx: np.ndarray, fraction: float) -> np.ndarray:
    """Which cells' features are drawn for their node: ``_unit(node, idx) < fraction``, the node's round done before."""
    h = _mix(of_node + idx.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)) < np.uint64(math.ceil(fraction * 2.0 ** 53))


def _node_round(seed: int, t: int, node: np.ndarray) -> np.ndarray:
    return _mix((_unit(seed, t, node) * 2.0 ** 53).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


#: distribution of Poisson(1); beyond it a count is 12
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def sparse_cells(vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, indices, values) of vector structs in an Arrow array."""
    kind, _, idx, val = vectors.flatten()
    n = pc.fill_null(pc.list_value_length(val), 0).to_numpy(zero_copy_only=False)
    offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    if pc.any(pc.equal(kind, 1)).as_py():
        at = np.concatenate([np.arange(m) if k else np.asarray(i) for k, m, i in zip(
            kind.to_pylist(), n, idx.to_pylist())])
    else:
        at = idx.flatten().to_numpy(zero_copy_only=False)
    return offs, at.astype(np.int64), val.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


class Grown:
    """A tree while it grows: nodes are numbered level by level, so children follow parents."""

    def __init__(self):
        self.feature, self.bin, self.threshold, self.left, self.right = [], [], [], [], []
        self.stats, self.depth, self.gain, self.open = [], [], [], []

    def add(self, stats, depth: int) -> int:
        for col, v in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, -1), (self.right, -1),
                       (self.stats, np.asarray(stats, np.float64)), (self.depth, depth), (self.gain, 0.0)):
            col.append(v)
        return len(self.left) - 1

    def arrays(self, cut: str) -> tuple:
        """(feature, cut, left, right) to walk by ``cut``: the bins or the thresholds."""
        return (np.array(self.feature, np.int64), np.array(getattr(self, cut), np.float64),
                np.array(self.left, np.int64), np.array(self.right, np.int64))

    def prune(self, prediction) -> None:
        """Two leaves of one prediction become their parent."""
        said = [prediction(s) for s in self.stats]
        for i in range(len(self.left) - 1, -1, -1):
            a, b = self.left[i], self.right[i]
            if a >= 0 and self.left[a] < 0 and self.left[b] < 0 and said[a] == said[b]:
                self.left[i] = self.right[i] = self.feature[i] = -1


def _walk(tree, keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The node that each of ``n`` rows ends in; ``keys`` are row * 2**32 + feature, ascending."""
    feature, cut, left, right = tree
    at = np.zeros(n, np.int64)
    moving = np.arange(n) if left[0] >= 0 else np.zeros(0, np.int64)
    while len(moving):
        node = at[moving]
        x = np.zeros(len(moving))
        if len(keys):
            asked = (moving << 32) | feature[node]
            pos = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            x = np.where(keys[pos] == asked, values[pos], 0.0)
        at[moving] = np.where(x <= cut[node], left[node], right[node])
        moving = moving[left[at[moving]] >= 0]
    return at


def _slices(offs: np.ndarray):
    """Row ranges of about ``CELLS`` cells."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + CELLS, "right")) - 1)
        yield a, min(b, n)
        a = b


def _thresholds(rows_total: int, splits: int):
    """Per feature the thresholds between its values, zeros counted."""
    def run(batches):
        for batch in batches:
            out = []
            for values, counts, df in zip(*(batch.column(c).to_pylist() for c in ("w", "c", "df"))):
                share = sum(counts) / df
                zero, total = (rows_total - df) * share, rows_total * share
                pairs = sorted(zip(values, counts))
                if zero > 0:
                    pairs = sorted([(0.0, zero), *pairs])
                found = []
                if len(pairs) - 1 <= splits:
                    found = [(a + b) / 2 for (a, _), (b, _) in zip(pairs, pairs[1:])]
                else:
                    stride = total / (splits + 1)
                    seen, target = pairs[0][1], stride
                    for (a, _), (b, n) in zip(pairs, pairs[1:]):
                        before, seen = seen, seen + n
                        if abs(before - target) < abs(seen - target):
                            found.append((a + b) / 2)
                            target += stride
                out.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("idx"), batch.column("df"), pa.array(out, pa.list_(pa.float64()))],
                ["idx", "df", "cuts"])
    return run


def _exploded(batches):
    for batch in batches:
        offs, idx, val = sparse_cells(batch.column("v"))
        held = val != 0
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        lists = np.concatenate([[0], np.cumsum(np.bincount(row[held], minlength=len(offs) - 1))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("label"),
             pa.ListArray.from_arrays(lists, pa.array(idx[held].astype(np.int32))),
             pa.ListArray.from_arrays(lists, pa.array(val[held]))], ["row", "label", "i", "w"])


class Points:
    """Training rows as (row, label, idx, bin) with the cells beyond a feature's first bin, written."""

    def __init__(self, data: DataFrame, features_col: str = "features", label_col: str = "label"):
        plain = data.select(F.monotonically_increasing_id().alias("row"),
                            F.col(label_col).cast("double").alias("label"), F.col(features_col).alias("v"))
        seen = plain.select("label").agg(
            F.count(F.lit(1)).alias("n"), F.max("label").alias("top"), F.count(F.when(
                F.col("label").isNull() | (F.col("label") < 0) | (F.floor("label") != F.col("label"))
                | F.isnan("label"), 1)).alias("bad")).first()
        if not seen.n or seen.bad:
            raise ValueError("training needs rows, and labels that are whole numbers from 0")
        self.rows, self.classes = seen.n, max(2, int(seen.top) + 1)
        lists = plain.mapInArrow(_exploded, "row long, label double, i array<int>, w array<double>")
        cells = lists.select("row", "label", F.explode_outer(F.arrays_zip("i", "w")).alias("x")).select(
            "row", "label", F.col("x.i").alias("idx"), F.col("x.w").alias("w"))
        held = cells.filter("idx is not null")
        df = held.groupBy("idx").agg(F.count(F.lit(1)).alias("df"))
        drawn = held.join(df, "idx").filter(F.pmod(F.xxhash64("row"), F.col("df")) < SAMPLED)
        values = drawn.groupBy("idx", "df", "w").agg(F.count(F.lit(1)).alias("c")).groupBy("idx", "df").agg(
            F.collect_list("w").alias("w"), F.collect_list("c").alias("c"))     # at most about SAMPLED a feature
        self.cuts = materialize(values.mapInArrow(_thresholds(self.rows, min(BINS, self.rows) - 1),
                                                  "idx int, df long, cuts array<double>"), "tree_cuts")
        self.sent, self.lock = None, threading.Lock()
        total = self.cells = self.cuts.agg(F.sum("df")).first()[0] or 0
        spark = data.sparkSession
        width = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 16 // CELLS),
                    total // CELLS)
        binned = cells.join(self.cuts.select("idx", "cuts"), "idx", "left").select("row", "label", "idx", F.size(
            F.filter("cuts", lambda c: c < F.col("w"))).cast("int").alias("bin"))
        self.table = materialize(binned.repartition(width, "row").groupBy("row").agg(
            F.first("label").alias("label"), F.sort_array(F.collect_list(F.when(
                F.col("bin") > 0, F.struct("idx", "bin")))).alias("x")).select(
            "row", "label", F.col("x.idx").alias("idx"), F.col("x.bin").alias("bin")), "tree_points")


    def shared(self):
        """:meth:`packed`, broadcast once."""
        with self.lock:
            if self.sent is None:
                self.sent = self.table.sparkSession.sparkContext.broadcast(self.packed())
            return self.sent

    def packed(self) -> tuple[np.ndarray, ...]:
        """(row, label, cells of a row, idx, bin) of all rows, for at most ``HERE`` cells."""
        def run(batches):
            for batch in batches:
                for row, label, offs, idx, b in _batch(batch):
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (
                        row, label, np.diff(offs).astype(np.int32), idx.astype(np.int32), b.astype(np.uint8))],
                        ["row", "label", "n", "idx", "bin"])
        got = self.table.mapInArrow(run, "row binary, label binary, n binary, idx binary, bin binary").collect()
        return tuple(np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[c], kind) for r in got)]) for c, kind in (
            ("row", np.int64), ("label", np.float64), ("n", np.int32), ("idx", np.int32), ("bin", np.uint8)))


def _grow_here(held, size: int, classes: int, depth: int, leaf: int, t: int, weights, fraction: float, seed: int):
    """Tree ``t`` of a forest as arrays (feature, bin, left, right, depth, gain, stats), the one that
    :func:`grow` makes, pruned."""
    row, label, n, idx, b = held
    count = weights(row, t)
    some = np.flatnonzero(count > 0)
    place = np.full(len(row), -1, np.int32)
    place[some] = np.arange(len(some))
    of = np.repeat(place, n)
    mine = of >= 0
    of, idx, b = of[mine], idx[mine], b[mine]
    cells = n[some].astype(np.int64)
    count, kind = count[some], label[some].astype(np.int64)
    stats = [np.bincount(kind, count, classes).astype(np.float64)]
    feature, cut, left, right, level_of, gain = [-1], [0], [-1], [-1], [0], [0.0]
    slot = np.zeros(len(some), np.int32)                    # of each row's open node, or -1
    front = np.array([0]) if stats[0].any() and stats[0].max() < stats[0].sum() else np.zeros(0, np.int64)
    for level in range(depth):
        if not len(front):
            break
        if cells[slot >= 0].sum() < 0.9 * len(of):
            on = slot[of] >= 0
            of, idx, b = of[on], idx[on], b[on]
            cells[slot < 0] = 0
        rounds, pick = _node_round(seed, t, front), []
        for a in range(0, len(of), STEP):                    # short pieces stay in the processor's cache
            at = slot[of[a:a + STEP]]
            drawn = at >= 0
            if fraction < 1:
                drawn &= _drawn(rounds[at], idx[a:a + STEP], fraction)
            pick.append(a + np.flatnonzero(drawn))
        pick = np.concatenate([np.zeros(0, np.int64), *pick])
        at = slot[of[pick]]
        cell, inv = np.unique((at.astype(np.int64) * size + idx[pick]) * BINS + b[pick], return_inverse=True)
        which = kind[of[pick]]
        sums = np.stack([np.bincount(inv[which == c], count[of[pick[which == c]]], len(cell)) for c in range(classes)], 1)
        group = cell // BINS
        last = np.append(group[1:] != group[:-1], True)[:len(cell)]
        after = np.cumsum(sums[::-1], axis=0)[::-1]              # whole counts, so differences are exact
        end = np.flatnonzero(last)[np.searchsorted(np.flatnonzero(last), np.arange(len(cell)))]
        side = after - (after[end] - sums[end])
        first = np.append(True, group[1:] != group[:-1])[:len(cell)]
        bins = cell % BINS
        below = np.where(first, 0, np.append(0, bins[:-1])[:len(cell)])
        node = (group // size).astype(np.int64)
        all_ = np.stack([stats[i] for i in front])[node]
        other = all_ - side
        n_l, n_r, n_all = (sum((x[:, c] for c in range(1, classes)), x[:, 0]) for x in (other, side, all_))
        good = np.flatnonzero((n_l >= leaf) & (n_r >= leaf) & (n_l > 0) & (n_r > 0))
        node, side, other, all_, below, group = (x[good] for x in (node, side, other, all_, below, group))
        n_l, n_r, n_all = n_l[good], n_r[good], n_all[good]

        def gini(x, n):
            out = 1.0
            for c in range(classes):
                out = out - (x[:, c] / n) * (x[:, c] / n)
            return out
        won = gini(all_, n_all) - n_l / n_all * gini(other, n_l) - n_r / n_all * gini(side, n_r)
        up = np.flatnonzero(won > 0)
        order = up[np.lexsort((below[up], group[up] % size, -won[up], node[up]))]
        best = order[np.append(True, node[order][1:] != node[order][:-1])[:len(order)]]
        to = np.full((len(front), 2), -1, np.int64)              # slots of the children
        asked, limit = np.full(len(front), -1, np.int64), np.zeros(len(front), np.int64)
        opened = []
        for i in best.tolist():
            k = int(node[i])
            me = front[k]
            feature[me], cut[me], gain[me] = int(group[i] % size), int(below[i]), float(won[i])
            asked[k], limit[k] = feature[me], cut[me]
            for which, child, s in ((left, 0, stats[me] - side[i]), (right, 1, side[i])):
                which[me] = len(left)
                for col, v in ((feature, -1), (cut, 0), (left, -1), (right, -1), (level_of, level + 1), (gain, 0.0),
                               (stats, s)):
                    col.append(v)
                if not s.max() >= s.sum():
                    to[k, child] = len(opened)
                    opened.append(which[me])
        x = np.zeros(len(slot), np.int64)
        for a in range(0, len(of), STEP):
            at = slot[of[a:a + STEP]]
            hit = a + np.flatnonzero((idx[a:a + STEP] == asked[at]) & (at >= 0))
            x[of[hit]] = b[hit]
        slot = np.where((slot >= 0) & (asked[slot] >= 0), to[slot, (x > limit[slot]).astype(int)], -1).astype(np.int32)
        front = np.array(opened, np.int64)
    feature, cut, left, right, level_of = (np.array(v, np.int64) for v in (feature, cut, left, right, level_of))
    stats = np.stack(stats)
    said = stats.argmax(axis=1)
    for d in range(int(level_of.max()), -1, -1):            # two leaves of one prediction become their parent
        i = np.flatnonzero((level_of == d) & (left >= 0))
        a, z = left[i], right[i]
        i = i[(left[a] < 0) & (left[z] < 0) & (said[a] == said[z])]
        left[i] = right[i] = feature[i] = -1
    return feature, cut, left, right, level_of, np.array(gain), stats


def grow_here(points: Points, size: int, depth: int, leaf: int, trees: int, weights, fraction: float,
              seed: int) -> list[Grown]:
    """The pruned trees of a forest, a tree a task; their tasks hold the cells of all rows."""
    spark, classes = points.table.sparkSession, points.classes
    held = points.shared()

    def run(batches):
        for batch in batches:
            for t in batch.column("id").to_pylist():
                *plain, stats = _grow_here(held.value, size, classes, depth, leaf, t, weights, fraction, seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), *(pa.array([v.tolist()], pa.list_(pa.float64() if v.dtype == float
                                                                                 else pa.int32())) for v in plain),
                     pa.array([stats.reshape(-1).tolist()], pa.list_(pa.float64()))],
                    ["tree", "feature", "bin", "left", "right", "depth", "gain", "stats"])
    tasks = min(trees, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = materialize(spark.range(0, trees, 1, tasks).mapInArrow(
        run, "tree int, feature array<int>, bin array<int>, left array<int>, right array<int>, depth array<int>, "
             "gain array<double>, stats array<double>"), "trees")
    asked = found.select(F.explode(F.arrays_zip("feature", "bin")).alias("s")).select("s.*").filter(
        "feature >= 0").distinct()
    cuts = asked.join(points.cuts, F.col("feature") == F.col("idx")).select(
        "feature", "bin", F.get("cuts", "bin").alias("threshold")).toPandas()
    key = cuts["feature"].to_numpy(np.int64) * BINS + cuts["bin"].to_numpy(np.int64)
    order = np.argsort(key)
    key, value = key[order], cuts["threshold"].to_numpy(np.float64)[order]
    out = []
    for r in sorted(found.collect(), key=lambda r: r.tree):
        g = Grown()
        g.feature, g.bin, g.left, g.right, g.depth = (np.array(v, np.int64) for v in (
            r.feature, r.bin, r.left, r.right, r.depth))
        g.gain, g.stats = np.array(r.gain, np.float64), np.array(r.stats, np.float64).reshape(-1, classes)
        g.threshold = np.zeros(len(g.left))
        some = g.feature >= 0
        g.threshold[some] = value[np.searchsorted(key, g.feature[some] * BINS + g.bin[some])]
        out.append(g)
    return out


def _batch(batch):
    """(row, label, offsets, idx, bin) slices of written points."""
    idx, b = batch.column("idx"), batch.column("bin")
    n = pc.list_value_length(idx).to_numpy(zero_copy_only=False)
    offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    idx, b = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (idx, b))
    row, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "label"))
    for s, e in _slices(offs):
        yield row[s:e], label[s:e], offs[s:e + 1] - offs[s], idx[offs[s]:offs[e]], b[offs[s]:offs[e]]


def _sums(trees, places, size: int, row_stats, names, weights, fraction: float, seed: int, totals: bool):
    """Per open node (slot), feature and bin the sums of the row statistics; or per slot alone."""
    def run(batches):
        for batch in batches:
            for row, label, offs, idx, b in _batch(batch):
                of = np.repeat(np.arange(len(row)), np.diff(offs))
                keys = (of << 32) | idx
                stats = row_stats(label, keys, b)
                parts = []
                for t, (tree, place) in enumerate(zip(trees, places)):
                    node = _walk(tree, keys, b, len(row))
                    slot, count = place[node], weights(row, t)
                    slot = np.where(count > 0, slot, -1)
                    if totals:
                        at, cell = np.flatnonzero(slot >= 0), slot[slot >= 0] * size * BINS
                    else:
                        pick = np.flatnonzero(slot[of] >= 0)
                        if fraction < 1:
                            pick = pick[_drawn(_node_round(seed, t, node)[of[pick]], idx[pick], fraction)]
                        at, cell = of[pick], (slot[of[pick]] * size + idx[pick]) * BINS + b[pick]
                    cell, inv = np.unique(cell, return_inverse=True)
                    parts.append((cell, [np.bincount(inv, (count * s)[at], len(cell)) for s in stats]))
                cell = np.concatenate([c for c, _ in parts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell // BINS // size), pa.array((cell // BINS % size).astype(np.int32)),
                     pa.array((cell % BINS).astype(np.int32)),
                     *(pa.array(np.concatenate([s[i] for _, s in parts]).astype(np.float64))
                       for i in range(len(names)))], ["slot", "idx", "bin", *names])
    return run


def _impurity(kind: str, s: list, n):
    if kind == "gini":
        out = F.lit(1.0)
        for c in s:
            out = out - (c / n) * (c / n)
        return out
    return (s[2] - s[1] * s[1] / n) / n


def grow(points: Points, size: int, kind: str, row_stats, k: int, depth: int, leaf: int, trees: int = 1,
         weights=None, fraction: float = 1.0, seed: int = SPLIT_SEED) -> list[Grown]:
    """``trees`` trees, all of them a level at a time."""
    weights = weights or (lambda row, t: np.ones(len(row)))
    spark, names = points.table.sparkSession, [f"s{i}" for i in range(k)]
    schema = "slot long, idx int, bin int, " + ", ".join(f"{n} double" for n in names)
    pure = (lambda s: s.max() >= s.sum()) if kind == "gini" else (
        lambda s: abs((s[2] - s[1] * s[1] / s[0]) / s[0]) < 2.3e-16)
    grown = [Grown() for _ in range(trees)]

    def summed(places, totals=False):
        return points.table.mapInArrow(
            _sums([g.arrays("bin") for g in grown], places, size, row_stats, names, weights, fraction, seed, totals),
            schema)
    for g in grown:
        g.add(np.zeros(k), 0)
    roots = summed([np.full(1, t) for t in range(trees)], True).groupBy("slot").agg(
        *(F.sum(n).alias(n) for n in names)).collect()
    for r in roots:
        grown[r.slot].stats[0] = np.array([r[n] for n in names])
    front = [(t, 0) for t, g in enumerate(grown) if g.stats[0].any() and not pure(g.stats[0])]
    for level in range(depth):
        if not front:
            break
        places = [np.full(len(g.left), -1, np.int64) for g in grown]
        for slot, (t, node) in enumerate(front):
            places[t][node] = slot
        known = spark.createDataFrame(pd.DataFrame(
            [[s, *grown[t].stats[node]] for s, (t, node) in enumerate(front)],
            columns=["at", *(f"t{i}" for i in range(k))]))
        sums = summed(places).repartition("slot", "idx").groupBy("slot", "idx", "bin").agg(
            *(F.sum(n).alias(n) for n in names))
        down = Window.partitionBy("slot", "idx").orderBy(F.desc("bin"))
        right = sums.select("slot", "idx", F.coalesce(F.lead("bin").over(down), F.lit(0)).alias("cut"), *(
            F.sum(n).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias(f"r{i}") for i, n in enumerate(names)))
        tried = right.join(F.broadcast(known), F.col("slot") == F.col("at"))
        r, all_ = [F.col(f"r{i}") for i in range(k)], [F.col(f"t{i}") for i in range(k)]
        l = [a - b for a, b in zip(all_, r)]  # noqa: E741
        n_l, n_r, n = ((sum(x[1:], x[0]) if kind == "gini" else x[0]) for x in (l, r, all_))
        gain = _impurity(kind, all_, n) - n_l / n * _impurity(kind, l, n_l) - n_r / n * _impurity(kind, r, n_r)
        if kind != "gini":                # sums of fractions differ in their last digits from run to run
            gain = F.round(gain, 10)
        best = tried.filter((n_l >= leaf) & (n_r >= leaf)).withColumn("gain", gain).filter("gain > 0").groupBy(
            "slot").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "idx", "cut", *r)).alias("b")).select("slot", "b.*")
        named = best.join(points.cuts, "idx").select(best["*"], F.get("cuts", "cut").alias("threshold")).toPandas()
        opened = []
        for s in named.sort_values("slot").itertuples(index=False):
            t, node = front[s.slot]
            g = grown[t]
            side = np.array([getattr(s, f"r{i}") for i in range(k)])
            g.feature[node], g.bin[node], g.threshold[node], g.gain[node] = s.idx, s.cut, s.threshold, -s.loss
            for which, stats in ((g.left, g.stats[node] - side), (g.right, side)):
                which[node] = child = g.add(stats, level + 1)
                if not pure(stats):
                    opened.append((t, child))
        front = opened
    return grown


class SparseTrees:
    """Fitted trees: ``kind`` is tree, rf or gbt."""

    def __init__(self, kind: str, trees: list[Grown], weights: list[float], size: int, classes: int):
        self.kind, self.trees, self.weights, self.size, self.classes = kind, trees, weights, size, classes
        self.getNumTrees = len(trees)

    def nodes(self) -> pd.DataFrame:
        """(tree, id, left, right, feature, threshold, stats), nodes after their parents."""
        return pd.concat([pd.DataFrame({"tree": t, "id": np.arange(len(g.left)), "left": g.left, "right": g.right,
                                        "feature": g.feature, "threshold": g.threshold, "stats": list(g.stats)})
                          for t, g in enumerate(self.trees)], ignore_index=True)

    @property
    def featureImportances(self):
        """Gain times rows by feature, each tree and the whole normalised to one."""
        total: dict[int, float] = {}
        for g in self.trees:
            # a pruned node's former descendants are not reached
            mine, reached = {}, [0]
            while reached:
                i = reached.pop()
                if g.left[i] >= 0:
                    n = g.stats[i][0] if self.kind == "gbt" else g.stats[i].sum()
                    mine[g.feature[i]] = mine.get(g.feature[i], 0.0) + g.gain[i] * n
                    reached += [g.left[i], g.right[i]]
            held = sum(mine.values()) if self.kind != "gbt" else 1.0
            for f, x in mine.items():
                total[f] = total.get(f, 0.0) + x / (held or 1.0)
        held = sum(total.values())
        return Vectors.sparse(self.size, {int(f): float(x / held) for f, x in total.items()} if held else {})

    def transform(self, df: DataFrame, features_col: str = "features") -> DataFrame:
        """``df`` with rawPrediction, probability and prediction, written."""
        walks, values = [g.arrays("threshold") for g in self.trees], [_leaf_values(self.kind, g) for g in self.trees]
        kind, weights, classes = self.kind, self.weights, self.classes

        @F.arrow_udf("array<double>")
        def raw(vectors: pa.Array) -> pa.Array:
            offs, idx, val = sparse_cells(vectors)
            out = np.zeros((len(vectors), classes if kind != "gbt" else 2))
            for s, e in _slices(offs):
                of = np.repeat(np.arange(e - s), np.diff(offs[s:e + 1]))
                keys, held = (of << 32) | idx[offs[s]:offs[e]], val[offs[s]:offs[e]]
                for tree, value, w in zip(walks, values, weights):
                    got = w * value[_walk(tree, keys, held, e - s)]
                    out[s:e] += got if kind != "gbt" else np.stack([-got, got], axis=1)
            return pa.array(list(out), pa.list_(pa.float64()))

        at = row_name(df, "raw")
        votes = F.col(at)
        if kind == "gbt":
            one = 1.0 / (1.0 + F.exp(-2.0 * votes[1]))
            probability, said = F.array(1.0 - one, one), F.when(votes[1] > 0, 1.0).otherwise(0.0)
        else:
            whole = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x)
            probability = F.transform(votes, lambda x: x / whole)
            said = (F.array_position(votes, F.array_max(votes)) - 1).cast("double")
        scored = materialize(df.withColumn(at, raw(F.col(features_col))), "scored")
        return scored.select(*df.columns, array_to_vector(votes).alias("rawPrediction"),
                             array_to_vector(probability).alias("probability"), said.alias("prediction"))


def _leaf_values(kind: str, g: Grown) -> np.ndarray:
    stats = np.stack(g.stats)
    if kind == "gbt":
        return stats[:, 1] / np.maximum(stats[:, 0], 1e-300)
    if kind == "tree":
        return stats
    total = stats.sum(axis=1, keepdims=True)
    return np.divide(stats, total, out=np.zeros_like(stats), where=total > 0)


class SparseTreeLearner:
    """``fit`` gives :class:`SparseTrees`; the parameters are named as in ``pyspark.ml``."""

    def __init__(self, kind: str, maxDepth: int = 5, numTrees: int = 1, maxIter: int = 20,
                 minInstancesPerNode: int = 1, featureSubsetStrategy: str = "all", bootstrap: bool | None = None,
                 seed: int = SPLIT_SEED):
        if featureSubsetStrategy not in ("all", "sqrt"):
            raise ValueError(featureSubsetStrategy)
        self.kind, self.depth, self.trees, self.rounds = kind, maxDepth, numTrees, maxIter
        self.leaf, self.subset, self.seed = minInstancesPerNode, featureSubsetStrategy, seed
        self.bootstrap = kind == "rf" if bootstrap is None else bootstrap

    def fit(self, data: DataFrame, points: Points | None = None) -> SparseTrees:
        """``points`` of the same rows, if they were made before."""
        first = data.select("features").first()
        if first is None:
            raise ValueError("training needs rows")
        size, points, seed = first.features.size, points or Points(data), self.seed
        if self.kind == "gbt":
            return self._boost(points, size)
        classes = points.classes

        def one_hot(label, keys, b):
            return [(label == c).astype(np.float64) for c in range(classes)]

        def poisson(row, t):
            return np.searchsorted(POISSON, _unit(seed, t, row), "right").astype(np.float64)
        share = math.ceil(math.sqrt(size)) / size if self.subset == "sqrt" and self.trees > 1 else 1.0
        if self.trees > 1 and points.cells <= HERE:
            once = poisson if self.bootstrap else (lambda row, t: np.ones(len(row)))
            grown = grow_here(points, size, self.depth, self.leaf, self.trees, once, share, seed)
            return SparseTrees(self.kind, grown, [1.0] * len(grown), size, classes)
        grown = grow(points, size, "gini", one_hot, classes, self.depth, self.leaf, self.trees,
                     poisson if self.bootstrap else None, share, seed)
        for g in grown:
            g.prune(lambda s: int(np.argmax(s)))
        return SparseTrees(self.kind, grown, [1.0] * len(grown), size, classes)

    def _boost(self, points: Points, size: int) -> SparseTrees:
        """Log loss on labels -1 and 1: each tree fits what the ones before leave."""
        if points.classes > 2:
            raise ValueError("boosted trees need labels 0 and 1")
        grown: list[Grown] = []
        for i in range(self.rounds):
            held = [(g.arrays("bin"), w * _leaf_values("gbt", g))
                    for g, w in zip(grown, [1.0] + [LEARNING_RATE] * i)]

            def left_over(label, keys, b, held=held):
                y = 2.0 * label - 1.0
                t = y
                if held:
                    margin = sum(value[_walk(tree, keys, b, len(y))] for tree, value in held)
                    t = 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
                return [np.ones(len(y)), t, t * t]
            grown += grow(points, size, "variance", left_over, 3, self.depth, self.leaf)
        return SparseTrees("gbt", grown, [1.0] + [LEARNING_RATE] * (len(grown) - 1), size, 2)
