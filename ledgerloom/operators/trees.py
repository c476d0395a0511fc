"""Regression trees, forests and extra trees, grown level by level from sums in the cluster.

Rows are bin numbers; where many are alike in bins and folds, they are added up once, for each
tree's draws. A level of all trees of all fits is one pass: each task adds up (node, feature, bin)
counts and sums of its rows, tree by tree, and sends those that aren't zero; they are added up by
node in the cluster, and there each node's split is chosen; the driver gets a row per node. The sums
are exact integers, so a tree depends on its rows alone, not on how they are partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import discard, written
from .local import Forest
from .ranks import order_statistics

#: Distinct values of a feature that are bins of their own; beyond them bins are quantile ranges.
MAX_BINS = 256
#: Cells (node, feature, bin) whose sums a task holds; a tree's level with more takes several turns.
CELLS = 1 << 20
#: Rows that a task takes together, and the numbers that these may hold in all.
CHUNK_ROWS, CHUNK_NUMBERS = 1 << 17, 1 << 22

#: What a model is unless its options say otherwise.
DEFAULTS = {
    "tree": {"trees": 1, "depth": 8, "leaf": 10, "features": 1.0, "bootstrap": False, "random_cuts": False},
    "random_forest": {"trees": 20, "depth": 10, "leaf": 3, "features": 0.5, "bootstrap": True, "random_cuts": False},
    "extra_trees": {"trees": 20, "depth": 10, "leaf": 3, "features": 1.0, "bootstrap": False, "random_cuts": True},
}


@dataclass(frozen=True)
class Fit:
    """One model on one set of rows: those whose fold in a scheme is neither negative nor held."""
    scheme: int
    held: int
    options: dict = field(hash=False)


@dataclass
class Edges:
    """Per feature the bins' least and greatest values, in order."""
    low: list[np.ndarray]
    high: list[np.ndarray]

    @property
    def bins(self) -> int:
        return max([len(a) for a in self.low], default=1)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def bin_edges(rows: DataFrame, width: int, max_bins: int = MAX_BINS) -> Edges:
    """The bins of x: a feature's values where there are at most max_bins, else ranges between
    exact quantiles. A task reports at most max_bins + 1 values a feature."""
    def seen(batches):
        found = [np.zeros(0) for _ in range(width)]
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for f in range(width):
                if len(found[f]) <= max_bins:
                    found[f] = np.union1d(found[f], x[:, f])[:max_bins + 1]
        for f, v in enumerate(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), f, np.int32)), pa.array(v)], ["f", "v"])

    some = rows.select("x").mapInArrow(seen, "f int, v double").distinct()
    listed = some.groupBy("f").agg(F.count("*").alias("n"), F.when(F.count("*") <= max_bins, F.array_sort(F.collect_set("v"))).alias("v")).collect()  # at most max_bins values of each feature
    low, high = [np.zeros(0)] * width, [np.zeros(0)] * width
    many = [r.f for r in listed if r.n > max_bins]
    for r in listed:
        if r.n <= max_bins:
            low[r.f] = high[r.f] = np.array(r.v, float)
    if many:
        long = rows.select(F.posexplode("x").alias("f", "v")).where(F.col("f").isin(many))
        cuts = order_statistics(long, ["f"], ["v"], [i / max_bins for i in range(max_bins + 1)]).select("f", "value").toPandas()
        for f, g in cuts.groupby("f"):
            edge = np.unique(g["value"].to_numpy())
            high[f], low[f] = edge[1:], edge[:-1]
    return Edges(low, high)


def binned(rows: DataFrame, edges: Edges) -> DataFrame:
    """rows with x as bin numbers (array of int), written: the table that every level reads."""
    names, width = [c for c in rows.columns if c != "x"], len(edges.low)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("x")), width)
            codes = np.column_stack([np.minimum(np.searchsorted(edges.high[f], x[:, f]), max(len(edges.high[f]) - 1, 0)) for f in range(width)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, len(x) * width + 1, width, dtype=np.int32), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], lists], [*names, "x"])

    types = dict(rows.dtypes)
    return written(rows.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in names], "x array<int>"])), "binned")


def poisson(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean 1, from the row's key alone."""
    with np.errstate(over="ignore"):
        h = key.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    upto = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 16)]))
    return np.searchsorted(upto, h / 2.0**64, "right")


class Grown:
    """A tree as arrays; node 0 is its root."""

    def __init__(self):
        self.feature, self.bin, self.cut, self.left, self.right, self.value, self.depth = [-1], [0], [0.0], [0], [0], [0.0], [0]

    def add(self, value: float, depth: int) -> int:
        for a, v in ((self.feature, -1), (self.bin, 0), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.value, value), (self.depth, depth)):
            a.append(v)
        return len(self.feature) - 1

    def nested(self, node: int = 0):
        if self.feature[node] < 0:
            return float(self.value[node])
        return int(self.feature[node]), float(self.cut[node]), self.nested(self.left[node]), self.nested(self.right[node])

    def arrays(self):
        return tuple(np.array(a) for a in (self.feature, self.bin, self.left, self.right))


def _nodes(tree, codes: np.ndarray) -> np.ndarray:
    """The node that each row has come to."""
    feature, cut, left, right = tree
    at = np.zeros(len(codes), np.int64)
    rows = np.arange(len(codes))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return at
        goes_left = codes[rows, feature[at]] <= cut[at]
        at = np.where(inner, np.where(goes_left, left[at], right[at]), at)


def _choose(n, s, edges: Edges, options: dict, seed: int, tree: int, node: int):
    """(feature, bin, cut, n left, sum left) of the best split from a node's (feature, bin) counts
    and sums; None without one. Cuts lie between the node's own neighbouring values."""
    total, mass = n[0].sum(), s[0].sum()
    if total < 2 * options["leaf"]:
        return None
    rng = np.random.default_rng([seed, tree, node])
    width = len(edges.low)
    take = max(1, int(round(options["features"] * width)))
    best, out = 1e-12, None
    for f in rng.choice(width, take, replace=False) if take < width else range(width):
        some = np.flatnonzero(n[f])
        if len(some) < 2 and (not len(some) or edges.low[f][some[0]] == edges.high[f][some[0]]):
            continue
        if options["random_cuts"]:
            cut = rng.uniform(edges.low[f][some[0]], edges.high[f][some[-1]])
            at = np.array([np.searchsorted(edges.high[f], cut, "right") - 1])
            if at[0] < some[0]:
                continue
            cuts = np.array([cut])
        else:
            at = some[:-1]
            exact = edges.low[f][at] == edges.high[f][at]
            cuts = np.where(exact, (edges.high[f][at] + edges.low[f][some[1:]]) / 2, edges.high[f][at])
        k, t = np.cumsum(n[f])[at], np.cumsum(s[f])[at]
        ok = (k >= options["leaf"]) & (total - k >= options["leaf"])
        if ok.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, k * (total - k) / total * (t / k - (mass - t) / (total - k)) ** 2, -1)
            i = int(gain.argmax())
            if gain[i] > best:
                best, out = gain[i], (int(f), int(at[i]), float(cuts[i]), int(k[i]), float(t[i]))
    return out


def _whole_numbers(y: np.ndarray, unit: tuple) -> tuple[np.ndarray, np.ndarray]:
    high = np.rint(y / unit[0])
    return high.astype(np.int64), np.rint((y - high * unit[0]) / unit[1]).astype(np.int64)


def _drawn(key, draw, seed: int) -> np.ndarray:
    return np.ones(len(key), np.int64) if draw is None else poisson(key, draw, seed).astype(np.int64)


def alike(rows: DataFrame, draws: list, units: list, seed: int) -> DataFrame | None:
    """folds, x, sums: rows (binned) of the same folds and bins as one, with the count and the two
    sums a unit of each draw; None unless that makes the table much smaller.

    Rows are dealt by ranges of (folds, x, key), so that no task gets more than its share of rows
    that are all alike; a task adds up what is alike in a batch, and what is left twice does no harm."""
    each = 1 + 2 * len(units)
    one = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("folds", "x")).alias("k")).first()
    if one.k * (4 + len(draws) * each) > 4 * one.n:
        return None

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key, y, folds, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            both = np.column_stack([_matrix(c, len(c[0])) for c in (folds, x)])
            first = np.flatnonzero(np.r_[True, (both[1:] != both[:-1]).any(axis=1)])
            numbers = [a for unit in units for a in _whole_numbers(y, unit)]
            sums = np.empty((len(first), len(draws), each), np.int64)
            for d, draw in enumerate(draws):
                w = _drawn(key, draw, seed)
                for i, v in enumerate([w, *[w * a for a in numbers]]):
                    sums[:, d, i] = np.add.reduceat(v, first)
            width = len(draws) * each
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(first) * width + 1, width), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([folds.take(first), x.take(first), lists], ["folds", "x", "sums"])

    dealt = rows.select("key", "y", "folds", "x").repartitionByRange("folds", "x", "key").sortWithinPartitions("folds", "x")
    return written(dealt.mapInArrow(run, "folds array<int>, x array<int>, sums array<long>"), "alike")


def _chunks(batches, most: int):
    """Batches put together, of at most so many rows."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            piece = batch.slice(at, most)
            if n + piece.num_rows > most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def grow(rows: DataFrame, edges: Edges, fits: list[Fit], seed: int = 42) -> list[Forest]:
    """The models of all fits. rows (binned): key long, y, folds (array of int, one a scheme), x."""
    width, bins, schemes = len(edges.low), edges.bins, len(rows.select("folds").first().folds)
    inside = [(F.get("folds", F.lit(f.scheme)) >= 0) & (F.get("folds", F.lit(f.scheme)) != f.held) for f in fits]
    most = rows.agg(*[F.max(F.when(c, F.abs("y"))).alias(f"m{i}") for i, c in enumerate(inside)]).first()
    if any(m is None for m in most):
        raise ValueError("a fit without rows")
    units = [((m or 1.0) / 2**31, (m or 1.0) / 2**62) for m in most]  # y as two integers, of which 2**32 rows can be added up
    kinds = sorted(set(units))
    trees = {(i, t): Grown() for i, fit in enumerate(fits) for t in range(fit.options["trees"])}
    draw_of = {(i, t): t if fits[i].options["bootstrap"] else None for i, t in trees}
    draws = sorted(set(draw_of.values()), key=lambda d: -1 if d is None else d)
    merged = alike(rows, draws, kinds, seed)
    table = rows.select("key", "y", "folds", "x") if merged is None else merged
    folded, numbers = merged is not None, 4 + (len(draws) * (1 + 2 * len(kinds)) if merged is not None else 0)
    at_once, chunk = max(1, CELLS // (width * bins)), max(1, min(CHUNK_ROWS, CHUNK_NUMBERS // numbers))
    frontier = [(*job, 0) for job in trees]
    while frontier:
        slots: dict = {}
        for slot, (i, t, node) in enumerate(frontier):
            slots.setdefault((i, t), []).append((node, slot))
        jobs = []
        for (i, t), nodes in slots.items():
            where = np.full(len(trees[i, t].feature), -1)
            where[[n for n, _ in nodes]] = [s for _, s in nodes]
            jobs.append((fits[i].scheme, fits[i].held, draw_of[i, t], kinds.index(units[i]), trees[i, t].arrays(), where, min(s for _, s in nodes), max(s for _, s in nodes) + 1))
        shared = rows.sparkSession.sparkContext.broadcast((jobs, [(fits[i].options, t, node, units[i]) for i, t, node in frontier]))

        def sums(batches):
            for part in _chunks(batches, chunk):
                folds, codes = (_matrix(part.column(c).chunk(0), n) for c, n in (("folds", schemes), ("x", width)))
                if folded:
                    held = _matrix(part.column("sums").chunk(0), numbers - 4).reshape(part.num_rows, len(draws), -1)
                else:
                    key, y = part.column("key").to_numpy(), part.column("y").to_numpy()
                    whole = [_whole_numbers(y, unit) for unit in kinds]
                for scheme, out, draw, unit, tree, where, begin, end in shared.value[0]:
                    mine = np.flatnonzero((folds[:, scheme] >= 0) & (folds[:, scheme] != out))
                    slot = where[_nodes(tree, codes[mine])]
                    mine, slot = mine[slot >= 0], slot[slot >= 0]
                    if folded:
                        three = held[mine, draws.index(draw)][:, [0, 1 + 2 * unit, 2 + 2 * unit]].T
                    else:
                        w = _drawn(key[mine], draw, seed)
                        three = np.stack([w, w * whole[unit][0][mine], w * whole[unit][1][mine]])
                    some = three[0] > 0
                    mine, slot, three = mine[some], slot[some], np.ascontiguousarray(three[:, some])
                    for low in range(begin, end, at_once):
                        high = min(low + at_once, end)
                        take = slice(None) if end - begin <= at_once else (slot >= low) & (slot < high)
                        cells = (((slot[take] - low) * width)[:, None] + np.arange(width)) * bins + codes[mine[take]]
                        total = np.zeros((3, (high - low) * width * bins), np.int64)
                        for f in range(width):
                            for into, v in zip(total, three):
                                np.add.at(into, cells[:, f], v[take])
                        at = np.flatnonzero(total[0])
                        if not len(at):
                            continue
                        of = at // (width * bins)
                        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                        offsets, place = pa.array(np.r_[first, len(at)], pa.int32()), (at % (width * bins)).astype(np.int32)
                        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (place, *total[:, at])]
                        yield pa.RecordBatch.from_arrays([pa.array(of[first] + low, pa.int32()), *lists], ["slot", "cell", "n", "high", "low"])

        def split(batches):
            """A node's rows follow each other; they are added up until the next node's begin."""
            now, total, found = -1, np.zeros((3, width * bins), np.int64), []

            def choose():
                options, t, node, unit = shared.value[1][now]
                n, high, low = total.reshape(3, width, bins)
                s = high * unit[0] + low * unit[1]
                f, b, cut, k, left = _choose(n, s, edges, options, seed, t, node) or (-1, 0, 0.0, 0, 0.0)
                found.append((now, int(n[0].sum()), float(s[0].sum()), f, b, cut, k, left))

            for batch in batches:
                slot, offsets = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy()
                cell, *values = (batch.column(c).values.to_numpy() for c in range(1, 5))
                for r in range(len(slot)):
                    if slot[r] != now:
                        if now >= 0:
                            choose()
                        now, total[:] = int(slot[r]), 0
                    some = slice(offsets[r], offsets[r + 1])
                    for into, v in zip(total, values):
                        into[cell[some]] += v[some]
            if now >= 0:
                choose()
            names = ["slot", "n", "mass", "f", "b", "cut", "k", "left"]
            types = [pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kind) for c, kind in enumerate(types)], names)

        sent = table.mapInArrow(sums, "slot int, cell array<int>, n array<long>, high array<long>, low array<long>")
        got = sent.repartition("slot").sortWithinPartitions("slot").mapInArrow(
            split, "slot int, n long, mass double, f int, b int, cut double, k long, left double").collect()  # a row per node
        shared.unpersist()
        following = []
        for r in sorted(got, key=lambda r: r.slot):
            i, t, node = frontier[r.slot]
            tree, options = trees[i, t], fits[i].options
            tree.value[node] = r.mass / r.n
            if r.f < 0 or tree.depth[node] >= options["depth"]:
                continue
            tree.feature[node], tree.bin[node], tree.cut[node] = r.f, r.b, r.cut
            for side, n, mass in (("left", r.k, r.left), ("right", r.n - r.k, r.mass - r.left)):
                child = tree.add(mass / n, tree.depth[node] + 1)
                getattr(tree, side)[node] = child
                if n >= 2 * options["leaf"] and tree.depth[child] < options["depth"]:
                    following.append((i, t, child))
        # A tree's nodes have neighbouring numbers, so that a task takes tree after tree.
        frontier = sorted(following)
    if merged is not None:
        discard(merged)
    return [Forest([trees[i, t].nested() for t in range(fit.options["trees"])]) for i, fit in enumerate(fits)]


def grow_on(rows: DataFrame, fits: list[Fit], seed: int = 42, max_bins: int = MAX_BINS) -> list[Forest]:
    """The fits' models from rows of key, y, folds and x (array of double, without nulls)."""
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows")
    edges = bin_edges(rows, first.n, max_bins)
    held = binned(rows, edges)
    out = grow(held, edges, fits, seed)
    discard(held)
    return out
