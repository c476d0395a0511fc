"""Nearest neighbours and distance sums of whole tables, in blocks of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import written
from .order import round_robin

#: Pivots that cut both sides, least rows of a block, most blocks, and queries of a block's part.
PIVOTS, BLOCK_ROWS, BLOCKS, PART_QUERIES = 256, 4_096, 65_536, 4_096
#: Room for rounding when bounds decide whether a block is visited.
ROOM = 1 + 1e-9


def _stack(column) -> np.ndarray:
    n = len(column)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, from exact differences, so that equal points are at zero."""
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        out += (a[:, f][:, None] - b[:, f][None, :]) ** 2
    return out


def _best(d, i, k):
    """The places of the k least (distance, id) in each row."""
    if d.shape[1] > 4 * k:  # those beyond the k-th distance, ties kept, can't be among them
        limit = np.partition(d, k - 1, axis=1)[:, k - 1:k]
        width = int((d <= limit).sum(axis=1).max())
        first = np.argpartition(d, min(width, d.shape[1]) - 1, axis=1)[:, :width]
        order = np.lexsort((i[first], np.take_along_axis(d, first, 1)), axis=1)[:, :k]
        return np.take_along_axis(first, order, 1)
    return np.lexsort((np.broadcast_to(i, d.shape), d), axis=1)[:, :k]


def _visit(train: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """q, n: for each asked (block, q, x, bound) the block's k best no farther than the bound, as
    (d, i, y). A block's queries are taken in parts, each of which meets the block's rows."""
    counts = asked.groupBy("block").agg(F.count("*").alias("n")).select(F.col("block").alias("b"), F.ceil(F.col("n") / PART_QUERIES).cast("int").alias("parts"))
    counts = F.broadcast(written(counts, "parts"))  # at most BLOCKS and PIVOTS rows
    right = asked.join(counts, F.col("block") == F.col("b")).withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
    left = train.join(counts, F.col("block") == F.col("b")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = pa.list_(pa.struct([("d", pa.float64()), ("i", pa.int64()), ("y", pa.float64())]))

    def search(mine: pa.Table, queries: pa.Table) -> pa.Table:
        a, points, bound = _stack(mine.column("x")), _stack(queries.column("x")), queries.column("bound").to_numpy()
        ids, y, out = mine.column("i").to_numpy(), mine.column("y").to_numpy(), []
        for at in range(0, len(points) if len(a) else 0, 512):
            d = _distances(points[at:at + 512], a)
            best = _best(d, ids, k)
            near = np.sqrt(np.take_along_axis(d, best, 1))
            for row, cols, limit in zip(near, best, bound[at:at + 512]):
                out.append([{"d": float(v), "i": int(ids[c]), "y": float(y[c])} for v, c in zip(row, cols) if v <= limit])
        return pa.table({"q": queries.column("q")[:len(out)], "n": pa.array(out, found)})

    return left.select("block", "part", "i", "x", "y").groupBy("block", "part").cogroup(right.select("block", "part", "q", "x", "bound").groupBy("block", "part")).applyInArrow(
        search, "q long, n array<struct<d:double,i:long,y:double>>")


def nearest(train: DataFrame, queries: DataFrame, id_col: str, x: str, y: str, k: int = 15) -> DataFrame:
    """query id and y_pred: the mean of the k nearest training values (Euclidean, ties by
    training id) weighted by 1 / distance; neighbours at distance zero take all the weight.

    Rows belong to the nearest of at most PIVOTS pivots, and a pivot's rows to blocks of rings
    around it, so a hot cell is many blocks. A query first visits the blocks that seem nearest until
    they hold k rows; by the triangle inequality its k-th distance there rules out most others, and
    it visits the rest. Any number of rows and queries; a query or a block is never in one task with
    more than a bounded number of the others. Without training rows there is no result. Null
    vectors take no part.
    """
    known = written(train.where(F.col(x).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y")), "train")
    asked = written(queries.where(F.col(x).isNotNull()).select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("id"), F.col(x).cast("array<double>").alias("x")), "queries")
    n = known.count()
    schema = f"{id_col} {queries.schema[id_col].dataType.simpleString()}, y_pred double"
    if not n:
        return train.sparkSession.createDataFrame([], schema)
    pivots = np.array([r.x for r in known.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(max(1, min(PIVOTS, n // 256))).collect()])
    held = train.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for b in batches:
            d = np.sqrt(_distances(_stack(b.column(1)), held.value)) if b.num_rows else np.zeros((0, 1))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["i", "x", "y", "cell", "r"])

    cells = known.mapInArrow(assign, "i long, x array<double>, y double, cell int, r double").withColumn("at", F.struct("r", "i"))
    rows = max(BLOCK_ROWS, -(-n // BLOCKS))
    placed = round_robin(cells, "cell", "at").withColumn("ring", F.floor((F.col("turn") - 1) / rows).cast("int"))
    known = written(placed.select("i", "x", "y", "cell", "r", (F.col("ring") * PIVOTS + F.col("cell")).cast("int").alias("block")), "blocks")
    rings = known.groupBy("block").agg(F.first("cell").alias("cell"), F.min("r").alias("a"), F.max("r").alias("z"), F.count("*").alias("n")).orderBy("block").toPandas()  # at most BLOCKS + PIVOTS
    table = train.sparkSession.sparkContext.broadcast((rings["block"].to_numpy(), rings["cell"].to_numpy(), rings["a"].to_numpy(), rings["z"].to_numpy(), rings["n"].to_numpy()))

    def route(first: bool):
        def run(batches):
            block, cell, a, z, size = table.value
            gap = np.sqrt(_distances(held.value, held.value))
            for b in batches:
                if not b.num_rows:
                    continue
                q, points = b.column(0).to_numpy(), _stack(b.column(1))
                bound = np.full(len(q), np.inf) if first else b.column(2).to_numpy()
                qs, blocks, xs, bounds = [], [], [], []
                for at in range(0, len(q), 256):
                    d = np.sqrt(_distances(points[at:at + 256], held.value))
                    own, to = d.argmin(axis=1), d[:, cell]
                    low = np.maximum(np.maximum(to - z, a - to), 0.0)
                    other = gap[own][:, cell]
                    plane = (to**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * np.where(other > 0, other, np.inf))
                    low = np.maximum(low, plane)
                    order = np.argsort(low + 1e-9 * (to + z), axis=1, kind="stable")
                    enough = np.cumsum(size[order], axis=1)
                    rank = (enough < k).sum(axis=1)  # the blocks up to this one hold k rows
                    visited = np.zeros(low.shape, bool)
                    np.put_along_axis(visited, order, np.arange(low.shape[1])[None, :] <= rank[:, None], axis=1)
                    take = visited if first else ~visited & (low <= bound[at:at + 256, None] * ROOM + 1e-12)
                    r, c = np.nonzero(take)
                    qs.append(q[at + r])
                    blocks.append(block[c])
                    xs.append(points[at + r])
                    bounds.append(bound[at + r])
                flat = np.concatenate(xs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]) if len(flat) else [0], pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks), pa.int32()), pa.array(np.concatenate(qs), pa.int64()), lists, pa.array(np.concatenate(bounds))], ["block", "q", "x", "bound"])
        return run

    width = "block int, q long, x array<double>, bound double"
    top = F.slice(F.array_sort(F.flatten(F.collect_list("n"))), 1, k)
    once = written(_visit(known, asked.select("q", "x").mapInArrow(route(True), width), k).groupBy("q").agg(top.alias("n")), "nearest")
    # Fewer than k rows in all: nothing is left to visit but what the first visit saw.
    limit = F.when(F.size("n") >= k, F.element_at("n", -1)["d"]).otherwise(float("inf"))
    bounded = asked.join(once.select("q", limit.alias("bound")), "q").select("q", "x", "bound")
    twice = _visit(known, bounded.mapInArrow(route(False), width), k)
    kept = once.unionByName(twice).groupBy("q").agg(top.alias("n"))
    zero = F.filter("n", lambda s: s["d"] == 0)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, s: t + s["y"]) / F.size(a)
    w = F.aggregate("n", F.lit(0.0), lambda t, s: t + F.try_divide(F.lit(1.0), s["d"]))
    wy = F.aggregate("n", F.lit(0.0), lambda t, s: t + F.try_divide(s["y"], s["d"]))
    return asked.select("q", "id").join(kept, "q").select(F.col("id").alias(id_col), F.when(F.size(zero) > 0, mean(zero)).otherwise(wy / w).alias("y_pred"))


#: Bytes of points on one side of a tile, its least rows, and its most (row, cluster) sums.
TILE_BYTES, TILE_ROWS, TILE_SUMS = 32 << 20, 128, 1 << 21
#: Rows of either side whose distances a task holds at once.
STRIP, SPAN = 256, 1_024
#: Columns of a tile's sums.
SUMS = ["id", "c", "other", "n", "total"]


def _by_cluster(t: pa.Table):
    """The tile in order of clusters: ids, the clusters, which of them each row has, and points."""
    c = t.column("c").combine_chunks().dictionary_encode()
    of = c.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(of, kind="stable")
    return t.column("id").combine_chunks().take(order), c.dictionary, of[order], _stack(t.column("p"))[order]


def runs(of: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal numbers begins and ends."""
    at = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    return list(zip(at, at[1:]))


def _strips(a: np.ndarray, b: np.ndarray):
    """Rows of a, rows of b (slices) and their distances, for STRIP by SPAN rows at a time."""
    square_a, square_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    for i in range(0, len(a) if len(b) else 0, STRIP):
        some = slice(i, i + STRIP)
        for j in range(0, len(b), SPAN):
            others = slice(j, j + SPAN)
            d = a[some] @ b[others].T
            d *= -2
            d += square_a[some, None]
            d += square_b[None, others]
            np.maximum(d, 0.0, out=d)
            np.sqrt(d, out=d)
            yield some, others, d


def tile_sums(a: pa.Table, b: pa.Table, one_tile: bool) -> pa.Table:
    """The rows of both tiles (id, c, p), or of one with itself, with their sums for the other's clusters."""
    ida, ca, of_a, pa_ = _by_cluster(a)
    del a
    idb, cb, of_b, pb = (ida, ca, of_a, pa_) if one_tile else _by_cluster(b)
    del b
    ia, ib = ida.to_numpy(zero_copy_only=False), idb.to_numpy(zero_copy_only=False)
    na = np.repeat(np.bincount(of_b, minlength=len(cb))[None, :], len(ia), axis=0)
    nb = np.repeat(np.bincount(of_a, minlength=len(ca))[None, :], len(ib), axis=0)
    sa, sb = np.zeros(na.shape), np.zeros(nb.shape)
    if one_tile:  # rows of one id don't count for each other
        order = np.argsort(ia, kind="stable")
        place = np.empty(len(ia), np.int64)
        place[order] = np.cumsum(np.r_[True, ia[order][1:] != ia[order][:-1]][:len(ia)]) - 1
        own = np.zeros(na.shape, np.int64)
        np.add.at(own, (place, of_a), 1)
        na -= own[place]
    for some, others, d in _strips(pa_, pb):
        if one_tile:
            d[place[some, None] == place[None, others]] = 0.0
        else:
            for lo, hi in runs(of_a[some]):
                sb[others, of_a[some.start + lo]] += d[lo:hi].sum(axis=0)
        first = [lo for lo, _ in runs(of_b[others])]
        sa[some, of_b[others][first]] += np.add.reduceat(d, first, axis=1)
    out = []
    for ids, of, c, other, n, s in ((ida, of_a, ca, cb, na, sa), *([] if one_tile else [(idb, of_b, cb, ca, nb, sb)])):
        r, k = np.nonzero(n)
        out.append(pa.table([ids.take(r), c.take(of[r]), other.take(k), pa.array(n[r, k]), pa.array(s[r, k])], SUMS))
    return pa.concat_tables(out)


def _tile_pairs(rows: DataFrame, n: int, width: int, clusters: int):
    """The n rows (id, ...), dealt into tiles of bounded size: each pair of tiles once, to find sums for the rows of both."""
    most = max(1, min(TILE_BYTES // (8 * width), max(TILE_SUMS // max(clusters, 1), math.isqrt(TILE_SUMS))))
    tiles = max(1, -(-n // most), min(8, n // TILE_ROWS))
    dealt = rows.withColumn("t", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    left = dealt.withColumn("u", F.explode(F.sequence(F.col("t"), F.lit(tiles - 1))))
    right = dealt.withColumnRenamed("t", "u").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("u"))))
    return left.groupBy("t", "u").cogroup(right.groupBy("t", "u"))


def cluster_distances(df: DataFrame, id_col: str, x: str, cluster: str) -> DataFrame:
    """id, cluster, other, n, total: the number and the sum of each row's Euclidean distances to the
    rows of each cluster, but for rows of its own id. All rows meet all rows, tile by tile, as matrix
    products; a task holds two tiles of bounded size, and distances of STRIP by SPAN rows at a time,
    whatever the table's size. What leaves it is a sum for each row and cluster. Null vectors and
    clusters take no part."""
    kind = df.schema[x].dataType.simpleString()
    points = F.col(x) if kind in ("array<float>", "array<double>") else F.col(x).cast("array<double>")
    rows = written(df.where(F.col(x).isNotNull() & F.col(cluster).isNotNull()).select(F.col(id_col).alias("id"), F.col(cluster).alias("c"), points.alias("p")), "points")
    one = rows.agg(F.count("*").alias("n"), F.max(F.size("p")).alias("d"), F.count_distinct("c").alias("k")).first()
    pairs = _tile_pairs(rows, one.n, one.d or 1, one.k)

    def sums(key, a: pa.Table, b: pa.Table) -> pa.Table:
        return tile_sums(a, b, key[0].as_py() == key[1].as_py())

    types = dict(rows.dtypes)
    parts = pairs.applyInArrow(sums, f"id {types['id']}, c {types['c']}, other {types['c']}, n long, total double")
    return parts.groupBy("id", "c", "other").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def weighted_sums(a: pa.Table, b: pa.Table, one_tile: bool, clusters: int) -> pa.Table:
    """The rows of both tiles (id, w, own, p), or of one with itself, with the sums of their distances
    to the other's rows, each counted w times, for each of the clusters; own: the clusters of a row."""
    def side(t: pa.Table):
        held = np.zeros((t.num_rows, clusters))
        held[np.arange(t.num_rows)[:, None], _stack(t.column("own")).astype(int)] = t.column("w").to_numpy()[:, None]
        return held, _stack(t.column("p"))

    ha, pa_ = side(a)
    origin = pa_.mean(axis=0) if len(pa_) else 0.0  # far from zero, products would lose digits
    pa_ -= origin
    hb, pb = (ha, pa_) if one_tile else side(b)
    if not one_tile and len(pb):
        pb -= origin
    sa, sb = np.zeros(ha.shape), np.zeros(hb.shape)
    for some, others, d in _strips(pa_, pb):
        if one_tile:
            both = np.arange(max(some.start, others.start), min(some.stop, others.stop, len(pa_)))
            d[both - some.start, both - others.start] = 0.0
        else:
            sb[others] += d.T @ ha[some]
        sa[some] += d @ hb[others]
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, clusters), pa.int32()), pa.array(x.ravel()))
    return pa.concat_tables([pa.table({"id": t.column("id"), "w": t.column("w"), "own": t.column("own"), "sums": lists(x)}) for t, x in ((a, sa), *([] if one_tile else [(b, sb)]))])


def distances_to_clusters(rows: DataFrame, clusters: int) -> DataFrame:
    """id, w, own, sums: for each row (id: unique, w: how often it counts, own: its cluster in each of
    several clusterings, all numbered from 0 to clusters - 1, p: its point) the sums of its Euclidean
    distances to the rows of each cluster. All rows meet all rows once for all clusterings, in the
    tiles of cluster_distances."""
    one = rows.agg(F.count("*").alias("n"), F.max(F.size("p")).alias("d")).first()

    def sums(key, a: pa.Table, b: pa.Table) -> pa.Table:
        return weighted_sums(a, b, key[0].as_py() == key[1].as_py(), clusters)

    parts = _tile_pairs(rows, one.n, one.d or 1, clusters).applyInArrow(sums, "id long, w long, own array<int>, sums array<double>")
    added = F.array(*[F.sum(F.get("sums", F.lit(c))) for c in range(clusters)])
    return parts.groupBy("id").agg(F.first("w").alias("w"), F.first("own").alias("own"), added.alias("sums"))
