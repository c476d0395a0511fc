"""Embedding near-duplicates by cover trees and their dual traversal.

Unit vectors at a cosine of at least c are at most t = sqrt(2 - 2 c) apart. A cover tree nests
levels of centres with halving radii; a pair of nodes whose covering balls are more than t
apart holds no link, and one whose balls lie within t of each other holds links only, which
are counted without being listed. What is left is decided on the vectors themselves.

The top of the tree is distributed. A label with over leaf_max distinct vectors is cut into
cells around CENTRES vectors drawn from it; each vector is a member of the nearest centre's cell
and visits those that the bisecting plane of the two centres doesn't put out of reach. A cell
that is still too large is cut in the same way around centres of its own, level below level, so
that the levels grow with the logarithm of the rows and a vector's copies with the cells near
it, not with the rows. A cell that no longer falls apart (a ball of near vectors) is taken in
blocks. A task holds up to leaf_max members and up to leaf_max visitors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, local_components, materialize

LEAF_MAX = 8192
CENTRES = 256
#: A level must leave at most this share of a cell in its largest part, else blocks follow.
SHRINK = 0.75
LEAF = 24
EPS = 1e-7
BLOCK = 1 << 20


class Node:
    __slots__ = ("centre", "radius", "points", "children")

    def __init__(self, centre, radius, points, children):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between unit vectors. Near zero, 2 - 2 cos loses digits; EPS leaves room for that."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def cover(x: np.ndarray, points: np.ndarray, centre: int, radius: float):
    """Greedy cover of points: centres (the given one first) more than radius apart from each
    other, and for each point its centre's position and the distance to it."""
    centres = [centre]
    owner = np.full(len(points), -1)
    far = np.zeros(len(points))
    step = 512
    for low in range(0, len(points), step):
        some = points[low:low + step]
        best = np.full(len(some), np.inf)
        who = np.zeros(len(some), np.int64)
        for at in range(0, len(centres), 4096):
            d = distances(x[some], x[centres[at:at + 4096]])
            k = d.argmin(axis=1)
            v = d[np.arange(len(some)), k]
            better = v < best
            best[better], who[better] = v[better], k[better] + at
        open_ = np.flatnonzero(best > radius)
        if len(open_):
            own = distances(x[some[open_]], x[some[open_]])
            for i in range(len(open_)):
                if best[open_[i]] > radius:
                    centres.append(some[open_[i]])
                    d = own[i]
                    better = d < best[open_]
                    best[open_[better]], who[open_[better]] = d[better], len(centres) - 1
                    best[open_[i]], who[open_[i]] = 0.0, len(centres) - 1
        owner[low:low + step], far[low:low + step] = who, best
    return np.array(centres), owner, far


def cover_tree(x: np.ndarray) -> Node:
    """Root of a cover tree over the rows of x."""
    def node(points, centre, bound, far):
        radius = float(far.max()) if len(points) > 1 else 0.0
        if len(points) <= LEAF or radius <= EPS:
            return Node(centre, radius, points, None)
        step = bound
        while True:  # halve until the ball falls apart
            step /= 2
            if step < radius:
                centres, owner, d = cover(x, points, centre, step)
                if len(centres) > 1:
                    break
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        kids = [node(points[order[a:z]], int(c), step, d[order[a:z]]) for c, a, z in zip(centres, cuts, cuts[1:]) if z > a]
        return Node(centre, radius, points, kids)

    points = np.arange(len(x))
    return node(points, 0, 4.0, distances(x, x[:1])[:, 0])


def dual_links(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cosine: float, exact) -> tuple[np.ndarray, np.ndarray]:
    """Links between the unit rows of x (visitors) and y (members): for each visitor the weight
    of the members linked to it, and component labels over visitors, then members.

    exact(i, j) decides pairs that lie within rounding of the threshold."""
    t = math.sqrt(2.0 - 2.0 * cosine)
    n = len(x)
    count = np.zeros(n, np.int64)
    label = np.arange(n + len(y))
    root_x = cover_tree(x)
    root_y = root_x if y is x else cover_tree(y)
    stack = [([root_x], [root_y])]
    while stack:
        a, b = stack.pop()
        if len(a) * len(b) > BLOCK and len(a) > 1:
            half = len(a) // 2
            stack += [(a[:half], b), (a[half:], b)]
            continue
        d = distances(x[[i.centre for i in a]], y[[j.centre for j in b]])
        reach = np.array([i.radius for i in a])[:, None] + np.array([j.radius for j in b])[None, :]
        linked = d + reach <= t - EPS
        if linked.any():
            sizes = np.array([int(weight[j.points].sum()) for j in b])
            for k in np.flatnonzero(linked.any(axis=1)):
                count[a[k].points] += int(sizes[linked[k]].sum())
            p, q = np.nonzero(linked)
            pi = np.array([a[k].points[0] for k in range(len(a))])[p]
            qj = np.array([b[k].points[0] for k in range(len(b))])[q]
            label = local_components(len(label), pi, n + qj, label)
            for k in np.flatnonzero(linked.any(axis=1)):
                if len(a[k].points) > 1:
                    label = local_components(len(label), a[k].points, np.full(len(a[k].points), a[k].points[0]), label)
            for k in np.flatnonzero(linked.any(axis=0)):
                if len(b[k].points) > 1:
                    label = local_components(len(label), n + b[k].points, np.full(len(b[k].points), n + b[k].points[0]), label)
        open_ = ~linked & (d - reach <= t + EPS)
        for k in np.flatnonzero(open_.any(axis=1)):
            others = [b[m] for m in np.flatnonzero(open_[k])]
            one = a[k]
            # Balls that can't be opened, or small ones, are decided by their vectors.
            direct = [o for o in others if one.children is None and o.children is None]
            if direct:
                i, j = one.points, np.concatenate([o.points for o in direct])
                hit = exact_block(x, y, i, j, cosine, exact)
                count[i] += hit.astype(np.int64) @ weight[j]
                p, q = np.nonzero(hit)
                label = local_components(len(label), i[p], n + j[q], label)
            wide = [o for o in others if o.children is not None and (one.children is None or o.radius >= one.radius)]
            if wide:
                stack.append(([one], [c for o in wide for c in o.children]))
            rest = [o for o in others if one.children is not None and not (o.children is not None and o.radius >= one.radius)]
            if rest:
                stack.append((one.children, rest))
    return count, label


def exact_block(x, y, i, j, cosine, exact):
    cos = x[i] @ y[j].T
    hit = cos >= cosine
    p, q = np.nonzero(np.abs(cos - cosine) <= EPS)
    if len(p):
        hit[p, q] = exact(i[p], j[q])
    return hit


def link_groups(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One task's members (kind 0) and visitors (kind 1): links of each visitor, and for each
    vector the smallest id it is joined to here."""
    members, visitors = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
    out = {"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "joined": np.zeros(0, np.int64)}
    if len(members) and len(visitors):
        raw_y, raw_x = (np.stack([np.asarray(v, np.float64) for v in part["vec"]]) for part in (members, visitors))
        iy, ix = members["id"].to_numpy(), visitors["id"].to_numpy()
        norm_y, norm_x = np.linalg.norm(raw_y, axis=1), np.linalg.norm(raw_x, axis=1)
        unit = lambda raw: (lambda s: s / np.linalg.norm(s, axis=1)[:, None])(raw / np.abs(raw).max(axis=1)[:, None])
        y = unit(raw_y)
        if len(ix) == len(iy) and np.array_equal(ix, iy):
            x = y
        else:
            x = unit(raw_x)
        def exact(i, j):
            return np.einsum("ij,ij->i", raw_x[i], raw_y[j]) / (norm_x[i] * norm_y[j]) >= cosine
        count, label = dual_links(x, y, members["w"].to_numpy(), cosine, exact)
        ids = np.concatenate([ix, iy])
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, label, ids)
        joined = low[label]
        out = {"id": ids, "links": np.concatenate([count, np.zeros(len(iy), np.int64)]), "joined": joined}
    return pd.DataFrame(out)


def assign_cells(points: pd.DataFrame, centres: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """The rows of a cell (kind 0: members, 1: visitors) in its parts: a member in that of the
    nearest centre, a visitor in all that hold vectors within reach. A cell whose centres are one
    vector stays whole."""
    t = math.sqrt(2.0 - 2.0 * cosine)
    columns = ["label", "cell", "kind", "id", "w", "vec"]
    if not len(points):
        return pd.DataFrame({c: [] for c in columns})
    if not len(centres):
        return points.assign(cell=points["cell"] + "/")[columns]
    centres = centres.sort_values("cid")
    unit = lambda col: (lambda r: r / np.linalg.norm(r, axis=1)[:, None])(np.stack([np.asarray(v, np.float64) / np.abs(v).max() for v in col]))
    c = unit(centres["cvec"])
    between = distances(c, c)
    parts = []
    for low in range(0, len(points), 4096):
        some = points.iloc[low:low + 4096]
        d2 = np.maximum(0.0, 2.0 - 2.0 * (unit(some["vec"]) @ c.T))
        home = d2.argmin(axis=1)
        # How far x lies beyond the plane between its centre and another, on its own side.
        gap = (d2 - d2[np.arange(len(some)), home][:, None]) / np.maximum(2 * between[home], 1e-12)
        reach = gap <= t + EPS
        member = (some["kind"] == 0).to_numpy()
        reach[member] = False
        reach[member, home[member]] = True
        p, q = np.nonzero(reach)
        one = some.iloc[p]
        parts.append(one.assign(cell=one["cell"].to_numpy() + np.array([f"/{k}" for k in range(len(c))], dtype=object)[q]))
    return pd.concat(parts)[columns]


def cells(reps: DataFrame, cosine: float, leaf_max: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sizes): the members and visitors (label, cell, kind, id, w, vec) of all cells, and
    the number of members and visitors of each cell (label, cell, members, visitors)."""
    schema = "label string, cell string, kind int, id long, w long, vec array<double>"
    rows = reps.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).select("label", F.lit("").alias("cell"), "kind", "id", "w", "vec")
    done, stuck = None, None
    while True:
        sizes = materialize(rows.groupBy("label", "cell").agg(F.count_if(F.col("kind") == 0).alias("members"), F.count_if(F.col("kind") == 1).alias("visitors")).where("members > 0 AND visitors > 0"), "cell-sizes")
        final = F.col("members") <= leaf_max
        if stuck is not None:
            # A part that holds most of its parent isn't cut again.
            parent = F.regexp_replace("cell", "/[^/]*$", "")
            sizes = sizes.withColumn("parent", parent).join(stuck, ["label", "parent"], "left").drop("parent")
            final = final | (F.col("members") > SHRINK * F.coalesce("before", F.lit(0)))
        else:
            sizes = sizes.withColumn("before", F.lit(None).cast("long"))
        sizes = materialize(sizes.withColumn("final", final), "cells")
        ready = sizes.where("final").select("label", "cell", "members", "visitors")
        done = (rows, ready) if done is None else (done[0].unionByName(rows), done[1].unionByName(ready))
        large = sizes.where("NOT final")
        if not large.limit(1).count():
            return done
        stuck = large.select("label", F.col("cell").alias("parent"), F.col("members").alias("before"))
        told = large.select("label", "cell", F.ceil((F.col("members") + F.col("visitors")) / leaf_max).cast("int").alias("salts"), (F.least(F.lit(CENTRES), F.ceil(4 * F.col("members") / leaf_max)) / F.col("members")).alias("share"))
        sized = rows.join(told, ["label", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id", "kind"), F.col("salts")).cast("int"))
        drawn = sized.where((F.col("kind") == 0) & (F.pmod(F.xxhash64(F.length("cell"), "id"), F.lit(1 << 31)) < F.col("share") * (1 << 31)))
        centres = drawn.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(
            F.col("label").alias("clabel"), F.col("cell").alias("ccell"), F.col("salt").alias("csalt"), F.col("id").alias("cid"), F.col("vec").alias("cvec"))
        rows = materialize(sized.select("label", "cell", "kind", "salt", "id", "w", "vec").groupBy("label", "cell", "salt").cogroup(centres.groupBy("clabel", "ccell", "csalt")).applyInPandas(
            lambda p, c: assign_cells(p, c, cosine), schema), "cell-rows")


def embedding_components(vectors: DataFrame, cosine: float = 0.98, leaf_max: int = LEAF_MAX, id_col: str = "vec_id",
                         vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least `cosine`; a row's own copies count as links. Exact. Null vectors,
    zero vectors and vectors with null or non-finite components link with nothing, nor do rows
    with a null label or id, or vectors of different lengths. Rows that repeat an id are vectors
    of their own. component_id is the smallest id reachable; kept holds for that id's rows.
    An empty table gives an empty result; other columns are not read.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = (F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("vec") > 0)
            & F.forall("vec", lambda z: z.isNotNull() & (F.abs(z) < float("inf")) & ~F.isnan(z)) & F.exists("vec", lambda z: z != 0))
    v = v.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # Vectors of another length never link: the length is part of the label.
    label = F.concat_ws(":", F.size("vec").cast("string"), F.col("label").cast("string"))
    # 0.0 and -0.0 are equal components.
    v = v.withColumn("vec", F.transform("vec", lambda z: z + F.lit(0.0))).withColumn("label", label)
    v = v.withColumns({"k1": F.xxhash64("label", "vec"), "k2": F.xxhash64(F.lit(7), "vec", "label")})
    reps = materialize(v.where("fine").groupBy("k1", "k2").agg(
        F.min("id").alias("id"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("vec").alias("vec")).drop("k1", "k2")
        .select("id", "w", "label", "vec"), "vectors")
    rows, sizes = cells(reps, cosine, leaf_max)
    counts = sizes.select("label", "cell", F.ceil(F.col("members") / leaf_max).cast("int").alias("mc"), F.ceil(F.col("visitors") / leaf_max).cast("int").alias("vc"))
    tasks = rows.join(counts, ["label", "cell"])
    own = F.pmod(F.xxhash64("id"), F.when(F.col("kind") == 0, F.col("mc")).otherwise(F.col("vc"))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 0, F.col("vc")).otherwise(F.col("mc")) - 1))
    tasks = tasks.withColumn("own", own).withColumn("other", every).withColumns({
        "m": F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("other")),
        "s": F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("own"))})
    links = materialize(tasks.select("label", "cell", "m", "s", "kind", "id", "w", "vec").groupBy("label", "cell", "m", "s").applyInPandas(
        lambda pdf: link_groups(pdf, cosine), "id long, links long, joined long"), "links")
    roots = connected_components(links.select(F.col("id").alias("a"), F.col("joined").alias("b")), "vector-links")
    found = links.groupBy("id").agg((F.sum("links") - 1).alias("n_links"))
    found = found.join(roots, found.id == roots.node, "left").select(F.col("id").alias("rep"), "n_links", F.coalesce("root", "id").alias("component_id"))
    # Copies take their representative's figures; the keys stand for equal labels and vectors.
    keys = v.where("fine").groupBy("k1", "k2").agg(F.min("id").alias("rep")).join(found, "rep")
    rows = v.select("id", F.when(F.col("fine"), F.col("k1")).alias("k1"), F.when(F.col("fine"), F.col("k2")).alias("k2"))
    out = rows.join(keys, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("component_id", "id") == F.col("id")).alias("kept"))
