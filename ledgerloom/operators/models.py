"""Regressors and segments. Fits reduce the training table to sums in the cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import networks, trees
from .components import written
from .local import FITS, Forest, Network, fit_mlp, fit_trees  # noqa: F401
from .neighbours import _distances, _stack, cluster_distances, distances_to_clusters, nearest  # noqa: F401
from .ranks import medians
from .trees import Fit

#: Features of a linear fit or of principal components: one matrix of their square in the driver.
MAX_FEATURES = 6_000


def gram(df: DataFrame, x: str, y: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, A'A, A'y) with A = [x, 1]. Each task sums its own rows' products; the sums are added
    up row by row of the matrix in the cluster, so the driver gets one matrix, however many tasks
    there are. More than MAX_FEATURES features are refused."""
    def run(batches):
        total, n = None, 0
        for pdf in batches:
            if len(pdf):
                a = np.column_stack([np.stack(pdf[x].to_numpy()), np.ones(len(pdf)), pdf[y].to_numpy(float)]).astype(float)
                if a.shape[1] > MAX_FEATURES + 2:
                    raise ValueError(f"more than {MAX_FEATURES} features")
                total = a[:, :-1].T @ a if total is None else total + a[:, :-1].T @ a
                n += len(pdf)
        if n:
            yield pd.DataFrame({"row": np.arange(len(total)), "sums": list(total)})

    def add(pdf):
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "sums": [np.sum(np.stack(pdf["sums"]), axis=0)]})

    parts = df.select(x, y).mapInPandas(run, "row int, sums array<double>")
    summed = parts.groupBy("row").applyInPandas(add, "row int, sums array<double>").toPandas().sort_values("row")  # one row per feature
    if not len(summed):
        raise ValueError("no rows")
    both = np.stack(summed["sums"])
    return int(round(both[-1, -2])), both[:, :-1], both[:, -1]


class Linear:
    """Least squares with an intercept, minimum norm on a singular design; alpha > 0: ridge, the
    intercept free of penalty."""

    def __init__(self, alpha: float = 0.0):
        self.alpha = alpha

    def fit(self, df: DataFrame, x: str = "x", y: str = "y") -> Linear:
        n, xx, xy = gram(df, x, y)
        k = len(xy) - 1
        mean, ymean = xx[k, :k] / n, xy[k] / n
        centred = xx[:k, :k] - n * np.outer(mean, mean)
        target = xy[:k] - n * mean * ymean
        self.coef = np.linalg.solve(centred + self.alpha * np.eye(k), target) if self.alpha else np.linalg.pinv(centred, hermitian=True, rcond=1e-10) @ target
        self.intercept = float(ymean - mean @ self.coef)
        return self

    def predict(self, df: DataFrame, x: str = "x", name: str = "y_pred") -> DataFrame:
        w = F.array(*[F.lit(float(c)) for c in self.coef])
        dot = F.aggregate(F.zip_with(F.col(x), w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return df.withColumn(name, dot + F.lit(self.intercept))


class Median:
    def fit(self, df: DataFrame, x: str = "x", y: str = "y") -> Median:
        self.value = medians(df, [], [y]).first()[0]
        return self

    def predict(self, df: DataFrame, x: str = "x", name: str = "y_pred") -> DataFrame:
        return df.withColumn(name, F.lit(self.value))


# Trees and networks, fitted in the cluster.

def model_rows(df: DataFrame, id_col: str, folds: list) -> DataFrame:
    """key, y, folds, x: what fits read. folds: columns, one a scheme; null folds take no part."""
    schemes = F.array(*[F.coalesce(f.cast("int"), F.lit(-1)) for f in folds])
    return df.select(F.xxhash64(id_col).alias("key"), F.col("y").cast("double").alias("y"), schemes.alias("folds"), F.col("x").cast("array<double>").alias("x"))


def fit_all(rows: DataFrame, jobs: list[tuple[str, int, int, dict]], seed: int = 42) -> list:
    """A fitted model for each (model, scheme, held, options): on the rows whose fold in the scheme is
    neither negative nor held. All trees grow together, and all networks descend together."""
    out: list = [None] * len(jobs)
    for module, fit in ((trees, trees.grow_on), (networks, networks.descend)):
        mine = [i for i, (m, *_) in enumerate(jobs) if (m == "mlp") == (module is networks)]
        if mine:
            defaults = [networks.DEFAULTS if jobs[i][0] == "mlp" else trees.DEFAULTS[jobs[i][0]] for i in mine]
            for i, model in zip(mine, fit(rows, [Fit(jobs[i][1], jobs[i][2], d | jobs[i][3]) for i, d in zip(mine, defaults)], seed)):
                out[i] = model
    return out


def cross_validate(df: DataFrame, id_col: str, model: str, folds: int = 5, seed: int = 42, **options) -> DataFrame:
    """Out-of-fold predictions: id, fold, y_true, y_pred, model.

    df: id, x (array<double>, no nulls), y, cv_fold (null: no part). All folds are fitted in the
    same passes over the table, from sums in the cluster, for any number of rows.
    """
    fitted = fit_all(model_rows(df, id_col, [F.col("cv_fold")]), [(model, 0, f, options) for f in range(folds)], seed)
    shared = df.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def score(x: pd.Series, fold: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for f in fold.unique():
            mine = (fold == f).to_numpy()
            out[mine] = shared.value[int(f)](np.stack(x[mine].to_numpy()).astype(float))
        return pd.Series(out)

    held = df.where(F.col("cv_fold").between(0, folds - 1))
    return held.select(id_col, F.col("cv_fold").cast("int").alias("fold"), F.col("y").cast("double").alias("y_true"), score(F.col("x").cast("array<double>"), "cv_fold").alias("y_pred"), F.lit(model).alias("model"))


# Segments.

def pca(df: DataFrame, x: str, share: float = 0.9):
    """(mean, components): the fewest leading components that explain the share of variance;
    each component's largest loading is positive."""
    n, xx, _ = gram(df.withColumn("__y", F.lit(0.0)), x, "__y")
    k = len(xx) - 1
    mean = xx[k, :k] / n
    value, vector = np.linalg.eigh(xx[:k, :k] / n - np.outer(mean, mean))
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    take = int(np.searchsorted(np.cumsum(value) / value.sum(), share - 1e-12) + 1)
    parts = vector[:, :take].T
    return mean, parts * np.sign(parts[np.arange(take), np.abs(parts).argmax(axis=1)])[:, None]


def project(df: DataFrame, x: str, mean, parts, name: str = "scores") -> DataFrame:
    centred = F.zip_with(F.col(x).cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    dots = [F.aggregate(F.zip_with("__c", F.array(*[F.lit(float(v)) for v in p]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for p in parts]
    return df.withColumn("__c", centred).withColumn(name, F.array(*dots)).drop("__c")


def whole(x: str):
    """Whether a vector can take part: neither null nor with null or non-finite components."""
    return F.col(x).isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))


def distinct_points(df: DataFrame, x: str) -> DataFrame:
    """x, w: the different whole vectors and how often each occurs."""
    points = written(df.where(whole(x)).groupBy(F.col(x).cast("array<double>").alias("x")).agg(F.count("*").alias("w")), "points")
    one = points.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("z")).first()
    if not one.z:
        raise ValueError("no rows")
    if one.a != one.z:
        raise ValueError("vectors of different lengths")
    return points


def _draw(points: DataFrame, held: list[np.ndarray], step: int) -> list[np.ndarray]:
    """The next centre of each start: a row of the whole table, drawn in proportion to its squared
    distance from the nearest of the start's centres (the first: each row alike). Each row has an
    exponential time of that rate, by its hash, and the first one is drawn: one pass, no order of rows.
    A start that all rows lie on gets its first centre again."""
    def run(batches):
        best: dict = {}
        for b in batches:
            if b.num_rows:
                p, w = _stack(b.column(0)), b.column(1).to_numpy()
                u = (_stack(b.column(2)) + 0.5) / 2.0**53
                for s, c in enumerate(held):
                    rate = w * (nearest_of(p, c)[1] if len(c) else 1.0)
                    time = np.divide(-np.log(u[:, s]), rate, out=np.full(len(p), np.inf), where=rate > 0)
                    at = int(time.argmin())
                    if time[at] < best.get(s, (np.inf,))[0]:
                        best[s] = (float(time[at]), p[at].tolist())
        if best:
            yield pa.RecordBatch.from_pylist([{"s": s, "time": t, "x": x} for s, (t, x) in best.items()], pa.schema([("s", pa.int32()), ("time", pa.float64()), ("x", pa.list_(pa.float64()))]))

    keys = F.array(*[F.shiftrightunsigned(F.xxhash64("x", F.lit(s), F.lit(step)), 11).cast("double") for s in range(len(held))])
    first = points.select("x", "w", keys.alias("u")).mapInArrow(run, "s int, time double, x array<double>").groupBy("s").agg(F.min_by("x", F.struct("time", "x")).alias("x"))
    drawn = {r.s: np.array(r.x)[None, :] for r in first.collect()}  # a row for each start
    return [np.concatenate([c, drawn.get(s, c[:1])]) if len(c) else drawn[s] for s, c in enumerate(held)]


def nearest_of(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, the first of equally near ones, and its squared distance."""
    own, least = np.zeros(len(p), np.int64), np.zeros(len(p))
    for at in range(0, len(p), 512):
        d = _distances(p[at:at + 512], c)
        own[at:at + 512], least[at:at + 512] = d.argmin(axis=1), d.min(axis=1)
    return own, least


def _lloyd(points: DataFrame, starts: dict, rounds: int) -> dict:
    """key: (centres, their cost) for each key: centres. A round is one pass over the whole table for
    all keys; a task sends one matrix for each, added up in the cluster. A key whose cost no longer
    falls takes no part in further rounds."""
    centres, last, cost, active = dict(starts), dict(starts), {k: np.inf for k in starts}, list(starts)
    schema = "job int, sums array<double>"
    for _ in range(rounds):
        if not active:
            break

        def run(batches, now=[centres[k] for k in active]):
            sums = [np.zeros((len(c), c.shape[1] + 2)) for c in now]
            some = False
            for b in batches:
                if b.num_rows:
                    some, p, w = True, _stack(b.column(0)), b.column(1).to_numpy().astype(float)
                    wide = np.column_stack([w, w, w[:, None] * p])
                    for c, total in zip(now, sums):
                        own, d = nearest_of(p, c)
                        wide[:, 1] = w * d
                        held = np.zeros((len(p), len(c)))
                        held[np.arange(len(p)), own] = 1.0
                        total += held.T @ wide
            if some:  # a task may have no rows
                yield pa.RecordBatch.from_pydict({"job": pa.array(range(len(now)), pa.int32()), "sums": [t.ravel() for t in sums]})

        def add(pdf):
            return pd.DataFrame({"job": pdf["job"].iloc[:1], "sums": [np.sum(np.stack(pdf["sums"]), axis=0)]})

        got = {r.job: np.array(r.sums) for r in points.mapInArrow(run, schema).groupBy("job").applyInPandas(add, schema).collect()}  # a matrix for each key
        for job, k in enumerate(list(active)):
            total = got[job].reshape(len(centres[k]), -1)
            now = float(total[:, 1].sum())
            if now >= cost[k] - 1e-9:
                active.remove(k)
            else:
                new, some = centres[k].copy(), total[:, 0] > 0
                new[some] = total[some, 2:] / total[some, :1]
                last[k], centres[k], cost[k] = centres[k], new, now
    return {k: (last[k], cost[k]) for k in starts}


def kmeans(df: DataFrame, x: str, k: int, seeds: int = 10, rounds: int = 50):
    """(centres, their cost) of k clusters."""
    return kmeans_each(df, x, [k], seeds, rounds)[k]


def kmeans_each(df: DataFrame, x: str, ks: list[int], seeds: int = 10, rounds: int = 50) -> dict:
    """k: (centres, their cost). Several k-means++ starts and 20 of Lloyd's rounds for each, then
    further rounds from the best start, all of it over the whole table; rows alike are added up once.
    Vectors that aren't whole take no part."""
    points = distinct_points(df, x)
    held, starts = [np.zeros((0, 0))] * seeds, {}
    for step in range(max(ks)):
        held = _draw(points, held, step)
        starts |= {(step + 1, s): c for s, c in enumerate(held) if step + 1 in ks}
    tried = _lloyd(points, starts, 20)
    return _lloyd(points, {k: min((tried[k, s] for s in range(seeds)), key=lambda t: t[1])[0] for k in ks}, rounds)


def assign_clusters(df: DataFrame, x: str, centres, name: str = "cluster") -> DataFrame:
    d = [F.aggregate(F.zip_with(F.col(x).cast("array<double>"), F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b) for c in centres]
    return df.withColumn("__d", F.array(*d)).withColumn(name, (F.array_position("__d", F.array_min("__d")) - 1).cast("int")).drop("__d")


def silhouette(df: DataFrame, id_col: str, x: str, cluster: str) -> DataFrame:
    """id, cluster, silhouette (Euclidean) of all rows against all rows, in tiles. A cluster of one row
    scores 0, as do rows without a cluster or a vector, which count for no others."""
    rows = df.select(id_col, cluster, x)
    rows = written(rows, "silhouette")
    m, own = F.col("total") / F.col("n"), F.col("c") == F.col("other")
    means = cluster_distances(rows, id_col, x, cluster).groupBy(F.col("id").alias("__id")).agg(F.max(F.when(own, m)).alias("own"), F.min(F.when(~own, m)).alias("far"))
    score = F.when(F.col("own").isNull(), 0.0).otherwise((F.col("far") - F.col("own")) / F.greatest("own", "far"))
    return rows.join(means, F.col(id_col) == F.col("__id"), "left").select(id_col, cluster, score.alias("silhouette"))


def mean_silhouettes(df: DataFrame, x: str, fits: dict) -> DataFrame:
    """k, cost, silhouette for each k: (centres, cost): the mean silhouette of all whole vectors, each
    in the cluster of its nearest centre. All clusterings share one pass over the distances of all
    rows, in which rows alike are one row with their number. Null unless there are two clusters with
    rows or more, and fewer than rows."""
    first = dict(zip(fits, np.cumsum([0, *(len(c) for c, _ in fits.values())])))
    clusters = sum(len(c) for c, _ in fits.values())

    def assign(batches):
        for b in batches:
            if b.num_rows:
                p = _stack(b.column(2))
                own = np.column_stack([first[k] + nearest_of(p, c)[0] for k, (c, _) in fits.items()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, len(fits)), pa.int32()), pa.array(own.ravel(), pa.int32()))], ["id", "w", "p", "own"])

    points = distinct_points(df, x).select(F.monotonically_increasing_id().alias("id"), "w", F.col("x").alias("p"))
    rows = written(points.mapInArrow(assign, "id long, w long, p array<double>, own array<int>"), "assigned")
    held = {r.c: r.n for r in rows.select(F.explode("own").alias("c"), "w").groupBy("c").agg(F.sum("w").alias("n")).collect()}  # a row for each cluster
    means = []
    for i, k in enumerate(fits):
        mine = {c: held[c] for c in range(first[k], first[k] + len(fits[k][0])) if c in held}
        n, at = sum(mine.values()), F.get("own", F.lit(i))
        if not 2 <= len(mine) < n:
            means.append(F.lit(None).cast("double"))
            continue
        total = lambda c: F.get("sums", F.lit(c))
        own = F.coalesce(*[F.when(at == c, total(c) / (m - 1)) for c, m in mine.items() if m > 1])  # null in a cluster of one row, which scores 0
        far = F.array_min(F.array(*[F.when(at != c, total(c) / m) for c, m in mine.items()]))
        top = F.greatest(own, far)
        means.append(F.sum(F.when(top > 0, (far - own) / top).otherwise(0.0) * F.col("w")) / n)
    scores = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(fits[k][1])).alias("cost"), m.alias("silhouette")) for k, m in zip(fits, means)])
    return distances_to_clusters(rows, clusters).agg(scores.alias("s")).select(F.inline("s"))


def choose_k(scores: DataFrame) -> DataFrame:
    """scores (k, silhouette, ...) with chosen: true for the largest silhouette, the smallest k of
    equal ones; without a valid silhouette none is chosen."""
    valid = F.col("silhouette").isNotNull() & ~F.isnan("silhouette")
    best = scores.where(valid).orderBy(F.desc("silhouette"), "k").limit(1).select(F.col("k").alias("__k"))
    return scores.join(F.broadcast(best), F.col("k") == F.col("__k"), "left").withColumn("chosen", F.col("__k").isNotNull()).drop("__k")
