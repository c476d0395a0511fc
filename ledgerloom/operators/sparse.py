"""Ridge over sparse designs of numbers, categories and texts, by conjugate gradients in the cluster.

A row is written once, as the indices and values of its own features; what a training set decides
(medians, scales, levels, vocabularies, idf) is a set of column factors, and one row factor for
each text. So the designs of all folds, arms and penalties share the written rows: a round of all
their fits broadcasts their directions, each task adds up A'(A p) over its rows, the sums are added
up by fit in the cluster, and the driver, which holds vectors only, takes the steps.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize, tokens, unigrams_bigrams
from ..functions.values import strip
from .components import written
from .features import term_counts
from .ranks import medians

#: Levels of a category, and entries of a task's products that are held at once.
MAX_LEVELS, ENTRIES = 10_000, 1 << 21
#: Columns whose products with each other precondition a solution.
HEAVY = 256


@dataclass
class Design:
    """Columns of a ridge over numbers (median of the training rows where missing, with an
    indicator; scaled), categories (one column a level of the training rows, missing ones as
    Unknown) and texts (sanitised; the most frequent uni- and bigrams of the training rows, 1 + log
    tf by idf, of unit length). Every set of training rows, one for each held fold and one of all
    rows, has its own columns: a factor of 0 leaves one out."""
    numeric: list[str]
    categorical: list[str]
    texts: list[str]
    max_features: int = 5_000
    min_df: int = 1
    names: list[str] = field(default_factory=list)
    block: np.ndarray = None    # 0 for numbers and categories, 1 + i for text i
    factor: np.ndarray = None   # (set, column)
    fill: np.ndarray = None     # (set, numeric): what an indicator adds to its number
    centre: dict = field(default_factory=dict)
    folds: int = 0

    def fit(self, df: DataFrame, folds: int, fold: str = "cv_fold") -> Design:
        """The columns of each set: the rows of other folds than 0, 1, ..., and all rows."""
        self.folds, sets = folds, folds + 1
        df = df.where(F.col(fold).between(0, folds - 1))
        number = {c: F.col(c).cast("double") for c in self.numeric}
        known = {c: F.when(~F.isnan(x), x) for c, x in number.items()}
        level = {c: F.coalesce(F.nullif(strip(F.col(c).cast("string")), F.lit("")), F.lit("Unknown")) for c in self.categorical}
        rows = written(df.select(F.col(fold).alias("fold"), *[x.alias(c) for c, x in known.items()], *[x.alias(c) for c, x in level.items()], *[tokens(sanitize(F.col(c))).alias(c) for c in self.texts]), "design")
        names, block, factor, fill = [], [], [], np.zeros((sets, len(self.numeric)))
        other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda s: s != F.col("fold"))).alias("set")
        if self.numeric:
            one = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in self.numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in self.numeric]).first()
            self.centre = {c: (one[f"m_{c}"] or 0.0, one[f"s_{c}"] or 1.0) for c in self.numeric}
            many = rows.select("fold", *self.numeric).select(other, *self.numeric)
            middle = {r["set"]: r for r in medians(many, ["set"], self.numeric).collect()}  # a row for each set
            place = F.col("set")
            filled = []
            for c in self.numeric:
                case = F.lit(0.0)
                for s in range(sets):
                    case = F.when(place == s, F.lit(float(middle[s][c] or 0.0) if s in middle else 0.0)).otherwise(case)
                filled += [F.stddev_pop(F.coalesce(F.col(c), case)).alias(f"s_{c}"), F.avg(F.col(c).isNull().cast("double")).alias(f"p_{c}")]
            spread = {r["set"]: r for r in many.groupBy("set").agg(*filled).collect()}
            for j, c in enumerate(self.numeric):
                mean, std = self.centre[c]
                unit = np.array([(spread[s][f"s_{c}"] or 1.0) if s in spread else 1.0 for s in range(sets)])
                share = np.array([spread[s][f"p_{c}"] if s in spread else 0.0 for s in range(sets)])
                middle_s = np.array([float(middle[s][c] or 0.0) if s in middle else 0.0 for s in range(sets)])
                names += [c, f"{c}__missing"]
                block += [0, 0]
                flag = np.sqrt(share * (1 - share))
                factor += [std / unit, np.where(share > 0, 1 / np.where(flag > 0, flag, 1.0), 0.0)]
                fill[:, j] = (middle_s - mean) / unit
        for c in self.categorical:
            seen = rows.groupBy(F.col(c).alias("v")).agg(F.collect_set("fold").alias("folds")).orderBy("v").limit(MAX_LEVELS + 1).collect()
            if len(seen) > MAX_LEVELS:
                raise ValueError(f"{c} has more than {MAX_LEVELS} categories")
            for r in seen:
                names.append(f"{c}={r.v}")
                block.append(0)
                factor.append(np.array([float(any(f != s for f in r.folds)) for s in range(sets)]))
        for i, c in enumerate(self.texts):
            for term, weights in sorted(self._vocabulary(rows, c).items()):
                names.append(f"{c}:{term}")
                block.append(1 + i)
                factor.append(weights)
        self.names, self.block = names, np.array(block, np.int64)
        self.factor, self.fill = np.array(factor, float).T.reshape(sets, len(names)), fill
        return self

    def _vocabulary(self, rows: DataFrame, text: str) -> dict[str, np.ndarray]:
        """term to its idf in each set, 0 where a set leaves it out. Terms are counted in tasks, by
        fold, before they are shuffled; a set's counts are those of all folds but its own."""
        sets = self.folds + 1
        seen = term_counts(rows.select("fold", F.col(text).alias("w")), "fold")
        each = [F.sum(F.when(F.col("fold") == k, F.col(n))).alias(f"{n}{k}") for k in range(self.folds) for n in ("tf", "df")]
        terms = written(seen.groupBy("term").agg(*each).fillna(0), "terms")
        size = {r.fold: r.n for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
        out: dict[str, np.ndarray] = {}
        for s in range(sets):
            others = [k for k in range(self.folds) if k != s]
            total = lambda n: sum([F.col(f"{n}{k}") for k in others], F.lit(0))
            n = sum(size.get(k, 0) for k in others)
            top = terms.select("term", total("tf").alias("tf"), total("df").alias("df")).where(F.col("df") >= max(1, self.min_df)).orderBy(F.desc("tf"), "term").limit(self.max_features)
            for r in top.collect():  # at most max_features terms
                out.setdefault(r.term, np.zeros(sets))[s] = np.log((1 + n) / (1 + r.df)) + 1
        return out

    def rows(self, df: DataFrame, keep: list[str], y: str, fold: str = "cv_fold") -> DataFrame:
        """keep, y, fold, idx, val, length of each row, written: its own features and, for each text
        and set, the length of its weighted terms."""
        sets, index = self.folds + 1, {n: i for i, n in enumerate(self.names)}
        shared = df.sparkSession.sparkContext.broadcast((index, self.block, self.factor, self.centre))
        number = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"__n{i}") for i, c in enumerate(self.numeric)]
        level = [F.concat(F.lit(f"{c}="), F.coalesce(F.nullif(strip(F.col(c).cast("string")), F.lit("")), F.lit("Unknown"))).alias(f"__c{i}") for i, c in enumerate(self.categorical)]
        texts = [unigrams_bigrams(F.col(f"__w{i}")).alias(f"__t{i}") for i in range(len(self.texts))]
        words = df.withColumns({f"__w{i}": tokens(sanitize(F.col(c))) for i, c in enumerate(self.texts)}) if self.texts else df
        source = words.select(*keep, F.col(y).cast("double").alias("y"), F.when(F.col(fold).between(0, self.folds - 1), F.col(fold)).otherwise(-1).cast("int").alias("fold"), *number, *level, *texts)
        numeric, texts_, fields = self.numeric, self.texts, len(keep) + 2

        def run(batches):
            index, block, factor, centre = shared.value
            for batch in batches:
                columns = [batch.column(k).to_pylist() for k in range(fields, batch.num_columns)]
                ends, idx, val, length = [0], [], [], []
                for row in zip(*columns) if columns else [()] * batch.num_rows:
                    at, found = 0, []
                    for c in numeric:
                        x, (mean, std) = row[at], centre[c]
                        found.append((index[c], (x - mean) / std) if x is not None else (index[f"{c}__missing"], 1.0))
                        at += 1
                    while at < len(row) - len(texts_):
                        if row[at] in index:
                            found.append((index[row[at]], 1.0))
                        at += 1
                    norms = np.zeros((len(texts_), sets))
                    for i, c in enumerate(texts_):
                        mine = [(index[f"{c}:{t}"], 1 + np.log(n)) for t, n in Counter(row[at + i]).items() if f"{c}:{t}" in index]
                        if mine:
                            k, v = np.array([m[0] for m in mine]), np.array([m[1] for m in mine])
                            norms[i] = np.sqrt(((v * factor[:, k]) ** 2).sum(axis=1))
                        found += mine
                    found.sort()
                    idx += [k for k, _ in found]
                    val += [v for _, v in found]
                    ends.append(len(idx))
                    length.append(norms.ravel())
                lists = lambda v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v)
                wide = len(texts_) * sets
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, wide * batch.num_rows + 1, wide) if wide else np.zeros(batch.num_rows + 1), pa.int32()), pa.array(np.concatenate(length) if length and wide else np.zeros(0)))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(fields)], lists(pa.array(idx, pa.int32())), lists(pa.array(val, pa.float64())), flat], [*keep, "y", "fold", "idx", "val", "length"])

        types = dict(source.dtypes)
        return written(source.mapInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in keep], "y double, fold int, idx array<int>, val array<double>, length array<double>"])), "sparse")

    def raw(self, s: int, w: np.ndarray) -> np.ndarray:
        """What w over the columns of set s is over the written values."""
        out = w * self.factor[s]
        if self.numeric:
            at = np.arange(len(self.numeric)) * 2
            out[at + 1] += self.fill[s] * w[at]
        return out

    def back(self, s: int, g: np.ndarray) -> np.ndarray:
        """The transpose of raw."""
        out = g * self.factor[s]
        if self.numeric:
            at = np.arange(len(self.numeric)) * 2
            out[at] += self.fill[s] * g[at + 1]
        return out


@dataclass
class System:
    """A ridge of one set of training rows, one choice of texts and one penalty."""
    set: int
    texts: tuple[int, ...]
    alpha: float


def _pieces(batch, per_row: int):
    """Rows of a batch in parts whose entries times per_row are bounded: y, fold, starts, idx, val, length."""
    names = batch.schema.names
    column = lambda c: batch.column(names.index(c))
    y, fold, idx, val, length = (column(c) for c in ("y", "fold", "idx", "val", "length"))
    ends = np.cumsum([0, *idx.value_lengths().to_numpy()])
    y, fold, idx, val = y.to_numpy(zero_copy_only=False), fold.to_numpy(), idx.flatten().to_numpy(), val.flatten().to_numpy()
    wide = length.flatten().to_numpy().reshape(len(y), -1)
    at = 0
    while at < len(y):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + max(1, ENTRIES // max(1, per_row)), "right")) - 1)
        stop = min(stop, len(y))
        yield at, stop, y[at:stop], fold[at:stop], ends[at:stop + 1] - ends[at], idx[ends[at]:ends[stop]], val[ends[at]:ends[stop]], wide[at:stop]
        at = stop


def _entries(starts, idx, val, length, block, systems, sets):
    """(entries, systems): each entry's value in each system's design, before column factors."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    out = np.repeat(val[:, None], len(systems), axis=1)
    for t in range(length.shape[1] // sets):
        mine = block[idx] == 1 + t
        for k, system in enumerate(systems):
            if t not in system.texts:
                out[mine, k] = 0.0
            else:
                norm = length[row[mine], t * sets + system.set]
                out[mine, k] /= np.where(norm > 0, norm, np.inf)
    return row, out


def _by_row(values, starts, n):
    out = np.zeros((n, values.shape[1]))
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


def _sums(rows: DataFrame, design: Design, systems: list[System], per_system, size: int, per_row: int = 1) -> dict[int, np.ndarray]:
    """Each system's sum, over its training rows, of what per_system gives for a part of rows, which
    may hold per_row numbers for each entry and system."""
    shared = rows.sparkSession.sparkContext.broadcast((design.block, systems, design.folds + 1))

    def run(batches):
        block, systems, sets = shared.value
        total = np.zeros((len(systems), size))
        for batch in batches:
            for _, _, y, fold, starts, idx, val, length in _pieces(batch, len(systems) * per_row):
                row, e = _entries(starts, idx, val, length, block, systems, sets)
                train = (fold[:, None] >= 0) & (fold[:, None] != np.array([s.set for s in systems])[None, :])
                per_system(total, y, train, starts, row, idx, e)
        for k in np.flatnonzero(total.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([total[k].tobytes()], pa.binary())], ["k", "sums"])

    def add(table: pa.Table) -> pa.Table:
        g = sum(np.frombuffer(b, float) for b in table.column("sums").to_pylist())
        return pa.table({"k": table.column("k")[:1], "sums": pa.array([g.tobytes()], pa.binary())})

    got = rows.select("y", "fold", "idx", "val", "length").mapInArrow(run, "k int, sums binary").groupBy("k").applyInArrow(add, "k int, sums binary").collect()  # a vector for each system
    shared.unpersist()
    return {r.k: np.frombuffer(r.sums, float) for r in got}


def _scatter(idx, values, size: int) -> np.ndarray:
    """(size, systems): values added up by index."""
    out = np.zeros((size, values.shape[1]))
    if len(idx):
        order = np.argsort(idx, kind="stable")
        starts = np.flatnonzero(np.diff(idx[order], prepend=-1))
        out[idx[order][starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def _heavy(rows: DataFrame, design: Design, systems: list[System], scale: np.ndarray, mean: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each system its at most HEAVY heaviest columns, and the inverse of their normal matrix."""
    sets = sorted({s.set for s in systems})
    whole = [System(s, tuple(sorted({t for x in systems if x.set == s for t in x.texts})), 0.0) for s in sets]
    heavy, place = [], np.full((len(sets), len(design.names)), -1)
    for i, s in enumerate(sets):
        weight = np.max([scale[k] - x.alpha for k, x in enumerate(systems) if x.set == s], axis=0)
        top = {int(c) for c in np.argsort(-weight, kind="stable")[:HEAVY] if weight[c] > 0}
        top |= {c + 1 for c in top if c < 2 * len(design.numeric) and c % 2 == 0}  # a number's indicator adds to it
        heavy.append(np.array(sorted(top), np.int64))
        place[i, heavy[-1]] = np.arange(len(top))
    size = max([len(h) for h in heavy])

    def products(total, y, train, starts, row, idx, e):
        for i in range(len(sets)):
            mine = np.flatnonzero((place[i, idx] >= 0) & train[row, i])
            r, c, v = row[mine], place[i, idx[mine]], e[mine, i]
            count = np.bincount(r, minlength=len(y))[r]  # each entry meets all of its row
            first = np.searchsorted(r, r)
            a = np.repeat(np.arange(len(r)), count)
            b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            total[i] += np.bincount(c[a] * size + c[b], v[a] * v[b], size * size)

    got = _sums(rows, design, whole, products, size * size, HEAVY)
    out = []
    for k, system in enumerate(systems):
        i = sets.index(system.set)
        h, raw = heavy[i], got.get(i, np.zeros(size * size)).reshape(size, size)[:len(heavy[i]), :len(heavy[i])]
        m = np.diag(design.factor[system.set][h])
        for j in range(len(design.numeric)):
            if place[i, 2 * j] >= 0:
                m[place[i, 2 * j + 1], place[i, 2 * j]] += design.fill[system.set][j]
        normal = m.T @ raw @ m - n[k] * np.outer(mean[k][h], mean[k][h])
        own = np.flatnonzero(np.isin(design.block[h], [0, *[1 + t for t in system.texts]]) & (design.factor[system.set][h] != 0))
        part = (normal + normal.T)[np.ix_(own, own)] / 2 + system.alpha * np.eye(len(own))
        out.append((h[own], np.linalg.inv(part)))
    return out


def solve(rows: DataFrame, design: Design, systems: list[System], tolerance: float = 1e-12, rounds: int = 1_000) -> list[tuple[np.ndarray, float]]:
    """(weights over the written values, intercept) of each system's ridge; the intercept is free of
    penalty. Conjugate gradients until each residual is below tolerance times its right side; what
    preconditions them is the normal matrix of the heaviest columns, and its diagonal for the others."""
    d, m = len(design.names), len(systems)
    inside = [np.isin(design.block, [0, *[1 + t for t in s.texts]]) & (design.factor[s.set] != 0) for s in systems]

    def first(total, y, train, starts, row, idx, e):
        """n, sum of y, X'1, X'y and squares, per system."""
        total[:, 0] += train.sum(axis=0)
        total[:, 1] += (train * y[:, None]).sum(axis=0)
        some = e * train[row]
        total[:, 2:2 + d] += _scatter(idx, some, d).T
        total[:, 2 + d:2 + 2 * d] += _scatter(idx, some * y[row, None], d).T
        total[:, 2 + 2 * d:] += _scatter(idx, some * some, d).T

    start = _sums(rows, design, systems, first, 2 + 3 * d)
    if len(start) < m or any(start[k][0] < 1 for k in range(m)):
        raise ValueError("a training set without rows")
    n = np.array([start[k][0] for k in range(m)])
    y_mean = np.array([start[k][1] for k in range(m)]) / n
    mean, right, scale = np.zeros((m, d)), np.zeros((m, d)), np.ones((m, d))
    for k, s in enumerate(systems):
        ones, xy, square = start[k][2:2 + d], start[k][2 + d:2 + 2 * d], start[k][2 + 2 * d:]
        mean[k] = design.back(s.set, ones) / n[k]
        right[k] = np.where(inside[k], design.back(s.set, xy) - n[k] * mean[k] * y_mean[k], 0.0)
        diagonal = square * design.factor[s.set] ** 2
        if design.numeric:
            at = np.arange(len(design.numeric)) * 2
            diagonal[at] += square[at + 1] * design.fill[s.set] ** 2
        scale[k] = np.maximum(diagonal - n[k] * mean[k] ** 2, 0.0) + s.alpha
    blocks = _heavy(rows, design, systems, scale, mean, n)

    def eased(k, r):
        z = r / scale[k]
        z[blocks[k][0]] = blocks[k][1] @ r[blocks[k][0]]
        return z

    w, r = np.zeros((m, d)), right.copy()
    z = np.stack([eased(k, r[k]) for k in range(m)])
    p, rz = z.copy(), (r * z).sum(axis=1)
    goal = tolerance * np.linalg.norm(right, axis=1)
    for _ in range(rounds):
        open_ = np.flatnonzero(np.linalg.norm(r, axis=1) > goal)
        if not len(open_):
            break
        some = [systems[k] for k in open_]
        raw = rows.sparkSession.sparkContext.broadcast(np.stack([design.raw(systems[k].set, p[k]) for k in open_], axis=1))

        def product(total, y, train, starts, row, idx, e):
            u = _by_row(e * raw.value[idx], starts, len(y)) * train
            total += _scatter(idx, e * u[row], d).T

        got = _sums(rows, design, some, product, d)
        raw.unpersist()
        for j, k in enumerate(open_):
            s = systems[k]
            q = design.back(s.set, got.get(j, np.zeros(d))) - n[k] * mean[k] * (mean[k] @ p[k]) + s.alpha * p[k]
            q = np.where(inside[k], q, 0.0)
            step = rz[k] / (p[k] @ q)
            w[k] += step * p[k]
            r[k] -= step * q
            new = eased(k, r[k])
            beta = (r[k] @ new) / rz[k]
            rz[k] = r[k] @ new
            p[k] = new + beta * p[k]
    else:
        raise ValueError(f"no solution in {rounds} rounds")
    return [(design.raw(s.set, w[k]), float(y_mean[k] - mean[k] @ w[k])) for k, s in enumerate(systems)]


def predict(rows: DataFrame, design: Design, system: System, fitted: tuple[np.ndarray, float], keep: list[str], name: str = "y_pred") -> DataFrame:
    """keep, y, fold and the system's predictions of written rows, whichever fold they are of."""
    shared = rows.sparkSession.sparkContext.broadcast((design.block, fitted, design.folds + 1))
    types = dict(rows.dtypes)

    def run(batches):
        block, (weights, intercept), sets = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, stop, y, _, starts, idx, val, length in _pieces(batch, 1):
                _, e = _entries(starts, idx, val, length, block, [system], sets)
                out[at:stop] = _by_row(e * weights[idx, None], starts, len(y))[:, 0] + intercept
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(k)) for k in keep], batch.column(batch.schema.names.index("y")), batch.column(batch.schema.names.index("fold")), pa.array(out)], [*keep, "y", "fold", name])

    return rows.mapInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in keep], f"y double, fold int, {name} double"]))


def arm_choices(rows: DataFrame, design: Design, arms: dict[str, list[str]], alphas: list[float]) -> list[tuple]:
    """(model, alpha, mae_mean, mae_std, arm_choice, selected) of each arm and penalty over written
    rows, all fitted together on the other folds."""
    if not arms or not alphas or len(set(alphas)) != len(alphas) or any(not a > 0 for a in alphas):
        raise ValueError("arms and different positive alphas are asked for")
    grid = [(arm, a, f) for arm in arms for a in alphas for f in range(design.folds)]
    systems = [System(f, tuple(design.texts.index(t) for t in arms[arm]), a) for arm, a, f in grid]
    errors = _held_errors(rows, design, systems, solve(rows, design, systems))
    scores: dict[tuple[str, float], list[float]] = {}
    for (arm, a, _), e in zip(grid, errors):
        scores.setdefault((arm, a), []).append(e)
    table = [(arm, a, float(np.mean(e)), float(np.std(e))) for (arm, a), e in scores.items()]
    choice = {arm: min((r for r in table if r[0] == arm), key=lambda r: (r[2], r[3], alphas.index(r[1]))) for arm in arms}
    best = min(choice.values(), key=lambda r: (r[2], r[3], list(arms).index(r[0])))
    return [(*r, r == choice[r[0]], r == best) for r in table]


GRID = "model string, alpha double, mae_mean double, mae_std double, arm_choice boolean, selected boolean"


def text_ridge_grid(df: DataFrame, design: Design, arms: dict[str, list[str]], alphas: list[float], y: str, fold: str = "cv_fold", folds: int = 5) -> DataFrame:
    """model (arm), alpha, mae_mean, mae_std (over the folds, population), arm_choice, selected.

    arms: name to the texts that join the structured columns, in order of preference. Everything is
    fitted on the other folds' rows. An arm chooses by the least mean, then deviation, then the
    order of alphas; of the choices the best by the same, then the order of arms, is selected.
    """
    design.fit(df, folds, fold)
    return df.sparkSession.createDataFrame(arm_choices(design.rows(df, [], y, fold), design, arms, alphas), GRID)


def _held_errors(rows: DataFrame, design: Design, systems: list[System], fitted: list) -> list[float]:
    """Each system's mean absolute error on its held fold, in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast((design.block, systems, np.stack([w for w, _ in fitted], axis=1), np.array([b for _, b in fitted]), design.folds + 1))

    def run(batches):
        block, systems, weights, intercepts, sets = shared.value
        n, total, own = np.zeros(len(systems), np.int64), np.zeros(len(systems)), np.array([s.set for s in systems])
        for batch in batches:
            for _, _, y, fold, starts, idx, val, length in _pieces(batch, len(systems)):
                _, e = _entries(starts, idx, val, length, block, systems, sets)
                off = np.abs(_by_row(e * weights[idx], starts, len(y)) + intercepts - y[:, None])
                held = fold[:, None] == own[None, :]
                n += held.sum(axis=0)
                total += (off * held).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(systems)), pa.int32()), pa.array(n), pa.array(total)], ["k", "n", "e"])

    got = rows.select("y", "fold", "idx", "val", "length").mapInArrow(run, "k int, n long, e double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).collect()  # a row for each system
    by = {r.k: r.e / r.n if r.n else float("nan") for r in got}
    return [by[k] for k in range(len(systems))]
