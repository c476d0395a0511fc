"""Nested grouped model search, with a selection that is sealed before any test row is scored."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import written
from .models import FITS, MAX_FEATURES, fit_all, model_rows
from .split import group_folds


def check_candidates(candidates: list[tuple[str, dict]], most: int = 12) -> None:
    keys = [json.dumps(c, sort_keys=True) for c in candidates]
    if not 0 < len(keys) <= most or len(set(keys)) != len(keys):
        raise ValueError(f"1 to {most} different candidates are asked for")
    for model, options in candidates:
        if model not in FITS or options.get("trees", 1) > 500 or options.get("epochs", 1) > 1000:
            raise ValueError(f"not a candidate: {(model, options)}")


def fold_grams(df: DataFrame, x: str, y: str, fold: str) -> dict[int, np.ndarray]:
    """[x, 1]'[x, 1, y] of the rows of each fold: one pass, sums added up in the cluster."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for f, some in pdf.groupby(fold):
                a = np.column_stack([np.stack(some[x].to_numpy()), np.ones(len(some)), some[y].to_numpy(float)]).astype(float)
                if a.shape[1] > MAX_FEATURES + 2:
                    raise ValueError(f"more than {MAX_FEATURES} features")
                total[f] = total.get(f, 0) + a[:, :-1].T @ a
        for f, sums in total.items():
            yield pd.DataFrame({"fold": np.full(len(sums), f), "row": np.arange(len(sums)), "sums": list(sums)})

    def add(pdf):
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "row": pdf["row"].iloc[:1], "sums": [np.sum(np.stack(pdf["sums"]), axis=0)]})

    schema = "fold int, row int, sums array<double>"
    got = df.select(x, y, F.col(fold).cast("int").alias(fold)).mapInPandas(run, schema).groupBy("fold", "row").applyInPandas(add, schema).toPandas()
    return {int(f): np.stack(g.sort_values("row")["sums"]) for f, g in got.groupby("fold")}


def ridge(both: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept (free of penalty) from [x, 1]'[x, 1, y]."""
    k, n = len(both) - 1, both[-1, -2]
    mean, ymean = both[k, :k] / n, both[k, -1] / n
    centred, target = both[:k, :k] - n * np.outer(mean, mean), both[:k, -1] - n * mean * ymean
    coef = np.linalg.solve(centred + alpha * np.eye(k), target) if alpha else np.linalg.pinv(centred, hermitian=True, rcond=1e-10) @ target
    return coef, float(ymean - mean @ coef)


def ridge_grid(df: DataFrame, arms: dict[str, str], alphas: list[float], y: str, fold: str) -> DataFrame:
    """model (arm), alpha, mae_mean, mae_std (over the folds, population), arm_choice, selected.

    arms: name to an array<double> column of df, in order of preference. The other folds' sums
    are all sums without a fold's own, so each arm takes one pass for all folds and alphas, and
    one pass scores them. An arm chooses by the least mean, then the least deviation, then the
    order of alphas; of the arms' choices the best by the same, then the order of arms, is
    selected.
    """
    if not arms or not alphas or len(set(alphas)) != len(alphas) or any(a < 0 for a in alphas):
        raise ValueError("arms and different alphas from 0 are asked for")
    rows = []
    for at, (arm, x) in enumerate(arms.items()):
        grams = fold_grams(df, x, y, fold)
        if len(grams) < 2:
            raise ValueError("fewer than two folds")
        every = sum(grams.values())
        fits = {(f, a): ridge(every - own, alpha) for f, own in grams.items() for a, alpha in enumerate(alphas)}
        errors = F.lit(None).cast("array<double>")
        for f in grams:
            dot = lambda w: F.aggregate(F.zip_with(F.col(x), F.array(*[F.lit(float(c)) for c in w]), lambda u, v: u * v), F.lit(0.0), lambda u, v: u + v)
            errors = F.when(F.col(fold) == f, F.array(*[F.abs(dot(fits[f, a][0]) + fits[f, a][1] - F.col(y)) for a in range(len(alphas))])).otherwise(errors)
        per = df.select(fold, F.posexplode(errors).alias("a", "e")).groupBy(fold, "a").agg(F.avg("e").alias("mae"))
        for r in per.groupBy("a").agg(F.avg("mae").alias("m"), F.stddev_pop("mae").alias("s")).collect():  # a row per alpha
            rows.append((arm, alphas[r.a], r.m, r.s, at, r.a))
    choices = {min((r for r in rows if r[4] == at), key=lambda r: (r[2], r[3], r[5])) for at in range(len(arms))}
    best = min(choices, key=lambda r: (r[2], r[3], r[4]))
    return df.sparkSession.createDataFrame([(*r[:4], r in choices, r == best) for r in sorted(rows, key=lambda r: r[4:])], "model string, alpha double, mae_mean double, mae_std double, arm_choice boolean, selected boolean")


def nested_search(df: DataFrame, candidates: list[tuple[str, dict]], group: str, outer: int = 5, inner: int = 3, seed: int = 42) -> DataFrame:
    """model, context (outer fold, or -1 for the selection on all rows), candidate, mae, chosen,
    outer_mae.

    df: id, x, y, cv_fold and the group. For each model and outer fold, inner group folds of the
    other rows choose a candidate by the least (mean, deviation, place), which is scored, fitted on
    all those rows, on the outer fold; then the outer folds choose among all candidates. Every
    fit of every context is a mask over one table, and all grow in the same passes.
    """
    check_candidates(candidates)
    id_col = df.columns[0]
    rows, schemes = df, [F.col("cv_fold")]
    for o in range(outer):
        name = f"__inner{o}"
        part = group_folds(df.where(F.col("cv_fold") != o), group, inner).select(F.col(group).alias(f"__g{o}"), F.col("cv_fold").alias(name))
        rows = rows.join(part, F.col(group) == F.col(f"__g{o}"), "left").drop(f"__g{o}")
        schemes.append(F.when(F.col("cv_fold") != o, F.col(name)))
    rows = written(model_rows(rows, id_col, schemes), "nested")
    jobs = [(m, scheme, held, options) for m, options in candidates for scheme, held in [*[(0, f) for f in range(outer)], *[(1 + o, i) for o in range(outer) for i in range(inner)]]]
    fitted = fit_all(rows, jobs, seed)
    errors = held_errors(rows, [(scheme, held, model) for (_, scheme, held, _), model in zip(jobs, fitted)])
    mae = {}
    each = len(jobs) // len(candidates)
    for k, (_, scheme, held, _) in enumerate(jobs):
        if k in errors:
            mae.setdefault((k // each, scheme), {})[held] = errors[k]
    out = []
    for model in sorted({m for m, _ in candidates}):
        mine = [c for c, (m, _) in enumerate(candidates) if m == model]
        for context in [*range(outer), -1]:
            scores = {c: list(mae[c, 1 + context].values()) for c in mine}
            best = min(mine, key=lambda c: (np.mean(scores[c]), np.std(scores[c]), c))
            out += [(model, context, c, float(np.mean(scores[c])), c == best, mae[c, 0][context] if c == best and context >= 0 else None) for c in mine]
    return df.sparkSession.createDataFrame(out, "model string, context int, candidate int, mae double, chosen boolean, outer_mae double")


def held_errors(rows: DataFrame, models: list[tuple[int, int, object]]) -> dict[int, float]:
    """Mean absolute error of each (scheme, held, model) on the rows that it left out, in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        n, total = np.zeros(len(models), np.int64), np.zeros(len(models))
        for batch in batches:
            y, x = batch.column(0).to_numpy(), np.stack(batch.column(2).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1))
            folds = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1))
            for k, (scheme, held, model) in enumerate(shared.value):
                mine = folds[:, scheme] == held if len(folds) else np.zeros(0, bool)
                if mine.any():
                    n[k] += mine.sum()
                    total[k] += np.abs(model(x[mine]) - y[mine]).sum()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some])], ["k", "n", "e"])

    got = rows.select("y", "folds", "x").mapInArrow(run, "k int, n long, e double").groupBy("k").agg((F.sum("e") / F.sum("n")).alias("mae")).collect()  # a row per model
    return {r.k: r.mae for r in got}


@dataclass(frozen=True)
class Choice:
    """A sealed selection. score_test asks for one, so no test row is scored before."""
    model: str
    options: str
    seal: str

    @staticmethod
    def of(model: str, options: dict) -> Choice:
        text = json.dumps(options, sort_keys=True)
        return Choice(model, text, hashlib.sha256(f"{model}:{text}".encode()).hexdigest())


def score_test(train: DataFrame, test: DataFrame, choice: Choice, id_col: str, seed: int = 42) -> DataFrame:
    """id, y_true, y_pred of the test rows by the chosen model, refitted on all training rows."""
    if Choice.of(choice.model, json.loads(choice.options)).seal != choice.seal:
        raise ValueError("the choice isn't the sealed one")
    model = fit_all(model_rows(train, id_col, [F.lit(0)]), [(choice.model, 0, -1, json.loads(choice.options))], seed)[0]
    scored = model.predict(test.select(id_col, F.col("x").cast("array<double>").alias("x"), "y"))
    return scored.select(id_col, F.col("y").cast("double").alias("y_true"), "y_pred")
