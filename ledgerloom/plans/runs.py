"""Training and evaluation runs over a cleaned dataset and its frozen split.

A run is a folder: config.json, cv_selection.json (the choice, written before any test row is
scored), folds, predictions, metrics, subgroup_errors and large_errors as tables, a bundle for each
model that can hold itself, and run_metadata.json with the hashes of what it was made from and made.
A folder that exists is refused.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, models, serve, sparse
from ..operators.components import written
from ..operators.features import Preprocessor, refuse_dense, select_predictors
from ..operators.joins import one_to_one
from ..sources import files, sinks

# Fixed values of the modelling contract.
NUMERIC = ["model_year", "displacement_l", "cylinders"]
CATEGORICAL = ["manufacturer", "transmission", "drivetrain", "vehicle_class"]
TARGET = "target_l100km"
MIDTERM = ["dummy", "linear", "knn", "tree"]
ALPHAS = [0.1, 1.0, 10.0, 100.0]
FOLDS = 5


def _framed(spark: SparkSession, dataset: str, manifest: str) -> DataFrame:
    """The dataset with split and cv_fold of its manifest, one to one; a target that isn't finite and
    positive raises."""
    df = files.dataset(spark, dataset, "vehicle_id").drop("split", "cv_fold", "model_group")
    m = spark.read.parquet(manifest).select("vehicle_id", "model_group", "split", "cv_fold")
    y = F.col(TARGET).cast("double")
    fine = (y > 0) & (y < float("inf"))
    joined = one_to_one(df, m, ["vehicle_id"])
    return written(joined.withColumn("y", F.when(fine, y).otherwise(F.raise_error(F.lit("a target isn't finite and positive")).cast("double"))), "run")


def _opened(out: str) -> Path:
    folder = Path(out)
    if folder.exists():
        raise ValueError(f"{out} exists; choose another run")
    folder.mkdir(parents=True)
    return folder


def _prepared(train: DataFrame) -> tuple[Preprocessor, DataFrame]:
    """The preprocessing of training rows, and those rows after it."""
    p = Preprocessor(NUMERIC, CATEGORICAL).fit(train)
    return p, written(p.vector(train, ["vehicle_id", "y"]), "features")


def _fitted(kind: str, p: Preprocessor, x: DataFrame, seed: int):
    """(predict, model): a function of a table, and the model where it can be saved."""
    if kind == "knn":
        return lambda df: models.nearest(x, p.vector(df, ["vehicle_id"]), "vehicle_id", "x", "y"), None
    if kind == "tree":
        model = models.fit_all(models.model_rows(x, "vehicle_id", [F.lit(0)]), [("tree", 0, -1, {})], seed)[0]
    else:
        model = (models.Median() if kind == "dummy" else models.Linear()).fit(x)
    return lambda df: model.predict(p.vector(df, ["vehicle_id"])).select("vehicle_id", "y_pred"), model


def _predicted(df: DataFrame, predict, model: str, split: str, fold: int | None = None) -> DataFrame:
    both = df.select("vehicle_id", "y").join(predict(df), "vehicle_id")
    return evaluate.prediction_rows(both, "vehicle_id", "y", "y_pred", model, split, None if fold is None else F.lit(fold).cast("int"))


def _closed(folder: Path, stage: str, selected: str, frame: DataFrame, dataset: str, manifest: str, predictions: DataFrame, extra: dict) -> dict:
    hashes = {"predictions": sinks.write_table(predictions, f"{folder}/predictions")}
    spark = frame.sparkSession
    kept = spark.read.parquet(f"{folder}/predictions.parquet")
    of = kept.withColumn("part", F.when(F.col("split") == "test", "test").otherwise("train_oof"))
    hashes["metrics"] = sinks.write_table(evaluate.metrics(of, ["model", "part"]), f"{folder}/metrics")
    meta = {"stage": stage, "status": "completed", "selected_model": selected, "selection_source": "train_group_cv", "test_used_for_selection": False, "n_train": frame.where("split = 'train'").count(), "n_test": frame.where("split = 'test'").count(),
            "dataset": str(Path(dataset).absolute()), "dataset_hash": sinks.content_hash(spark.read.parquet(dataset)), "manifest_hash": sinks.content_hash(spark.read.parquet(manifest)), "hashes": hashes, **extra}
    sinks.write_json(folder / "run_metadata.json", meta)
    evaluate_run(spark, str(folder), dataset)
    return meta


def train(spark: SparkSession, dataset: str, manifest: str, out: str, seed: int = 42) -> dict:
    """The midterm comparison: out-of-fold predictions of MIDTERM, each fold's preprocessing fitted on
    its training rows; the least (mean, deviation, place) is selected and sealed, then all models
    are refitted on all training rows and score the test rows once."""
    folder = _opened(out)
    frame = select_predictors(_framed(spark, dataset, manifest), NUMERIC, CATEGORICAL, ["vehicle_id", "y", "split", "cv_fold"])
    known = written(frame.where("split = 'train'"), "train")
    refuse_dense(known, NUMERIC, CATEGORICAL)
    sinks.write_json(folder / "config.json", {"models": MIDTERM, "numeric": NUMERIC, "categorical": CATEGORICAL, "seed": seed, "folds": FOLDS})
    held = []
    for fold in range(FOLDS):
        own, prepared = known.where(F.col("cv_fold") == fold), _prepared(known.where(F.col("cv_fold") != fold))
        for kind in MIDTERM:
            held.append(written(_predicted(own, _fitted(kind, *prepared, seed)[0], kind, "train_oof", fold), "oof"))
    oof = reduce(DataFrame.unionByName, held)
    folds = written(evaluate.metrics(oof, ["model", "fold"]), "folds")
    sinks.write_table(folds, f"{folder}/fold_metrics")
    summary = evaluate.fold_summary(folds)
    selected = evaluate.winner(summary, MIDTERM).first()[0]
    sinks.write_json(folder / "cv_selection.json", {"selected_model": selected, "cv": {r.model: [r.cv_mean, r.cv_std] for r in summary.collect()}, "test_evaluation_started": False})
    bundles, prepared = {}, _prepared(known)
    for kind in MIDTERM:
        predict, model = _fitted(kind, *prepared, seed)
        if model:
            bundles[kind] = serve.save_bundle(folder / kind, model, prepared[0], {"model": kind, "stage": "midterm"})
        held.append(written(_predicted(frame.where("split = 'test'"), predict, kind, "test"), "test"))
    return _closed(folder, "midterm", selected, frame, dataset, manifest, reduce(DataFrame.unionByName, held), {"bundles": bundles})


def final(spark: SparkSession, dataset: str, manifest: str, out: str, alphas: list[float] | None = None) -> dict:
    """The final comparison: ridges of all text arms and penalties on the same folds; the choice is
    sealed, then each arm's choice is refitted on all training rows and scores the test rows. Paired
    differences to the structured arm describe the test rows and choose nothing."""
    alphas = alphas or ALPHAS
    folder = _opened(out)
    texts = ["model_name", "engine_description"]
    frame = _framed(spark, dataset, manifest)
    checked = select_predictors(frame, NUMERIC, CATEGORICAL, ["vehicle_id", "y", "split", "cv_fold", *texts])
    known = written(checked.where("split = 'train'"), "train")
    sinks.write_json(folder / "config.json", {"arms": serve.ARMS, "alphas": alphas, "numeric": NUMERIC, "categorical": CATEGORICAL, "folds": FOLDS})
    design = sparse.Design(NUMERIC, CATEGORICAL, texts).fit(known, FOLDS)
    rows = design.rows(known, ["vehicle_id"], "y")
    grid = sparse.arm_choices(rows, design, serve.ARMS, alphas)
    sinks.write_table(spark.createDataFrame(grid, sparse.GRID), f"{folder}/cv_grid_metrics")
    chosen = {r[0]: r[1] for r in grid if r[4]}
    selected = next(r[0] for r in grid if r[5])
    sinks.write_json(folder / "cv_selection.json", {"selected_model": selected, "arm_choices": chosen, "test_evaluation_started": False})
    arms = {arm: tuple(design.texts.index(t) for t in serve.ARMS[arm]) for arm in serve.ARMS}
    systems = [(arm, fold, sparse.System(FOLDS if fold is None else fold, arms[arm], chosen[arm])) for arm in arms for fold in [*range(FOLDS), None]]
    fitted = sparse.solve(rows, design, [s for *_, s in systems])
    test = design.rows(checked.where("split = 'test'"), ["vehicle_id"], "y")
    held = []
    for (arm, fold, system), fit in zip(systems, fitted):
        source = test if fold is None else rows.where(F.col("fold") == fold)
        out_ = sparse.predict(source, design, system, fit, ["vehicle_id"])
        held.append(evaluate.prediction_rows(out_, "vehicle_id", "y", "y_pred", arm, "test" if fold is None else "train_oof", None if fold is None else F.lit(fold).cast("int")))
    predictions = written(reduce(DataFrame.unionByName, held), "predictions")
    wide = evaluate.paired(predictions.where("split = 'test'"), "vehicle_id", list(arms))
    sinks.write_table(evaluate.paired_delta(wide, "structured", [a for a in arms if a != "structured"]), f"{folder}/paired_comparison")
    return _closed(folder, "final", selected, frame, dataset, manifest, predictions, {"alphas": chosen})


def evaluate_run(spark: SparkSession, run: str, dataset: str | None = None) -> int:
    """Rebuild a run's error tables from its saved predictions, if those and the dataset are the ones it
    was made of; nothing is fitted. Returns the number of prediction rows."""
    folder = Path(run)
    meta = json.loads((folder / "run_metadata.json").read_text())
    kept, data = spark.read.parquet(f"{folder}/predictions.parquet"), spark.read.parquet(dataset or meta["dataset"])
    if sinks.content_hash(kept) != meta["hashes"]["predictions"]:
        raise ValueError("the predictions aren't the run's")
    if sinks.content_hash(data) != meta["dataset_hash"]:
        raise ValueError("the dataset isn't the run's")
    both = kept.join(data.select("vehicle_id", "vehicle_class", "manufacturer"), "vehicle_id")
    for name, table in (("subgroup_errors", evaluate.subgroup_errors(both, ["model", "split"], "vehicle_class")), ("large_errors", evaluate.top_errors(both.where("split = 'test'"), "vehicle_id"))):
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return kept.count()
