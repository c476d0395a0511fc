"""Regression metrics, subgroup errors, folds, winners and paired comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import medians


def prediction_rows(df: DataFrame, id_col: str, truth: str, predicted: str, model: str, split: str, fold=None) -> DataFrame:
    """Long rows: id, split, fold, y_true, y_pred, residual (predicted - true), abs_error, model."""
    return df.select(F.col(id_col), F.lit(split).alias("split"), (F.lit(None).cast("int") if fold is None else fold).alias("fold"), F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred"),
                     (F.col(predicted) - F.col(truth)).alias("residual"), F.abs(F.col(predicted) - F.col(truth)).alias("abs_error"), F.lit(model).alias("model"))


def metrics(df: DataFrame, by: list[str], truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """n, mae, rmse and r2 per group, in one aggregate. r2 is null for fewer than two rows; for
    a constant truth it is 1 if all errors are zero, else 0."""
    y, e = F.col(truth), F.col(predicted) - F.col(truth)
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("v"))
    r2 = F.when(F.col("n") < 2, None).when(F.col("v") == 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide("mse", "v"))
    return out.select(*by, "n", "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def subgroup_errors(df: DataFrame, by: list[str], label: str, small: int = 30) -> DataFrame:
    """by, subgroup, n, mae, rmse, median_absolute_error, bias, small_support."""
    e = F.col("residual")
    rows = df.select(*by, F.col(label).alias("subgroup"), e.alias("__e"), F.abs(e).alias("__abs"))
    means = rows.groupBy(*by, "subgroup").agg(F.count("*").alias("n"), F.avg("__abs").alias("mae"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), F.avg("__e").alias("bias"), (F.count("*") < small).alias("small_support"))
    keys = [*by, "subgroup"]
    middle = medians(rows, keys, ["__abs"]).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col("__abs").alias("median_absolute_error"))
    return means.join(middle, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]).select(*keys, "n", "mae", "rmse", "median_absolute_error", "bias", "small_support")


def top_errors(df: DataFrame, id_col: str, k: int = 10) -> DataFrame:
    """The k largest absolute errors of each model, ties by id."""
    order = Window.partitionBy("model").orderBy(F.desc("abs_error"), id_col)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def fold_summary(folds: DataFrame) -> DataFrame:
    """model, mean and population standard deviation of the folds' mae (not pooled)."""
    return folds.groupBy("model").agg(F.avg("mae").alias("cv_mean"), F.stddev_pop("mae").alias("cv_std"))


def winner(summary: DataFrame, declared: list[str]) -> DataFrame:
    """The model with the least (mean, std, declared place)."""
    place = F.array_position(F.array(*map(F.lit, declared)), F.col("model"))
    return summary.agg(F.min_by("model", F.struct("cv_mean", "cv_std", place)).alias("model"))


def improvement(summary: DataFrame, baseline: str) -> DataFrame:
    """model, improvement_pct of cv_mean over the baseline model's."""
    base = summary.where(F.col("model") == baseline).select(F.col("cv_mean").alias("b"))
    return summary.crossJoin(F.broadcast(base)).select("model", (100 * F.try_divide(F.col("b") - F.col("cv_mean"), F.col("b"))).alias("improvement_pct"))


def paired(df: DataFrame, id_col: str, models: list[str]) -> DataFrame:
    """id and a column of abs_error per model; ids that lack a model raise when evaluated."""
    wide = df.groupBy(id_col).pivot("model", models).agg(F.first("abs_error"))
    full = F.lit(True)
    for m in models:
        full = full & F.col(f"`{m}`").isNotNull()
    return wide.select(id_col, *[F.when(full, F.col(f"`{m}`")).otherwise(F.raise_error(F.lit("incomplete pairs")).cast("double")).alias(m) for m in models])


def paired_delta(wide: DataFrame, base: str, models: list[str]) -> DataFrame:
    """model, mean_delta of abs_error against base, n_better, n."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), (F.col(f"`{m}`") - F.col(f"`{base}`")).alias("d")) for m in models])
    return wide.select(F.inline(rows)).groupBy("model").agg(F.avg("d").alias("mean_delta"), F.count_if(F.col("d") < 0).alias("n_better"), F.count("*").alias("n"))


def check_reported(reported: DataFrame, derived: DataFrame, by: list[str], columns: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Rows where a reported metric isn't what the predictions give."""
    d = derived.select(*by, *[F.col(c).alias(f"__{c}") for c in columns])
    off = F.lit(False)
    for c in columns:
        off = off | F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) > tolerance, ~F.col(c).eqNullSafe(F.col(f"__{c}")))
    return reported.join(d, by, "left").where(off)
