"""Joins with checked cardinality, set checks, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import require_unique


def one_to_one(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join after a check that both sides' keys are unique."""
    return require_unique(a, on).join(require_unique(b, on), on, how)


def many_to_one(a: DataFrame, b: DataFrame, on: list[str], require_match: bool = True) -> DataFrame:
    """Left join to unique keys; rows without a match raise."""
    b = require_unique(b, on)
    if require_match and a.join(b, on, "left_anti").limit(1).count():
        raise ValueError(f"rows without a match on {on}")
    return a.join(b, on, "left")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """side, key of the ids on one side only; empty if the sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(y.join(x, key, "left_anti").select(F.lit("right").alias("side"), key))


def reconcile(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """key, reasons of rows that differ: missing on a side, or a field's value (doubles within
    tolerance, nulls equal to each other only)."""
    x = a.select(F.col(key), F.struct(*columns).alias("x"))
    y = b.select(F.col(key), F.struct(*columns).alias("y"))
    tests = [F.when(F.col("x").isNull(), "missing_left"), F.when(F.col("y").isNull(), "missing_right")]
    for c in columns:
        p, q = F.col(f"x.{c}"), F.col(f"y.{c}")
        near = F.coalesce(F.abs(p - q) <= tolerance, F.lit(False)) if tolerance and dict(a.dtypes)[c] == "double" else F.lit(False)
        tests.append(F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & ~p.eqNullSafe(q) & ~near, f"differs:{c}"))
    out = x.join(y, key, "full").select(key, F.array_compact(F.array(*tests)).alias("r"))
    return out.where(F.size("r") > 0).select(key, F.array_join("r", "|").alias("reasons"))


def overlay(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """primary, and fallback's rows for keys that primary lacks."""
    return primary.unionByName(fallback.join(primary, key, "left_anti"))
