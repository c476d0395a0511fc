"""Exact order statistics without a sort: ranges of values are narrowed on counts in the cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import discard, written

#: Bins of a range, and so the rows of a range's histogram that a window holds.
BINS = 4_096
#: Ranges that are broadcast; more are joined by a shuffle, each in SALTS copies.
BROADCAST_RANGES, SALTS = 100_000, 16


def _with_ranges(rows: DataFrame, ranges: DataFrame, on: list[str], most: int) -> DataFrame:
    """rows joined with at most so many ranges, where no group of rows comes together in one task."""
    right = ranges.select(*[F.col(c).alias(f"__r_{c}") for c in on], "lo", "hi")
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    within = F.col("__v").between(F.col("lo"), F.col("hi"))
    if most <= BROADCAST_RANGES:
        joined = rows.join(F.broadcast(right), [*same, within])
    else:
        salted = rows.withColumn("__salt", F.spark_partition_id() % SALTS)
        copies = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, [*same, F.col("__salt") == F.col("__s"), within]).drop("__salt", "__s")
    return joined.drop(*[f"__r_{c}" for c in on])


def _met(left: DataFrame, right: DataFrame, on: list[str], where) -> DataFrame:
    """left joined with what was found in the ranges of its rows."""
    keys = [*on, "lo", "hi"]
    renamed = right.select(*[F.col(c).alias(f"__m_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    return left.join(renamed, [*[F.col(c).eqNullSafe(F.col(f"__m_{c}")) for c in keys], where])


def order_statistics(df: DataFrame, by: list[str], columns: list[str], shares: list[float]) -> DataFrame:
    """by, column, share, n, value: exact quantiles of each numeric column in each group, as double,
    linear between neighbours, over the n values that are neither null nor NaN (none: no row).

    A rank is looked for in a range of values, at first the group's extremes. Each round counts the
    range's rows in bins with the bins' own extremes and goes on within the bin that holds the
    rank, until its extremes are equal or it has at most BINS rows, which are then listed. A task
    holds no more than bins or such a list, whatever a group's size, and the driver learns only how
    many ranks are still open. Null groups are groups.
    """
    if not columns or not shares or any(not 0 <= s <= 1 for s in shares):
        raise ValueError("columns and shares from 0 to 1 are asked for")
    key = [f"__g{i}" for i in range(len(by))]
    on = [*key, "__c"]
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    long = df.select(*[F.col(c).alias(k) for c, k in zip(by, key)], F.explode(pairs).alias("p")).select(*key, F.col("p.c").alias("__c"), F.col("p.v").alias("__v"))
    rows = written(long.where(F.col("__v").isNotNull() & ~F.isnan("__v")), "values")
    inf = math.inf
    finite = F.when(F.abs("__v") < inf, F.col("__v"))
    stats = rows.groupBy(*on).agg(F.count("*").alias("n"), F.count_if(F.col("__v") == -inf).alias("__low"), F.count(finite).alias("__finite"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    # Two ranks a share: the neighbours between which the quantile lies. The shares are rows of one
    # constant, so that the plan's code doesn't grow with their number.
    asked = stats.withColumn("share", F.explode(F.lit([float(s) for s in shares]).cast("array<double>"))).withColumn("up", F.explode(F.array(F.lit(False), F.lit(True))))
    place = (F.col("n") - 1) * F.col("share")
    open_ = asked.select(*on, "n", "share", "up", F.when(F.col("up"), F.ceil(place)).otherwise(F.floor(place)).cast("long").alias("k"), "__low", "__finite", "lo", "hi")
    below, above = F.col("k") < F.col("__low"), F.col("k") >= F.col("__low") + F.col("__finite")
    value = F.when(below, -inf).when(above, inf).when(F.col("lo") == F.col("hi"), F.col("lo"))
    public = [*on, "n", "share", "up"]
    state = written(open_.select(*public, value.alias("value"), (F.col("k") - F.col("__low")).alias("k"), F.col("__finite").alias("m"), "lo", "hi"), "ranks")
    while True:
        few, many = state.where("value IS NULL").agg(F.count_if(F.col("m") <= BINS), F.count_if(F.col("m") > BINS)).first()
        if not few + many:
            break
        out = state.where("value IS NOT NULL")
        if few:
            left = state.where(F.col("value").isNull() & (F.col("m") <= BINS)).drop("value")
            listed = _with_ranges(rows, left.select(*on, "lo", "hi").distinct(), on, few).groupBy(*on, "lo", "hi").agg(F.sort_array(F.collect_list("__v")).alias("vs"))  # at most BINS values
            out = out.unionByName(_met(left, listed, on, F.lit(True)).select(*public, F.get("vs", F.col("k").cast("int")).alias("value"), "k", "m", "lo", "hi"))
        if many:
            left = state.where(F.col("value").isNull() & (F.col("m") > BINS)).drop("value", "m")
            width = F.col("hi") - F.col("lo")  # above 0; where it is beyond a double, halves are taken
            share = F.when(width < inf, (F.col("__v") - F.col("lo")) / width).otherwise((F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
            bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
            ranged = _with_ranges(rows, left.select(*on, "lo", "hi").distinct(), on, many)
            counted = ranged.groupBy(*on, "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("m"), F.min("__v").alias("a"), F.max("__v").alias("z"))
            running = Window.partitionBy(*on, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
            counted = counted.withColumn("before", F.coalesce(F.sum("m").over(running), F.lit(0)))
            met = _met(left, counted, on, (F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("m")))
            out = out.unionByName(met.select(*public, F.when(F.col("a") == F.col("z"), F.col("a")).alias("value"), (F.col("k") - F.col("before")).alias("k"), "m", F.col("a").alias("lo"), F.col("z").alias("hi")))
        after = written(out, "ranks")
        discard(state)
        state = after
    discard(rows)
    both = state.groupBy(*on, "n", "share").agg(F.max(F.when(~F.col("up"), F.col("value"))).alias("a"), F.max(F.when(F.col("up"), F.col("value"))).alias("z"))
    part = (F.col("n") - 1) * F.col("share") - F.floor((F.col("n") - 1) * F.col("share"))
    names = F.get(F.array(*map(F.lit, columns)), F.col("__c"))
    mixed = F.when((part == 0) | (F.col("a") == F.col("z")), F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("z") * part)
    return both.select(*[F.col(k).alias(c) for k, c in zip(key, by)], names.alias("column"), "share", "n", mixed.alias("value"))


def medians(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by and one column each with the exact median of columns, null where a group has no value;
    every group of df has a row."""
    groups = df.select(*by).distinct() if by else df.agg(F.count("*").alias("__n"))
    found = order_statistics(df, by, columns, [0.5])
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])
    if not by:
        return groups.crossJoin(F.broadcast(wide)).drop("__n")  # one row each
    right = wide.select(*[F.col(c).alias(f"__r_{i}") for i, c in enumerate(by)], *columns)
    return groups.join(right, [F.col(c).eqNullSafe(F.col(f"__r_{i}")) for i, c in enumerate(by)], "left").select(*by, *columns)
