"""Deterministic orders: round-robin, seeded, capped, batched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import written


def placed(df: DataFrame, by: str, name: str = "place") -> DataFrame:
    """df with the place, from 0, of each row in the order of by (without repeats or nulls). Rows are
    dealt by ranges; what comes together in one task is a count for each range."""
    ranged = written(df.repartitionByRange(by).withColumn("__part", F.spark_partition_id()), "placed")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("__part").agg(F.count("*").alias("__n")).select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1
    return ranged.withColumn("__own", own).join(F.broadcast(base), F.col("__part") == F.col("__p")).select(*df.columns, (F.col("__base") + F.col("__own")).cast("long").alias(name))


def round_robin(df: DataFrame, queue: str, item: str) -> DataFrame:
    """df with turn, the item's place in its queue; ordering by (turn, queue) takes the i-th
    item of every queue before any (i+1)-th.

    Rows are dealt by ranges of (queue, item), so that a hot queue lies in many tasks; what
    comes together for a queue is a count per task."""
    ranged = written(df.repartitionByRange(queue, item).withColumn("__part", F.spark_partition_id()), "round-robin")
    counts = ranged.groupBy(queue, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(queue).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col(queue).alias("__q"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__part", queue).orderBy(item))
    placed = ranged.withColumn("__own", own).join(base, (F.col("__part") == F.col("__p")) & F.col(queue).eqNullSafe(F.col("__q")))
    return placed.select(*df.columns, (F.col("__base") + F.col("__own")).cast("int").alias("turn"))


def batches(df: DataFrame, queue: str, item: str, size: int) -> DataFrame:
    """df with turn, seq (the global place of a round-robin drain, from 1) and batch.

    seq is the place in the order of (turn, queue), taken from ranges of both: the first turn, which
    holds a row of every queue, lies in many tasks, and nothing is sorted as a whole.
    """
    turns = round_robin(df, queue, item).withColumn("__at", F.struct("turn", queue))
    drained = placed(turns, "__at", "__place").withColumn("seq", F.col("__place") + 1)
    return drained.drop("__at", "__place").withColumn("batch", F.floor((F.col("seq") - 1) / size).cast("long"))


def seeded_rank(df: DataFrame, by: str, value: str, seed: int) -> DataFrame:
    """df's distinct (by, value) with place: a permutation within each group that depends on
    the seed, the group and the value alone."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string"), F.col(value).cast("string")).cast("binary"), 256)
    return df.select(by, value).distinct().withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(key, value)))


def cap(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group: a top-k report."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= k)


def largest(df: DataFrame, key: str, order: list, n: int, others: DataFrame) -> DataFrame:
    """The first n rows of df by order (a top-n report) with the columns of others joined back by
    key, and rank. Only those n rows meet the other table."""
    top = df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # n rows
    return others.join(F.broadcast(top), key)


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Values by their first position."""
    return df.groupBy(value).agg(F.min(position).alias("first_position"))


def latest(df: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key: of repeated log lines the later wins. One aggregate."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), position).alias("r")).select(key, "r.*")
