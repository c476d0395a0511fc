"""Profiles of tables: inventories, missingness, histograms, descriptions, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import json_map, json_text, json_type, missingness, width_bin
from .ranks import medians, order_statistics


def category_inventory(df: DataFrame, columns: list[str], missing: str = "<MISSING>") -> DataFrame:
    """field, value, n: rows per value of each column, in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def raw_inventory(df: DataFrame, json_col: str, fields: list[str], pairs: list = (), missing: str = "<MISSING>", empty: str = "<EMPTY>") -> DataFrame:
    """field, value, n over the top-level keys of JSON objects, in one scan: absent and null
    values count as missing, empty texts as empty. pairs: (name, [keys, ...], separator), each
    part the first of its keys that holds a value; what has none is missing in the first part
    and empty in the others."""
    m = F.col("__m")
    text = lambda k: json_text(F.element_at(m, F.lit(k)))
    rows = [F.struct(F.lit(f).alias("field"), F.when(text(f).isNull(), missing).when(text(f) == "", empty).otherwise(text(f)).alias("value")) for f in fields]
    for name, parts, separator in pairs:
        values = [F.coalesce(*[F.nullif(text(k), F.lit("")) for k in keys], F.lit(empty if i else missing)) for i, keys in enumerate(parts)]
        rows.append(F.struct(F.lit(name).alias("field"), F.concat_ws(separator, *values).alias("value")))
    known = df.select(json_map(F.col(json_col)).alias("__m")).where("__m IS NOT NULL")
    return known.select(F.explode(F.array(*rows)).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def segment_summary(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """by, n, and mean and median of each measure: descriptions of segments after their fit."""
    rows = df.select(*by, *[c.alias(f"__m{i}") for i, c in enumerate(measures.values())])
    held = [f"__m{i}" for i in range(len(measures))]
    means = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in held])
    middle = medians(rows, by, held).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], *held)
    both = means.join(middle, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)])
    stats = [F.col(f"{c}{end}").alias(f"{name}_{of}") for name, c in zip(measures, held) for of, end in (("mean", "_mean"), ("median", ""))]
    return both.select(*by, "n", *stats)


def column_missingness(df: DataFrame, columns: list[str], blank_is_empty: bool = False) -> DataFrame:
    """field, null_n, empty_n, missing_n, fraction per column, in one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        text = F.btrim(F.col(c).cast("string")) if blank_is_empty else F.col(c).cast("string")
        aggs += [F.count_if(F.col(c).isNull()).alias(f"a{i}"), F.count_if(text == "").alias(f"b{i}")]
    one = df.agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a{i}").alias("null_n"), F.col(f"b{i}").alias("empty_n")) for i, c in enumerate(columns)])
    out = one.select("n", F.inline(rows))
    return out.select("field", "null_n", "empty_n", (F.col("null_n") + F.col("empty_n")).alias("missing_n"),
                      F.try_divide((F.col("null_n") + F.col("empty_n")).cast("double"), F.col("n").cast("double")).alias("fraction"))


def key_types(df: DataFrame, json_col: str) -> DataFrame:
    """key, type, n over the top-level keys of JSON objects."""
    entries = df.select(F.explode(json_map(F.col(json_col))).alias("key", "v"))
    return entries.groupBy("key", json_type(F.col("v")).alias("type")).agg(F.count("*").alias("n"))


def key_presence(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """key, status, n: absent, null, empty or valued, per key."""
    m = json_map(F.col(json_col))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), missingness(F.col("m"), k).alias("status")) for k in keys])
    return df.select(m.alias("m")).select(F.inline(pairs)).groupBy("key", "status").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, split: str, fields: list[str]) -> DataFrame:
    """split, field, value, n for each field, by grouping sets over one scan."""
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in fields:
        held = F.grouping(f) == 0
        which, value = F.when(held, f).otherwise(which), F.when(held, F.col(f).cast("string")).otherwise(value)
    grouped = df.groupingSets([[split, f] for f in fields], split, *fields)
    return grouped.agg(which.alias("field"), value.alias("value"), F.count("*").alias("n")).select(F.col(split).alias("split"), "field", "value", "n")


def distinct_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, n_distinct. Values are reduced to one row each before they are counted, so no
    column's values meet in one task."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    seen = df.select(F.explode(pairs).alias("p")).select("p.field", "p.value").where("value IS NOT NULL").distinct()
    return seen.groupBy("field").agg(F.count("*").alias("n_distinct"))


def describe_groups(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, median, mean and sample standard deviation per group; the median is exact, by counts."""
    rest = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    middle = medians(df, [by], [value]).select(F.col(by).alias("__by"), F.col(value).alias("median"))
    return rest.join(middle, F.col(by).eqNullSafe(F.col("__by"))).select(by, "n", "median", "mean", "std")


def quantiles(df: DataFrame, value: str, at=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """q, value: exact linear-interpolated quantiles, by counts in narrowing ranges."""
    return order_statistics(df, [], [value], list(at)).select(F.col("share").alias("q"), "value")


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, n of equal-width bins between the extremes, the last one closed."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    both = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    return both.groupBy(width_bin(F.col(value), F.col("lo"), F.col("hi"), bins).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def group_consistency(df: DataFrame, by: list[str], base: str, year: str) -> DataFrame:
    """Distinct bases, years and missing bases per group."""
    return df.groupBy(*by).agg(
        F.count_distinct(base).alias("n_bases"), F.array_join(F.array_sort(F.collect_set(F.col(base).cast("string"))), " | ").alias("bases"),
        F.array_join(F.transform(F.array_sort(F.collect_set(year)), lambda y: y.cast("string")), ",").alias("years"),
        F.count_if(F.col(base).isNull()).alias("missing_base"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
