"""Name families: assignment by priority, prefix candidates, alias components."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import group_key, group_text
from .components import components


def component_tag(make: pd.Series, bases: pd.Series) -> pd.Series:
    """20 hex digits over the compact JSON of [make, bases]: a row for each component."""
    return pd.Series([hashlib.sha256(json.dumps([m, list(b)], separators=(",", ":")).encode()).hexdigest()[:20] for m, b in zip(make, bases)], dtype=object)


def prefix_candidates(df: DataFrame, make: str, name: str, base: str) -> DataFrame:
    """make, name, possible_bases: the make's bases of which the name is an extension by further
    words, or the other way round. Equal only on the make, then a residual on distinct names."""
    names = df.where(F.col(base).isNull()).select(group_text(F.col(make)).alias("make"), group_text(F.col(name)).alias("name")).distinct()
    bases = df.where(F.col(base).isNotNull()).select(group_text(F.col(make)).alias("make"), group_text(F.col(base)).alias("base")).distinct()
    near = F.expr("startswith(name, base || ' ') OR startswith(base, name || ' ')")
    return names.join(bases, "make").where(near).groupBy("make", "name").agg(F.array_join(F.array_sort(F.collect_set("base")), " | ").alias("possible_bases"))


def assign(df: DataFrame, id_col: str, make: str, name: str, base: str, aliases: DataFrame | None = None) -> DataFrame:
    """id, make, family, model_group, group_source: an explicit alias comes first, then the base,
    then a base of the same make that equals the name, then the name itself.

    aliases: make, name, family (names as they are, compared normalised). A name with two
    families raises, and so does an empty make or name.
    """
    rows = df.select(F.col(id_col), group_text(F.col(make)).alias("make"), group_text(F.col(name)).alias("name"), F.nullif(group_text(F.col(base)), F.lit("")).alias("base"))
    if rows.where("make IS NULL OR name IS NULL OR make = '' OR name = ''").limit(1).count():
        raise ValueError("empty make or name")
    known = rows.where("base IS NOT NULL").select("make", F.col("base").alias("name")).distinct().withColumn("exact", F.lit(True))
    out = rows.join(known, ["make", "name"], "left")
    if aliases is None:
        out = out.withColumn("alias", F.lit(None).cast("string"))
    else:
        a = aliases.select(group_text(F.col("make")).alias("make"), group_text(F.col("name")).alias("name"), group_text(F.col("family")).alias("alias")).distinct()
        if a.groupBy("make", "name").count().where("count > 1").limit(1).count():
            raise ValueError("a name with several families")
        out = out.join(a, ["make", "name"], "left")
    source = F.when(F.col("alias").isNotNull(), "explicit_alias").when(F.col("base").isNotNull(), "base_model").when(F.col("exact"), "audited_alias").otherwise("fallback_name")
    family = F.coalesce("alias", "base", "name")
    return out.select(id_col, "make", family.alias("family"), group_key(F.col("make"), family).alias("model_group"), source.alias("group_source"))


def alias_components(df: DataFrame, make: str, name: str, base: str) -> DataFrame:
    """make, base, canonical, component_id: bases of one make that share a full name belong
    together, transitively; only components of two or more bases. canonical is the smallest;
    component_id begins the SHA-256 of the compact JSON list of make and sorted bases."""
    rows = df.where(F.col(base).isNotNull()).select(group_text(F.col(make)).alias("make"), group_text(F.col(name)).alias("name"), group_text(F.col(base)).alias("base")).distinct()
    first = rows.groupBy("make", "name").agg(F.min("base").alias("low"))
    key = lambda c: F.concat_ws("\x1f", "make", c)
    edges = rows.join(first, ["make", "name"]).where("base <> low").select(key("base").alias("a"), key("low").alias("b"))
    found = components(edges)
    parts = lambda c, i: F.split_part(F.col(c), F.lit("\x1f"), F.lit(i))
    members = found.select(parts("node", 1).alias("make"), parts("node", 2).alias("base"), parts("root", 2).alias("canonical"))
    tag = members.groupBy("make", "canonical").agg(F.array_sort(F.collect_list("base")).alias("bases")).select("make", "canonical", F.pandas_udf(component_tag, "string")("make", "bases").alias("component_id"))
    return members.join(tag, ["make", "canonical"]).select("make", "base", "canonical", "component_id")


def alias_rows(df: DataFrame, id_col: str, make: str, name: str, base: str) -> DataFrame:
    """One row per distinct name of a component, from its smallest id; rows without a base join
    where their name is a member name already."""
    rows = df.select(F.col(id_col).alias("id"), group_text(F.col(make)).alias("make"), group_text(F.col(name)).alias("name"), group_text(F.col(base)).alias("base"))
    members = alias_components(df, make, name, base)
    named = rows.join(members, ["make", "base"]).groupBy("make", "name").agg(F.first("canonical").alias("family"))
    pick = Window.partitionBy("make", "name").orderBy(F.col("id").cast("long"))
    joined = rows.where("base IS NULL OR base = ''").join(named, ["make", "name"]).select("id", "make", "name", "family").unionByName(
        rows.join(members, ["make", "base"]).select("id", "make", "name", F.col("canonical").alias("family")))
    return joined.withColumn("rn", F.row_number().over(pick)).where("rn = 1").drop("rn")
