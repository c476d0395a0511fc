"""Duplicate candidates, conservative resolution, and field differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import fingerprint


def candidates(df: DataFrame, id_col: str, fields: list[str], comparable: list[str], target: str) -> DataFrame:
    """candidate_group, id, candidate_size, target_conflict, status, for groups of two or more.

    Groups agree on fields (nulls equal); the target isn't one of them. Members that also agree
    on all comparable columns are copies; a group with several comparable contents stays whole.
    """
    keyed = df.select(F.col(id_col), fingerprint(*map(F.col, fields)).alias("candidate_group"), fingerprint(*map(F.col, comparable)).alias("__eq"), F.col(target).alias("__t"))
    groups = _groups(keyed)
    joined = keyed.join(groups.where("candidate_size > 1"), "candidate_group")
    return joined.select("candidate_group", id_col, "candidate_size", "target_conflict", F.when(
        F.col("contents") > 1, "retained_differences_unresolved").otherwise("confirmed_complete_equivalence").alias("status"))


def _groups(keyed: DataFrame) -> DataFrame:
    """Two aggregates: contents per group first, so a large group of copies is a few rows."""
    part = keyed.groupBy("candidate_group", "__eq", "__t").agg(F.count("*").alias("n"))
    return part.groupBy("candidate_group").agg(
        F.sum("n").alias("candidate_size"), F.count_distinct("__eq").alias("contents"), (F.count_distinct("__t") > 1).alias("target_conflict"))


def resolution(df: DataFrame, id_col: str, fields: list[str], comparable: list[str], target: str) -> DataFrame:
    """candidate_group, id, representative_id, removed, decision, target_conflict per member: of
    equal contents the smallest id stays."""
    keyed = df.select(F.col(id_col), fingerprint(*map(F.col, fields)).alias("candidate_group"), fingerprint(*map(F.col, comparable)).alias("__eq"), F.col(target).alias("__t"))
    equal = keyed.groupBy("candidate_group", "__eq").agg(F.min_by(id_col, F.col(id_col).cast("long")).alias("representative_id"), F.count("*").alias("__same"))
    big = _groups(keyed).where("candidate_size > 1").select("candidate_group", "target_conflict")
    joined = keyed.join(big, "candidate_group").join(equal, ["candidate_group", "__eq"])
    return joined.select("candidate_group", id_col, "representative_id", (F.col(id_col) != F.col("representative_id")).alias("removed"), F.when(
        F.col("__same") > 1, "complete_equivalence").otherwise("retain_differences").alias("decision"), "target_conflict")


def field_diff(df: DataFrame, id_col: str, group: str, columns: list[str]) -> DataFrame:
    """group, id, reference_id, field, reference_value, member_value where a member differs from
    its group's reference (the smallest id), nulls equal to each other only."""
    values = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))
    rows = df.select(F.col(group).alias("group"), F.col(id_col).alias("id"), values.alias("m"))
    reference = rows.groupBy("group").agg(F.min_by(F.struct("id", "m"), "id").alias("r"))
    both = rows.join(reference, "group").where("id <> r.id")
    diffs = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), F.element_at(F.col("r.m"), F.lit(c)).alias("reference_value"), F.element_at("m", F.lit(c)).alias("member_value")) for c in columns]),
                     lambda s: ~s["reference_value"].eqNullSafe(s["member_value"]))
    return both.select("group", "id", F.col("r.id").alias("reference_id"), F.inline(diffs))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, after a check that its keys are unique and not null."""
    bad = df.where(" OR ".join(f"`{k}` IS NULL" for k in keys)).limit(1).count() + repeated_keys(df, keys).limit(1).count()
    if bad:
        raise ValueError(f"keys {keys} are null or repeated")
    return df


#: Keys that identify or date a record and say nothing about its content.
INCIDENTAL = ("id", "createdOn", "modifiedOn")


def comparable_json(text: str) -> str:
    """SQL expression: canonical form of a JSON object column for complete equivalence, without
    incidental keys and without the ids in emissionsList.emissionsInfo (an object or a list)."""
    drop = " AND ".join(f"k <> '{k}'" for k in INCIDENTAL)
    entries = f"map_filter(try_variant_get(try_parse_json({text}), '$', 'map<string,variant>'), (k, v) -> {drop})"
    clean = "map_filter(try_variant_get(x, '$', 'map<string,variant>'), (k, v) -> k <> 'id')"
    info = "variant_get(v, '$.emissionsInfo', 'variant')"
    return (f"to_json(map_from_entries(array_sort(map_entries(transform_values({entries}, (k, v) -> CASE WHEN k = 'emissionsList' AND try_variant_get(v, '$.emissionsInfo', 'array<variant>') IS NOT NULL "
            f"THEN to_json(transform(try_variant_get(v, '$.emissionsInfo', 'array<variant>'), x -> {clean})) "
            f"WHEN k = 'emissionsList' AND schema_of_variant({info}) LIKE 'OBJECT%' THEN to_json(transform(array({info}), x -> {clean})[0]) "
            f"ELSE to_json(v) END)))))")
