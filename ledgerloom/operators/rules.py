"""Declarative rules: every reason is kept, rows leave a funnel at their earliest stage."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import casefold, compact, strip


def with_reasons(df: DataFrame, rules: Sequence[tuple[str, Column]], column: str = "reasons") -> DataFrame:
    """Add an array of the names of all rules that hold, in rule order and without repeats. A
    rule that is null doesn't hold."""
    return df.withColumn(column, compact(*[F.when(test, F.lit(name)) for name, test in rules]))


def reason_counts(df: DataFrame, column: str = "reasons") -> DataFrame:
    """Rows per reason; a row counts for each of its reasons."""
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def prefix_stage(reason: Column, table: Sequence[tuple[str, str, str]], default: str) -> Column:
    """Stage of a reason by the first row (how, text, stage) of an ordered table that fits; how
    is prefix, suffix, equals or contains."""
    tests = {"prefix": reason.startswith, "suffix": reason.endswith, "equals": lambda t: reason == t, "contains": reason.contains}
    out = F.when(F.lit(False), None)
    for how, text, stage in table:
        out = out.when(tests[how](text), stage)
    return out.otherwise(default)


def funnel(df: DataFrame, stages: Sequence[str], stage_of, column: str = "reasons") -> DataFrame:
    """stage, before, removed, after per stage in order, stages without removals included.

    A row is removed at the earliest stage among its reasons'. One pass with a partial
    aggregate: a count per stage is all that is shuffled.
    """
    spark = df.sparkSession
    order = F.create_map(*[F.lit(x) for i, s in enumerate(stages) for x in (s, i)])
    first = F.array_min(F.transform(column, lambda r: F.element_at(order, stage_of(r))))
    removed = df.groupBy(F.coalesce(first, F.lit(len(stages))).alias("ord")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(i, s) for i, s in enumerate([*stages, None])], "ord int, stage string")
    steps = names.join(F.broadcast(removed), "ord", "left").select("ord", "stage", F.coalesce("n", F.lit(0)).cast("long").alias("removed"))
    rest = Window.orderBy("ord").rowsBetween(Window.currentRow, Window.unboundedFollowing)  # over len(stages) + 1 rows
    steps = steps.withColumn("before", F.sum("removed").over(rest))
    return steps.where("stage IS NOT NULL").select("stage", "before", "removed", (F.col("before") - F.col("removed")).alias("after"))


def _by_make(df: DataFrame, rules: DataFrame, max_rules: int) -> DataFrame:
    """df with __rules, a map from make to its rules: one broadcast row, after a size check."""
    if rules.limit(max_rules + 1).count() > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    lists = rules.groupBy(casefold(strip(F.col("make"))).alias("k")).agg(F.collect_list(F.struct(*rules.columns)).alias("v"))
    return df.crossJoin(F.broadcast(lists.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__rules"))))


def match_rules(df: DataFrame, rules: DataFrame, *, make: str, name: str, year: str, engine: Sequence[tuple[str, str]] = (),
                mode: str = "full", max_rules: int = 10_000) -> DataFrame:
    """df with rule_ids, the sorted ids of the rules that match.

    rules: rule_id, make, year_min, year_max, pattern and the columns named in engine, pairs of
    (column of df, column of rules); a null there sets no condition. Makes compare stripped and
    case-folded, years inclusively, patterns by search, engine values within 1e-6.
    mode full: all conditions hold. identity: engine values aren't looked at. missing: the
    identity fits, some required engine value is null and none contradicts. The rules of a
    row's make are looked up in a broadcast map, so rows stay where they are.
    """
    return match_rule_kinds(df, rules, {"rule_ids": (mode, None, None)}, make=make, name=name, year=year, engine=engine, max_rules=max_rules)


def match_rule_kinds(df: DataFrame, rules: DataFrame, kinds: dict, *, make: str, name: str, year: str, engine: Sequence[tuple[str, str]] = (), max_rules: int = 10_000) -> DataFrame:
    """df with a column of matching ids for each of kinds, {column: (mode, keep, form)}: keep(r)
    says which rules count (None: all), form(id) what is listed (None: the id). The rules are
    looked up once; see match_rules."""
    def fits(mode, keep):
        return lambda r: F.coalesce(_fit(r, mode) if keep is None else keep(r) & _fit(r, mode), F.lit(False))

    def _fit(r, mode):
        on = F.col(year).between(r["year_min"], r["year_max"]) & F.regexp_like(F.col(name), r["pattern"])
        some = F.lit(mode != "missing")
        for value, column in engine if mode != "identity" else ():
            need, value = r[column], F.col(value)
            unknown = value.isNull() if mode == "missing" else F.lit(False)
            on = on & (need.isNull() | unknown | F.coalesce(F.abs(value - need) < 1e-6, F.lit(False)))
            some = some | (need.isNotNull() & value.isNull())
        return on & some

    def ids(mode, keep, form):
        found = F.transform(F.filter("__mine", fits(mode, keep)), lambda r: r["rule_id"])
        listed = F.array_sort(found) if form is None else F.transform(F.array_sort(found), form)
        return F.coalesce(listed, F.array().cast("array<string>"))

    told = _by_make(df, rules, max_rules).withColumn("__mine", F.element_at("__rules", casefold(strip(F.col(make))))).drop("__rules")
    return told.withColumns({c: ids(*kind) for c, kind in kinds.items()}).drop("__mine")


def in_rule_range(df: DataFrame, rules: DataFrame, *, make: str, year: str, column: str = "in_range", max_rules: int = 10_000) -> DataFrame:
    """df with a flag: some rule covers the make and year."""
    hit = F.exists(F.element_at("__rules", casefold(strip(F.col(make)))), lambda r: F.col(year).between(r["year_min"], r["year_max"]))
    return _by_make(df, rules, max_rules).withColumn(column, F.coalesce(hit, F.lit(False))).drop("__rules")


def check_rule_table(rows: list[dict], technologies: Sequence[str] | None = None, years: tuple[int, int] | None = None) -> None:
    """Raise on repeated ids, a missing make, a pattern that isn't one, unknown technologies,
    unbounded or reversed years or such outside of `years`, missing sources, or engine values
    that aren't finite and positive."""
    seen = set()
    for r in rows:
        if not r.get("rule_id") or r["rule_id"] in seen:
            raise ValueError(f"rule id missing or repeated: {r}")
        seen.add(r["rule_id"])
        if not (isinstance(r.get("year_min"), int) and isinstance(r.get("year_max"), int) and r["year_min"] <= r["year_max"]):
            raise ValueError(f"years of {r['rule_id']}")
        if years and not years[0] <= r["year_min"] <= r["year_max"] <= years[1]:
            raise ValueError(f"years of {r['rule_id']} leave {years}")
        if not isinstance(r.get("make"), str) or not r["make"].strip():
            raise ValueError(f"no make for {r['rule_id']}")
        try:
            re.compile(r.get("pattern") or "(")
        except re.error:
            raise ValueError(f"pattern of {r['rule_id']}") from None
        if technologies is not None and r.get("technology") not in technologies:
            raise ValueError(f"technology of {r['rule_id']}")
        if not r.get("source"):
            raise ValueError(f"no source for {r['rule_id']}")
        for k in ("displacement", "cylinders"):
            v = r.get(k)
            if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 < v < math.inf):
                raise ValueError(f"{k} of {r['rule_id']}")
