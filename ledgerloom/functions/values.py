"""Column functions for semi-structured values: stripping, checked parsing, missingness.

Variants keep what a typed struct would merge: an absent key, a JSON null, an empty string and
white space are four different things. Every function is a Column expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"


#: Every Unicode white space character, as Python's strip takes them.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def group_text(c: Column) -> Column:
    """Grouping key of a name: collapsed and case-folded."""
    return casefold(collapse(c))


def group_key(make: Column, family: Column) -> Column:
    """Collision-safe: the length of the first part is part of the key."""
    return F.concat(F.length(make).cast("string"), F.lit(":"), make, F.lit("|"), family)


def json_map(text: Column) -> Column:
    """Top-level keys of a JSON object as MAP<STRING, VARIANT>; null if it is no object."""
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")


def json_type(v: Column) -> Column:
    """object, array, string, boolean, number or null; SQL null for an absent value."""
    s = F.schema_of_variant(v)
    return (F.when(v.isNull(), None).when(s == "VOID", "null").when(s.startswith("OBJECT"), "object")
            .when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").otherwise("number"))


def missingness(m: Column, key: str) -> Column:
    """<KEY_ABSENT>, <NULL>, <EMPTY> or <VALUE> of a key in a map of variants."""
    v = F.element_at(m, F.lit(key))
    t = json_type(v)
    text = F.try_variant_get(v, "$", "string")
    return (F.when(~F.coalesce(F.map_contains_key(m, F.lit(key)), F.lit(False)), "<KEY_ABSENT>").when(t == "null", "<NULL>")
            .when((t == "string") & (strip(text) == ""), "<EMPTY>").otherwise("<VALUE>"))


def json_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def string_field(t: Column, text: Column, field: str) -> tuple[Column, Column]:
    """(stripped text or null, reason or null) from a value's JSON type and text: nulls and
    blanks pass, other types don't."""
    value = F.when(t == "string", F.nullif(strip(text), F.lit("")))
    return value, F.when(~t.isin("null", "string"), f"invalid_type:{field}")


def checked_string(v: Column, field: str) -> tuple[Column, Column]:
    return string_field(json_type(v), json_text(v), field)


def parse_number(text: Column, integer: bool = False) -> Column:
    """Double of a stripped decimal text, or null: no type suffixes, infinities or NaN."""
    value = F.when(strip(text).rlike(NUMBER), F.replace(strip(text), F.lit("_"), F.lit("")).try_cast("double"))
    value = F.when(F.abs(value) < float("inf"), value)
    return F.when(F.floor(value) == value, value) if integer else value


def number_field(t: Column, text: Column, field: str, integer: bool = False) -> tuple[Column, Column]:
    """(double or null, reason or null): nulls and blanks pass, what isn't a finite number doesn't."""
    value = F.when(t.isin("string", "number"), parse_number(text, integer))
    blank = t.isNull() | (t == "null") | ((t == "string") & (strip(text) == ""))
    return value, F.when(~blank & value.isNull(), f"invalid_numeric:{field}")


def checked_number(v: Column, field: str, integer: bool = False) -> tuple[Column, Column]:
    return number_field(json_type(v), json_text(v), field, integer)


def boolean_field(t: Column, text: Column) -> tuple[Column, Column]:
    """(boolean or null, known): true/1/y/yes and false/0/n/no in any case, blanks are false."""
    said = casefold(strip(text))
    value = F.when(t.isin("boolean", "string"), F.when(said.isin("true", "1", "y", "yes"), True).when(said.isin("false", "0", "n", "no", ""), False))
    return value, t.isNull() | (t == "null") | value.isNotNull()


def parse_boolean(v: Column) -> tuple[Column, Column]:
    return boolean_field(json_type(v), json_text(v))


def alias_value(m: Column, main: str, alias: str) -> tuple[Column, Column, Column]:
    """(value, reason, flag): the main key wins; two different values are a conflict, and use
    of the alias alone is flagged."""
    a, b = F.element_at(m, F.lit(main)), F.element_at(m, F.lit(alias))
    has_a, has_b = F.map_contains_key(m, F.lit(main)), F.map_contains_key(m, F.lit(alias))
    differ = ~F.to_json(a).eqNullSafe(F.to_json(b))
    return (F.when(has_a, a).otherwise(b), F.when(has_a & has_b & differ, f"conflicting_alias:{main}"),
            F.when(~has_a & has_b, f"compatibility_alias:{alias}->{main}"))


def compact(*columns: Column) -> Column:
    """The distinct non-null values of string columns, in order, as an array."""
    return F.array_distinct(F.array_compact(F.array(*columns)))


def fingerprint(*columns: Column, missing: str = "∅") -> Column:
    """SHA-256 over values in a fixed order; nulls are equal to each other only. Each value
    carries its length, so shifted contents differ."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit(missing)) for c in columns]
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def positive_ratio(constant: float, x: Column) -> Column:
    """constant / x where that is finite and positive, else null."""
    y = F.when(x > 0, F.try_divide(F.lit(constant), x))
    return F.when((y > 0) & (y < float("inf")), y)


def right_closed_bins(x: Column, edges: list[float]) -> Column:
    """Labels (a,b] per value; Missing for null and NaN, Invalid at or below the first edge."""
    def show(e):
        return f"{e:g}"
    out = F.when(x.isNull() | F.isnan(x.cast("double")), "Missing").when(x <= edges[0], "Invalid")
    for a, b in zip(edges, edges[1:]):
        out = out.when(x <= b, f"({show(a)},{show(b)}]")
    return out.otherwise(f"({show(edges[-1])},+inf)")


def width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the last bin includes the largest value."""
    at = F.floor((x - low) / ((high - low) / bins)).cast("int")
    return F.when(high == low, 0).otherwise(F.least(at, F.lit(bins - 1)))
