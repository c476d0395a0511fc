"""Document fingerprints that keep every shingle hash below a fixed fraction, in DataFrame functions.

Two sketches at one fraction merge by their union, and what a small document shares with a much
larger one is counted whole, as no number of hashes is fixed. A text none of whose hashes is below
the fraction keeps its smallest, so that short texts can be told apart; merged, such a hash only
stands where no hash is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

WORDS = 5
#: Hashes whose first hexadecimal digit is below it are kept: an eighth of all.
BELOW = "2"
#: Hexadecimal digits of a kept hash.
DIGITS = 16
#: Rows of a range that a window holds at once, and most ranges.
RANGE_ROWS, RANGES = 2_048, 16_384


def sketched(df: DataFrame, text: str, name: str, words: int = WORDS, below: str = BELOW) -> DataFrame:
    """df with name: the sorted distinct kept hashes (array of string) of a text's shingles.

    Words are lower-cased and cut at ASCII white space; fewer words than a shingle's make one
    shingle, no words (and null) an empty sketch. Linear in the text; only kept hashes are held.
    """
    cols = df.columns
    w, at = unused(cols, "__w"), unused(cols, "__at")
    cut = df.withColumn(w, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x09-\x0D\x20]+"), lambda x: x != ""))

    def hashed(i):
        return F.md5(F.concat_ws(" ", *[F.get(F.col(w), i + k) for k in range(words)]).cast("binary"))  # concat_ws skips what is beyond the end

    last = F.greatest(F.size(w) - words, F.lit(0))
    every = F.when(F.size(w) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    kept = cut.withColumn(at, F.filter(every, lambda i: hashed(i) < below))
    short = lambda h: F.substring(h, 1, DIGITS)
    least = F.array(short(F.array_min(F.transform(every, hashed))))
    some = F.array_sort(F.array_distinct(F.transform(at, lambda i: short(hashed(i)))))
    return kept.withColumn(name, F.when(F.size(at) > 0, some).when(F.size(w) > 0, least).otherwise(F.array().cast("array<string>"))).select(*cols, name)


def merge(a: Column, b: Column, below: str = BELOW) -> Column:
    """The sketch of two documents' shingles together, from theirs."""
    both = F.array_sort(F.array_union(a, b))
    under = F.filter(both, lambda h: h < below)
    return F.when(F.size(under) > 0, under).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both; two empty sketches are alike."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; an empty sketch is held by all."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double")), F.lit(1.0))


def as_text(sketch: Column) -> Column:
    return F.array_join(sketch, "")


def with_next(docs: DataFrame, key: str, columns: list[str], derive=None) -> DataFrame:
    """docs with next_<column> of the row that follows in descending order of key (integers); the
    last row is followed by the first, a single one by itself. Null keys come last, rows of equal
    key stand by the hash of their columns.

    Rows are dealt once, to ranges of key cut at quantiles; the first row of a range is also sent
    to the range before it, so each range finds its successors alone. derive, a function of the
    dealt table, may add columns that are then carried as well; they are computed once a row.
    """
    low = -(2**63)
    k, part, ghost, tie = (unused(docs.columns, c) for c in ("__key", "__part", "__ghost", "__tie"))
    rows = docs.withColumn(k, F.coalesce(F.col(key).cast("long"), F.lit(low)))
    n = rows.count()
    ranges = max(1, min(RANGES, -(-n // RANGE_ROWS)))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx(k, shares, 20 * ranges).alias("b")).first().b or [])) if shares else []
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    held = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # How many bounds are at most the key, by binary descent.
    place = F.aggregate(F.array(*[F.lit(s) for s in steps]).cast("array<int>"), F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= F.col(k), at + s).otherwise(at)) if bounds else F.lit(0)
    rows = rows.withColumn(part, place)
    heads = sorted(rows.groupBy(part).agg(F.max(k).alias("head")).collect(), key=lambda r: -r["head"])  # a row for each of at most RANGES ranges
    to = [(h["head"], heads[i - 1][part]) for i, h in enumerate(heads)]
    sent = docs.sparkSession.createDataFrame(to, "__head long, __to int")
    first = rows.join(F.broadcast(sent), F.col(k) == F.col("__head"), "left")
    copies = F.array(F.struct(F.col(part).alias("p"), F.lit(False).alias("g")), F.struct(F.col("__to").alias("p"), F.lit(True).alias("g")))
    dealt = first.withColumn("__c", F.explode(F.filter(copies, lambda c: c["p"].isNotNull()))).withColumn(part, F.col("__c.p")).withColumn(ghost, F.col("__c.g")).drop("__c", "__head", "__to")
    dealt = dealt.withColumn(tie, F.xxhash64(*columns))
    order = Window.partitionBy(part).orderBy(ghost, F.desc(k), tie)
    for c in columns:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    if derive is not None:
        before = set(dealt.columns)
        dealt = derive(dealt)
        for c in [c for c in dealt.columns if c not in before]:
            dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.where(~F.col(ghost)).drop(k, part, ghost, tie)


def edited_half(text: Column, following: Column) -> Column:
    """text, its last floor(n / 2) code points replaced by the first as many of following."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", words: int = WORDS, below: str = BELOW) -> DataFrame:
    """id, n_chars, edited, sketch, edited_sketch, next_sketch of each row: the sketches of its
    text, of the text whose second half is that of the next document, and of the next document.

    Null texts count as empty. Repeated rows repeat, each followed by the other. An empty table
    gives an empty result; other columns are not read. Texts are shuffled once.
    """
    rows = docs.select(id_col, F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(rows, id_col, ["text"], lambda d: sketched(d, "text", "sketch", words, below))
    both = both.select(id_col, F.length("text").cast("long").alias("n_chars"), edited_half(F.col("text"), F.col("next_text")).alias("edited"), "sketch", "next_sketch")
    return sketched(both, "edited", "edited_sketch", words, below)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fingerprints as strings, and their likenesses and containments."""
    own = F.col("sketch")
    return found.select(
        id_col, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(own).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(own, F.col("edited_sketch")).alias("near_edited"), likeness(own, F.col("next_sketch")).alias("near_next"), containment(own, F.col("edited_sketch")).alias("held_by_edited"))
