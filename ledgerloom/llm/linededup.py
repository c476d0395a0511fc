"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused

#: Boilerplate is on more than one page in twenty of its site (and on min_docs pages).
RATIO = 0.05
#: A site's boilerplate lines are broadcast only while all of them together are at most so many.
MAX_BROADCAST_LINES = 200_000


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line):
    """MD5 of a line without surrounding ASCII white space; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\f"))
    return F.when(bare != "", F.md5(bare.cast("binary")))


def boilerplate(docs: DataFrame, ratio: float, min_docs: int, host: str = "source") -> DataFrame:
    """host, k: the lines on more than `ratio` of their host's documents and on at least
    min_docs of them. A document counts a line once, however often it holds it. Lines are
    counted before the shuffle, so a hot host or line moves one row per task."""
    site = docs.select(F.col(host).alias("host"), F.array_distinct(F.transform(_lines(F.col("text")), _key)).alias("ks"))
    held = site.select("host", F.explode("ks").alias("k")).where("k IS NOT NULL")
    counts = held.groupBy("host", "k").count().where(F.col("count") >= min_docs)
    totals = docs.groupBy(F.col(host).alias("h")).agg(F.count("*").alias("total"))
    return counts.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("count") > ratio * F.col("total")).select("host", "k")


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_docs: int = 5, host: str = "source",
                     max_broadcast: int = MAX_BROADCAST_LINES) -> DataFrame:
    """docs with boilerplate lines cut from text, and the longs n_lines and n_dropped.

    The other lines stay as they are and in place. Blank lines are never dropped. A null text
    stays null; a null host is a site of its own. A line is compared without the white space
    around it. Repeated rows count as often as they come; an empty table gives an empty result.
    Columns of docs named n_lines or n_dropped are replaced; any other name may clash.
    """
    marked = materialize(boilerplate(docs, ratio, min_docs, host), "boilerplate")
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    host_, drop_, row_, stay_ = (unused(keep, c) for c in ("__host", "__drop", "__row", "__stay"))
    sites = marked.groupBy("host").agg(F.collect_set("k").alias(drop_)).withColumnRenamed("host", host_)
    base = docs.select(*keep)
    if marked.count() <= max_broadcast:
        joined = base.join(F.broadcast(sites), F.col(host).eqNullSafe(F.col(host_)), "left")
    else:
        # The lines of each document are looked up by (host, line); only hits come back, by row.
        rows = materialize(base.withColumn(row_, F.monotonically_increasing_id()), "lines")
        held = rows.select(row_, F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _key))).alias("k")).where("k IS NOT NULL")
        some_ = marked.select(F.col("host").alias("h2"), F.col("k").alias("k2"))
        hits = held.join(some_, F.col("host").eqNullSafe(F.col("h2")) & (F.col("k") == F.col("k2"))).groupBy(row_).agg(F.collect_set("k").alias(drop_))
        joined = rows.join(hits, row_, "left")
    lines = _lines(F.col("text"))
    hits = F.array_intersect(F.transform(lines, _key), F.col(drop_))  # by hash; most often empty
    joined = joined.withColumn(drop_, F.when(F.col(drop_).isNotNull() & F.col("text").isNotNull(), F.array_compact(hits)))
    stay = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(drop_), _key(x)), F.lit(False)))
    some = F.size(drop_) > 0
    cut = joined.withColumn(stay_, F.when(some, stay))
    return cut.select(
        *[F.when(some, F.array_join(stay_, "\n")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in keep],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(some, F.size(lines) - F.size(stay_)).otherwise(0).cast("long").alias("n_dropped"))
