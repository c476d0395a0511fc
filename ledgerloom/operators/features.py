"""Imputation, scaling, encoding and TF-IDF, fitted on training rows only."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, unigrams_bigrams
from ..functions.values import strip
from .ranks import medians


def require_columns(df: DataFrame, allowed: list[str]) -> DataFrame:
    """df, if its predictors are exactly the allowed ones."""
    if sorted(df.columns) != sorted(allowed):
        raise ValueError(f"predictors {sorted(set(df.columns) ^ set(allowed))}")
    return df


def select_predictors(df: DataFrame, numeric: list[str], categorical: list[str], keep: list[str] = ()) -> DataFrame:
    """Numbers as double (NaN to null, infinities raise), categories stripped (blank to null)."""
    def number(c):
        x = F.col(c).cast("double")
        return F.when(F.isnan(x), None).when(F.abs(x) == float("inf"), F.raise_error(F.lit(f"infinite {c}")).cast("double")).otherwise(x).alias(c)
    return df.select(*keep, *map(number, numeric), *[F.nullif(strip(F.col(c)), F.lit("")).alias(c) for c in categorical])


@dataclass
class Preprocessor:
    """Median imputation with missing indicators (for columns with missing training values),
    scaling by the population deviation (1 where that is 0), and one-hot columns of the sorted
    training categories; unknown categories are all zeros."""
    numeric: list[str]
    categorical: list[str]
    medians: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)
    missing: list = field(default_factory=list)
    levels: dict = field(default_factory=dict)

    def fit(self, train: DataFrame, max_levels: int = 10_000) -> Preprocessor:
        meds = medians(train, [], self.numeric).first() if self.numeric else {}
        gaps = train.agg(F.count("*"), *[F.count_if(F.col(c).isNull()).alias(c) for c in self.numeric]).first()
        self.medians = {c: meds[c] if meds[c] is not None else 0.0 for c in self.numeric}
        self.missing = [c for c in self.numeric if gaps[c]]
        filled = train.select(*[F.coalesce(F.col(c), F.lit(self.medians[c])).alias(c) for c in self.numeric])
        row = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in self.numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in self.numeric]).first()
        self.means = {c: row[f"m_{c}"] for c in self.numeric}
        self.stds = {c: row[f"s_{c}"] or 1.0 for c in self.numeric}
        for c in self.categorical:
            found = train.select(F.coalesce(F.col(c), F.lit("Unknown")).alias(c)).distinct().orderBy(c).limit(max_levels + 1).collect()
            if len(found) > max_levels:
                raise ValueError(f"{c} has more than {max_levels} categories")
            self.levels[c] = [r[0] for r in found]
        return self

    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}__missing" for c in self.missing], *[f"{c}={v}" for c in self.categorical for v in self.levels[c]]]

    def columns(self):
        out = [((F.coalesce(F.col(c), F.lit(self.medians[c])) - self.means[c]) / self.stds[c]).alias(c) for c in self.numeric]
        out += [F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in self.missing]
        return out + [(F.coalesce(F.col(c), F.lit("Unknown")) == v).cast("double").alias(f"{c}={v}") for c in self.categorical for v in self.levels[c]]

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        return df.select(*keep, *self.columns())

    def vector(self, df: DataFrame, keep: list[str] = (), name: str = "x") -> DataFrame:
        """keep and an array<double> of all features."""
        return df.select(*keep, F.array(*self.columns()).alias(name))

    def dense_bytes(self, n: int) -> int:
        return 8 * n * len(self.names())


#: A vocabulary is broadcast up to so many terms; a larger one is joined by a shuffle.
MAX_BROADCAST_TERMS = 100_000


def refuse_dense(df: DataFrame, numeric: list[str], categorical: list[str], limit: int = 2 << 30) -> int:
    """Upper bound of the dense matrix's bytes, from exact counts; raises beyond the limit."""
    row = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(c) for c in categorical]).first()
    size = int(8 * row["n"] * (2 * len(numeric) + sum(row[c] + 1 for c in categorical)))
    if size > limit:
        raise ValueError(f"a dense matrix of {size} bytes")
    return size


#: Distinct terms that a task counts before it sends their sums on, and rows it reads at once.
COUNTED_TERMS, COUNTED_ROWS = 200_000, 256


def term_counts(words: DataFrame, by: str | None = None) -> DataFrame:
    """by, term, tf, df: occurrences and rows of the uni- and bigrams of w (array of words), for each
    value of by. Terms are counted within a task, in Arrow batches, before their sums are shuffled."""
    names = [by] if by else []
    fields = ", ".join([*[f"`{by}` {words.schema[by].dataType.simpleString()}" for _ in names], "term string, tf long, df long"])

    def run(batches):
        counts: dict = {}  # of each group: a term's rows << 40 | its occurrences

        def sums():
            for k, of in counts.items():
                both = np.fromiter(of.values(), np.int64, len(of))
                group = [pa.array([k] * len(of), kind)] if by else []
                yield pa.RecordBatch.from_arrays([*group, pa.array(list(of), pa.string()), pa.array(both & (1 << 40) - 1), pa.array(both >> 40)], [*names, "term", "tf", "df"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(by).type if by else None
            for at in range(0, batch.num_rows, COUNTED_ROWS):
                some = batch.slice(at, COUNTED_ROWS)
                groups = some.column(by).to_pylist() if by else [None] * some.num_rows
                for k, row in zip(groups, some.column("w").to_pylist()):
                    if row:
                        of = counts.setdefault(k, {})
                        had = of.get
                        for term, n in Counter(chain(row, map(" ".join, zip(row, row[1:])))).items():
                            of[term] = had(term, 0) + n + (1 << 40)
                if sum(map(len, counts.values())) > COUNTED_TERMS:
                    yield from sums()
                    counts.clear()
        yield from sums()

    counted = words.select(*names, "w").mapInArrow(run, fields)
    return counted.groupBy(*names, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary(docs: DataFrame, text: str, max_features: int = 5000, min_df: int = 1) -> DataFrame:
    """term, tf, df, idf of the most frequent uni- and bigrams (ties by term). Texts are cut once and
    their terms counted before they are shuffled."""
    n = docs.select(F.count("*").alias("n"))
    counts = term_counts(docs.select(tokens(F.col(text)).alias("w")))
    top = counts.where(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(max_features)
    return top.crossJoin(F.broadcast(n)).select("term", "tf", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def tfidf(docs: DataFrame, id_col: str, text: str, vocab: DataFrame, sublinear: bool = True) -> DataFrame:
    """id, term, weight of each row's vocabulary terms, of unit length per row."""
    terms = docs.select(id_col, F.explode(unigrams_bigrams(tokens(F.col(text)))).alias("term"))
    known = vocab.select("term", "idf")
    if known.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS:
        known = F.broadcast(known)
    tf = terms.join(known, "term").groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.first("idf").alias("idf"))
    w = (1 + F.log("tf") if sublinear else F.col("tf")) * F.col("idf")
    raw = tf.select(id_col, "term", w.alias("w"))
    norm = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, id_col).select(id_col, "term", (F.col("w") / F.col("norm")).alias("weight"))
