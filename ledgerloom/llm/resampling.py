"""Quality classification by importance resampling (DSIR, Xie et al., 2023).

Two bag models over hashed word uni- and bigrams, one of target texts and one of all raw texts;
a document's log weight is the sum of its n-grams' log probability ratios. Adding Gumbel noise
and keeping the k largest keys samples k documents without replacement by their weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices

BUCKET_BITS = 18
#: Labelled target rows from which the target model is fitted: those of the smallest id hashes.
MAX_TARGET_ROWS = 50_000
#: Standard deviations of a bucket's count that count as chance.
SIGMAS = 5.0


class _Hashes(dict):
    def __missing__(self, word):
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 1 << 18:
            self[word] = h
        return h


def ngram_buckets(texts: list[str | None], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and how many each text has. Words are cut at ASCII
    white space; case stays, as it tells texts apart."""
    lists = [(t or "").encode().split() for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    h = np.fromiter((hashes[w] for words in lists for w in words), np.uint64, int(n.sum()))
    doc = np.repeat(np.arange(len(lists)), n)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    two = (h[pair] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[pair + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    shift = np.uint64(64 - BUCKET_BITS)
    mixed = np.concatenate([h * np.uint64(0xD6E8FEB86659FD93), two * np.uint64(0xFF51AFD7ED558CCD)]) >> shift
    owner = np.concatenate([doc, doc[pair]])
    return mixed.astype(np.int64), owner


def _counts_task(targets):
    def run(batches):
        hashes, chosen = _Hashes(), targets.value
        raw = np.zeros(1 << BUCKET_BITS, np.int64)
        target = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in slices(batches):
            buckets, owner = ngram_buckets(batch.column(1).to_pylist(), hashes)
            raw += np.bincount(buckets, minlength=len(raw))
            good = np.fromiter((i in chosen for i in batch.column(0).to_pylist()), bool, batch.num_rows)
            if good.any():
                target += np.bincount(buckets[good[owner]], minlength=len(raw))
        b = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(raw[b]), pa.array(target[b])], ["bucket", "raw", "target"])
    return run


def judged(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(
        "doc_id", (F.col("quality") * (1 - F.coalesce("toxic", F.lit(0)))).alias("y"))


def _fitted():
    """Half of the labelled rows fit the target model; the cut is chosen on the others."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0


def log_ratios(docs: DataFrame, labels: DataFrame, max_target_rows: int = MAX_TARGET_ROWS, smoothing: float = 8.0) -> np.ndarray:
    """log p_target - log p_raw per bucket.

    The raw model counts every document. A fixed number of buckets comes to the driver.
    """
    rows = judged(labels).where("y = 1").where(_fitted()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target_rows).collect()
    targets = docs.sparkSession.sparkContext.broadcast(frozenset(r.doc_id for r in rows))
    sums = docs.select("doc_id", "text").mapInArrow(_counts_task(targets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table = sums.toArrow()
    raw = np.zeros(1 << BUCKET_BITS)
    target = np.zeros(1 << BUCKET_BITS)
    raw[table["bucket"].to_numpy()] = table["raw"].to_numpy()
    target[table["bucket"].to_numpy()] = table["target"].to_numpy()
    if not target.sum():
        return np.zeros(len(raw))
    # Both models get the same prior counts, the raw one at the target's size: what is rare says little.
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log(target + smoothing) - np.log(expected + smoothing)
    # The target model departs from the raw one only where the counts do so significantly.
    sure = 1 - SIGMAS**2 * (expected + smoothing) / np.maximum((target - expected) ** 2, 1e-9)
    return ratio * np.maximum(sure, 0.0)


def target_cut(keys: DataFrame, labels: DataFrame, keep_targets: float, max_rows: int = MAX_TARGET_ROWS) -> float:
    """The log weight that the share keep_targets of the labelled targets reach, over at most
    max_rows targets that the model wasn't fitted on (those of the smallest id hashes)."""
    some = judged(labels).where("y = 1").where(~_fitted()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    held = materialize(keys.join(F.broadcast(some), "doc_id").select(F.col("log_weight").alias("key")), "targets")  # max_rows ids
    n = held.count()  # rows, of which an id may have any number
    cut = kth_key(held, n - int((n - 1) * (1 - keep_targets))) if n else -np.inf
    discard(held)
    return cut


def _score_task(table, seed):
    def run(batches):
        hashes, ratio = _Hashes(), table.value
        for batch in slices(batches):
            buckets, owner = ngram_buckets(batch.column(1).to_pylist(), hashes)
            weight = np.bincount(owner, ratio[buckets], batch.num_rows)
            u = np.fromiter(((xxhash.xxh64_intdigest(str(i).encode(), seed) >> 11) + 0.5 for i in batch.column(0).to_pylist()), float, batch.num_rows) / 2.0**53
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(weight - np.log(-np.log(u)))], ["doc_id", "log_weight", "key"])
    return run


def resample(docs: DataFrame, labels: DataFrame, keep_fraction: float | None = None, keep_targets: float = 0.97,
             seed: int = 17, max_target_rows: int = MAX_TARGET_ROWS) -> DataFrame:
    """doc_id, log_weight, key and kept of each row of docs.

    Keeps the k largest keys: round(keep_fraction * rows), or by default as many as there are
    rows of at least the log weight that the share keep_targets of the labelled targets (quality
    1, not toxic) reach that the model wasn't fitted on. Equal keys at the border (repeated rows) are kept together.
    The noise depends on doc_id and seed alone. Null and empty texts have weight 0; null
    labels count as unlabelled, null toxic as not toxic; without target rows all weights are 0.
    An empty table gives an empty result. Other columns are not read.
    """
    table = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, max_target_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = materialize(docs.select("doc_id", "text").mapInArrow(_score_task(table, seed), f"doc_id {kind}, log_weight double, key double"), "keys")
    if keep_fraction is None:
        k = keys.where(F.col("log_weight") >= F.lit(target_cut(keys, labels, keep_targets, max_target_rows))).count()
    else:
        k = round(keys.count() * keep_fraction)
    low = kth_key(keys, k)
    return keys.withColumn("kept", F.col("key") >= F.lit(low))


def kth_key(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest key, exactly: the range that holds it is cut into equal bins, whose
    counts are all that is collected, until it holds a single value."""
    if k <= 0:
        return float("inf")
    low, high, above = *keys.agg(F.min("key"), F.max("key")).first(), 0
    if low is None:
        return float("inf")
    while low < high:
        width = (high - low) / bins
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("key") - F.lit(low)) / F.lit(width)).cast("int")) if width > 0 else F.lit(0)
        some = keys.where((F.col("key") >= F.lit(low)) & (F.col("key") <= F.lit(high)))
        rows = some.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r.low):
            if above + r.n >= k:
                if (r.low, r.high) == (low, high):
                    return low
                low, high = r.low, r.high
                break
            above += r.n
        else:
            return low  # k exceeds the rows
    return low
