"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are factored from the top down: an upper node is a set of bit positions (a mask)
with the pattern its fingerprints share there. Two fingerprints at most D bits apart agree on
one of D + 1 disjoint masks, so they meet below one of the upper nodes. Below a node,
fingerprints stand in the order of their Gray rank, runs of neighbours are factored into the
bits they share, and pairs of such groups are pruned by the differences accumulated on them.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, local_components, materialize, slices

FAN = 16
BLOCK = 1 << 15
PAIRS = 1 << 18
NODE_CAP = 1 << 16


def shingles(text: str | None, words: int) -> list[bytes]:
    """Space-joined shingles of the lower-cased (A-Z) words, repeats included."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) < words:
        return [joined]
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends]
    return [joined[a:b - 1] for a, b in zip(starts, ends[words - 1:])]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of uint64) of documents with counts[i] consecutive rows of hashes
    each: a bit is 1 where it is 1 in over half of the rows; without rows all bits are 0.

    Bits are summed as bytes, eight to a word, over runs of at most 255 rows of a document."""
    width = hashes.shape[1]
    out = np.zeros((len(counts), width), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    many = counts[full]
    parts = -(-many // 255)
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(many) - many, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    ends = np.append(starts[1:], many.sum())
    ones = np.zeros((len(starts), 64 * width), np.uint8)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        rows = np.ascontiguousarray(hashes[starts[at]:ends[stop - 1]]).view(np.uint8)
        lanes = np.unpackbits(rows, axis=1, bitorder="little").view(np.uint64)
        ones[at:stop] = np.add.reduceat(lanes, starts[at:stop] - starts[at], axis=0).view(np.uint8)
        at = stop
    sums = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * sums > many[:, None], axis=1, bitorder="little").view(np.uint64)
    return out


def fingerprints64(texts: list[str | None], words: int) -> np.ndarray:
    lists = [shingles(t, words) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for one in lists for s in one), np.uint64, int(counts.sum()))
    return majority_bits(hashes.reshape(-1, 1), counts)[:, 0]


def gray_rank(fp: np.ndarray) -> np.ndarray:
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def hierarchy(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, bits) per level over fingerprints (rows of uint64) in Gray order, leaves first."""
    levels = [(np.full_like(fp, ~np.uint64(0)), fp)]
    while len(levels[-1][0]) > FAN:
        mask, bits = levels[-1]
        at = np.arange(0, len(mask), FAN)
        ones = np.bitwise_and.reduceat(mask & bits, at, axis=0)
        zeros = np.bitwise_and.reduceat(mask & ~bits, at, axis=0)
        levels.append((ones | zeros, ones))
    return levels


def near_pairs(fp: np.ndarray, most: int):
    """Positions (i, j), i < j, in blocks, of all pairs of fingerprints (rows in Gray order) at
    most `most` bits apart. Pairs of groups fall away once the differences on the bits that
    both groups share exceed it."""
    levels = hierarchy(fp)
    top = len(levels) - 1
    i, j = np.triu_indices(len(levels[top][0]))
    stack = [(top, i, j)]
    own = np.arange(FAN)
    while stack:
        level, i, j = stack.pop()
        if len(i) > PAIRS // FAN**2:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        mask, bits = levels[level]
        apart = np.bitwise_count((bits[i] ^ bits[j]) & mask[i] & mask[j]).sum(axis=1, dtype=np.int64)
        near = apart <= most
        i, j = i[near], j[near]
        if level == 0:
            two = i < j
            yield i[two], j[two]
            continue
        size = len(levels[level - 1][0])
        ci = np.repeat((i[:, None] * FAN + own).ravel(), FAN)
        cj = np.repeat(j[:, None] * FAN + own, FAN, axis=0).ravel()
        good = (ci < size) & (cj < size) & (ci <= cj)
        if good.any():
            stack.append((level - 1, ci[good], cj[good]))


def index_links(fp: np.ndarray, most: int) -> np.ndarray:
    """Component labels (smallest position) of fingerprints over links of at most `most` bits."""
    order = np.argsort(gray_rank(fp[:, 0]), kind="stable")
    label = np.arange(len(fp))
    for i, j in near_pairs(fp[order], most):
        label = local_components(len(fp), order[i], order[j], label)
    return label


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Start positions of runs of equal keys."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def grouped(batches, keys: list[str], columns: list[str]):
    """Whole runs of rows with equal keys, from batches sorted by the keys, as numpy columns."""
    held = None
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in columns}
        if not len(now[columns[0]]):
            continue
        last = runs_of(*(now[k] for k in keys))[-1]
        if last:
            yield {c: v[:last] for c, v in now.items()}
        held = {c: v[last:] for c, v in now.items()}
    if held is not None and len(held[columns[0]]):
        yield held


def link_task(most: int):
    def run(batches):
        for rows in grouped(batches, ["m", "key"], ["m", "key", "fp", "rep"]):
            fp, rep = rows["fp"].view(np.uint64), rows["rep"]
            start = runs_of(rows["m"], rows["key"])
            size = np.diff(np.append(start, len(fp)))
            group = np.repeat(np.arange(len(start)), size)
            label = np.arange(len(fp))
            if (size > 1).any():
                small = size[group] <= FAN  # such a group is one leaf of the hierarchy
                for k in range(1, min(FAN, int(size.max()))):
                    i = np.flatnonzero(small[:-k] & (group[:-k] == group[k:]))
                    i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= most]
                    label = local_components(len(fp), i, i + k, label)
                for g in np.flatnonzero(size > FAN):
                    s, e = start[g], start[g] + size[g]
                    label[s:e] = s + index_links(fp[s:e].reshape(-1, 1), most)
            i = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[label[i]])], ["a", "b"])
    return run


def child_masks(parent: int, most: int) -> list[int]:
    """most + 1 masks: the parent's bits and one of as many near-equal blocks of the others."""
    free = [b for b in range(64) if not parent >> b & 1]
    cuts = [len(free) * i // (most + 1) for i in range(most + 2)]
    return [parent | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_links(fps: DataFrame, most: int = 2, node_cap: int = NODE_CAP) -> DataFrame:
    """Links (a, b) that join each component of distinct fingerprints (fp, rep), at most `most`
    bits apart; a and b are values of rep. Exact. An upper node with over node_cap fingerprints
    is factored by further masks, until 64 - its bits bound it: no task takes a larger group."""
    def below(df, parents):
        kids = {p: child_masks(p, most) for p in parents}
        table = F.create_map(*[x for p in parents for x in (F.lit(signed(p)), F.array(*[F.lit(signed(k)) for k in kids[p]]))])
        out = df.select("fp", "rep", F.explode(F.element_at(table, F.col("m"))).alias("m"))
        return out.withColumn("key", F.col("fp").bitwiseAND(F.col("m"))), [k for ks in kids.values() for k in ks]

    level, masks = below(fps.withColumn("m", F.lit(0).cast("long")), [0])
    ready = None
    while True:
        large = level.groupBy("m", "key").count().where(F.col("count") > node_cap).select("m", "key")
        if 64 - min(m.bit_count() for m in masks) <= math.log2(node_cap) or large.isEmpty():
            ready = level if ready is None else ready.unionByName(level)
            break
        part = level.join(large, ["m", "key"], "left_anti")
        ready = part if ready is None else ready.unionByName(part)
        level, masks = below(level.join(large, ["m", "key"], "left_semi"), masks)
    rows = ready.repartition("m", "key").sortWithinPartitions("m", "key")
    return rows.select("m", "key", "fp", "rep").mapInArrow(link_task(most), "a long, b long")


def fingerprint_documents(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each row's whole text."""
    def run(batches):
        for batch in slices(batches):
            fp = fingerprints64(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def simhash_components(docs: DataFrame, words: int = 3, most: int = 2, node_cap: int = NODE_CAP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over
    links of at most `most` differing bits) of each row. doc_id is an integer column.

    Null and empty texts have fingerprint zero and link like any other. A null doc_id gives
    a row with a component of its fingerprint's other ids, or null. Repeated rows repeat in the
    result; an empty table gives an empty result; other columns of docs are not read.
    """
    fps = materialize(fingerprint_documents(docs, words), "simhash")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "simhash-reps")
    roots = connected_components(fingerprint_links(distinct, most, node_cap), "simhash-links")
    classes = distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(classes, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
