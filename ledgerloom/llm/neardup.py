"""Near-duplicate classes of texts by word shingles, over a Gray-order index of SimHashes.

Texts at a Jaccard similarity of 0.8 differ in about 15 % of a SimHash's bits, far beyond the
few bits of an exact Hamming index. So the index is probabilistic, and exact behind that:

1. Each distinct text gets a 256-bit SimHash of its distinct shingles.
2. Upper nodes: a mask (some of the 256 bits) with the pattern its fingerprints share there.
   Masks are so many that a pair at the wanted similarity meets below one of them with
   probability 1 - MISS. Below a node fingerprints stand in Gray order, runs of neighbours are
   factored into the bits they share, and pairs of runs are pruned by accumulated differences.
   Near fingerprints form families; only stars, never pairs, leave a task.
3. Each family's texts are verified on their whole shingle sets: every pair within FAR standard
   deviations that isn't in one class yet. What is linked is at the similarity for certain.

Nodes and families of any size are dealt in blocks. First one hub (a leader of the node, the
blocks themselves for a family) joins what it can; only what it leaves apart visits the others'
blocks, so a large group of near copies costs work in proportion to its rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, local_components, materialize, slices, unused
from .simhash import gray_rank, majority_bits, runs_of

WIDE = 4  # words of a fingerprint; masks are drawn from all of its bits
NODE_BITS = 12  # a node holds up to 2 ** NODE_BITS unrelated texts, at any number of texts
NODE_CAP = 1 << 15  # fingerprints that a task compares with as many others
BLOCK_SHINGLES = 1 << 21  # shingles that a task verifies against as many others
NEAR_WORDS = 3  # words of a fingerprint that are compared below a node
MISS = 0.005
FAR = 3.5
NEAR = [f"f{k}" for k in range(NEAR_WORDS)]
RUN = 64
PAIRS = 1 << 20
#: Rows of (doc_id, hash) that are broadcast to find rows of docs by them; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 300_000


def agreement(similarity: float) -> float:
    """How often a bit of two SimHashes agrees at this Jaccard similarity of sets of equal size
    (sets of other sizes at the same similarity agree more often)."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def far_bits(similarity: float, bits: int) -> int:
    """Of so many bits, how many may differ: FAR standard deviations above the mean."""
    p = 1 - agreement(similarity)
    return min(bits, math.ceil(bits * p + FAR * math.sqrt(bits * p * (1 - p))))


# Shingles.

_rng = np.random.default_rng(3)
_ODD = _rng.integers(1 << 62, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _rng.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LONG = 4096  # bytes of a word from which it is hashed by itself
_POWER = np.cumprod(np.full(_LONG, 0xD6E8FEB86659FD93, np.uint64))
_LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTES = 1 << 20


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Well-spread 64-bit values (the finaliser of splitmix64)."""
    z = h + np.uint64(0x9E3779B97F4A7C15 * seed % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words, text after text, and how many each has."""
    parts = [(t or "").encode() for t in texts]
    raw = _LOWER[np.frombuffer(b"".join(p + b" " for p in parts), np.uint8)]
    inside = ~_BLANK[raw]
    change = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = change[::2], change[1::2]  # every text ends with a blank
    size = ends - starts
    n = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)])))
    out = np.zeros(len(starts), np.uint64)
    at, total = 0, np.cumsum(size)
    while at < len(starts):
        done = total[at] - size[at]
        stop = max(at + 1, int(np.searchsorted(total, done + _BYTES, "right")))
        long = size[at:stop] >= _LONG
        if long.any():
            stop = at + max(1, int(np.flatnonzero(long)[0]))
        if size[at] >= _LONG:
            out[at] = xxhash.xxh3_64_intdigest(raw[starts[at]:ends[at]].tobytes())
        else:
            some = raw[starts[at]:ends[stop - 1]]
            some, first = some[inside[starts[at]:ends[stop - 1]]], total[at:stop] - size[at:stop] - done
            place = np.arange(len(some)) - np.repeat(first, size[at:stop])
            out[at:stop] = np.add.reduceat(_BYTE[some] * _POWER[place], first)
        at = stop
    return out, n


def shingle_sets(w: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit shingles of texts of n[i] consecutive words of hashes w, text after
    text in ascending order, and how many each has. A text of fewer words is one shingle, one
    without words none."""
    total = len(w)
    if not total:
        return np.zeros(0, np.uint64), n
    end = np.repeat(np.cumsum(n), n)
    spread = mixed(w, 9)
    h = spread * _ODD[0]
    left = end - np.arange(total)  # words of the text from here
    for k in range(1, min(words, total)):
        h[:total - k] += spread[k:] * _ODD[k % 64] * (left[:total - k] > k)
    h, ends = mixed(h, 1), np.cumsum(n)
    sets = []
    for k, e in zip(n.tolist(), ends.tolist()):
        own = np.sort(h[e - k:max(e - words, e - k) + 1] if k else h[:0])
        sets.append(own[np.append(True, own[1:] != own[:-1])] if k else own)
    return np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))


def wide_fingerprints(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """256-bit fingerprints of the distinct shingles, a 128-bit hash of each text's lower-cased
    words in order, and the number of shingles."""
    w, n = word_hashes(texts)
    h, counts = shingle_sets(w, n, words)
    hashes = np.stack([mixed(h, 2 + k) for k in range(WIDE)], axis=1)
    same = np.zeros((len(texts), 2), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        first = np.cumsum(n) - n
        place = mixed((np.arange(len(w)) - np.repeat(first, n)).astype(np.uint64), 7)
        for k in range(2):
            same[full, k] = np.add.reduceat(mixed(w ^ place, 20 + k), first[full])
    same += mixed(n.astype(np.uint64), 30)[:, None]
    return majority_bits(hashes, counts), same.view(np.int64), counts


# The index.

def mask_recall(bits: int, masks: int, similarity: float) -> float:
    """How probably a pair at the similarity agrees on one of the masks: the masks are drawn
    from the same bits, so this is an expectation over how many of these differ."""
    width, same = 64 * WIDE, agreement(similarity)
    if same >= 1:
        return 1.0
    ways = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    missed = 0.0
    for d in range(width + 1):
        chance = math.exp(ways(width, d) + d * math.log(1 - same) + (width - d) * math.log(same))
        agree = math.exp(ways(width - d, bits) - ways(width, bits)) if width - d >= bits else 0.0
        missed += chance * (1 - agree) ** masks
    return 1 - missed


def upper_masks(n: int, similarity: float = 0.8, miss: float = MISS) -> list[np.ndarray]:
    """Bit positions of the upper nodes' masks for n distinct texts: so many bits that a node
    holds about 2 ** NODE_BITS unrelated texts at any n, and so many masks that a pair at the
    similarity shares the pattern of at least one with probability 1 - miss (see mask_recall)."""
    bits = min(40, max(4, math.ceil(math.log2(max(n, 2))) - NODE_BITS))
    count = 1
    while mask_recall(bits, count, similarity) < 1 - miss:
        count += max(1, count // 32)
    rng = np.random.default_rng(7)
    return [np.sort(rng.choice(64 * WIDE, bits, replace=False)) for _ in range(count)]


def key_task(masks: list[np.ndarray]):
    """A row (key, the first NEAR_WORDS words, tid) for each text and mask."""
    def run(batches):
        for batch in batches:
            f = [batch.column(f"f{k}").to_numpy() for k in range(WIDE)]
            bits = np.unpackbits(np.stack(f, axis=1).view(np.uint8), axis=1, bitorder="little")
            for t, mask in enumerate(masks):
                key = bits[:, mask].astype(np.int64) @ (1 << np.arange(len(mask), dtype=np.int64)) | t << len(mask)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c) for c in (*NEAR, "tid"))], ["key", *NEAR, "tid"])
    return run


def factored(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, bits) that runs of RUN neighbouring fingerprints (rows in Gray order) share."""
    at = np.arange(0, len(fp), RUN)
    ones, zeros = np.bitwise_and.reduceat(fp, at, axis=0), np.bitwise_and.reduceat(~fp, at, axis=0)
    return ones | zeros, ones


def near(x: np.ndarray, y: np.ndarray, cuts: list[int]):
    """Positions (i, j), in blocks, of the fingerprints (rows of words, in Gray order) of which
    the first k + 1 words differ in at most cuts[k] bits, for each k; i < j where y is x.

    Runs of neighbours are compared first, on the bits that both runs share: differences add up
    word by word, and what exceeds a word's cut falls away with all that stands below it."""
    mask_x, bits_x = factored(x)
    mask_y, bits_y = (mask_x, bits_x) if y is x else factored(y)
    ends = np.minimum(RUN * (np.arange(len(mask_y)) + 1), len(y))
    for g in range(len(mask_x)):
        low = g if y is x else 0
        apart = np.cumsum(np.bitwise_count((bits_x[g] ^ bits_y[low:]) & mask_x[g] & mask_y[low:]), axis=1, dtype=np.int64)
        live = low + np.flatnonzero((apart <= cuts).all(axis=1))
        if not len(live):
            continue
        if live[-1] - live[0] + 1 == len(live):
            js = np.arange(RUN * live[0], ends[live[-1]])
            whole = y[js[0]:js[-1] + 1]
        else:
            js = np.concatenate([np.arange(RUN * k, ends[k]) for k in live])
            whole = y[js]
        rows = np.arange(RUN * g, min(RUN * (g + 1), len(x)))
        for at in range(0, len(js), PAIRS // RUN):
            some, mine = whole[at:at + PAIRS // RUN], x[rows]
            d = np.bitwise_count(mine[:, :1] ^ some[None, :, 0])
            i, j = np.nonzero(d <= cuts[0])
            d = d[i, j].astype(np.int64)
            for k in range(1, x.shape[1]):
                d += np.bitwise_count(mine[i, k] ^ some[j, k])
                keep = d <= cuts[k]
                i, j, d = i[keep], j[keep], d[keep]
            i, j = rows[i], js[at + j]
            if y is x:
                two = i < j
                i, j = i[two], j[two]
            if len(i):
                yield i, j


def gray_order(fp: np.ndarray) -> np.ndarray:
    return np.lexsort([gray_rank(fp[:, k]) for k in range(fp.shape[1] - 1, -1, -1)])


def groups(batches, keys: list[str]):
    """Each run of rows with equal keys as one record batch, from batches sorted by the keys."""
    whole = lambda parts: parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    held, mark = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        starts = runs_of(*cols)
        for a, z in zip(starts, np.append(starts[1:], batch.num_rows)):
            now = tuple(c[a] for c in cols)
            if held and now != mark:
                yield whole(held)
                held = []
            held.append(batch.slice(a, z - a))
            mark = now
    if held:
        yield whole(held)


def words_of(batch, names) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in names], axis=1).view(np.uint64)


def stars(ids: np.ndarray, label: np.ndarray):
    """(a, b): each id and the first one of its label."""
    i = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[label[i]])], ["a", "b"])


def near_task(keys: list[str], cuts: list[int]):
    """Stars of the near fingerprints of each group: of its members (kind 0) with each other,
    or where there are visitors (kind 1) of these with the members."""
    def run(batches):
        for batch in groups(batches, keys):
            if batch.num_rows < 2:
                continue
            fp, ids = words_of(batch, NEAR), batch.column("tid").to_numpy()
            kind = batch.column("kind").to_numpy()
            order = gray_order(fp)
            order = order[np.argsort(kind[order], kind="stable")]
            fp, ids, members = fp[order], ids[order], int((kind == 0).sum())
            label = np.arange(len(fp))
            if members == len(fp):
                for i, j in near(fp, fp, cuts):
                    label = local_components(len(fp), i, j, label)
            elif members:
                for i, j in near(fp[members:], fp[:members], cuts):
                    label = local_components(len(fp), members + i, j, label)
            yield stars(ids, label)
    return run


def sorted_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def families(texts: DataFrame, similarity: float, node_cap: int = NODE_CAP) -> DataFrame:
    """(node, root) of the texts (tid, f0 to f3) with near fingerprints; see the module."""
    masks = upper_masks(texts.count(), similarity)
    cuts = [far_bits(similarity, 64 * (k + 1)) for k in range(NEAR_WORDS)]
    words = ", ".join(f"{c} long" for c in NEAR)
    keyed = texts.select("tid", *[f"f{k}" for k in range(WIDE)]).mapInArrow(key_task(masks), f"key long, {words}, tid long")
    large = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("tid", *NEAR)).alias("hub")).where(F.col("n") > node_cap), "node-sizes")
    some = large.limit(1).count() > 0
    small = keyed.join(large.select("key"), "key", "left_anti") if some else keyed
    edges = sorted_groups(small.withColumn("kind", F.lit(0)), ["key"]).mapInArrow(near_task(["key"], cuts), "a long, b long")
    if some:
        # Rows near the hub of their node are joined by it; the others visit all rows of the node.
        apart, by_hub = F.lit(0), F.lit(True)
        for c, cut in zip(NEAR, cuts):
            apart = apart + F.bit_count(F.col(c).bitwiseXOR(F.col(f"hub.{c}")))
            by_hub = by_hub & (apart <= cut)
        rows = keyed.join(large, "key").withColumn("blocks", F.ceil(F.col("n") / node_cap).cast("int"))
        rows = materialize(rows.select("key", *NEAR, "tid", F.col("hub.tid").alias("hub"), "blocks", by_hub.alias("joined")), "node-rows")
        counts = rows.where("NOT joined").groupBy("key").agg(F.ceil(F.count("*") / node_cap).cast("int").alias("parts"))
        hash_ = F.xxhash64("tid")
        members = rows.join(counts, "key").select("key", F.pmod(hash_, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), *NEAR, "tid")
        visitors = rows.where("NOT joined").join(counts, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(hash_, F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), *NEAR, "tid")
        place = ["key", "block", "part"]
        edges = edges.unionByName(rows.where("joined").select(F.col("tid").alias("a"), F.col("hub").alias("b"))).unionByName(
            sorted_groups(members.unionByName(visitors), place).mapInArrow(near_task(place, cuts), "a long, b long"))
    found = materialize(edges.where("a <> b").distinct(), "near-stars")
    roots = connected_components(found, "near-families")
    discard(found)
    return roots


# Verification.

def verify_task(keys: list[str], similarity: float):
    """Stars of the texts of each group that are linked: its members (kind 0) with each other,
    or where there are visitors (kind 1) these with the members. Texts of one label are in one
    class already; pairs between labels are verified where their fingerprints are near."""
    far = far_bits(similarity, 64 * WIDE)

    def run(batches):
        for batch in groups(batches, keys):
            if batch.num_rows < 2:
                continue
            kind = batch.column("kind").to_numpy()
            batch = batch.take(pa.array(np.argsort(kind, kind="stable")))
            members = int((kind == 0).sum())
            ids, fp = batch.column("tid").to_numpy(), words_of(batch, [f"f{k}" for k in range(WIDE)])
            s = batch.column("s")
            ends = s.offsets.to_numpy() - s.offsets[0].as_py()
            values, token = np.unique(s.flatten().to_numpy(), return_inverse=True)
            size = np.diff(ends)
            label = np.unique(batch.column("label").to_numpy(), return_inverse=True)[1]
            seen = np.zeros(len(values), bool)
            own = members == len(ids)
            for x in range(0 if own else members, len(ids)):
                y = np.arange(x) if own else np.arange(members)
                y = y[label[y] != label[x]]
                y = y[np.bitwise_count(fp[y] ^ fp[x]).sum(axis=1, dtype=np.int64) <= far]
                y = y[(np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x])) & (size[y] > 0)]
                if not len(y) or not size[x]:
                    continue
                mine = token[ends[x]:ends[x + 1]]
                seen[mine] = True
                hit = seen[np.concatenate([token[ends[k]:ends[k + 1]] for k in y])]
                seen[mine] = False
                both = np.add.reduceat(hit, np.cumsum(size[y]) - size[y], dtype=np.int64)
                y = y[both >= similarity * (size[y] + size[x] - both)]
                if len(y):
                    low = min(label[x], label[y].min())
                    label[np.isin(label, np.append(label[y], label[x]))] = low
            first = np.full(int(label.max()) + 1, len(ids))
            np.minimum.at(first, label, np.arange(len(ids)))
            yield stars(ids, first[label])
    return run


def rows_by(docs: DataFrame, h: str, keys: DataFrame, how: str) -> DataFrame:
    """docs (with the hash h of its texts) joined to keys (gid, gh, ...), by doc_id and h. Keys
    are broadcast up to MAX_BROADCAST_ROWS."""
    if keys.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return docs.join(keys, (docs["doc_id"] == keys["gid"]) & (docs[h] == keys["gh"]), how)


def class_rows(docs: DataFrame, words: int, similarity: float, node_cap: int = NODE_CAP, block: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (doc_id, h, s0, s1) of docs, classes (s0, s1, low, many) of the distinct texts of
    rows with a doc_id, and repeats (gid, gh): the pairs doc_id and h that more rows share. h is
    xxhash64 of the text, low the smallest (doc_id, h) of the class; many tells classes of more
    than one row."""
    def prints(batches):
        for batch in slices(batches):
            fp, same, n = wide_fingerprints(batch.column(1).to_pylist(), words)
            cols = [pa.array(np.ascontiguousarray(x[:, k])) for x in (fp.view(np.int64), same) for k in range(x.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), *cols], ["doc_id", "h", "n", *names, "s0", "s1"])

    def sets(columns):
        def run(batches):
            for batch in slices(batches):
                h, n = shingle_sets(*word_hashes(batch.column(0).to_pylist()), words)
                s = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], s], [*columns, "s"])
        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"f{k}" for k in range(WIDE)]
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = materialize(hashed.mapInArrow(prints, f"doc_id {kind}, h long, n long, {', '.join(f'{c} long' for c in names)}, s0 long, s1 long"), "prints")
    repeats = materialize(rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("gid"), F.col("h").alias("gh")).count().where("count > 1").select("gid", "gh"), "repeats")
    texts = materialize(rows.where("doc_id IS NOT NULL").groupBy("s0", "s1").agg(
        F.min(F.struct("doc_id", "h")).alias("low"), F.count("*").alias("rows"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in names])
        .withColumn("tid", F.monotonically_increasing_id()), "texts")
    family = families(texts, similarity, node_cap)
    family = family.unionByName(family.select(F.col("root").alias("node"), "root").distinct())
    # The families' texts, and the blocks that each family is dealt in.
    held = texts.join(family, texts.tid == family.node).select("tid", "n", *names, "low", F.col("root").alias("family"))
    size = held.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / block), F.lit(1)).cast("int").alias("blocks"), F.count("*").alias("members"))
    held = held.join(size, "family").where("members > 1").select(
        F.col("low.doc_id").alias("gid"), F.col("low.h").alias("gh"), "tid", "family", "blocks", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int").alias("block"), *names)
    held = materialize(held, "family-texts")
    twice = repeats.limit(1).count() > 0

    def shingled(some):
        """The texts some of held with their shingle sets, each once."""
        columns = ["tid", "family", "blocks", "block", *names]
        text = rows_by(hashed, "h", some, "inner").select("text", *columns)
        if twice:
            text = text.groupBy("tid").agg(F.first("text").alias("text"), *[F.first(c).alias(c) for c in columns[1:]]).select("text", *columns)
        return text.mapInArrow(sets(columns), ", ".join(f"{c} {t}" for c, t in some.select(*columns).dtypes) + ", s array<long>")

    place = ["family", "block"]
    own = sorted_groups(shingled(held).select(*place, "tid", F.col("tid").alias("label"), F.lit(0).alias("kind"), "s", *names), place)
    links = materialize(own.mapInArrow(verify_task(place, similarity), "a long, b long"), "links")
    roots = connected_components(links, "classes")
    wide = held.where("blocks > 1")
    if wide.limit(1).count():
        wide = shingled(wide)
        # Of families in blocks, texts outside of the largest class visit all other blocks.
        wide = materialize(wide.join(roots, wide.tid == roots.node, "left").withColumn("label", F.coalesce("root", "tid")).drop("node", "root"), "wide-families")
        most = wide.groupBy("family", "label").agg(F.count("*").alias("c")).groupBy("family").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
        visiting = F.col("label") != F.col("main")
        told = wide.join(most, "family")
        parts = told.where(visiting).groupBy("family").agg(F.ceil(F.sum(F.size("s")) / block).cast("int").alias("parts"))
        told = told.join(parts, "family")
        columns = ["family", "block", "part", "tid", "label", "kind", "s", *names]
        members = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(0))
        visitors = told.where(visiting).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "tid"), F.greatest("parts", F.lit(1))).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("kind", F.lit(1))
        place = ["family", "block", "part"]
        across = sorted_groups(members.select(*columns).unionByName(visitors.select(*columns)), place).mapInArrow(verify_task(place, similarity), "a long, b long")
        links = links.unionByName(materialize(across, "links-across"))
        roots = connected_components(links, "classes")
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    named = texts.join(roots, texts.tid == roots.node, "left").select("s0", "s1", "low", "rows", F.coalesce("root", "tid").alias("class"), F.col("root").isNotNull().alias("linked"))
    lows = named.where("linked").groupBy("class").agg(F.min("low").alias("least"))
    classes = named.join(lows, "class", "left").select("s0", "s1", F.coalesce("least", "low").alias("low"), (F.col("linked") | (F.col("rows") > 1)).alias("many"))
    return rows, materialize(classes, "text-classes"), repeats


def near_duplicate_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id) of each row: texts linked at a Jaccard similarity of their word
    shingles (A-Z lower-cased) of at least `similarity`, class_id the smallest doc_id reachable.

    Equal word sequences are one text from the start; null and empty texts are one text. No
    pair below `similarity` links; a pair at it is found with probability 1 - MISS at least, and
    pairs of a family of near texts by any way between them. Rows that repeat a doc_id with
    another text are rows of their own. A null doc_id gives its text's class, or null where no
    row with a doc_id has that text.
    """
    rows, classes, _ = class_rows(docs, words, similarity)
    return rows.join(classes, ["s0", "s1"], "left").select("doc_id", F.col("low.doc_id").alias("class_id"))


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each class of near duplicates, that of the smallest doc_id (of equal
    ones, the smallest hash of the text); columns as they were.

    Of rows that repeat a doc_id and its text one stays. Rows without a doc_id stay. Rows that
    repeat a doc_id with texts of different classes all stay. Texts are shuffled only if more
    than MAX_BROADCAST_ROWS rows go.
    """
    rows, classes, repeats = class_rows(docs, words, similarity)
    out_of = classes.where("many").select("s0", "s1", "low")
    gone = rows.where("doc_id IS NOT NULL").join(out_of, ["s0", "s1"]).where("doc_id <> low.doc_id OR h <> low.h")
    gone = materialize(gone.select(F.col("doc_id").alias("gid"), F.col("h").alias("gh")).distinct(), "gone")
    columns = docs.columns
    h = unused(columns, "h")
    rest = rows_by(docs.withColumn(h, F.xxhash64("text")), h, gone, "left_anti")
    if repeats.limit(1).count():
        once = rows_by(rest, h, repeats, "left_anti")
        rest = once.unionByName(rows_by(rest, h, repeats, "left_semi").dropDuplicates(["doc_id", h]))
    return rest.select(*[F.col(f"`{c}`") for c in columns])
