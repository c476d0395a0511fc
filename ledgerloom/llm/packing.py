"""Mixture-controlled packing: deficit round-robin over one queue of documents per source.

Each round is one window of tokens. It gives every queue a quantum of credit, its target share
of the window in units of 2**-16 token, and a queue sends whole documents as long as its credit
covers the next one; what is left is carried to the next round. So the first t tokens of a queue
have been sent once the credit of k rounds covers them: a document leaves in round
ceil(e / quantum), where e are the tokens of its queue up to its own end. That needs no state
from other partitions but the queues' totals before them, and no queue is ever more than one
document away from its share. Documents longer than a window leave in parts of a window.

Documents are then sorted by round, queue and place, which is the order of the stream of tokens,
and the stream is cut into sequences. Runs of rounds are laid out by themselves, from the number
of tokens before them.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialize, running_totals, slices

UNIT = 1 << 16
#: Rounds that one task lays out in order.
RUN = 16
MAX_BROADCAST_BASES = 1_000_000
CACHE = 1 << 19
SPACE = re.compile(r"[\x20\t-\r]+")


#: Texts of these characters alone split by PARTS as the tokenizer splits them: no white space
#: but ASCII's, no character that normalisation composes, lower case by single characters.
PLAIN = re.compile(r"[^\t-\r\x20-\x7e\xa1-\xff]")
LETTER, DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^\\s{LETTER}{DIGIT}]+")

_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordIds:
    """Ids of a lower-casing word tokenizer whose parts never hold white space. Each part is
    encoded by the tokenizer once and then comes from a cache. A text is cut into the parts that
    the tokenizer itself cuts where its characters make that certain, else at white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        text = text or ""
        if PLAIN.search(text) or "<|" in text:  # the tokenizer finds its special tokens in texts
            return b"".join([np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in SPACE.split(text)])
        parts = PARTS.findall(text.lower())
        out = list(map(self.cache.get, parts))
        if None in out:
            new = {p for p, ids in zip(parts, out) if ids is None}
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
            model = self.tokenizer.model
            fresh = {}
            for p in new:  # a part's bytes, as the characters that byte-level models write them with
                ids = [t.id for t in model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(BYTES))]
                fresh[p] = struct.pack(f"<{len(ids)}I", *ids)
            self.cache.update((p, i) for p, i in fresh.items() if len(p) <= 64)
            out = [fresh[p] if ids is None else ids for p, ids in zip(parts, out)]
        return b"".join(out)


@lru_cache(2)
def load(path: str) -> WordIds:
    return WordIds(path)


def tokenize(docs: DataFrame, path: str, end_id: int, queue: str) -> DataFrame:
    """One row per row of docs: doc_id, queue, ids (with end_id), and where it stands: part
    (the partition), start (tokens of its queue before it in that partition)."""
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words = load(path)
        end = np.array([end_id], "<u4").tobytes()
        sent: dict[str | None, int] = {}
        for some in slices(batches, 512):
            ids = [words.encode(t) + end for t in some.column("text").to_pylist()]
            queues = some.column("queue").to_pylist()
            start = []
            for q, i in zip(queues, ids):
                start.append(sent.get(q, 0))
                sent[q] = start[-1] + len(i) // 4
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), some.column("queue"), pa.array([part] * len(ids), pa.int64()), pa.array(start, pa.int64()),
                 pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "queue", "part", "start", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.expr(queue).alias("queue")).mapInArrow(
        run, f"doc_id {kind}, queue string, part long, start long, n long, ids binary")


def quanta(totals: DataFrame, mixture: dict[str, float] | None, temper: float, window_tokens: int) -> DataFrame:
    """queue, quantum and after of each queue of totals (queue, total). after is the number of
    rounds before the queue's first: queues without a target begin when the others have ended,
    in proportion to their totals. Sources are never collected."""
    spark = totals.sparkSession
    if mixture is None:
        aimed = totals.withColumn("weight", F.pow(F.col("total").cast("double"), F.lit(temper)))
    else:
        if any(w < 0 or w != w or w == float("inf") for w in mixture.values()):
            raise ValueError("a target that is no share")
        wanted = spark.createDataFrame(list(mixture.items()) or [(None, 0.0)], "of string, weight double")
        aimed = totals.join(wanted, F.col("queue").eqNullSafe(F.col("of")), "left").select("queue", "total", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    late = F.col("weight") <= 0
    aimed = aimed.withColumns({"late": late, "weight": F.when(late, F.col("total").cast("double")).otherwise(F.col("weight"))})
    sums = {r.late: r.w for r in aimed.groupBy("late").agg(F.sum("weight").alias("w")).collect()}  # two rows
    whole = F.when(F.col("late"), F.lit(sums.get(True, 1.0))).otherwise(F.lit(sums.get(False, 1.0)))
    aimed = aimed.withColumn("quantum", F.greatest(F.lit(1), F.round(F.col("weight") / whole * (window_tokens * UNIT)).cast("long")))
    last = aimed.where("NOT late").agg(F.max(F.expr(f"(total * {UNIT} + quantum - 1) div quantum"))).first()[0] or 0
    return aimed.select("queue", "quantum", F.when(F.col("late"), F.lit(last)).otherwise(F.lit(0)).cast("long").alias("after"))


def stream(tokens: DataFrame, mixture: dict[str, float] | None, temper: float, window_tokens: int) -> DataFrame:
    """tokens (see tokenize) with where they stand: doc_id, queue, ids, begin (within the
    document), n, doc_tokens, round, place (in the queue), run and base (tokens of the stream
    before the run); partitioned by run and sorted by the order of the stream."""
    sums = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    q = quanta(materialize(sums.groupBy("queue").agg(F.sum("n").alias("total")), "totals"), mixture, temper, window_tokens)
    bases = sums.select(F.col("queue").alias("q"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    bases = materialize(bases.join(q, F.col("q").eqNullSafe(F.col("queue"))).select("q", "p", "before", "quantum", "after"), "bases")
    if bases.count() <= MAX_BROADCAST_BASES:  # a row per queue and partition; beyond it Spark shuffles by them
        bases = F.broadcast(bases)
    w = window_tokens
    units = tokens.join(bases, F.col("queue").eqNullSafe(F.col("q")) & (F.col("part") == F.col("p"))).select(
        "doc_id", "queue", "ids", "n", (F.col("before") + F.col("start")).alias("place"), "quantum", "after",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {w}"))).alias("k"))
    units = units.select(
        "doc_id", "queue", F.col("n").alias("doc_tokens"), (F.col("k") * w).alias("begin"), F.least(F.lit(w), F.col("n") - F.col("k") * w).alias("n"),
        (F.col("place") + F.col("k") * w).alias("place"), "quantum", "after",
        F.when(F.col("n") <= w, F.col("ids")).otherwise(F.substring("ids", (F.col("k") * (4 * w) + 1).cast("int"), F.lit(4 * w))).alias("ids"))
    units = units.withColumn("round", F.expr(f"after + ((place + n) * {UNIT} + quantum - 1) div quantum")).withColumn("run", F.expr(f"round div {RUN}"))
    runs = running_totals(units.groupBy("run").agg(F.sum("n").alias("n")), "run", "n").select(F.col("run").alias("r"), F.col("before").alias("base"))
    keep = ["doc_id", "queue", "ids", "begin", "n", "doc_tokens", "round", "place", "run"]
    placed = units.select(*keep).repartition("run").join(runs, F.col("run") == F.col("r")).select(*keep, "base")
    return placed.sortWithinPartitions("run", "round", "queue", "place")


def pack(docs: DataFrame, path: str, *, seq_len: int = 2048, end_id: int = 1, mixture: dict[str, float] | None = None, temper: float = 0.7,
         window_tokens: int = 64 * 2048, queue_col: str = "source", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, laid into sequences of seq_len tokens: doc_id, start, length,
    ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens, sequence_id, offset, queue.

    Every id of a document (its text's, then end_id) lies in exactly one piece, and only the
    last sequence isn't full. mixture maps queues to target shares of each window's tokens; by
    default the targets are the corpus's shares raised to the power `temper`, so that small
    sources are met earlier than at random. Queues without a target come after the others. A
    queue that is empty no longer takes part; the others keep their proportions. A document of
    up to a window's tokens is never interleaved with others, so it has at most
    length / seq_len + 2 pieces. Null and empty texts are packed as a single end_id. A null
    source is a queue of its own; repeated rows are packed as often as they come; an empty table
    gives an empty result; other columns are not read.
    """
    tokens = materialize(tokenize(docs, path, end_id, f"cast(`{queue_col}` as string)"), "tokens")
    placed = stream(tokens, mixture, temper, window_tokens)

    def run(batches):
        now, position = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                rows, where, ids_out = [], [], []
                data = some.column("ids")
                for i, (group, base, begin, n, whole) in enumerate(zip(*(some.column(c).to_pylist() for c in ("run", "base", "begin", "n", "doc_tokens")))):
                    if group != now:
                        now, position = group, base
                    ids, done = data[i].as_buffer(), 0
                    while done < n:
                        take = min(n - done, seq_len - position % seq_len)
                        piece = ids[4 * done:4 * (done + take)]
                        rows.append((begin + done, take, zlib.crc32(piece), whole, position // seq_len, position % seq_len))
                        where.append(i)
                        if with_ids:
                            ids_out.append(piece.to_pybytes())
                        done += take
                        position += take
                index = pa.array(where, pa.int64())
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 6
                names = ["doc_id", "queue", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                cols = [some.column("doc_id").take(index), some.column("queue").take(index), *cols]
                if with_ids:
                    names.append("ids")
                    cols.append(pa.array(ids_out, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, queue string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.select("doc_id", "queue", "run", "base", "begin", "n", "doc_tokens", "ids").mapInArrow(run, schema + (", ids binary" if with_ids else ""))
