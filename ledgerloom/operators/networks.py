"""A network with one hidden layer, fitted by rounds of gradient sums in the cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import discard, written
from .local import Network
from .trees import Fit, _matrix

#: What a network is unless its options say otherwise.
DEFAULTS = {"hidden": 16, "epochs": 200, "rate": 0.01, "l2": 1e-4}

#: Rows of a block.
BLOCK = 4_096


def _shapes(width: int, hidden: int) -> list[tuple]:
    return [(width, hidden), (hidden,), (hidden,), (1,)]


def _parts(flat: np.ndarray, width: int, hidden: int) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _shapes(width, hidden):
        size = int(np.prod(shape))
        out.append(flat[at:at + size].reshape(shape))
        at += size
    return out


def gradient(p: list[np.ndarray], x: np.ndarray, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The sum of the gradients of half the squared error, flat. A row of x stands for n rows, whose
    targets add up to t: nothing else of them enters the sum."""
    h = np.maximum(0, x @ p[0] + p[1])
    e = n * (h @ p[2] + p[3][0]) - t
    back = np.outer(e, p[2]) * (h > 0)
    return np.concatenate([(x.T @ back).ravel(), back.sum(0), h.T @ e, [e.sum()]])


def _blocks(batches):
    """Batches as rows of bytes, one for BLOCK rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            parts = [some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2).flatten().to_numpy(), some.column(3).flatten().to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["n", "t", "folds", "x"])


def descend(rows: DataFrame, fits: list[Fit], seed: int = 42) -> list[Network]:
    """The fits' networks: Adam over the full batch, the target standardised on each fit's rows.

    rows: y, folds (array of int, one a scheme), x (array of double). Rows of the same folds and x
    are added up once, and the table that all rounds read is written in blocks of bytes, which cost
    a round little but the products. A round broadcasts the weights of all fits; each task sends one
    gradient sum a fit, they are added up by fit in the cluster, and the driver takes the step. No
    task or driver holds rows beyond a batch.
    """
    first = rows.select(F.size("x").alias("n"), F.size("folds").alias("s")).first()
    if first is None:
        raise ValueError("no rows")
    width, schemes = first.n, first.s
    held = written(rows.select("y", "folds", "x"), "network")
    mid = held.agg(F.avg("y")).first()[0]  # sums of deviations, so that no precision is lost
    alike = held.where(F.col("y").isNotNull()).groupBy("folds", "x").agg(F.count("y").alias("n"), F.sum(F.col("y") - F.lit(mid)).alias("t"))
    blocks = written(alike.select(F.col("n").cast("double").alias("n"), "t", "folds", "x").mapInArrow(_blocks, "n binary, t binary, folds binary, x binary"), "blocks")
    inside = [(F.get("folds", F.lit(f.scheme)) >= 0) & (F.get("folds", F.lit(f.scheme)) != f.held) for f in fits]
    y = [F.when(c, F.col("y")) for c in inside]
    # Two passes: deviations from the mean, so that no precision is lost.
    one = held.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(y)], *[F.avg(v).alias(f"m{i}") for i, v in enumerate(y)]).first()
    count, mean = np.array([one[f"n{i}"] for i in range(len(fits))]), [one[f"m{i}"] for i in range(len(fits))]
    if not count.all():
        raise ValueError("a fit without rows")
    square = held.agg(*[F.avg((v - F.lit(m)) * (v - F.lit(m))).alias(f"v{i}") for i, (v, m) in enumerate(zip(y, mean))]).first()
    std = [float(np.sqrt(square[f"v{i}"])) or 1.0 for i in range(len(fits))]
    flat = []
    for fit in fits:
        rng, hidden = np.random.default_rng(seed), fit.options["hidden"]
        p = [rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
        flat.append(np.concatenate([a.ravel() for a in p]))
    m, v = [np.zeros_like(a) for a in flat], [np.zeros_like(a) for a in flat]
    for step in range(1, max(f.options["epochs"] for f in fits) + 1):
        active = [i for i, f in enumerate(fits) if step <= f.options["epochs"]]
        shared = held.sparkSession.sparkContext.broadcast([(i, fits[i].scheme, fits[i].held, fits[i].options["hidden"], flat[i], mean[i], std[i]) for i in active])

        def run(batches):
            total: dict[int, np.ndarray] = {}
            for block in (b for batch in batches for b in zip(*(c.to_pylist() for c in batch.columns))):
                n, t, folds, x = (np.frombuffer(b, kind) for b, kind in zip(block, (float, float, np.int32, float)))
                folds, x = folds.reshape(-1, schemes), x.reshape(-1, width)
                for i, scheme, out, hidden, weights, mu, sd in shared.value:
                    mine = (folds[:, scheme] >= 0) & (folds[:, scheme] != out)
                    if mine.any():
                        total[i] = total.get(i, 0) + gradient(_parts(weights, width, hidden), x[mine], n[mine], (t[mine] - n[mine] * (mu - mid)) / sd)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([g.tobytes() for g in total.values()], pa.binary())], ["fit", "sums"])

        def add(table: pa.Table) -> pa.Table:
            g = sum(np.frombuffer(b, float) for b in table.column("sums").to_pylist())
            return pa.table({"fit": table.column("fit")[:1], "sums": pa.array([g.tobytes()], pa.binary())})

        got = blocks.mapInArrow(run, "fit int, sums binary").groupBy("fit").applyInArrow(add, "fit int, sums binary").collect()  # a row per fit
        shared.unpersist()
        for r in got:
            i, options = r.fit, fits[r.fit].options
            g = np.frombuffer(r.sums, float) / count[i]
            decay = np.concatenate([np.full(int(np.prod(s)), options["l2"] if k in (0, 2) else 0.0) for k, s in enumerate(_shapes(width, options["hidden"]))])
            g = g + decay * flat[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            flat[i] = flat[i] - options["rate"] * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    discard(held)
    discard(blocks)
    return [Network([a.copy() for a in _parts(flat[i], width, f.options["hidden"])], float(mean[i]), float(std[i])) for i, f in enumerate(fits)]
