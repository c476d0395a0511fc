"""Leakage-free grouped splits and folds, their checks and their seal."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import written
from .order import placed, round_robin

#: Groups of a shuffle split: its permutation is sequential and made in the driver, as numbers.
MAX_GROUPS = 50_000_000


def shuffle_split(df: DataFrame, group: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """group, split: the first ceil(share * groups) of a seeded permutation of the sorted groups
    are the test groups. Groups are known to the driver as places only, and a bit a place is sent
    back; more than MAX_GROUPS raise (hash_split takes any number)."""
    found = placed(df.select(group).where(F.col(group).isNotNull()).distinct(), group)
    n = found.count()
    if n > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups; use hash_split")
    test = np.zeros(n, bool)
    test[np.random.RandomState(seed).permutation(n)[:math.ceil(test_share * n)]] = True
    bits = df.sparkSession.sparkContext.broadcast(np.packbits(test))

    @F.pandas_udf("boolean")
    def is_test(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((bits.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    return found.select(group, F.when(is_test("place"), "test").otherwise("train").alias("split"))


def hash_split(df: DataFrame, group: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with split, by a hash of the group: no driver step and no shuffle, for any number of
    groups; the share holds in expectation."""
    part = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("split", F.when(part < test_share, "test").otherwise("train"))


def fold_runs(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """(size, first, folds): of the groups of a size, those from place `first` on go to folds in turn.

    sizes: (size, number of groups), largest first. Each group goes to the lightest fold, the first
    of equals. Groups of one size fill slots at a fold's weight, weight + size, and so on, by
    (weight, fold): in whole rounds of the size, which folds join as their weight is reached."""
    weight, out = [0] * k, []
    for size, n in sizes:
        joins = sorted((w // size, w % size, f) for f, w in enumerate(weight))
        at, round_ = 0, joins[0][0]
        while at < n:
            active = [f for _, _, f in sorted((0, rest, f) for q, rest, f in joins if q <= round_)]
            later = min([q for q, _, _ in joins if q > round_], default=None)
            rounds = -(-(n - at) // len(active)) if later is None else min(later - round_, -(-(n - at) // len(active)))
            out.append((size, at, active))
            taken = min(n - at, rounds * len(active))
            for i, f in enumerate(active):
                weight[f] += size * (taken // len(active) + (i < taken % len(active)))
            at, round_ = at + taken, round_ + rounds
    return out


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """group, cv_fold: groups by size, largest first, each to the lightest fold; equal sizes go
    in reverse order of the group, ties to the lowest fold.

    The driver sees how many groups each size has; a group's fold follows from its place among
    the groups of its size."""
    sized = written(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("__size")), "sized")
    sizes = [(r[0], r[1]) for r in sized.groupBy("__size").agg(F.count("*").alias("n")).orderBy(F.desc("__size")).collect()]  # distinct sizes
    if sum(n for _, n in sizes) < k:
        raise ValueError(f"fewer than {k} groups")
    count = dict(sizes)
    runs: dict[int, list] = {}
    for size, first, folds in fold_runs(sizes, k):
        runs.setdefault(size, []).append((first, folds))
    table = df.sparkSession.createDataFrame([(size, count[size], [f for f, _ in r], [g for _, g in r]) for size, r in runs.items()], "__s long, __n long, __first array<long>, __folds array<array<int>>")
    turns = round_robin(sized, "__size", group).join(table, F.col("__size") == F.col("__s"))
    place = F.col("__n") - F.col("turn")  # in reverse order of the group
    turns = turns.withColumn("__place", place.cast("long")).withColumn("__run", (F.size(F.filter("__first", lambda f: f <= F.col("__place"))) - 1).cast("int"))
    folds = F.get("__folds", F.col("__run"))
    return turns.select(group, F.get(folds, ((F.col("__place") - F.get("__first", F.col("__run"))) % F.size(folds)).cast("int")).cast("int").alias("cv_fold"))


#: Fixed values of the split protocol.
PROTOCOL = {"method": "GroupShuffleSplit", "test_group_fraction": 0.2, "random_state": 42, "cv_method": "GroupKFold", "cv_n_splits": 5, "cv_shuffle": False,
            "group_fields": ["manufacturer", "base_model"], "fallback_group_field": "model_name"}


def check_protocol(split: dict) -> None:
    """Raise on any setting of a split that departs from the locked protocol."""
    off = sorted(k for k, v in PROTOCOL.items() if k not in split or split[k] != v)
    if off:
        raise ValueError(f"the split protocol is locked; changed: {', '.join(off)}")


#: Models whose predictions are checked together.
MAX_MODELS = 1_000


def check_predictions(predictions: DataFrame, manifest: DataFrame, id_col: str) -> DataFrame:
    """check, n over predictions (id, model, split, fold) against the manifest (id, split,
    cv_fold): per model, test and training ids exactly once, no fold on test rows, and the
    manifest's folds on training rows."""
    models = predictions.select("model").distinct()
    if models.limit(MAX_MODELS + 1).count() > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    m = manifest.select(id_col, F.col("split").alias("s"), F.col("cv_fold").alias("f"))
    wanted = m.crossJoin(F.broadcast(models))  # at most MAX_MODELS rows
    p = predictions.select(id_col, "model", F.when(F.col("split") == "test", "test").otherwise("train").alias("s"), F.col("fold").alias("pf"))
    checks = {
        "missing": F.col("n").isNull(), "unknown": (F.col("n") > 0) & ~F.col("known"), "repeated": F.col("n") > 1,
        "test_with_fold": (F.col("s") == "test") & F.col("pf").isNotNull(), "other_fold": F.col("known") & (F.col("s") == "train") & F.col("n").isNotNull() & ~F.col("pf").eqNullSafe(F.col("f")),
    }
    both = wanted.withColumn("known", F.lit(True)).join(p.groupBy(id_col, "model", "s").agg(F.count("*").alias("n"), F.max("pf").alias("pf")), [id_col, "model", "s"], "full").withColumn("known", F.coalesce("known", F.lit(False)))
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).cast("long").alias("off")) for k, v in checks.items()])
    return both.select(F.inline(rows)).groupBy("check").agg(F.sum("off").alias("n"))


def check_manifest(frame: DataFrame, manifest: DataFrame, id_col: str, group: str, k: int = 5) -> DataFrame:
    """check, n: violations; all zero for a sound manifest. Coverage both ways, groups on one
    side only, folds on training rows only and complete, one fold per group."""
    f, m = frame.select(id_col), manifest
    counts = [
        ("missing_ids", f.join(m, id_col, "left_anti")),
        ("unknown_ids", m.join(f, id_col, "left_anti")),
        ("repeated_ids", m.groupBy(id_col).count().where("count > 1")),
        ("groups_in_both_splits", m.groupBy(group).agg(F.count_distinct("split").alias("s")).where("s > 1")),
        ("test_rows_with_fold", m.where("split = 'test' AND cv_fold IS NOT NULL")),
        ("train_rows_without_fold", m.where(f"split = 'train' AND (cv_fold IS NULL OR cv_fold < 0 OR cv_fold >= {k})")),
        ("groups_in_several_folds", m.where("split = 'train'").groupBy(group).agg(F.count_distinct("cv_fold").alias("s")).where("s > 1")),
    ]
    out = None
    for name, df in counts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def build_manifest(df: DataFrame, id_col: str, group: str, k: int = 5, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """id, group, split, cv_fold (null on test rows)."""
    rows = df.select(id_col, group)
    split = shuffle_split(rows, group, test_share, seed)
    joined = rows.join(split, group)
    folds = group_folds(joined.where("split = 'train'"), group, k)
    return joined.join(folds, group, "left").select(id_col, group, "split", F.when(F.col("split") == "train", F.col("cv_fold")).alias("cv_fold"))
