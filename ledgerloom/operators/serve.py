"""Serving bundles, text arms, target scaling, stage comparison, review checks."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize
from ..functions.values import strip
from ..sources.sinks import write_json, write_once
from .features import Preprocessor
from .models import Forest, Linear, Median, Network
from .ranks import medians

#: Models that a bundle can hold; the numpy ones write themselves.
NUMPY = {"Forest": Forest, "Network": Network}

#: Feature arms: the structured predictors, and which text columns join them.
ARMS = {"structured": [], "structured_model": ["model_name"], "structured_engine": ["engine_description"], "structured_model_engine": ["model_name", "engine_description"]}


def select_arm(df: DataFrame, arm: str, structured: list[str], keep: list[str] = ()) -> DataFrame:
    """keep, the structured columns and the arm's sanitised texts; nothing else gets through."""
    if arm not in ARMS:
        raise ValueError(f"no arm {arm}")
    return df.select(*keep, *structured, *[sanitize(F.col(c)).alias(c) for c in ARMS[arm]])


#: Ids that one hash may run over.
MAX_IDS = 10_000_000


def ids_digest(df: DataFrame, id_col: str) -> str:
    """SHA-256 of the ids, sorted as texts, as a compact JSON list. The hash of one list is
    sequential, so the ids are hashed in the driver as they come, a partition at a time; more than
    MAX_IDS raise (content_hash takes any number)."""
    if df.limit(MAX_IDS + 1).count() > MAX_IDS:
        raise ValueError(f"more than {MAX_IDS} ids for one hash")
    h, first = hashlib.sha256(b"["), True
    for r in df.select(F.col(id_col).cast("string").alias("i")).orderBy("i").toLocalIterator():
        h.update((b"" if first else b",") + json.dumps(r.i).encode())
        first = False
    h.update(b"]")
    return h.hexdigest()


def interface_schema(train: DataFrame, categorical: list[str], numeric: list[str], id_col: str, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """field, options, median from training rows alone: the sorted stripped values of categories
    (within allowed, if given) and the medians of numbers, null where there are none; and a row
    `training_rows` with their number as median and the digest of their ids as its option.
    Rows of another split, or none at all, raise."""
    if not train.limit(1).count():
        raise ValueError("no training rows")
    if "split" in train.columns and train.where("NOT split <=> 'train'").limit(1).count():
        raise ValueError("the interface is described by training rows only")
    aggs = [F.array_sort(F.collect_set(F.nullif(strip(F.col(c).cast("string")), F.lit("")))).alias(c) for c in categorical] + []
    one = train.agg(*aggs, F.count("*").cast("double").alias("__n"))
    if numeric:
        one = one.crossJoin(F.broadcast(medians(train, [], numeric)))  # one row each
    listed = lambda c: F.array_sort(F.array_intersect(F.col(c), F.array(*map(F.lit, allowed[c])))) if c in (allowed or {}) else F.col(c)
    rows = [F.struct(F.lit(c).alias("field"), listed(c).alias("options"), F.lit(None).cast("double").alias("median")) for c in categorical]
    rows += [F.struct(F.lit(c).alias("field"), F.lit(None).cast("array<string>").alias("options"), F.col(c).cast("double").alias("median")) for c in numeric]
    rows.append(F.struct(F.lit("training_rows").alias("field"), F.array(F.lit(ids_digest(train, id_col))).alias("options"), F.col("__n").alias("median")))
    return one.select(F.inline(F.array(*rows)))


class TargetScaler:
    """Standardises the target by training rows and undoes it on predictions."""

    def fit(self, train: DataFrame, y: str) -> TargetScaler:
        self.mean, std = train.agg(F.avg(y), F.stddev_pop(y)).first()
        self.std = std or 1.0
        return self

    def transform(self, df: DataFrame, y: str) -> DataFrame:
        return df.withColumn(y, (F.col(y) - self.mean) / self.std)

    def inverse(self, df: DataFrame, predicted: str) -> DataFrame:
        return df.withColumn(predicted, F.col(predicted) * self.std + self.mean)


def save_bundle(folder: str | Path, model: Linear | Median | Forest | Network, preprocessor: Preprocessor, meta: dict) -> str:
    """Write the model once, and beside it a sidecar with its SHA-256; returns the hash."""
    p = preprocessor
    body = {"kind": type(model).__name__, "preprocessor": {k: getattr(p, k) for k in ("numeric", "categorical", "medians", "means", "stds", "missing", "levels")}}
    if isinstance(model, Linear):
        body |= {"coef": [float(c) for c in model.coef], "intercept": model.intercept}
    else:
        body |= model.to_json() if body["kind"] in NUMPY else {"value": model.value}
    data = json.dumps(body, sort_keys=True, allow_nan=False).encode()
    write_once(Path(folder) / "model.json", data)
    digest = hashlib.sha256(data).hexdigest()
    write_json(Path(folder) / "bundle.json", {**meta, "model_sha256": digest})
    return digest


def load_bundle(folder: str | Path, expected: dict | None = None) -> tuple[Linear | Median | Forest | Network, Preprocessor, dict]:
    """The bundle, after its hash and the expected metadata have been checked."""
    meta = json.loads((Path(folder) / "bundle.json").read_text())
    for k, v in (expected or {}).items():
        if meta.get(k) != v:
            raise ValueError(f"{k} isn't the expected one")
    data = (Path(folder) / "model.json").read_bytes()
    if hashlib.sha256(data).hexdigest() != meta["model_sha256"]:
        raise ValueError("the model isn't the sealed one")
    body = json.loads(data)
    if body["kind"] == "Linear":
        model = Linear()
        model.coef, model.intercept = np.array(body["coef"]), body["intercept"]
    elif body["kind"] in NUMPY:
        model = NUMPY[body["kind"]].from_json(body)
    else:
        model = Median()
        model.value = body["value"]
    return model, Preprocessor(**body["preprocessor"]), meta


def score(bundle, df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, y_pred and error: rows that already have an error aren't scored, and a prediction
    that isn't finite and positive is an error."""
    model, p, _ = bundle
    checked = df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))
    out = model.predict(p.vector(checked, [*keep, "error"]))
    good = F.coalesce((F.col("y_pred") > 0) & (F.col("y_pred") < float("inf")), F.lit(False))
    return out.select(*keep, F.when(F.col("error").isNull() & good, F.col("y_pred")).alias("y_pred"), F.coalesce("error", F.when(~good, "invalid_prediction")).alias("error"))


def compare_stages(stages: list[tuple[str, dict, DataFrame]]) -> DataFrame:
    """stage and the rows of each stage's summary; the stages' hashes must be the same."""
    if len({json.dumps(h, sort_keys=True) for _, h, _ in stages}) != 1:
        raise ValueError("the stages don't share dataset and split")
    out = None
    for name, _, df in stages:
        one = df.withColumn("stage", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def check_reviews(candidates: DataFrame, decisions: DataFrame, key: str, final: bool) -> DataFrame:
    """check, n: candidates without a decision, decisions without a candidate, repeated ones,
    unknown ones, accepted or rejected ones without a reason, and (if final) pending ones."""
    d = decisions
    counts = [
        ("undecided", candidates.join(d, key, "left_anti")), ("unknown_candidate", d.join(candidates, key, "left_anti")), ("repeated", d.groupBy(key).count().where("count > 1")),
        ("unknown_decision", d.where("decision IS NULL OR decision NOT IN ('accept', 'reject', 'pending')")),
        ("unjustified", d.where("decision IN ('accept', 'reject') AND coalesce(trim(reason), '') = ''")), ("pending", d.where("decision = 'pending'") if final else d.where("false")),
    ]
    out = None
    for name, df in counts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def check_segments(assignments: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose split differs from the manifest's, or that are on one side only."""
    a, b = assignments.select(key, F.col("split").alias("a")), manifest.select(key, F.col("split").alias("b"))
    return a.join(b, key, "full").where("NOT a <=> b")
