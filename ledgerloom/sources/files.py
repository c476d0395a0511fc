"""Scans: datasets, JSON folders, request logs, inventories, manifests, menus, pages, runs."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import strip
from ..operators.dedup import require_unique
from ..operators.joins import overlay
from ..operators.order import latest


def dataset(spark: SparkSession, path: str, id_col: str, schema: str | None = None) -> DataFrame:
    """Parquet or CSV (typed by schema, ids as strings); ids trimmed, not null, not empty and
    unique; ordered by id as a string."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader).csv(path)
    else:
        raise ValueError(f"neither parquet nor csv: {path}")
    df = df.withColumn(id_col, F.nullif(strip(F.col(id_col).cast("string")), F.lit("")))
    return require_unique(df, [id_col]).orderBy(id_col)


def ids_only(spark: SparkSession, path: str, id_col: str, flag: str | None = None) -> DataFrame:
    """Only the ids, of rows whose flag column is true; flags other than true and false raise."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    if flag:
        text = F.lower(F.col(flag).cast("string"))
        df = df.where(F.when(text.isin("true", "false"), text == "true").otherwise(F.raise_error(F.lit(f"{flag} is not a boolean")).cast("boolean")))
    return df.select(F.col(id_col).cast("string").alias(id_col))


def json_folder(spark: SparkSession, path: str) -> DataFrame:
    """file, content, sha256, raw (text) of each whole *.json file; an empty folder raises."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    if df.limit(1).count() == 0:
        raise ValueError(f"no JSON files in {path}")
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("raw"))


LOG = "request_id string, url string, file string, sha256 string, status int, valid boolean, received_at_utc string, kind string, snapshot_id string"


def request_log(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """Per file the last entry of a JSONL log; blank lines are skipped, back slashes in names
    become slashes. A fallback index (name to entry, flat or below `entries`) only adds files."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))  # files by name, then lines in order
    lines = spark.read.text(path).select("value", place.alias("line")).where("trim(value) <> ''")
    log = lines.select("line", F.from_json("value", LOG).alias("e")).select("line", "e.*").withColumn("file", F.replace("file", F.lit("\\"), F.lit("/")))
    last = latest(log.where("file IS NOT NULL"), "file", "line").drop("line")
    if fallback is None:
        return last
    text = spark.read.text(fallback, wholetext=True)
    m = "from_json(value, 'map<string,string>')"
    flat = text.selectExpr(f"explode(coalesce(from_json({m}['entries'], 'map<string,string>'), {m})) as (k, v)")
    index = flat.select("k", F.from_json("v", LOG).alias("e")).select("e.*", F.replace(F.coalesce("e.file", "k"), F.lit("\\"), F.lit("/")).alias("name"))
    index = index.drop("file").withColumnRenamed("name", "file").select(*last.columns)
    return overlay(last, index, "file")


PROVENANCE = "array<struct<model_year:int,manufacturer:string,model_name:string,option_text:string,options_url:string>>"


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """vehicle_id, status, error, provenance: a row per entry of the `records` mapping."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.from_json("value", f"records map<string,struct<vehicle_id:string,status:string,error:string,provenance:{PROVENANCE}>>").alias("j"))
    if rows.where("j.records IS NULL").limit(1).count():
        raise ValueError("no records mapping")
    return rows.select(F.explode("j.records").alias("key", "r")).select(F.coalesce("r.vehicle_id", "key").alias("vehicle_id"), "r.status", "r.error", "r.provenance")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("vehicle_id string, model_group string, split string, cv_fold int").csv(path)


def menu_file(name: str, params: dict | None = None) -> str:
    """File name of a menu request: the name and 16 hex digits over the parameters as a JSON object
    with sorted keys (values of any JSON type, ASCII escapes, a blank after `,` and `:`)."""
    if name == "year":
        return "menus/year.json"
    text = json.dumps(params or {}, sort_keys=True)
    return f"menus/{name}_{hashlib.sha256(text.encode()).hexdigest()[:16]}.json"


def menu_items(df: DataFrame, raw: str) -> DataFrame:
    """df with items (array of text, value) and menu_error: null gives no items, an object one,
    a list its items; anything else is an error. Numbers count as text, booleans don't."""
    v = F.try_parse_json(F.col(raw))
    item = F.try_variant_get(v, "$.menuItem", "variant")
    kind = F.schema_of_variant(item)
    root = F.schema_of_variant(v)
    listed = F.try_variant_get(v, "$.menuItem", "array<variant>")
    items = F.when(kind.startswith("OBJECT"), F.array(item)).when(kind.startswith("ARRAY"), listed).otherwise(F.array().cast("array<variant>"))

    def part(x, key):
        p = F.try_variant_get(x, f"$.{key}", "variant")
        return F.when(F.schema_of_variant(p).isin("STRING", "BIGINT"), F.nullif(strip(F.try_variant_get(x, f"$.{key}", "string")), F.lit("")))

    rows = F.transform(items, lambda x: F.struct(part(x, "text").alias("text"), part(x, "value").alias("value")))
    bad = F.exists(rows, lambda r: r["text"].isNull() | r["value"].isNull())
    has = F.map_contains_key(F.try_variant_get(v, "$", "map<string,variant>"), F.lit("menuItem"))
    error = (F.when(v.isNull(), "invalid_json").when(root == "VOID", None).when(~root.startswith("OBJECT") | ~F.coalesce(has, F.lit(False)), "no_menu_object")
             .when((kind != "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), "bad_menu_type").when(bad, "bad_item"))
    return df.withColumn("menu_error", error).withColumn("items", F.when(F.col("menu_error").isNull(), F.coalesce(rows, F.array().cast("array<struct<text:string,value:string>>"))))


#: Named entities that list_items decodes.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def list_items(pages: DataFrame, id_col: str, html: str, keyed: bool = True) -> DataFrame:
    """id, position, key, meaning of list items, in the order in which they open; keyed: only
    `key - meaning` items, the first of each key; else every item's text as meaning.

    An item's own text runs from its tag to the next item, block or end of an item; tags inside
    are dropped, ENTITIES decoded, white space collapsed. Null pages have none. One projection.
    """
    begun = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<li(?:\s[^>]*)?>(.*?)(?=<li[\s>]|<div[\s>]|</li\s*>|\z)"), F.lit(1))

    def text(item):
        out = F.regexp_replace(item, r"(?s)<!--.*?-->|<[^>]*>", "")
        for entity, plain in ENTITIES.items():
            out = F.replace(out, F.lit(entity), F.lit(plain))
        return F.btrim(F.regexp_replace(out, r"(?U)\s+", " "))

    items = pages.select(id_col, F.posexplode(F.transform(begun, text)).alias("position", "item"))
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9_]*)\s*-\s*(.+)"
    named = F.nullif(F.regexp_extract("item", pattern, 1), F.lit(""))
    if not keyed:
        return items.select(id_col, "position", named.alias("key"), F.col("item").alias("meaning"))
    found = items.select(id_col, "position", named.alias("key"), F.regexp_extract("item", pattern, 2).alias("meaning")).where("key IS NOT NULL")
    return found.groupBy(id_col, "key").agg(F.min(F.struct("position", "meaning")).alias("m")).select(id_col, "m.position", "key", "m.meaning")


def best_run(root: str) -> Path:
    """Of completed runs, the production one, final before midterm, latest completed."""
    found = []
    for p in sorted(Path(root).glob("*/run_metadata.json")):
        m = json.loads(p.read_text())
        if m.get("status") == "completed" and m.get("stage") in ("final", "midterm"):
            found.append(((not m.get("development", False), m["stage"] == "final", str(m.get("completed_at", ""))), p.parent))
    if not found:
        raise ValueError(f"no completed run in {root}")
    return max(found)[1]


def snapshot_path(value: str, root: str) -> Path:
    """An absolute path, or one below the working folder, the root, or root/data/raw."""
    for p in (Path(value), Path(root) / value, Path(root) / "data" / "raw" / Path(value).name):
        if p.is_dir():
            return p.resolve()
    raise ValueError(f"no snapshot {value}")
