"""A journal of responses as a data source: content-addressed bodies and one record per write.

    root/bodies/<part>/<sha256>    a task's bodies, each once, named by their content
    root/bodies/<part>/entries     the task's entries, one JSON object a line
    root/log/<write>.json          the record of a write: its parts, in order
    root/staging/<part>/           what a running task writes

A task writes to a folder of its own below staging, so a task that is repeated, or runs twice, leaves
two folders, of which the write's record names one. On commit the folders named are moved to
bodies, then the record is put in place by one rename: entries count from there on. What an aborted
or lost write leaves is in no record, is read by nobody, and goes with `recover`. The folder must
be one that the driver and all executors share as a file system.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

#: Columns of an entry besides its body; a row may lack any but url.
ENTRY = ["request_id", "url", "status", "valid", "received_at_utc", "kind", "error"]
ENTRIES = "request_id string, url string, status int, valid boolean, received_at_utc string, kind string, error string, file string, sha256 string"


def _folder(path: str) -> Path:
    return Path(path.removeprefix("file://"))


def _synced(path: Path, data: bytes) -> None:
    with open(path, "xb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())


@dataclass
class Part(WriterCommitMessage):
    """What a task has staged."""
    name: str
    entries: int


def stage(root: Path, rows) -> Part:
    """Write rows (with body, and ENTRY columns) to a new folder below staging."""
    part = uuid.uuid4().hex
    folder = root / "staging" / part
    folder.mkdir(parents=True)
    n = 0
    with open(folder / "entries", "x", encoding="utf-8") as log:
        for row in rows:
            given = row.asDict() if hasattr(row, "asDict") else dict(row)
            entry, body = {k: given.get(k) for k in ENTRY}, given.get("body")
            if body is not None:
                digest = hashlib.sha256(body).hexdigest()
                if not (folder / digest).exists():
                    _synced(folder / digest, bytes(body))
                entry |= {"file": f"bodies/{part}/{digest}", "sha256": digest}
            log.write(json.dumps(entry, sort_keys=True, allow_nan=False) + "\n")
            n += 1
        log.flush()
        os.fsync(log.fileno())
    return Part(part, n)


def publish(root: Path, write: str, parts: list[Part]) -> None:
    """Put a write's parts in place, then its record; a write that has a record already is not
    written again, and its new parts go."""
    record = root / "log" / f"{write}.json"
    if record.exists():
        return withdraw(root, parts)
    (root / "bodies").mkdir(parents=True, exist_ok=True)
    record.parent.mkdir(parents=True, exist_ok=True)
    used = [p for p in parts if p.entries]
    for p in used:
        os.rename(root / "staging" / p.name, root / "bodies" / p.name)
    new = record.with_name(f".{record.name}.{uuid.uuid4().hex}")
    _synced(new, json.dumps({"write": write, "parts": [p.name for p in used], "entries": sum(p.entries for p in used)}, sort_keys=True).encode())
    os.rename(new, record)
    withdraw(root, [p for p in parts if not p.entries])


def withdraw(root: Path, parts: list[Part]) -> None:
    for p in parts:
        shutil.rmtree(root / "staging" / p.name, ignore_errors=True)


def records(root: Path) -> list[dict]:
    """The journal's write records, by name of the write."""
    return [json.loads(p.read_text()) for p in sorted((root / "log").glob("*.json"))] if (root / "log").is_dir() else []


def recover(path: str) -> list[str]:
    """Remove what no record names: to be called while nobody writes. Returns the parts' names."""
    root = _folder(path)
    known = {p for r in records(root) for p in r["parts"]}
    lost = [p for d in ("staging", "bodies") if (root / d).is_dir() for p in sorted((root / d).iterdir()) if d == "staging" or p.name not in known]
    for p in lost:
        shutil.rmtree(p)
    for p in (root / "log").glob(".*") if (root / "log").is_dir() else []:
        p.unlink()
    return [p.name for p in lost]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.root, self.write_name = _folder(options["path"]), options.get("write") or uuid.uuid4().hex

    def write(self, iterator) -> Part:
        return stage(self.root, iterator)

    def commit(self, messages) -> None:
        publish(self.root, self.write_name, [m for m in messages if m is not None])

    def abort(self, messages) -> None:
        withdraw(self.root, [m for m in messages if m is not None])


class _StreamWriter(DataSourceStreamWriter):
    """A batch of a stream is a write named by the query and the batch, so a repeated one counts once."""

    def __init__(self, options: dict):
        self.root, self.query = _folder(options["path"]), options.get("write", "stream")

    def write(self, iterator) -> Part:
        return stage(self.root, iterator)

    def commit(self, messages, batchId) -> None:
        publish(self.root, f"{self.query}-{batchId:012d}", [m for m in messages if m is not None])

    def abort(self, messages, batchId) -> None:
        withdraw(self.root, [m for m in messages if m is not None])


class JournalSink(DataSource):
    """spark.dataSource.register(JournalSink); df.write.format("ledgerloom_journal").mode("append")
    .option("path", ...).option("write", name).save(). A write name that was committed is not written
    again. df: url, and any of ENTRY and body (binary)."""

    @classmethod
    def name(cls):
        return "ledgerloom_journal"

    def schema(self):
        return ENTRIES

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a journal is only appended to")
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The committed entries, with the write and the line of each part."""
    root = _folder(path)
    parts = [(r["write"], p) for r in records(root) for p in r["parts"]]
    if not parts:
        return spark.createDataFrame([], f"write string, {ENTRIES}")
    read = spark.read.schema(ENTRIES).json([f"file://{(root / 'bodies' / p / 'entries').absolute()}" for _, p in parts])
    named = read.withColumn("__part", F.element_at(F.split("_metadata.file_path", "/"), -2))
    writes = spark.createDataFrame(parts, "write string, part string")
    return named.join(F.broadcast(writes), F.col("__part") == F.col("part")).select("write", *read.columns)


def check_bodies(spark: SparkSession, path: str) -> DataFrame:
    """check, n: committed entries whose body is missing or has another hash, and bodies in parts that
    no entry names."""
    root = _folder(path)
    told = entries(spark, path).where("file IS NOT NULL").select("file", "sha256").distinct()
    if (root / "bodies").is_dir():
        found = spark.read.format("binaryFile").load(f"file://{root.absolute()}/bodies/*/*").where(F.element_at(F.split("path", "/"), -1) != "entries")
        held = found.select(F.concat_ws("/", F.lit("bodies"), F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)).alias("name"), F.sha2("content", 256).alias("is"))
    else:
        held = spark.createDataFrame([], "name string, is string")
    both = told.join(held, F.col("file") == F.col("name"), "full")
    checks = {"missing": F.col("name").isNull(), "other_content": F.col("name").isNotNull() & F.col("file").isNotNull() & (F.col("is") != F.col("sha256")), "unnamed": F.col("file").isNull()}
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).cast("long").alias("off")) for k, v in checks.items()])
    return both.select(F.inline(rows)).groupBy("check").agg(F.sum("off").alias("n"))
