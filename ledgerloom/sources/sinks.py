"""Sinks: tables with content hashes, atomic JSON, write-once bytes, append-only logs, seals."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hash(df: DataFrame) -> str:
    """SHA-256 over a table's rows regardless of their order and files: a digest of row digests'
    sums, so nothing but counts and sums leaves the executors."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(5)]
    one = df.select(row.alias("h")).agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256(json.dumps([df.schema.simpleString(), *map(str, one)]).encode()).hexdigest()


def write_table(df: DataFrame, path: str, csv: bool = False) -> str:
    """Parquet, and CSV beside it, never over what exists; returns the content hash."""
    df.write.mode("errorifexists").parquet(f"{path}.parquet")
    back = df.sparkSession.read.parquet(f"{path}.parquet")
    if csv:
        flat = [F.array_join(c, "|").alias(c) if t == "array<string>" else F.col(c) for c, t in back.dtypes]
        back.select(*flat).write.mode("errorifexists").option("header", True).csv(f"{path}.csv")
    return content_hash(back)


def write_json(path: str | Path, value) -> None:
    """Atomic: a temporary file in the same folder, synced, then renamed. NaN is refused."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps(value, indent=2, sort_keys=True, allow_nan=False, ensure_ascii=False)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_once(path: str | Path, body: bytes) -> None:
    """Refuses to overwrite, unless the bytes are the same."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        with open(path, "xb") as f:
            f.write(body)
            f.flush()
            os.fsync(f.fileno())
    except FileExistsError:
        if path.read_bytes() != body:
            raise ValueError(f"{path} exists with other content") from None


def append_log(path: str | Path, entry: dict) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, sort_keys=True, allow_nan=False) + "\n")
        f.flush()
        os.fsync(f.fileno())


def rebuild_index(log: DataFrame, path: str) -> None:
    """The derived index of a log: a table of its last entries, always recomputed."""
    log.write.mode("overwrite").parquet(path)


def file_sha256(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def seal(path: str | Path, tables: dict[str, DataFrame], config: dict) -> dict:
    """Write-once hashes of tables and config. A second seal must say the same."""
    said = {"config": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(), "tables": {k: content_hash(v) for k, v in sorted(tables.items())}}
    if Path(path).exists():
        verify_seal(path, tables, config)
    else:
        write_json(path, said)
    return said


def verify_seal(path: str | Path, tables: dict[str, DataFrame], config: dict) -> None:
    kept = json.loads(Path(path).read_text())
    if kept["config"] != hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest():
        raise ValueError("the config isn't the sealed one")
    for name, df in tables.items():
        if kept["tables"].get(name) != content_hash(df):
            raise ValueError(f"{name} isn't the sealed table")


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of at most limit rows; floats with four decimals, pipes escaped."""
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in df.limit(limit).collect()])
