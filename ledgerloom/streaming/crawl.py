"""A bounded, resumable acquisition: discovery, statuses, waves of requests, resume guards.

The state of a crawl is never kept as such: what is known of each record is recomputed from the
discovered options and the log of attempts, so an interrupted crawl resumes from its tables.
"""

from __future__ import annotations

import json
import shutil
import threading
import time
import uuid
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import written
from ..operators.order import round_robin, seeded_rank
from ..sources.http import header, retry_after, retryable, wait
from ..sources.sinks import write_json

IDENTITY = ["model_year", "manufacturer", "model_name"]
CONFLICT = "conflicting identities"
ATTEMPT = "url string, place long, wave int, status int, body binary, error string, retryable boolean, after double"


def discovered(options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inventory, refused) from rows of option menus: vehicle_id, the IDENTITY columns,
    option_text and options_url. A menu with any id that isn't a positive whole number is refused
    as a whole (options_url). inventory: vehicle_id, provenance (sorted, without repeats),
    identities (their number); ids stay texts."""
    fine = F.coalesce(F.col("vehicle_id").rlike("^[0-9]*[1-9][0-9]*$"), F.lit(False))
    refused = options.groupBy("options_url").agg(F.min(fine).alias("fine")).where("NOT fine").select("options_url")
    good = options.join(refused, "options_url", "left_anti")
    told = F.struct(*IDENTITY, "option_text", "options_url")
    inventory = good.groupBy("vehicle_id").agg(F.array_sort(F.collect_set(told)).alias("provenance"), F.size(F.collect_set(F.struct(*IDENTITY))).alias("identities"))
    return inventory, refused


def statuses(inventory: DataFrame, log: DataFrame) -> DataFrame:
    """inventory with status and error from the last attempts (vehicle_id, valid, error): failed
    where identities conflict, whatever was fetched; fetched after a valid attempt; failed
    after others; discovered where there is none."""
    last = log.select("vehicle_id", F.col("valid").alias("__valid"), F.col("error").alias("__error"))
    both = inventory.join(last, "vehicle_id", "left")
    conflict = F.col("identities") > 1
    status = F.when(conflict, "failed").when(F.col("__valid"), "fetched").when(F.col("__valid").isNotNull(), "failed").otherwise("discovered")
    error = F.when(conflict, CONFLICT).when(~F.col("__valid"), F.coalesce("__error", F.lit("invalid")))
    return both.select(*inventory.columns, status.alias("status"), error.alias("error"))


def pending(state: DataFrame, seed: int = 42, most: int | None = None) -> DataFrame:
    """vehicle_id and place of the records to ask for: neither fetched nor in conflict, in a
    round-robin over year and make, in each in a seeded order. most bounds the fetched records of
    the whole crawl, those of earlier runs included."""
    queue = F.concat_ws(":", F.col("provenance")[0]["model_year"].cast("string"), F.col("provenance")[0]["manufacturer"]).alias("queue")
    open_ = state.where("status <> 'fetched' AND identities = 1").select("vehicle_id", queue)
    ranked = seeded_rank(open_, "queue", "vehicle_id", seed)
    turns = round_robin(ranked, "queue", "place").select("vehicle_id", "queue", "turn")
    left = None if most is None else max(0, most - state.where("status = 'fetched' AND identities = 1").count())
    ordered = turns.orderBy("turn", "queue") if left is None else turns.orderBy("turn", "queue").limit(left)
    return ordered.select("vehicle_id", "turn", "queue")


def attempts(urls: DataFrame, transport, wave: int, workers: int, spacing: float, timeout: float, valid) -> DataFrame:
    """A row of ATTEMPT for each row of urls (url, place): one request each, by at most so many
    workers, which together keep to one start per spacing."""
    def run(batches):
        for batch in batches:
            rows = []
            for url, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                begun, status, body, error, after = time.monotonic(), None, b"", None, None
                try:
                    status, headers, body = transport(url, timeout)
                    after = retry_after(header(headers, "Retry-After"), time.time())
                    error = f"http_{status}" if status != 200 else None if valid(url, body) else "schema"
                except OSError as e:
                    error = type(e).__name__
                again = error is not None and error != "schema" and retryable(status)
                rows.append((url, place, wave, status, body, error, again, after))
                time.sleep(max(0.0, workers * spacing - (time.monotonic() - begun)))
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], schema=SCHEMA)

    dealt = urls.repartitionByRange(workers, "place") if workers > 1 else urls.coalesce(1)
    return dealt.select("url", "place").mapInArrow(run, ATTEMPT)


SCHEMA = pa.schema([("url", pa.string()), ("place", pa.int64()), ("wave", pa.int32()), ("status", pa.int32()), ("body", pa.binary()), ("error", pa.string()), ("retryable", pa.bool_()), ("after", pa.float64())])
NAMES = SCHEMA.names


def crawl(urls: DataFrame, transport, *, valid=lambda url, body: True, most_attempts: int = 5, budget: int | None = None, workers: int = 4, spacing: float = 0.25,
          timeout: float = 30.0, sleep=time.sleep, jitter=lambda: 0.5) -> DataFrame:
    """All attempts (ATTEMPT) at urls (url, place), in waves.

    A wave asks for every url that is still open, in order of place, as far as the budget of
    requests goes; what failed for a passing reason is asked for again in the next wave. The
    longest Retry-After of a wave, or the backoff if that is longer, holds for the whole next
    wave. Each wave is written before the next one starts. What the budget leaves out has no row.
    """
    if not 1 <= workers <= 4 or most_attempts < 1 or (budget is not None and budget < 0):
        raise ValueError("1 to 4 workers, an attempt at least and no negative budget")
    out, open_, left = None, urls.select("url", F.col("place").cast("long").alias("place")), budget
    for wave in range(1, most_attempts + 1):
        if left is not None:
            open_ = open_.orderBy("place", "url").limit(left)
        done = written(attempts(open_, transport, wave, workers, spacing, timeout, valid), "wave")
        out = done if out is None else out.unionByName(done)
        n, again, after = done.agg(F.count("*"), F.count_if("retryable"), F.max("after")).first()
        if left is not None:
            left -= n
        if not again or left == 0 or wave == most_attempts:
            break
        sleep(wait(wave, jitter(), after))
        open_ = done.where("retryable").select("url", "place")
    return out


def open_snapshot(folder: str | Path, scope: dict, config: dict, resume: bool = False) -> dict:
    """Start a snapshot, or resume one whose scope and configuration are the same. Returns its
    metadata, with one more invocation."""
    folder = Path(folder)
    if resume:
        if not (folder / "snapshot.json").is_file():
            raise ValueError("there is no snapshot to resume")
        meta = json.loads((folder / "snapshot.json").read_text())
        if meta["scope"] != scope:
            raise ValueError("the scope isn't that of the snapshot")
        if json.loads((folder / "config.json").read_text()) != config:
            raise ValueError("the configuration isn't that of the snapshot")
    else:
        if (folder / "snapshot.json").exists():
            raise ValueError("the snapshot exists; resume it")
        meta = {"scope": scope, "invocations": 0}
        write_json(folder / "config.json", config)
    meta["invocations"] += 1
    write_json(folder / "snapshot.json", meta)
    return meta


def _expired(lock: Path, lease: float, now: float) -> bool:
    """Whether the holder of a lock has let its lease run out; without a lease, its folder's age counts."""
    try:
        return json.loads((lock / "lease.json").read_text())["until"] < now
    except (OSError, ValueError, KeyError, TypeError):
        try:
            return lock.stat().st_mtime + lease < now
        except OSError:
            return False


@contextmanager
def only_writer(folder: str | Path, resume: bool = False, lease: float = 60.0, clock=time.time):
    """One crawl at a time in a folder that hosts may share: who makes the lock's folder holds it, and
    renews its lease while it runs. On resume a lock whose lease has run out is moved aside, which
    one caller alone can do; any other lock raises."""
    lock, holder, ended = Path(folder) / ".crawl.lease", uuid.uuid4().hex, threading.Event()
    taken = f"{lock}: another crawl may be running"
    try:
        lock.mkdir()
    except FileExistsError:
        if not (resume and _expired(lock, lease, clock())):
            raise RuntimeError(taken) from None
        try:
            lock.rename(aside := lock.with_name(f".expired-{holder}"))
            lock.mkdir()
        except OSError:
            raise RuntimeError(taken) from None
        shutil.rmtree(aside, ignore_errors=True)

    def renew():
        write_json(lock / "lease.json", {"holder": holder, "until": clock() + lease})

    def keep():
        while not ended.wait(lease / 3):
            renew()

    renew()
    keeper = threading.Thread(target=keep, daemon=True)
    keeper.start()
    try:
        yield
    finally:
        ended.set()
        keeper.join()
        if json.loads((lock / "lease.json").read_text())["holder"] == holder:
            shutil.rmtree(lock)
