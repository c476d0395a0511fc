"""The state of a crawl as a stream: what is known of each record, kept by Spark across restarts.

Events are options (a menu names the record) and attempts (a request for it ended). Each changes
the record's state and gives its new status; a passing failure also sets a timer, which says when
the record may be asked for again. The statuses are those that `crawl.statuses` recomputes from all
options and attempts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.http import wait
from .crawl import CONFLICT, IDENTITY

EVENTS = "vehicle_id string, seq long, kind string, model_year int, manufacturer string, model_name string, valid boolean, retryable boolean, error string, after double"
STATE = "identities string, conflict boolean, attempts int, last long, valid boolean, retryable boolean, error string"
CHANGES = "vehicle_id string, change string, seq long, status string, error string, attempts int, wait double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def change(known: tuple | None, event: dict) -> tuple:
    """The state (fields of STATE) after an event. Of attempts the one with the largest seq is the
    last, in whichever order they come; a second identity is a conflict for good."""
    identity, conflict, attempts, last, valid, retryable, error = known or (None, False, 0, None, None, None, None)
    if event["kind"] == "option":
        told = json.dumps([event[c] for c in IDENTITY])
        conflict, identity = conflict or identity not in (None, told), identity or told
    else:
        attempts += 1
        if last is None or event["seq"] > last:
            last, valid, retryable, error = event["seq"], event["valid"], event["retryable"], event["error"]
    return identity, conflict, attempts, last, valid, retryable, error


def status(known: tuple) -> tuple[str | None, str | None]:
    """Status and error of a state; none for a record that no menu has named."""
    identity, conflict, _, _, valid, _, error = known
    if identity is None:
        return None, None
    if conflict:
        return "failed", CONFLICT
    if valid is None:
        return "discovered", None
    return ("fetched", None) if valid else ("failed", error or "invalid")


class Record(StatefulProcessor):
    """State of one record; most_attempts bounds how often it is asked for."""

    def __init__(self, most_attempts: int = 5):
        self.most_attempts = most_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = tuple(self.known.get()) if self.known.exists() else None
        after, seq = None, -1
        for row in rows:
            event = row.asDict()
            known = change(known, event)
            seq = max(seq, event["seq"])
            if event["kind"] == "attempt" and event["seq"] == known[3]:
                after = event["after"]
        self.known.update(known)
        said, error = status(known)
        pause = None
        if said == "failed" and not known[1] and known[5] and known[2] < self.most_attempts:
            pause = wait(known[2], 0.0, after)
            for timer in list(self.handle.listTimers()):  # an older cooldown doesn't count
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * pause))
        if said is not None:
            yield Row(vehicle_id=key[0], change="status", seq=seq, status=said, error=error, attempts=known[2], wait=pause)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = tuple(self.known.get())
        said, error = status(known)
        if said == "failed" and not known[1] and known[5]:
            yield Row(vehicle_id=key[0], change="due", seq=known[3], status=said, error=error, attempts=known[2], wait=0.0)

    def close(self) -> None:
        pass


def record_changes(events: DataFrame, most_attempts: int = 5) -> DataFrame:
    """CHANGES of a stream of EVENTS: the new status of each record that a batch says something about,
    and a `due` row when a cooldown ends. Rows of a record are dealt to one task; nothing else is."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.groupBy("vehicle_id").transformWithState(Record(most_attempts), CHANGES, "Update", "ProcessingTime")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New events of a folder of JSONL files."""
    return spark.readStream.schema(EVENTS).json(folder)


def current(changes: DataFrame) -> DataFrame:
    """vehicle_id, status, error, attempts: the last status of each record among written changes,
    which have the number of their batch."""
    last = F.max_by(F.struct("status", "error", "attempts"), F.struct("batch", "seq"))
    return changes.where("change = 'status'").groupBy("vehicle_id").agg(last.alias("r")).select("vehicle_id", "r.*")


def follow(changes: DataFrame, path: str, checkpoint: str, **trigger):
    """A running query that appends changes, with their batch, to a table; a batch that is repeated
    after a restart replaces its rows. While cooldowns are timed it runs until it is stopped."""
    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():  # timers make batches without rows
            batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    query = changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (query.trigger(**trigger) if trigger else query).start()
