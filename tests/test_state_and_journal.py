"""The crawl's state as a stream against its batch recomputation, and the journal's commit protocol."""

import json
import random
import shutil
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerloom.sources import journal
from ledgerloom.streaming import crawl, state

OPTION = "vehicle_id string, model_year int, manufacturer string, model_name string, option_text string, options_url string"


def eventually(read, fine, seconds=60):
    """What read gives once it is fine, or at last: timers keep a query running."""
    got = None
    for _ in range(2 * seconds):
        try:
            got = read()
        except AnalysisException:  # nothing is written yet
            pass
        if got is not None and fine(got):
            break
        time.sleep(0.5)
    return got


def events(n, seed=4):
    r = random.Random(seed)
    out = []
    for seq in range(n):
        v = str(r.randint(1, 12))
        if r.random() < 0.4:
            out.append(dict(vehicle_id=v, seq=seq, kind="option", model_year=2015, manufacturer="h", model_name=f"m{int(v) % 5}" if r.random() < 0.9 else "other"))
        else:
            valid = r.random() < 0.4
            out.append(dict(vehicle_id=v, seq=seq, kind="attempt", valid=valid, retryable=not valid and r.random() < 0.5, error=None if valid else r.choice(["http_503", "OSError"]), after=0.0))
    return out


def batch_statuses(spark, seen):
    options = [(e["vehicle_id"], e["model_year"], e["manufacturer"], e["model_name"], "o", f"u{e['seq']}") for e in seen if e["kind"] == "option"]
    inventory, _ = crawl.discovered(spark.createDataFrame(options, OPTION))
    last = {}
    for e in sorted((e for e in seen if e["kind"] == "attempt"), key=lambda e: e["seq"]):
        last[e["vehicle_id"]] = (e["vehicle_id"], e["valid"], e["error"])
    log = spark.createDataFrame(list(last.values()), "vehicle_id string, valid boolean, error string")
    return {r.vehicle_id: (r.status, r.error) for r in crawl.statuses(inventory, log).collect()}


def test_streamed_statuses_equal_the_batch_ones_after_any_stop(spark, tmp_path):
    all_events = events(60)
    random.Random(1).shuffle(all_events)  # attempts come out of order too
    files = [all_events[i:i + 15] for i in range(0, 60, 15)]
    (tmp_path / "in").mkdir()
    for k, some in enumerate(files):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, some)))
        want = batch_statuses(spark, [e for f in files[:k + 1] for e in f])
        query = state.follow(state.record_changes(state.event_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp", processingTime="1 second")
        got = eventually(lambda: {r.vehicle_id: (r.status, r.error) for r in state.current(spark.read.parquet(f"{tmp_path}/out")).collect()}, lambda got: got == want)
        query.stop()  # after each file; the next query starts from the checkpoint
        assert got == want
    attempts = {r.vehicle_id: r.attempts for r in state.current(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert all(n == sum(e["vehicle_id"] == v and e["kind"] == "attempt" for e in all_events) for v, n in attempts.items())


def test_a_cooldown_ends_with_a_due_row(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [dict(vehicle_id="1", seq=0, kind="option", model_year=2015, manufacturer="h", model_name="m"), dict(vehicle_id="1", seq=1, kind="attempt", valid=False, retryable=True, error="http_503", after=0.0),
            dict(vehicle_id="2", seq=2, kind="option", model_year=2015, manufacturer="h", model_name="m"), dict(vehicle_id="2", seq=3, kind="attempt", valid=False, retryable=False, error="schema", after=None)]
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, rows)))
    query = state.follow(state.record_changes(state.event_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp", processingTime="1 second")
    try:
        changes = eventually(lambda: spark.read.parquet(f"{tmp_path}/out").collect(), lambda rows: any(r.change == "due" for r in rows))
        assert [r.vehicle_id for r in changes if r.change == "due"] == ["1"] and {r.wait for r in changes if r.change == "status"} == {1.0, None}
    finally:
        query.stop()


def test_state_changes_alone():
    option = dict(kind="option", seq=0, model_year=1, manufacturer="a", model_name="b")
    tried = lambda seq, valid, error=None: dict(kind="attempt", seq=seq, valid=valid, retryable=False, error=error)
    assert state.status(state.change(None, tried(1, True))) == (None, None)
    late = state.change(state.change(state.change(None, option), tried(5, True)), tried(2, False, "x"))
    assert state.status(late) == ("fetched", None) and late[2] == 2
    both = state.change(state.change(late, {**option, "model_name": "c"}), option)
    assert state.status(both) == ("failed", crawl.CONFLICT)
    assert state.status(state.change(state.change(None, option), tried(1, False))) == ("failed", "invalid")


def journal_rows(spark, n, part=0):
    return spark.range(n).select(F.concat(F.lit(f"u{part}-"), "id").alias("url"), F.lit(200).alias("status"), F.lit(True).alias("valid"), F.concat(F.lit("body"), (F.col("id") % 5).cast("string")).cast("binary").alias("body")).repartition(3)


def whole(spark, path):
    assert {r.check: r.n for r in journal.check_bodies(spark, path).collect()} in ({"missing": 0, "other_content": 0, "unnamed": 0}, {})


def test_journal_counts_each_write_once(spark, tmp_path):
    spark.dataSource.register(journal.JournalSink)
    path = f"{tmp_path}/j"
    assert journal.entries(spark, path).count() == 0
    put = lambda df, write: df.write.format("ledgerloom_journal").mode("append").option("path", path).option("write", write).save()
    put(journal_rows(spark, 20), "first")
    put(journal_rows(spark, 20), "first")  # repeated
    put(journal_rows(spark, 7, 1), "second")
    got = journal.entries(spark, path)
    assert {r["write"]: r["count"] for r in got.groupBy("write").count().collect()} == {"first": 20, "second": 7}
    assert got.select("sha256").distinct().count() == 5
    whole(spark, path)
    assert not list((tmp_path / "j" / "staging").iterdir())
    with pytest.raises(Exception):
        journal_rows(spark, 2).write.format("ledgerloom_journal").mode("overwrite").option("path", path).save()


def test_an_aborted_write_leaves_nothing_that_is_read(spark, tmp_path):
    spark.dataSource.register(journal.JournalSink)
    path = f"{tmp_path}/j"
    bad = journal_rows(spark, 30).withColumn("url", F.when(F.col("url") == "u0-29", F.raise_error(F.lit("broken"))).otherwise(F.col("url")))
    with pytest.raises(Exception):
        bad.write.format("ledgerloom_journal").mode("append").option("path", path).option("write", "w").save()
    assert journal.entries(spark, path).count() == 0
    journal_rows(spark, 30).write.format("ledgerloom_journal").mode("append").option("path", path).option("write", "w").save()
    assert journal.entries(spark, path).count() == 30
    journal.recover(path)
    whole(spark, path)


def test_a_task_that_runs_twice_and_a_driver_that_dies(tmp_path, spark):
    root = tmp_path / "j"
    rows = [{"url": "a", "body": b"1"}, {"url": "b", "body": b"1"}, {"url": "c", "body": None}]
    kept, lost = journal.stage(root, rows), journal.stage(root, rows)  # a speculative copy
    journal.publish(root, "w", [kept])
    assert journal.entries(spark, str(root)).count() == 3
    again = journal.stage(root, rows)
    journal.publish(root, "w", [again])  # the same write, committed again
    assert journal.entries(spark, str(root)).count() == 3
    late = journal.stage(root, rows)
    shutil.move(root / "staging" / late.name, root / "bodies" / late.name)  # died before the record
    assert journal.entries(spark, str(root)).count() == 3
    assert set(journal.recover(str(root))) == {lost.name, late.name}
    whole(spark, str(root))
    assert sorted(p.name for p in (root / "bodies").iterdir()) == [kept.name]


def test_a_streamed_journal_repeats_no_batch(spark, tmp_path):
    spark.dataSource.register(journal.JournalSink)
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"url": f"u{k}{i}", "status": 200}) for i in range(4)))
        source = spark.readStream.schema("url string, status int").json(f"{tmp_path}/in").withColumn("body", F.col("url").cast("binary"))
        query = source.writeStream.format("ledgerloom_journal").option("path", f"{tmp_path}/j").option("write", "s").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    last = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"))[-1]
    last.unlink()  # as if the driver had died before Spark noted the commit
    for crc in (tmp_path / "cp" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    query = source.writeStream.format("ledgerloom_journal").option("path", f"{tmp_path}/j").option("write", "s").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert journal.entries(spark, f"{tmp_path}/j").count() == 12
    whole(spark, f"{tmp_path}/j")
