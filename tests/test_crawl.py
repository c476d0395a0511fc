"""Acquisition: discovery, statuses, waves of requests with one cooldown and budget, resuming."""

import json
import time

import pytest

from ledgerloom.streaming import crawl

OPTIONS = "vehicle_id string, model_year int, manufacturer string, model_name string, option_text string, options_url string"


def test_discovery_and_statuses(spark):
    rows = [("1", 2015, "h", "civic", "a", "u1"), ("2", 2015, "h", "civic", "b", "u1"), ("2", 2015, "h", "civic", "b", "u1"), ("2", 2015, "h", "fit", "b", "u2"), ("3", 2015, "t", "x", "c", "u3"),
            ("4", 2016, "t", "x", "c", "u4"), ("0", 2016, "t", "y", "c", "u5"), ("5", 2016, "t", "y", "c", "u5"), ("6", 2016, "t", "z", "d", "u6"), (None, 2016, "t", "z", "d", "u7")]
    inventory, refused = crawl.discovered(spark.createDataFrame(rows, OPTIONS))
    assert {r.options_url for r in refused.collect()} == {"u5", "u7"}  # one bad id refuses the menu
    got = {r.vehicle_id: r for r in inventory.collect()}
    assert set(got) == {"1", "2", "3", "4", "6"} and got["2"].identities == 2 and len(got["2"].provenance) == 2
    log = spark.createDataFrame([("1", True, None), ("2", True, None), ("3", False, "http_404"), ("9", True, None)], "vehicle_id string, valid boolean, error string")
    state = crawl.statuses(inventory, log)
    assert {r.vehicle_id: (r.status, r.error) for r in state.collect()} == {
        "1": ("fetched", None), "2": ("failed", crawl.CONFLICT), "3": ("failed", "http_404"), "4": ("discovered", None), "6": ("discovered", None)}
    assert sorted(r.vehicle_id for r in crawl.pending(state).collect()) == ["3", "4", "6"]
    assert crawl.pending(state, most=1).count() == 0 and crawl.pending(state, most=3).count() == 2
    first = crawl.pending(state).where("turn = 1").collect()
    assert {r.queue for r in first} == {"2015:t", "2016:t"}  # a record of every queue before any second one


def transport_of(plan):
    """Answers by url: a list of (status, headers, body) or an exception, by wave."""
    def transport(url, timeout):
        from pathlib import Path

        count = Path(plan["folder"]) / url.replace("/", "_")
        n = len(count.read_text()) if count.exists() else 0
        count.write_text("x" * (n + 1))
        answer = plan[url][min(n, len(plan[url]) - 1)]
        if isinstance(answer, str):
            raise OSError(answer)
        return answer
    return transport


def test_waves_share_cooldown_and_budget(spark, tmp_path):
    ok = (200, {}, b"{}")
    plan = {"folder": str(tmp_path), "a": [ok], "b": [(503, {"retry-after": "7"}, b""), ok], "c": ["reset", (429, {}, b""), ok], "d": [(404, {}, b"no")], "e": [(200, {}, b"bad")], "f": [(500, {}, b"")]}
    urls = spark.createDataFrame([(u, i) for i, u in enumerate("abcdef")], "url string, place int")
    slept = []
    options = dict(valid=lambda url, body: body != b"bad", spacing=0.0, sleep=slept.append, jitter=lambda: 0.25)
    out = crawl.crawl(urls, transport_of(plan), **options).collect()
    waves = {u: [r.status for r in sorted(out, key=lambda r: r.wave) if r.url == u] for u in "abcdef"}
    assert waves == {"a": [200], "b": [503, 200], "c": [None, 429, 200], "d": [404], "e": [200], "f": [500] * 5}
    assert {r.url: r.error for r in out if r.wave == 1 and r.error} == {"b": "http_503", "c": "OSError", "d": "http_404", "e": "schema", "f": "http_500"}
    assert slept == [7.0, 2.25, 4.25, 8.25]  # the longest Retry-After or the backoff, for all of the next wave
    for f in tmp_path.iterdir():
        f.unlink()
    out = crawl.crawl(urls, transport_of(plan), budget=7, **options).collect()
    assert len(out) == 7 and [r.url for r in out if r.wave == 2] == ["b"]
    assert crawl.crawl(urls, transport_of(plan), budget=0, **options).count() == 0
    for bad in (dict(workers=5), dict(budget=-1)):
        with pytest.raises(ValueError):
            crawl.crawl(urls, transport_of(plan), **bad)


def test_resume_guards_and_lock(tmp_path):
    scope, config = {"years": [2015]}, {"rate": 1}
    with pytest.raises(ValueError):
        crawl.open_snapshot(tmp_path, scope, config, resume=True)
    assert crawl.open_snapshot(tmp_path, scope, config)["invocations"] == 1
    assert crawl.open_snapshot(tmp_path, scope, config, resume=True)["invocations"] == 2
    for args in (({"years": [2016]}, config, True), (scope, {"rate": 2}, True), (scope, config, False)):
        with pytest.raises(ValueError):
            crawl.open_snapshot(tmp_path, *args)
    with crawl.only_writer(tmp_path):
        for resume in (False, True):
            with pytest.raises(RuntimeError), crawl.only_writer(tmp_path, resume):
                pass
    (tmp_path / ".crawl.lease").mkdir()
    (tmp_path / ".crawl.lease" / "lease.json").write_text(json.dumps({"holder": "dead", "until": 1.0}))
    with pytest.raises(RuntimeError), crawl.only_writer(tmp_path):
        pass
    with crawl.only_writer(tmp_path, resume=True), pytest.raises(RuntimeError), crawl.only_writer(tmp_path, resume=True):
        pass
    assert not (tmp_path / ".crawl.lease").exists()
    (tmp_path / ".crawl.lease").mkdir()  # its holder died before it wrote a lease
    with pytest.raises(RuntimeError), crawl.only_writer(tmp_path, resume=True):
        pass
    with crawl.only_writer(tmp_path, resume=True, clock=lambda: 1e12):
        pass
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []


def test_a_lease_is_renewed_while_it_is_held(tmp_path):
    with crawl.only_writer(tmp_path, lease=0.3):
        first = json.loads((tmp_path / ".crawl.lease" / "lease.json").read_text())["until"]
        time.sleep(0.5)
        assert json.loads((tmp_path / ".crawl.lease" / "lease.json").read_text())["until"] > first
