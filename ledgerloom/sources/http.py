"""A batch data source for GET requests with admission control, and its pure retry schedule."""

from __future__ import annotations

import datetime
import email.utils
import hashlib
import math
import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, body binary, sha256 string, attempts int, error string, retryable boolean"


def retryable(status: int | None) -> bool:
    """Network errors, 408, 429 and 5xx; a wrong body with status 200 isn't."""
    return status is None or status in (408, 429) or 500 <= status <= 599


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds from a Retry-After header: a finite number, or an HTTP date (one without a zone
    is in UTC); none where it is neither."""
    if not value:
        return None
    try:
        seconds = float(value)
    except ValueError:
        try:
            date = email.utils.parsedate_to_datetime(value)
        except (TypeError, ValueError):
            return None
        seconds = (date if date.tzinfo else date.replace(tzinfo=datetime.timezone.utc)).timestamp() - now
    return max(0.0, seconds) if math.isfinite(seconds) else None


def header(headers: dict, name: str) -> str | None:
    """A header's value; names compare without case."""
    return next((v for k, v in headers.items() if k.lower() == name.lower()), None)


def wait(attempt: int, jitter: float, after: float | None) -> float:
    """Seconds before the attempt after the given one (1-based)."""
    return max(2.0 ** (attempt - 1) + jitter, after or 0.0)


def get(url: str, timeout: float) -> tuple[int, dict, bytes]:
    """Status, headers and exact bytes, for HTTP errors too."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def fetch(url: str, *, transport=get, attempts: int = 5, timeout: float = 30.0, sleep=time.sleep, now=time.time, jitter=lambda: 0.5):
    """One row of SCHEMA."""
    status, body, error = None, b"", None
    for attempt in range(1, attempts + 1):
        after = None
        try:
            status, headers, body = transport(url, timeout)
            error = None if status == 200 else f"http_{status}"
            after = retry_after(header(headers, "Retry-After"), now())
        except OSError as e:
            status, body, error = None, b"", type(e).__name__
        if error is None or not retryable(status) or attempt == attempts:
            break
        sleep(wait(attempt, jitter(), after))
    return url, status, body, hashlib.sha256(body).hexdigest(), attempt, error, error is not None and retryable(status)


class _Slice(InputPartition):
    def __init__(self, urls):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.workers, self.spacing = min(4, int(options.get("workers", 4))), float(options.get("spacing", 0.25))

    def partitions(self):
        """At most four slices, each spaced so that together they keep to one start per spacing."""
        k = max(1, min(self.workers, len(self.urls)))
        return [_Slice(self.urls[i::k]) for i in range(k)]

    def read(self, partition):
        k = max(1, min(self.workers, len(self.urls)))
        for url in partition.urls:
            begun = time.monotonic()
            yield fetch(url)
            time.sleep(max(0.0, k * self.spacing - (time.monotonic() - begun)))


class HttpSource(DataSource):
    """spark.dataSource.register(HttpSource); spark.read.format("ledgerloom_http").option("urls", ...)."""

    @classmethod
    def name(cls):
        return "ledgerloom_http"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
