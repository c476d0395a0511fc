"""URL filtering by a trie over reversed host labels and the path, broadcast to every task.

Rules are (action, host, path). A rule fits its host and all subdomains of it where the url's
path starts with the rule's path. Below the node of a host, paths hang in a trie of their
segments; the last, possibly partial, segment of a rule is matched as a prefix. The longest
fit wins: most host labels first, then the longest path, then block before allow.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The trie is broadcast only up to this many rules; more raise, and are for the caller to split.
MAX_BROADCAST_RULES = 1_000_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host with A-Z lower-cased; both empty for null or without `://`."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    end = len(url)
    for c in "?#":
        if (k := url.find(c, at + 3, end)) >= 0:
            end = k
    slash = url.find("/", at + 3, end)
    if slash < 0:
        return url[at + 3:end].translate(_LOWER), ""
    return url[at + 3:slash].translate(_LOWER), url[slash:end]


class UrlTrie:
    """Nodes are dicts: host labels lead on, None leads to the path trie of that host. A path
    node is [children by whole segment, rules whose last segment is a prefix]."""

    def __init__(self, rules):
        self.root: dict = {}
        for action, host, path in rules:
            if action not in ("allow", "block") or not host:
                raise ValueError(f"not a rule: {(action, host, path)}")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            at = node.setdefault(None, [{}, {}])
            *whole, last = path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}])
            if at[1].get(last, ("allow",))[0] != "block":
                at[1][last] = (action, f"{host}{path}")

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the longest fit, or None."""
        node, best = self.root, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._path(node[None], segments) or best
        return best

    @staticmethod
    def _path(at, segments):
        best = None
        for segment in segments:
            ends = at[1]
            if ends:
                for n in sorted({len(e) for e in ends}, reverse=True):
                    if n <= len(segment) and segment[:n] in ends:
                        best = ends[segment[:n]]
                        break
            at = at[0].get(segment)
            if at is None:
                break
        return best


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (host and path; null where none fits) and verdict of every row.

    Null urls and urls without `://` have an empty host and path and get the default verdict.
    Repeated rows and ids repeat; an empty table gives an empty result; other columns of pages
    are not read. An empty path starts with no rule's `/`.
    """
    rules = list(rules)
    if len(rules) > MAX_BROADCAST_RULES:
        raise ValueError(f"{len(rules)} rules exceed the broadcast bound of {MAX_BROADCAST_RULES}; split them by top-level label and union the results")
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def run(batches):
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                hit = trie.value.match(host, path) if host else None
                rows.append((host, path, hit[1] if hit else None, hit[0] if hit else default))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], [id_col, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(run, f"{id_col} {kind}, host string, path string, rule string, verdict string")
