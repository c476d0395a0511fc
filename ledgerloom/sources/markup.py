"""List items of HTML pages, read by a streaming tag tokenizer and a stack of open items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What begins with `<` and isn't text. A quoted value may hold `>`; quotes count behind `=` alone.
_NAME = r"[a-zA-Z][^\t\n\r\f />\x00]*+"
_TAG = re.compile(
    rf"<!--(?:-?>|.*?--!?>)|<!\[.*?\]\]?>|<[!?][^>]*>|</(?P<close>{_NAME})[^>]*>|</(?:[^a-zA-Z>][^>]*)?>"
    rf"|<(?P<open>{_NAME})(?P<rest>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>", re.S)
_UNQUOTED = re.compile(r"=\s*[^\s\"'/][^\s>]*/$")
#: Elements whose content is no markup.
_RAW = ("script", "style")
_ITEM = re.compile(r"([A-Za-z][A-Za-z0-9_]*)\s*-\s*(.+)")
_BLANKS = re.compile(r"\s+")


def events(html: str) -> Iterator[tuple[str, str]]:
    """("text", s), ("open", tag) and ("close", tag), in order; comments, declarations and processing
    instructions are no events, and in scripts and styles there are none but their text, as it is. An
    opening tag that ends in a slash closes at once."""
    at, last = 0, html.rfind(">") + 1  # beyond it there are no tags
    while at < len(html):
        m = _TAG.search(html, at, last) if at < last else None
        if m is None:
            yield "text", unescape(html[at:])
            return
        if m.start() > at:
            yield "text", unescape(html[at:m.start()])
        at = m.end()
        if m["close"]:
            yield "close", m["close"].lower()
        elif m["open"]:
            tag = m["open"].lower()
            yield "open", tag
            if m["rest"].endswith("/") and not _UNQUOTED.search(m["rest"]):
                yield "close", tag
            elif tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\t\n\r\f />])", re.I).search(html, at)
                stop = end.start() if end else len(html)
                yield "text", html[at:stop]
                at = stop


def closed_items(html: str) -> list[str]:
    """The own text of each list item, in the order in which items close: what stands between its
    tag and the first item or block inside it. Items that never close have none."""
    parts: list[list[str]] = []
    counts: list[bool] = []  # whether text still belongs to the open item of that depth
    out = []
    for kind, value in events(html):
        if kind == "text":
            if counts and counts[-1]:
                parts[-1].append(value)
        elif kind == "open" and value in ("li", "div"):
            counts[-1:] = [False] * len(counts[-1:])
            if value == "li":
                parts.append([])
                counts.append(True)
        elif kind == "close" and value == "li" and parts:
            out.append(_BLANKS.sub(" ", "".join(parts.pop())).strip())
            counts.pop()
    return out


def list_descriptions(pages: DataFrame, id_col: str, html: str, keyed: bool = True) -> DataFrame:
    """id, position, key, meaning of list items, in the order in which they close; keyed: only
    `key - meaning` items, the first of each key of a page; else every item, its text as meaning.

    All character references are decoded, white space is collapsed. Null pages have none. Pages are
    read in Arrow batches, without a shuffle.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            row, position, key, meaning = [], [], [], []
            for r, page in enumerate(batch.column(1).to_pylist()):
                seen = set()
                for k, text in enumerate(closed_items(page or "")):
                    m = _ITEM.match(text)
                    if keyed and (not m or m[1] in seen):
                        continue
                    if m:
                        seen.add(m[1])
                    row.append(r)
                    position.append(k)
                    key.append(m[1] if m else None)
                    meaning.append(m[2] if keyed else text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(position, pa.int32()), pa.array(key, pa.string()), pa.array(meaning, pa.string())], [id_col, "position", "key", "meaning"])

    return pages.select(id_col, F.col(html)).mapInArrow(run, f"{id_col} {kind}, position int, key string, meaning string")
