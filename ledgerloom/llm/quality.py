"""Quality rules: repetition by suffix arrays over the words of each document.

Longest-common-prefix intervals of the suffix array are the maximal repeated substrings; the
union of their spans and the longest of them are limited.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
BLOCK_WORDS = 1 << 18


class _WordIds(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def suffix_array(words: np.ndarray, doc: np.ndarray, end: np.ndarray, held_words: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of several documents' words in order, and the longest common prefix of each
    with the next one (in words, 0 between documents).

    Prefix doubling; each round sorts only the suffixes that aren't told apart yet. doc and end
    hold each position's document and that document's end: suffixes end with their document and
    compare equal only within one. Up to held_words the ranks by prefix of 1, 2, 4, ... words
    are held for the common prefixes; of more words only the last ranks are."""
    n = len(words)
    key = doc.astype(np.int64) << 32 | words
    sa = np.argsort(key, kind="stable").astype(np.int32)
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del key
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    ranks, k = [rank], 1
    size = np.bincount(rank, minlength=n)
    live = sa[size[rank[sa]] > 1]
    del size, new
    while len(live):
        after = live + k
        second = np.where(after < end[live], rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[live]
        order = np.lexsort((second, first))
        live, first, second = live[order], first[order], second[order]
        head = np.ones(len(live), bool)
        head[1:] = first[1:] != first[:-1]
        new = head.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(live), dtype=np.int32)
        group = np.maximum.accumulate(np.where(head, at, 0))
        sub = np.maximum.accumulate(np.where(new, at, 0))
        sa[first + at - group] = live
        if n <= held_words:
            rank = rank.copy()
            ranks.append(rank)
        rank[live] = first + sub - group
        k *= 2
        alone = new & np.append(new[1:], True)
        live = live[~alone]
    if n <= held_words:
        return sa, common_by_ranks(sa, ranks, doc, end)
    return sa, common_by_text(sa, rank, words, doc, end)


def common_by_ranks(sa: np.ndarray, ranks: list[np.ndarray], doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Common prefixes by binary lifting on the ranks by prefix."""
    p, q = sa[:-1], sa[1:]
    lcp = np.zeros(len(sa), np.int32)
    for level in range(len(ranks) - 1, -1, -1):
        rank, k = ranks[level], 1 << level
        i, j = p + lcp[:-1], q + lcp[:-1]
        inside = np.flatnonzero((i + k <= end[p]) & (j + k <= end[q]) & (doc[p] == doc[q]))
        lcp[inside[rank[i[inside]] == rank[j[inside]]]] += k
    return lcp


def common_by_text(sa: np.ndarray, rank: np.ndarray, words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Common prefixes in the order of the text: from one position to the next they shrink by
    one word at most (Kasai et al., 2001). No memory beyond the arrays."""
    out = np.zeros(len(sa), np.int32)
    order, place, text, stop, which, result = map(memoryview, (sa, rank, words, end, doc, out))
    last, h = len(sa) - 1, 0
    for i in range(len(sa)):
        r = place[i]
        if r == last or which[order[r + 1]] != which[i]:
            h = 0
            continue
        j = order[r + 1]
        room = stop[i] - (i if i > j else j)
        while h < room and text[i + h] == text[j + h]:
            h += 1
        result[r] = h
        if h:
            h -= 1
    return out


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, first, last): for every suffix in a repeat of at least `least` words the deepest
    longest-common-prefix interval that holds it, each once: the suffixes first to last of the
    suffix array share `length` words, the longest substring that each of them repeats. Deeper
    levels of an interval are intervals of their own; its other levels' spans lie within these."""
    level = np.maximum(lcp, np.concatenate([[0], lcp[:-1]]))  # the larger of the prefixes on either side
    first = np.flatnonzero(level >= least)
    if not len(first):
        return first, first, first
    # Neighbours belong to one interval where the prefix between them is the level of both.
    new = np.ones(len(first), bool)
    new[1:] = (np.diff(first) > 1) | (lcp[first[1:] - 1] != level[first[1:]]) | (level[first[1:]] != level[first[:-1]])
    begin = np.flatnonzero(new)
    return level[first[begin]], first[begin], first[np.append(begin[1:], len(first)) - 1]


@dataclass(frozen=True)
class Rules:
    """Repeats count from min_repeat words. A document is kept if at most max_covered of its
    words lie in repeats and the longest repeat has at most max_longest words."""
    min_repeat: int = 8
    max_covered: float = 0.25
    max_longest: int = 100


def measure(texts: list[str | None], rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """Columns of figures, a value per text; null texts have no words."""
    n = len(texts)
    out = {c: np.zeros(n, np.int64) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")}
    lists = []
    for i, text in enumerate(texts):
        text = text or ""
        words = text.encode().split()
        lists.append(words)
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(text) - sum(map(text.count, BLANKS))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        if "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(BLANKS)]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    first = 0
    while first < n:  # whole documents, BLOCK_WORDS words or a single longer one at a time
        last, total = first, 0
        while last < n and (last == first or total + len(lists[last]) <= BLOCK_WORDS):
            total += len(lists[last])
            last += 1
        if total:
            ids = _WordIds()
            words = np.fromiter((ids[w] for x in lists[first:last] for w in x), np.int32, total)
            lists[first:last] = [None] * (last - first)
            counts = out["n_words"][first:last]
            doc = np.repeat(np.arange(last - first, dtype=np.int32), counts)
            end = np.cumsum(counts).astype(np.int32)[doc]
            sa, lcp = suffix_array(words, doc, end)
            length, low, high = intervals(lcp, rules.min_repeat)
            many = high - low + 1
            starts = sa[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())].astype(np.int64)
            length = np.repeat(length, many)
            cover = np.zeros(total + 1, np.int32)  # union of the spans
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + length, -1)
            covered = np.cumsum(cover)[:total] > 0
            out["n_repeat_words"][first:last] = np.bincount(doc, covered, last - first)
            np.maximum.at(out["longest_repeat"][first:last], doc[starts], length)
        first = last
    words = out["n_words"]
    out["base_failed"] = (words < 20) | (100 * out["n_repeat_words"] > 30 * words)
    out["kept"] = ~out["base_failed"] & (out["n_repeat_words"] <= rules.max_covered * words) & (out["longest_repeat"] <= rules.max_longest)
    return out


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "base_failed", "kept"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, base_failed boolean, kept boolean"


def quality_report(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id") -> DataFrame:
    """One row of figures and verdicts per row of docs.

    A null or empty text has no words and fails. Repeated rows repeat; an empty table gives an
    empty result; other columns are not read. Words are cut at ASCII white space.
    """
    def run(batches):
        for some in slices(batches, 512):
            out = measure(some.column(1).to_pylist(), rules)
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(out[c]) for c in COLUMNS)], [id_col, *COLUMNS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, {SCHEMA}")


def keep_quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, columns as they were; no shuffle."""
    at = docs.columns.index("text")

    def run(batches):
        for some in slices(batches, 512):
            yield some.filter(pa.array(measure(some.column(at).to_pylist(), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
