"""Fill-in-middle examples, cut at units found by an Aho-Corasick event scan.

A unit is a run of ASCII letters or any other single code point. The text is written as one class
byte per code point; one automaton finds the two-character strings in which letters begin or end,
and the sentinels. Between two events all code points are of one class, so a gap counts as one
unit (letters) or as its length, and the place of the k-th unit is a binary search over the
events' running counts and a difference within one gap.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: What an event says: letters begin, letters have ended, a sentinel has ended.
BEGIN, END, SENTINEL = 0, 1, 2
_EVENT = np.dtype([("at", np.int32), ("what", np.int8)])
_CONTINUED = bytes(range(0x80, 0xC0))


@lru_cache(1)
def classes() -> bytes:
    """Class of each byte that begins a code point: itself in a sentinel, else a letter `a` or `.`."""
    kept = set("".join(SENTINELS).encode())
    return bytes(b if b in kept else ord("a") if bytes([b]).isalpha() else ord(".") for b in range(256))


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    signs = sorted({chr(b) for b in classes()})
    out = ahocorasick.Automaton()
    for a, b in product(signs, signs):
        if a.isalpha() != b.isalpha():
            out.add_word(a + b, BEGIN if b.isalpha() else END)
    for s in SENTINELS:
        out.add_word(s, SENTINEL)
    out.make_automaton()
    return out


@dataclass(frozen=True)
class Units:
    """Gaps between class changes: gap i begins at code point begin[i], after before[i] units."""
    begin: np.ndarray
    before: np.ndarray
    n: int
    n_chars: int
    has_sentinel: bool

    def place(self, k: int) -> int:
        """The code point before which k units lie."""
        if k >= self.n:
            return self.n_chars
        gap = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.begin[gap] + (k - self.before[gap]))


def scan(text: str) -> Units:
    signs = text.encode().translate(classes(), _CONTINUED).decode("ascii")
    if not signs:
        return Units(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, False)
    events = np.fromiter(automaton().iter(signs), _EVENT)
    sentinel = events["what"] == SENTINEL
    begin = np.concatenate([[0], events["at"][~sentinel]]).astype(np.int64)
    letters = np.concatenate([[signs[0].isalpha()], events["what"][~sentinel] == BEGIN])
    units = np.where(letters, 1, np.diff(begin, append=len(signs)))
    after = np.cumsum(units)
    return Units(begin, after - units, int(after[-1]), len(signs), bool(sentinel.any()))


def draws(doc_id, seed: str = "1") -> tuple[int, int, int, int]:
    """Four integers of an id: the first 8-digit groups of a hash. A null id counts as empty."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i:i + 8], 16) for i in (0, 8, 16, 24))


def transform(text: str | None, doc_id, seed: str = "1", rate: int = 90, spm_rate: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    text = text or ""
    units, (h1, h2, h3, h4) = scan(text), draws(doc_id, seed)
    if not text or units.has_sentinel or h3 % 100 >= rate:
        return units.n, "plain", None, None, text
    low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, z = units.place(low), units.place(high)
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h4 % 100 < spm_rate:
        return units.n, "spm", a, z - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, z - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", seed: str = "1", rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output of each row's whole text.

    n counts the text's units. Prefix and middle end after two drawn numbers of units; rate
    percent of the ids are cut, and spm_rate percent of those put the suffix first. Null and empty
    texts and texts that hold a sentinel stay plain. The draws depend on the id alone (a null one
    counts as empty), so repeated rows repeat. An empty table gives an empty result; other columns
    are not read. Work and memory are linear in a text.
    """
    def run(batches):
        for batch in slices(batches):
            rows = [transform(t, i, seed, rate, spm_rate) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            n, form, prefix, middle, out = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())],
                [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(examples: DataFrame, name: str = "restored") -> DataFrame:
    """examples with the text that output and form were made of, read from these two alone. No
    sentinel begins as another ends, so the first of each kind is the written one."""
    out = F.col("output")
    cut = lambda text, mark: (F.substring_index(text, mark, 1), F.substr(text, F.instr(text, F.lit(mark)) + len(mark)))
    body = F.substr(out, F.lit(len(PREFIX) + 1))
    prefix, rest = cut(body, SUFFIX)
    suffix, middle = cut(rest, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = cut(body, PREFIX)
    prefix, middle = cut(rest, MIDDLE)
    spm = F.concat(prefix, middle, suffix)
    return examples.withColumn(name, F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(out))


def digest(examples: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The examples' sizes, and hashes of the output and of the text restored from it."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restore(examples).select(id_col, "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))
