"""Byte-level BPE as a monoid: halves are encoded recursively and joined at their border.

The element of a text is its own list of tokens. To join two neighbours, windows of tokens on
either side of the border grow until each holds a settled cut; what lies between the two cuts is
encoded again, and the tokens outside stand. A cut is settled where a character that isn't white
space precedes a space or line feed: no match of the pattern holds both, and no alternative looks
past white space, so the text on either side is encoded alike whatever follows or precedes. Where
a half has no settled cut its whole side is the window.

A window too long to encode at once is reduced by matches of the pattern in the same way:
joining re-matches from the last match of the left half that cannot have seen its end, over a
growing window, until a match ends where one of the right half's matches ends; beyond that
point matching depends only on the text that follows, so the right half's other matches stand.
Decoding concatenates the tokens' bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

LEAF_CHARS = 512
LEAF_IDS = 256
#: Tokens of a border window before it grows.
WINDOW = 8
#: Characters of a window that are encoded at once.
AT_ONCE = 1 << 15
#: A match ending within so many characters of a half's end may depend on what follows it: the
#: longest fixed alternative of the pattern has 3 characters, and one is looked ahead at.
REACH = 4
FIRST = regex.compile(r"[^\s\x1c-\x1f](?=[ \n])")
LAST = regex.compile(r"(?r)[^\s\x1c-\x1f](?=[ \n])")
BLANK = regex.compile(r"\s{512}")


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        make = lambda p: tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ordinary, self.whole = make(pattern), make("(?s).+")  # whole: the text is one match
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def leaf(self, text: str) -> list[int]:
        if BLANK.search(text):  # the library's matcher has a bounded stack
            return [i for match in self.find(text) for i in self.whole(match)]
        return self.ordinary(text)

    def encode(self, text: str | None, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
        """Ids of the whole text, as unsigned 32-bit integers."""
        return np.array(self.tree(text, 0, len(text), leaf_chars) if text else [], np.uint32)

    def tree(self, text: str, a: int, z: int, leaf_chars: int) -> list[int]:
        """The tokens of text[a:z] as a text of its own."""
        if z - a <= leaf_chars:
            return self.leaf(text[a:z])
        middle = (a + z) // 2
        return self.join(self.tree(text, a, middle, leaf_chars), self.tree(text, middle, z, leaf_chars))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring texts, from theirs."""
        keep, before = self.last_settled(left)
        drop, after = self.first_settled(right)
        return left[:keep] + self.window((before + after).decode()) + right[drop:]

    def last_settled(self, ids: list[int]) -> tuple[int, bytes]:
        """How many tokens lie before the last settled cut (0 without one), and the bytes after it."""
        k = WINDOW
        while True:
            some = ids[-k:]
            raw = b"".join([self.bytes_of[i] for i in some])
            skip = 0
            while skip < len(raw) and raw[skip] & 0xC0 == 0x80 and len(some) < len(ids):
                skip += 1  # the window begins within a character
            text = raw[skip:].decode()
            if m := LAST.search(text):
                at = skip + len(text[:m.end()].encode())
                return len(ids) - len(some) + self.tokens_before(some, at), raw[at:]
            if len(some) == len(ids):
                return 0, raw
            k *= 4

    def first_settled(self, ids: list[int]) -> tuple[int, bytes]:
        """How many tokens lie before the first settled cut (all without one), and their bytes."""
        k = WINDOW
        while True:
            some = ids[:k]
            raw = b"".join([self.bytes_of[i] for i in some])
            text = raw.decode(errors="ignore")  # the window may end within a character
            if m := FIRST.search(text):
                at = len(text[:m.end()].encode())
                return self.tokens_before(some, at), raw[:at]
            if len(some) == len(ids):
                return len(ids), raw
            k *= 4

    def tokens_before(self, ids: list[int], at: int) -> int:
        """How many of the tokens hold the first `at` bytes: a settled cut is a token's border."""
        n = 0
        for i in ids:
            if at <= 0:
                break
            at -= len(self.bytes_of[i])
            n += 1
        assert at == 0
        return n

    def window(self, text: str) -> list[int]:
        if len(text) <= AT_ONCE:
            return self.leaf(text)

        def tree(a, z):
            if z - a <= AT_ONCE // 4:
                return self.find(text, a, z)
            middle = (a + z) // 2
            return self.join_matches(tree(a, middle), tree(middle, z))
        return [i for match in tree(0, len(text)) for i in self.whole(match)]

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of two neighbouring texts, from theirs."""
        drop = size = 0
        while drop < len(left) and size < REACH:  # what the end of the left text can have shaped
            drop += 1
            size += len(left[-drop])
        tail, take = "".join(left[len(left) - drop:]), 1
        while True:
            ends, at = {}, len(tail)
            for k, match in enumerate(right[:take]):
                at += len(match)
                ends[at] = k + 1
            window, position, matches = tail + "".join(right[:take]), 0, []
            for match in self.find(window):
                position += len(match)
                matches.append(match)
                if position in ends and (position + REACH <= len(window) or take >= len(right) and position == len(window)):
                    return left[:len(left) - drop] + matches + right[ends[position]:]
            take = 2 * take + 4

    def decode(self, ids) -> bytes:
        """The bytes of the ids, concatenated up the tree."""
        if len(ids) <= LEAF_IDS:
            return b"".join([self.bytes_of[i] for i in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(2)
def load(path: str, pattern: str) -> Bpe:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Bpe(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id, ids (array of int) and decoded (binary) of each row's whole text.

    path is the ranks file, present on every executor. Null and empty texts have no ids and
    decode to empty bytes. Repeated rows repeat; an empty table gives an empty result; other
    columns are not read.
    """
    def run(batches):
        bpe = load(path, pattern)
        for batch in slices(batches, 64):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), pa.array(np.concatenate(ids).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([bpe.decode(i.tolist()) for i in ids], pa.binary())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, ids array<int>, decoded binary")


def id_digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 per row."""
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
