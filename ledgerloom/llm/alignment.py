"""Alignment of two tokenizers' tokens, by a transducer over dangling suffixes.

The state is the side that leads and its bytes that the other side has not matched yet; they are
always a suffix of that side's last token. Each step reads the next token of the other side, so
it is a link of two overlapping tokens, and a transition depends on the state and that token alone:
transitions are memoised. Where nothing is left unmatched a group closes.

Both tokenizers cut between a character that isn't white space and the spaces before a next word,
whatever stands around, so there the state is empty. A text is read word by word, and a word's whole
path through the transducer is memoised like a transition.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, unused

#: Where neither tokenizer joins what lies on both sides.
CUT = re.compile(r"(?<=\S)(?= +\S)")
#: Bounds of a worker's memos, which are emptied beyond them; longer words aren't kept.
WORDS, STEPS, WORD_CHARS = 50_000, 500_000, 64
#: Words that are encoded in one call, and in one string.
BATCH, JOINED = 4_096, 64
#: Rows and bytes of texts that are counted together.
BLOCK_ROWS, BLOCK_BYTES = 8_192, 10 << 20
A, B = 0, 1


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies: itself where it is
    a visible Latin-1 character, else the next free sign from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Paths:
    """The paths of a block's distinct words, one after the other. A word whose tokens' bytes aren't
    its own has no tokens and is not sound."""

    def __init__(self):
        self.sizes, self.links, self.groups, self.sound = array("i"), array("q"), [], bytearray()

    def add(self, some: list[tuple | None]) -> None:
        told = [p or (0, 0, 0, "", ()) for p in some]
        self.sizes.extend(chain.from_iterable([(a, b, g, len(links)) for a, b, g, _, links in told]))
        self.links.extend(chain.from_iterable([p[4] for p in told]))
        self.groups += [p[3] for p in told]
        self.sound += bytes([p is not None for p in some])


class Aligner:
    """Tokens, groups and links of texts under a byte-level tokenizer (A) and a piece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        signs = byte_signs()
        vocabulary = json.loads(self.a.to_str())["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(signs[c] for c in token)
        self.length_a = np.array([len(b) for b in self.bytes_a], np.int64)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [piece(i) for i in range(self.b.get_piece_size())]
        self.words: dict[str, tuple | None] = {}
        self.forget_steps()

    def forget_steps(self) -> None:
        """States are numbered as they come up; 0 has nothing unmatched."""
        self.states: dict[tuple[int, bytes], int] = {(A, b""): 0}
        self.state: list[tuple[int, bytes]] = [(A, b"")]
        self.a_leads = [False]
        self.steps: dict[int, int] = {}

    def numbered(self, lead: int, rest: bytes) -> int:
        key = (lead, rest) if rest else (A, b"")
        if key not in self.states:
            self.states[key] = len(self.state)
            self.state.append(key)
            self.a_leads.append(lead == A)
        return self.states[key]

    def step(self, state: int, token: int) -> int:
        """The state after the next token, which A reads where nothing is unmatched and else the side
        that doesn't lead; -1 where the bytes differ."""
        lead, rest = self.state[state]
        if not rest:
            out = self.numbered(A, self.bytes_a[token])
        else:
            new = (self.bytes_b if lead == A else self.bytes_a)[token]
            if rest.startswith(new):
                out = self.numbered(lead, rest[len(new):])
            elif new.startswith(rest):
                out = self.numbered(1 - lead, new[len(rest):])
            else:
                out = -1
        self.steps[state << 20 | token] = out
        return out

    def path(self, a: list[int], b: list[int]) -> tuple | None:
        """(n_a, n_b, n_groups, groups, links) of two token lists, each link as a << 32 | b; None
        where their bytes differ."""
        if len(self.steps) >= STEPS:
            self.forget_steps()
        steps, a_leads, n_a, n_b = self.steps, self.a_leads, len(a), len(b)
        if n_a == n_b == 1:  # two steps, of which the first makes the state of a whole token
            begin = steps[a[0]] if a[0] in steps else self.step(0, a[0])
            key = begin << 20 | b[0]
            end = steps[key] if key in steps else self.step(begin, b[0])
            return None if end else (1, 1, 1, f"{a[0]}|{b[0]}", (a[0] << 32 | b[0],))
        i = j = begin_a = begin_b = state = 0
        groups, links = [], []
        try:
            while i < n_a or j < n_b:
                if a_leads[state]:
                    token = b[j]
                    links.append(a[i - 1] << 32 | token)
                    j += 1
                else:
                    token = a[i]
                    if state:
                        links.append(token << 32 | b[j - 1])
                    i += 1
                key = state << 20 | token
                state = steps[key] if key in steps else self.step(state, token)
                if not state:
                    groups.append(f"{a[begin_a]}|{b[begin_b]}" if i - begin_a == 1 == j - begin_b else ",".join(map(str, a[begin_a:i])) + "|" + ",".join(map(str, b[begin_b:j])))
                    begin_a, begin_b = i, j
                elif state < 0:
                    return None
        except IndexError:  # a side has no token left
            return None
        return None if state else (n_a, n_b, len(groups), ";".join(groups), links)

    def encode_a(self, words: list[str]) -> list[list[int] | None]:
        """Each word's ids under A; None where their bytes aren't the word's. Words that end in what
        isn't white space are encoded side by side, as they would be in a text, and cut apart."""
        joined = [k for k, w in enumerate(words) if not w[-1].isspace()]
        strings = ["".join([words[k] for k in joined[at:at + JOINED]]) for at in range(0, len(joined), JOINED)]
        out: list[list[int] | None] = [None] * len(words)
        ids = list(chain.from_iterable([e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)]))
        ends = np.cumsum(self.length_a[ids]) if ids else np.zeros(0, np.int64)
        wanted = np.cumsum([len(words[k].encode()) for k in joined])
        cuts = np.searchsorted(ends, wanted).tolist()
        sound = bool(len(joined)) and b"".join([self.bytes_a[i] for i in ids]) == "".join(strings).encode() and np.array_equal(ends[cuts], wanted)
        begin = 0
        for k, cut in zip(joined, cuts):
            out[k] = ids[begin:cut + 1] if sound else None
            begin = cut + 1
        for k, w in enumerate(words):
            if out[k] is None:
                alone = self.a.encode(w, add_special_tokens=False).ids
                out[k] = alone if b"".join([self.bytes_a[i] for i in alone]) == w.encode() else None
        return out

    def read(self, texts: list[str | None]) -> tuple[list[np.ndarray], Paths]:
        """For each text the words it consists of, as places among the distinct words' paths; none
        where a word isn't sound."""
        place: dict[str, int] = defaultdict(count().__next__)
        own = [np.fromiter(map(place.__getitem__, CUT.split(f" {t}") if t else ()), np.int32) for t in texts]
        uses = np.bincount(np.concatenate(own), minlength=len(place)) if own else np.zeros(0)
        if len(self.words) > WORDS:
            self.words.clear()
        paths, distinct = Paths(), list(place)
        for at in range(0, len(distinct), BATCH):
            some = distinct[at:at + BATCH]
            missing = [w for w in some if w not in self.words]
            ids_b = self.b.encode([w[1:] for w in missing], num_threads=1) if missing else []  # which adds the space
            found = {w: None if a is None else self.path(a, b) for w, a, b in zip(missing, self.encode_a(missing), ids_b)}
            paths.add([found[w] if w in found else self.words[w] for w in some])
            often = uses[at:at + BATCH] > 1
            self.words.update((w, found[w]) for w, twice in zip(some, often.tolist()) if twice and w in found and len(w) <= WORD_CHARS)
        sound = np.frombuffer(bytes(paths.sound), bool)
        return [w if sound[w].all() else w[:0] for w in own], paths


@lru_cache(2)
def load(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups of each row's whole text, and what link_scores needs.

    A tokenizes a space and the text, B the text (and adds the space). groups is `a1,a2|b1;a3|b2,b3`:
    the ids between two places where tokens of both end; a link is a pair of overlapping tokens.
    Null and empty texts, and texts whose tokens' bytes aren't the space and the text on either
    side, have zeros and an empty string. The paths name files that every executor has. Repeated
    rows repeat; an empty table gives an empty result; other columns are not read. Texts are cut at
    words, so memory is bound by a block of texts or the longest text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        aligner, block = load(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in slices(batches, BLOCK_ROWS, BLOCK_BYTES):
            if not batch.num_rows:
                continue
            gc.disable()  # reading makes many small objects and no cycles
            words, paths = aligner.read(batch.column(1).to_pylist())
            gc.enable()
            sizes = np.array(paths.sizes, np.int64).reshape(-1, 4)
            totals = np.array([sizes[w].sum(axis=0) for w in words], np.int64).reshape(-1, 4)
            uses = np.bincount(np.concatenate(words), minlength=len(sizes))
            pairs, index = np.unique(np.array(paths.links, np.int64), return_inverse=True)
            counts = np.bincount(index, np.repeat(uses, sizes[:, 3]), minlength=len(pairs)).astype(np.int64)
            used = counts > 0  # pairs of words of texts without tokens are not
            first = [True] + [False] * (batch.num_rows - 1)  # the block's own data stand in its first row
            only = lambda x: pa.array([x if f else None for f in first])
            lists = lambda x: pa.array([x if f else None for f in first], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array(totals[:, k]) for k in range(4)),
                pa.array([";".join(map(paths.groups.__getitem__, w.tolist())) for w in words], pa.string()),
                pa.array(np.full(batch.num_rows, block)), pa.array([w.tobytes() for w in words], pa.binary()),
                lists(pairs[used]), lists(counts[used]), only(sizes[:, 3].astype(np.int32).tobytes()), only((np.cumsum(used) - 1)[index].astype(np.int32).tobytes()),
            ], [id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "block", "words", "pairs", "counts", "word_links", "word_pairs"])
            block += 1

    return docs.select(id_col, "text").mapInArrow(
        run, f"{id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, block long, words binary, pairs array<long>, counts array<long>, word_links binary, word_pairs binary")


INNER = ["block", "words", "pairs", "counts", "word_links", "word_pairs"]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (a << 32 | b), n, best: how many links of all texts hold a pair, and whether no other
    pair of its B id is held by more. Blocks come with sums, so a frequent pair is a row a block."""
    counts = aligned.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    same_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))  # at most a row for each A id
    return counts.withColumn("best", F.col("n") == F.max("n").over(same_b))


def link_scores(aligned: DataFrame) -> DataFrame:
    """aligned's rows and public columns, with n_best (links whose pair is its B id's most frequent,
    ties included) and count_sum (the pairs' corpus-wide counts, over the links).

    The texts are tokenized once and written. Each block asks for its distinct pairs, and its rows
    meet the answers in one task; a block is bounded, so neither rows nor answers of a task grow."""
    public = [c for c in aligned.columns if c not in INNER]
    held = materialize(aligned, "aligned")
    asked = held.where("pairs IS NOT NULL").select("block", F.explode("pairs").alias("pair"))
    answers = asked.join(pair_counts(held), "pair").select("block", "pair", "n", "best")
    inner = [unused(public, c) for c in INNER]
    rows = held.select(*public, *[F.col(c).alias(d) for c, d in zip(INNER, inner)])
    block, words, _, _, word_links, word_pairs = inner
    kept = held.select(*public).schema

    def score(mine: pa.Table, counts: pa.Table) -> pa.Table:
        first = next(i for i, x in enumerate(mine.column(word_links)) if x.is_valid)
        links = np.frombuffer(mine.column(word_links)[first].as_py(), np.int32)
        order = np.argsort(counts.column("pair").to_numpy())
        n = counts.column("n").to_numpy()[order]
        best = counts.column("best").to_numpy()[order].astype(np.int64)
        index = np.frombuffer(mine.column(word_pairs)[first].as_py(), np.int32)
        ends = np.cumsum(links)
        per_word = []
        for values in (best, n):
            # A word of a text without tokens may name a pair that isn't counted; it is never used.
            taken = values[np.clip(index, 0, len(values) - 1)] if len(values) else np.zeros(len(index), np.int64)
            total = np.concatenate([[0], np.cumsum(taken)])
            per_word.append(total[ends] - total[ends - links])
        own = [np.frombuffer(w, np.int32) for w in mine.column(words).to_pylist()]
        out = mine.select(public)
        for name, values in zip(("n_best", "count_sum"), per_word):
            out = out.append_column(name, pa.array([int(values[w].sum()) for w in own], pa.int64()))
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.groupBy(block).cogroup(answers.select(F.col("block").alias("__block"), "pair", "n", "best").groupBy("__block")).applyInArrow(score, f"{fields}, n_best long, count_sum long")


def digest(aligned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """align's rows with groups_sha256 in place of groups; '' for texts without tokens."""
    said = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return aligned.select(id_col, "n_a", "n_b", "n_groups", "n_links", said.alias("groups_sha256"), *INNER)
