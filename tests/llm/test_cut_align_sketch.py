"""Fill-in-middle, token alignment and fingerprints against brute force and on edge cases."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import alignment, fim, queries, sketch

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n string, form string, block long, __w string, __key int, sketch string"
PARTS = ["the", "The", " ", "  ", "\n", " \n", "\t", "é", "日本語", "it's", "123", "x1y", "<P>", "<S", "M>", "<M>", "▁", "a ▁b", "\x85", " ", " ", "\x1c", "😀", "é", "-", "...", "<|endoftext|>", "<s>", "<0x41>", "don't", "Ａ", "ﬁ", "PPP", "P>", "<", "\x00", "ß"]


def texts(n=300, seed=3):
    r = random.Random(seed)
    out = ["".join(r.choice(PARTS) + r.choice(["", "", " "]) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return out + ["", " ", "  ", "a ", " a", "\n", "word", "<P>", "a<P>", " ".join(f"w{i % 97}" for i in range(30_000)), "x" * 5000, "日" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", "f", 1, "w", 2, "s") for i, t in enumerate(texts())]
    rows += [(None, "no id at all", *rows[0][2:]), (5000, None, *[None] * 6), (5001, rows[3][1], *rows[0][2:]), (5002, "twice said", *rows[0][2:]), (5002, "twice said", *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# 11

def slow_fim(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_equals_brute_force_and_restores(docs):
    made = fim.restore(fim.fill_in_middle(docs)).collect()
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = Counter((i, *slow_fim(i, t), t) for i, t in given)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made) == want
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_fim_units_of_every_place():
    for text in texts(60, 8)[:60]:
        units, places = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), [0]
        for u in units:
            places.append(places[-1] + len(u))
        found = fim.scan(text)
        assert found.n == len(units) and [found.place(k) for k in range(len(units) + 1)] == places
        assert found.has_sentinel == any(s in text for s in fim.SENTINELS)


def test_fim_rates_and_restored_ends(spark):
    rows = spark.createDataFrame([(i, "ends with < and <S or <", "x") for i in range(400)], "doc_id long, text string, output string")
    out = fim.restore(fim.fill_in_middle(rows, seed="7", rate=50, spm_rate=50))
    assert {r[0] for r in out.select("restored").distinct().collect()} == {"ends with < and <S or <"}
    forms = Counter(r.form for r in out.collect())
    assert all(60 < forms[f] < 260 for f in ("plain", "psm", "spm"))


# 12

def slow_alignment(rows):
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    signs = alignment.byte_signs()
    docs = []
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", b.id_to_piece(i)) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not (b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode()):
            ids_a = ids_b = raw_a = raw_b = []
        spans = []
        for raw in (raw_a, raw_b):
            at, mine = 0, []
            for x in raw:
                mine.append((at, at + len(x)))
                at += len(x)
            spans.append(mine)
        cuts = sorted({z for _, z in spans[0]} & {z for _, z in spans[1]})
        groups, low, i, j, links = [], 0, 0, 0, []
        for cut in cuts:
            i2, j2 = i, j
            while i2 < len(ids_a) and spans[0][i2][1] <= cut:
                i2 += 1
            while j2 < len(ids_b) and spans[1][j2][1] <= cut:
                j2 += 1
            groups.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[j:j2])))
            links += [(ids_a[p], ids_b[q]) for p in range(i, i2) for q in range(j, j2) if spans[0][p][0] < spans[1][q][1] and spans[1][q][0] < spans[0][p][1]]
            i, j, low = i2, j2, cut
        docs.append((doc_id, len(ids_a), len(ids_b), groups, links))
    n = Counter(link for d in docs for link in d[4])
    top = {}
    for (_, q), c in n.items():
        top[q] = max(top.get(q, 0), c)
    return [(i, x, y, len(g), len(k), sum(n[p] == top[p[1]] for p in k), sum(n[p] for p in k), ";".join(g)) for i, x, y, g, k in docs]


def test_alignment_equals_brute_force(docs, monkeypatch):
    given = [(r.doc_id, r.text or "") for r in docs.collect() if len(r.text or "") < 20_000]
    want = Counter(slow_alignment(given))
    for rows, size in ((8192, 8 << 20), (7, 400)):  # one block a task, and many
        monkeypatch.setattr(alignment, "BLOCK_ROWS", rows)
        monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
        made = alignment.link_scores(alignment.align(docs.where("text IS NULL OR length(text) < 20000"), PATH_A, PATH_B))
        assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
        assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in made.collect()) == want
    assert any(r[1] == 0 for r in want) and any(len(r[7]) > 100 for r in want)


def test_alignment_memos_are_bounded_and_change_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "STEPS", 5)
    monkeypatch.setattr(alignment, "WORDS", 3)
    small = alignment.Aligner(PATH_A, PATH_B)
    monkeypatch.undo()
    large = alignment.Aligner(PATH_A, PATH_B)
    for part in (texts(40, 5)[:40], texts(40, 6)[:40]):
        (a, pa), (b, pb) = small.read(part), large.read(part)
        assert [x.tolist() for x in a] == [x.tolist() for x in b] and vars(pa) == vars(pb)


def test_alignment_words_are_whole_texts_tokens():
    one = alignment.Aligner(PATH_A, PATH_B)
    for text in [t for t in texts(200, 9) if t and len(t) < 6000]:
        words = alignment.CUT.split(" " + text)
        assert [i for w in words for i in one.a.encode(w, add_special_tokens=False).ids] == one.a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert [i for w in words for i in one.b.encode(w[1:])] == one.b.encode(text)


# 13

def slow_sketch(text):
    w = [x for x in re.split(r"[\t\n\x0b\x0c\r ]+", text.lower()) if x]
    s = {hashlib.md5(" ".join(w[i:i + 5]).encode()).hexdigest() for i in range(max(len(w) - 4, 1))} if w else set()
    kept = [h for h in s if h < "2"] or ([min(s)] if s else [])
    return sorted(h[:16] for h in kept)


def slow_likeness(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def test_fingerprints_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE_ROWS", 20)  # many ranges
    rows = [r for r in docs.collect() if r.doc_id not in (None, 5002)]
    given = sorted(((r.doc_id, r.text or "") for r in rows), reverse=True)
    got = {r.doc_id: r for r in sketch.digest(sketch.fingerprints(docs.where("doc_id <> 5002"))).collect()}
    assert len(got) == len(given)
    for (i, text), (_, following) in zip(given, given[1:] + given[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, other, after = map(slow_sketch, (text, edited, following))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(edited), "".join(own), "".join(other))
        assert r.near_edited == pytest.approx(slow_likeness(own, other)) and r.near_next == pytest.approx(slow_likeness(own, after))


def test_fingerprints_of_repeated_and_null_ids_and_one_row(spark, docs):
    made = sketch.digest(sketch.fingerprints(docs))
    assert made.count() == docs.count()
    twice = made.where("doc_id = 5002").collect()
    assert len({r.fingerprint for r in twice}) == 1 and max(r.near_next for r in twice) == 1.0
    one = sketch.digest(sketch.fingerprints(spark.createDataFrame([(1, "a text of its own, followed by itself")], "doc_id long, text string"))).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_sketches_merge_and_contain(spark):
    r = random.Random(2)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(20_000)]
    rows = [(0, " ".join(words)), (1, " ".join(words[5000:5600])), (2, " ".join(words[19_000:]) + " " + " ".join(f"v{i}" for i in range(5000))), (3, "one two three"), (4, "")]
    held = {x.doc_id: x.sketch for x in sketch.sketched(spark.createDataFrame(rows, "doc_id long, text string"), "text", "sketch").collect()}
    pairs = spark.createDataFrame([(held[a], held[b], f"{a}{b}") for a in held for b in held], "a array<string>, b array<string>, k string")
    out = {x.k: x for x in pairs.select("k", "b", sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.merge(F.col("a"), F.col("b")).alias("m")).collect()}
    assert out["10"].c == 1.0 and 0.09 < out["20"].c < 0.25 and out["01"].c < 0.06
    both = spark.createDataFrame([(0, " ".join(words[5000:5600]))], "doc_id long, text string")
    assert out["11"].m == held[1] == sketch.sketched(both, "text", "sketch").first().sketch
    assert out["34"].m == held[3] and out["30"].m == held[0] and out["44"].m == []
    union = sorted(set(held[1]) | set(held[2]))
    assert out["12"].m == union


def test_no_rows_and_other_columns_are_left(nothing, docs):
    assert fim.digest(fim.fill_in_middle(nothing)).count() == 0
    assert alignment.link_scores(alignment.digest(alignment.align(nothing, PATH_A, PATH_B))).count() == 0
    assert sketch.digest(sketch.fingerprints(nothing)).count() == 0
    assert fim.fill_in_middle(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_columns_of_the_queries(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op11_fill_in_middle(spark, sf).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert queries.op12_token_alignment(spark, sf).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert queries.op13_document_fingerprints(spark, sf).columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
