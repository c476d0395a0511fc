"""The pipeline's stages against plain versions of them, and the registered queries."""

import collections

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from ledgerloom.llm import pii, quality

from .test_operators import corpus, slow_classes, slow_lines, DOCS  # noqa: I001

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    extra = [(500, "too short", "en", "s0", 9), (501, None, None, None, None), (502, "rep " * 60, "en", "s1", 240), (503, "a b c d e f g h i j k l m n o p q r s t mail x.y@z.org now", "en", "s1", 60)]
    rows = [(i, t, la, s, len(t)) for i, t, la, s, _ in corpus(4)] + extra
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = docs
    want = rows
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, got, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        got = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "quality_rules":
            keep = quality.measure([r[1] for r in want])["kept"]
            want = [r for r, ok in zip(want, keep) if ok]
        elif name == "line_dedup":
            want = [(r[0], x[3], r[2], r[3], len(x[3])) for r, x in zip(want, slow_lines(want, 0.05, 5))]
        elif name == "simhash_near_dedup":
            rows_ = [collections.namedtuple("R", "doc_id text")(r[0], r[1]) for r in want]
            low = slow_classes(rows_)
            want = [r for r in want if low[r[0]] == r[0]]
        elif name == "pii_redaction":
            m = pii.model()
            done = []
            for r in want:
                t, at, parts = r[1], 0, []
                for a, z, kind in pii.find(t, m):
                    if a >= at:
                        parts += [t[at:a], f"[{kind.upper()}]"]
                    at = max(at, z)
                t = "".join([*parts, t[at:]])
                done.append((r[0], t, r[2], r[3], len(t)))
            want = done
        if name != "packing":
            assert got.columns == docs.columns
            assert sorted(map(tuple, got.collect())) == sorted(want), name
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = collections.defaultdict(list)
    for r in got.collect():
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in pieces.items()} == {r[0]: np.array([*t.encode(r[1], add_special_tokens=False).ids, 1], "<u4").tobytes() for r in want}
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.drop("ids").collect())) == sorted(map(tuple, got.drop("ids").collect()))


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_queries_cover_every_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    q = entry.queries()
    names = [k for k in q if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in q
    for name in ("op2_importance_resampling", "op5_simhash_components", "op7_line_dedup", "op8_byte_bpe", "op9_quality_rules", "op10_pii_spans", "op11_fill_in_middle", "op12_token_alignment", "op13_document_fingerprints"):
        assert q[name](spark, SF).count() == n, name
    assert q["op4_mixture_packing"](spark, SF).select(F.count_distinct("doc_id")).first()[0] == n
