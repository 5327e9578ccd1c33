"""The stages, each against a brute-force version of its own."""

from __future__ import annotations

from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import quality, secrets, sentence_pieces
from lattica.storage import stored

from .test_duplicates import brute
from .test_text_operators import PIECES

SMALL = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, SMALL), "stage")
        a, b = {r.doc_id: r for r in before.collect()}, after.collect()
        if name != "SentencePiece encoding":
            assert after.columns == columns
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            gone = set(a) - {r.doc_id for r in b}
            assert gone and all(r == a[r.doc_id] for r in b)
            assert sum(labels.get(i) == 1 for i in gone) <= 2 and sum(labels.get(r.doc_id) == 0 for r in b) <= 2
        elif name == "MinHash near-dedup":
            expected = brute([(i, r.text) for i, r in a.items()], 5)
            assert sorted(r.doc_id for r in b) == sorted(i for i, (_, _, kept) in expected.items() if kept)
        elif name == "secret scans":
            assert {r.doc_id: r.text for r in b} == {i: secrets.cleaned(r.text) for i, r in a.items()}
            assert all(not secrets.find(r.text) and r.n_chars == len(r.text) for r in b)
        elif name == "mixing sources":
            times = Counter(r.doc_id for r in b)
            assert max(times.values()) <= 3 and all(r == a[r.doc_id] for r in b)
            size = lambda r: len(r.text.split())
            total = sum(map(size, a.values()))
            assert abs(sum(map(size, b)) - total) < 0.1 * total
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
            texts = {r.doc_id: r.text for r in before.collect()}
            assert len(b) == before.count()
            assert all(r.ids == library.encode(texts[r.doc_id], add_bos=True, add_eos=True) and r.n_tokens == len(r.ids) for r in b)
        before = after
    assert corpus_pipeline.run(spark, SMALL).count() == before.count()


@pytest.fixture
def odd(spark):
    rows = [(1, None, None, None, None, "x"), (None, "some words of text", "en", "s", 18, None), (1, "other words token = abcdefgh1", "en", None, 20, "y"), (1, "other words token = abcdefgh1", "en", None, 20, "y"), (4, "", "en", "s", 0, "z"), (5, "word " * 100_000, "en", "s", 500_000, "z")]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, `{quality.SCORE[2:]}` string")


def test_odd_rows(spark, odd):
    before = odd
    for _, stage in corpus_pipeline.STAGES:
        for frame in (before, before.limit(0)):
            out = stage(spark, frame, SMALL)
            n, had = out.count(), frame.count()
            assert (n == had) if stage in (corpus_pipeline.secret_stage, corpus_pipeline.encoding_stage) else n <= 3 * had
            assert had or not n
        before = stored(stage(spark, before, SMALL), "stage")
    assert corpus_pipeline.near_duplicate_stage(spark, odd, SMALL).filter(F.col("doc_id").isNull()).count() == 1
    assert sentence_pieces.encode_documents(odd, PIECES).count() == odd.count()


def test_rows_of_one_id_or_none(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other, third = text.replace("w", "v"), text.replace("w", "u")
    rows = [(1, text), (7, text + " more"), (7, other), (8, third), (8, third), (8, other + " more"), (None, third), (None, "null " * 9), (None, "null " * 9), (None, ""), (None, ""), (9, ""), (9, ""), (10, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.near_duplicate_stage(spark, frame, SMALL)
    assert out.columns == frame.columns
    expected = [(1, text), (7, other), (8, third), (None, "null " * 9), (None, ""), (None, ""), (9, ""), (10, "")]
    assert sorted(map(str, [(r.doc_id, r.text) for r in out.collect()])) == sorted(map(str, expected))
