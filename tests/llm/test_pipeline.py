"""The pipeline against a plain version of its stages over the smallest given tables."""

import os

import pytest
from pyspark.sql import functions as F
from test_decontaminate import smith_waterman
from test_language_id import Plain, held
from test_near_dedup import brute as near_brute
from test_secret_scan import BASE, judged

import corpus_pipeline
from tidemark.llm.decontaminate import THRESHOLD, _words

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")

def plain(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    model = Plain([(r.text, r.lang) for r in docs.values() if not held(r.doc_id)])
    left = {i: r.text for i, r in docs.items() if model.predict(r.text)[0] in model.languages}
    classes = near_brute(left.items(), 5, 80)
    left = {i: t for i, t in left.items() if classes[i][1] == i}
    words = {i: _words(t.encode())[0].tolist() for i, t in left.items()}
    tests = [_words(t.encode())[0].tolist() for _, t in items]

    def leaks(own):
        return any(len(set(t) & set(own)) >= THRESHOLD * len(set(t)) / 2 and smith_waterman(t, own) >= THRESHOLD * 2 * len(t) for t in tests)

    left = {i: t for i, t in left.items() if not leaks(words[i])}
    ids = list(left)
    out = {}
    for at, spans in judged([(i, left[i], docs[i].source) for i in ids]).items():
        text, done, upto = left[ids[at]], "", 0
        value = lambda a, k, b: (a + [m.start(1) - m.start() for m in BASE[0][1].finditer(text, a, b)][0] if k == 0 else a, b)
        for a, b in sorted(value(a, k, b) for a, k, b, live in spans if live):
            if a >= upto:
                done += text[upto:a] + "[SECRET]"
            upto = max(upto, b)
        out[ids[at]] = done + text[upto:]
    return out


def test_the_language_stage_decides_by_its_classifier(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    rows = docs.collect()
    model = Plain([(r.text, r.lang) for r in rows if not held(r.doc_id)])
    want = {}
    for r in rows:
        said, _, ambiguous, _ = model.predict(r.text)
        if said != "und":
            want[r.doc_id] = r.lang if r.lang is not None or ambiguous else said
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, DATA).collect()}
    assert got == want and sum(r.lang is None and want.get(r.doc_id) is not None for r in rows) > 30


def test_against_plain_stages(spark):
    from tidemark.llm.sentencepiece_codec import Codec, Pieces

    codec = Codec(Pieces.load())
    want = plain(spark)
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        assert codec.decode(r.ids) == want[r.doc_id] and r.n_chars == len(want[r.doc_id]) and r.restored


def test_stages_keep_columns_and_bear_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, bands string, key int"
    rows = [(1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, "x", 1), (None, "words without an id", "en", None, 19, None, None),
            (3, "token=abcdefgh12345678 the end", "en", "s", 30, "x", 1), (3, "token=abcdefgh12345678 the end", "en", "s", 30, "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, DATA)
            assert frame.columns == docs.columns
        frame.collect()
    last = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        last = stage(spark, last, DATA)
    assert sorted(((r.doc_id, r.text) for r in last.collect()), key=repr) == [(3, "token=[SECRET] the end"), (None, "words without an id")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0
