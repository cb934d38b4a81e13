"""Held-out accuracy on the given documents, and the odd inputs."""

import math
import os
import zlib
from collections import Counter

import pytest

from tidemark.llm.language_id import AMBIGUOUS, BUCKETS, Model, codewords, fit, identify, keep_identified

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    out = identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) > 250 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 40):
        code = codewords(n)
        assert len({tuple(r) for r in code}) == n
        assert all(0 < (code[:, b] > 0).sum() < n for b in range(code.shape[1]))


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(6)] + [(i, "der hund und die katze", "de") for i in range(6, 12)]
    rows += [(20, None, "en"), (21, "123 !?", "de"), (22, "", None), (None, "und der", None), (23, "the " * 50_000, None), (24, "DER UND DIE", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert [got[i].lang_pred for i in (20, 21, 22)] == ["und"] * 3 and got[23].lang_pred == "en" and got[24].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(12), None, 23, 24}
    nothing = docs.limit(0)
    assert identify(nothing).count() == 0 and keep_identified(nothing).count() == 0
    unlabelled = docs.withColumn("lang", docs.lang.cast("string")).filter("lang is null")
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {"und"} and keep_identified(unlabelled).count() == unlabelled.count()


def test_one_language(spark):
    model = fit(spark.createDataFrame([("ein hund", "de")], "text string, lang string"))
    assert isinstance(model, Model) and model.predict("was auch immer")[:2] == ("de", 1.0) and model.predict("7")[0] == "und"


def test_predictions_fill_missing_languages(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(6)] + [(i, "der hund und die katze", "de") for i in range(6, 12)]
    rows += [(i, "la casa blanca " * 2000, ("es", "it")[i % 2]) for i in range(30, 42)]
    rows += [(20, "the dog", None), (21, "die katze und der hund", None), (22, "the dog", "de"), (23, "la casa", None), (24, "?", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    said = {r.doc_id: r for r in identify(docs).collect()}
    assert said[23].ambiguous and not said[20].ambiguous and not said[21].ambiguous
    got = {r.doc_id: r.lang for r in keep_identified(docs).collect()}
    assert got == {i: lang for i, _, lang in rows if not 20 <= i < 30} | {20: "en", 21: "de", 22: "de", 23: None}


def plain_grams(text):
    """Buckets of a text's letter n-grams, one by one."""
    text = (text or "").lower()
    if not any(c.isalpha() for c in text):
        return []
    line, before = [0], False
    for c in text:
        if c.isalpha():
            line.append(ord(c))
        elif before:
            line.append(0)
        before = c.isalpha()
    line.append(0)
    out, word = [], 2**32 - 1
    for n in (1, 2, 3):
        for at in range(len(line) - n + 1):
            h = 0
            for c in line[at : at + n]:
                h = (h * 0x01000193 + c * 0x9E3779B1) & word
            h ^= n * 0x85EBCA6B & word
            out.append((h ^ h >> 15) * 0x2C1B3C6D % 2**32 >> 17)
    return out


class Plain:
    """The output codes over (text, lang) rows, in plain Python."""

    def __init__(self, rows):
        counts = {}
        for text, lang in rows:
            if lang is not None:
                counts.setdefault(lang, Counter()).update(plain_grams(text))
        counts = {k: c for k, c in counts.items() if c}
        self.languages = sorted(counts)
        self.code = [[int(x) for x in row] for row in codewords(len(self.languages))]
        share = []
        for lang in self.languages:
            whole = sum(counts[lang].values()) + 0.1 * BUCKETS
            share.append([(counts[lang][b] + 0.1) / whole for b in range(BUCKETS)])
        self.weights, self.trust = [], []
        for bit in range(len(self.code[0]) if len(share) > 1 else 0):
            sides = [[share[k] for k in range(len(share)) if self.code[k][bit] == s] for s in (1, -1)]
            yes, no = ([sum(x) / len(side) for x in zip(*side)] for side in sides)
            self.weights.append([math.log(y / n) for y, n in zip(yes, no)])
            self.trust.append(sum((y - n) * w for y, n, w in zip(yes, no, self.weights[-1])))

    def predict(self, text):
        found = plain_grams(text)
        if not found or not self.languages:
            return "und", 0.0, False, None
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False, None
        margins = [sum(w[g] for g in found) / math.sqrt(len(found)) for w in self.weights]
        term = lambda x: math.log1p(math.exp(-x)) if x > -700 else -x
        loss = [sum(t * term(c * m) for t, c, m in zip(self.trust, code, margins)) / sum(self.trust) for code in self.code]
        order = sorted(range(len(loss)), key=lambda k: loss[k])
        best, second = order[:2]
        return self.languages[best], 1 / sum(math.exp(loss[best] - x) for x in loss), loss[second] - loss[best] < AMBIGUOUS, self.languages[second]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
def test_against_plain_output_codes(spark):
    docs = spark.read.parquet(DATA.replace("sf0.01", "sf0.001"))
    rows = docs.collect()
    model = Plain([(r.text, r.lang) for r in rows if not held(r.doc_id)])
    texts = {r.doc_id: r.text for r in rows}
    for r in identify(docs).collect():
        want = model.predict(texts[r.doc_id])
        assert (r.held_out, r.lang_pred, r.ambiguous, r.runner_up) == (held(r.doc_id), want[0], *want[2:])
        assert r.score == pytest.approx(want[1], abs=1e-4)


def test_only_wanted_languages_stay(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(6)] + [(i, "der hund und die katze", "de") for i in range(6, 12)] + [(20, "die katze", "en"), (21, "the dog", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang for r in keep_identified(docs, {"en"}).collect()} == {**{i: "en" for i in range(6)}, 21: "en"}
    assert keep_identified(docs, ()).count() == 0 and keep_identified(docs).count() == len(rows)


def test_columns_of_the_same_names_are_replaced(spark):
    from tidemark.llm.language_id import predict

    docs = spark.createDataFrame([("the cat", "en", "x", 7), ("der hund", "de", "x", 7)], "text string, lang string, score string, lang_pred int")
    out = predict(docs, fit(docs))
    assert out.columns == ["text", "lang", "lang_pred", "score", "ambiguous", "runner_up"] and [r.lang_pred for r in out.collect()] == ["en", "de"]
    too_many = spark.range(600).selectExpr("'a' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError):
        fit(too_many)
