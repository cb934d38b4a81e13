"""Importance resampling: the drawn set is the top k by key; junk goes, good texts stay."""

import math
import os
import re
import struct

import pytest
import xxhash

from tidemark.llm import importance as I

DATA = "/root/testdata/sf0.01"


def rows(n=400):
    good = lambda i: f"the quick brown fox number {i % 7} jumps over the lazy dog and sleeps well"
    junk = lambda i: f"BUY!!! $$$ {i % 5} %%% cheap### pills!!! $$$ click&&& now%%%"
    docs = [(i, (good if i % 4 else junk)(i)) for i in range(n)]
    labels = [(i, 1 if i % 4 else 0, 0) for i in range(0, n, 3)]
    return docs, labels


def test_draw_is_the_top_k_and_junk_goes(spark, monkeypatch):
    monkeypatch.setattr(I, "_BINS", 4)  # the histograms then have to narrow down several times
    docs, labels = rows()
    frame = spark.createDataFrame([(*d, True) for d in docs], "doc_id long, text string, kept boolean")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    everything = sorted(((r.key, r.doc_id) for r in I.resample(frame, known, fraction=1.0).collect()), reverse=True)
    assert len(everything) == 400
    drawn = {r.doc_id for r in I.resample(frame, known, fraction=0.6).collect()}
    assert drawn == {i for _, i in everything[:240]} and all(i % 4 for i in drawn)
    assert {r.doc_id for r in I.resample(frame, known, fraction=0.6).collect()} == drawn
    assert {r.doc_id for r in I.resample(frame, known, fraction=0.6, seed=2).collect()} != drawn


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (None, "words without id"), (4, "a"), (4, "a"), (5, "long " * 100_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 0), (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(str(r.doc_id) for r in I.resample(frame, labels, fraction=1.0).collect()) == ["4", "4", "5", "None"]
    assert I.resample(frame, labels.limit(0)).count() == 0 and I.resample(frame.limit(0), labels).count() == 0
    assert I.resample(frame, labels.limit(0), fraction=1.0).count() == 4


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
def test_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in I.resample(docs, labels).collect()}
    known = labels.collect()
    good, junk = [r.doc_id in kept for r in known if r.quality], [r.doc_id in kept for r in known if not r.quality]
    assert sum(good) / len(good) > 0.9 and sum(junk) / len(junk) < 0.1


WORD = 2**64 - 1


def mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & WORD
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & WORD
    return x ^ x >> 33


def plain_buckets(text):
    """Buckets of a text's uni- and bigrams, one by one."""
    tokens = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", (text or "").encode())
    hashes = []
    for t in tokens:
        total = 0
        for k, b in enumerate(t):
            total += mix((b + 1) * 0xD1342543DE82EF95 & WORD) * pow(0x9E3779B97F4A7C15, k, 2**64)
        hashes.append(mix(total & WORD))
    out = []
    for n in (1, 2):
        for at in range(len(hashes) - n + 1):
            acc = n
            for h in hashes[at : at + n]:
                acc = (acc * 0x9E3779B97F4A7C15 + h) & WORD
            out.append(mix(acc) >> 48)
    return out


def test_ratio_noise_and_draw_against_plain_python(spark):
    docs, labels = rows(200)
    docs += [(1000, "é ünï -- ça, va?"), (1001, None), (1002, "..."), (1003, "x\ty\x0bz")]
    good = {i for i, q, t in labels if q == 1 and t == 0}
    raw, target = [0.0] * I.BUCKETS, [0.0] * I.BUCKETS
    for i, t in docs:
        for b in plain_buckets(t):
            raw[b] += 1
            target[b] += i in good
    share = sum(target) / sum(raw)
    ratio = [math.log((t + I.PRIOR) / (r * share + I.PRIOR)) for r, t in zip(raw, target)]
    keys = {}
    for i, t in docs:
        if found := plain_buckets(t):
            h = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<i", 1), h)
            keys[i] = sum(ratio[b] for b in found) / len(found) * I.GRAMS - math.log(-math.log(((h >> 11) + 0.5) / 2**53))
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.key for r in I.resample(frame, known, fraction=0.4).collect()}
    want = dict(sorted(keys.items(), key=lambda x: -x[1])[: round(0.4 * len(keys))])
    assert got == {i: pytest.approx(k, abs=1e-9) for i, k in want.items()}


def test_ties_are_cut_by_id_without_being_collected(spark, monkeypatch):
    monkeypatch.setattr(I, "_BINS", 3)
    scored = spark.createDataFrame([(i, 1.0) for i in range(-2000, 2000)] + [(None, 1.0)] * 50 + [(9000 + i, 2.0) for i in range(10)] + [(2**63 - 1, 0.5), (-(2**63), 0.5)], "doc_id long, key double")
    for k, want in ((1, (2.0, 9000)), (10, (2.0, 9009)), (11, (1.0, -2000)), (1510, (1.0, -501)), (4010, (1.0, 1999)), (4011, (1.0, None)), (4061, (0.5, -(2**63))), (4062, (0.5, 2**63 - 1))):
        assert I._cutoff(scored, k) == want
