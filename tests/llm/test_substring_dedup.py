"""Repeated windows against a count of all windows in Python."""

import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm.substring_dedup import remove_repeats


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_against_counts(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"v{rng.randrange(10_000)}" for _ in range(n)]
    shared, edge = fresh(50), fresh(35)
    rows = [(i, " ".join(fresh(rng.randrange(80)) + shared[rng.randrange(5) : 40 + rng.randrange(11)] + fresh(rng.randrange(60)))) for i in range(40)]
    rows += [(50, " ".join(edge)), (51, "\n".join(fresh(3) + edge)), (52, " ".join(edge[:34])), (53, " ".join(fresh(20) * 4)), (54, "a " * 100)]
    rows += [(55, " ".join(x := fresh(90))), (56, " ".join(x)), (None, " ".join(x)), (57, None), (57, None), (58, ""), (59, "Ünï cödé " * 3)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, 35).collect()), key=repr)
    assert got == brute(rows, 35)
    spans = {r.doc_id: [(x["first"], x["last"]) for x in r.repeats] for r in remove_repeats(docs, 35).collect()}
    assert spans[50] == [(0, 35)] and spans[51] == [(3, 38)] and spans[52] == []


def test_empty_table_and_window(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([], "doc_id long, text string"), window=8)
