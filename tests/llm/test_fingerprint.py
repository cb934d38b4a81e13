"""Fingerprints: the edited texts exactly, the likeness within its sampling error."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

from tidemark.llm.fingerprint import BINS, fingerprint_edits, fingerprints


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def test_edits_and_likeness(spark):
    rng = random.Random(1)
    rows = [(i * 3 - 50, " ".join(f"w{rng.randrange(3000)}é" for _ in range(rng.choice([40, 200, 700, 2000])))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "ab"), (None, "no id here at all, and some words more"), (7777, "one"), (7777, "two")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fingerprint int")
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in fingerprint_edits(docs).collect()}
    line = sorted(((i is not None, i or 0, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    worst = 0
    for k, (known, i, text) in enumerate(line):
        after = line[(k + 1) % len(line)][2]
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        r = got[(i if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest())]
        a, b, c = shingles(text), shingles(edited), shingles(after)
        if len(a) > 30:
            worst = max(worst, abs(r.near_edited - len(a & b) / len(a | b)))
        if a and c and not a & c:
            assert r.near_next < 0.2
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert len(r.fingerprint) == (BINS if a else 0)
    assert worst < 0.16


def test_equal_texts_order_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A  b\nc d e f g"), (3, "b a c d e f g")], "doc_id long, text string")
    one, two, three = (r.f for r in fingerprints(docs, "text", "f").orderBy("doc_id").collect())
    assert one == two != three
    assert fingerprint_edits(docs.limit(0)).count() == 0
    (alone,) = fingerprint_edits(docs.filter("doc_id = 1")).collect()
    assert alone.near_next == 1.0


def test_many_buckets(spark):
    from tidemark.llm import fingerprint as M

    docs = spark.range(0, 5000).selectExpr("id * id as doc_id", "concat('t', id) as text")
    old, M.BUCKET_ROWS = M.BUCKET_ROWS, 100
    try:
        rows = M.with_next(docs, "doc_id", "text", {"text": "n"}).collect()
    finally:
        M.BUCKET_ROWS = old
    want = {i * i: f"t{i - 1 if i else 4999}" for i in range(5000)}
    assert len(rows) == 5000 and {r.doc_id: r.n for r in rows} == want


def h64(value, seed=42):
    if isinstance(value, str):
        return xxhash.xxh64_intdigest(value.encode(), seed)
    return xxhash.xxh64_intdigest(struct.pack("<q" if value >> 31 not in (0, -1) else "<i", value), seed)


def long64(value, seed=42):
    return xxhash.xxh64_intdigest(struct.pack("<Q", value), seed)


def plain_fingerprint(text):
    """Bins, walks and digits, one by one."""
    words = [h64(w) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]
    if not words:
        return ""
    n, bins = min(5, len(words)), {}
    for k in range(len(words) - n + 1):
        h = 42
        for w in words[k : k + n]:
            h = long64(w, h)
        signed = lambda x: x - 2**64 if x >> 63 else x
        bins[h >> 56] = min(bins.get(h >> 56, h), h, key=signed)
    int32 = lambda v, seed=42: xxhash.xxh64_intdigest(struct.pack("<i", v), seed)
    out = []
    for b in range(256):
        if b in bins:
            value = bins[b]
        else:
            for j in range(1, 8 * -(-256 // len(bins)) + 1):
                at = (lambda x: (x - 2**64 if x >> 63 else x) % 256)(int32(j, int32(b)))
                if at in bins:
                    value = bins[at]
                    break
            else:
                value = min(bins.values(), key=lambda v: signed(long64(v >> 56, int32(b))))
            value = int32(b, long64(value))
        out.append("0123456789abcdef"[value & 15])
    return "".join(out)


def test_fingerprints_against_plain_python(spark):
    rng = random.Random(2)
    texts = [" ".join(f"W{rng.randrange(900)}ü" for _ in range(n)) for n in (1, 3, 5, 6, 9, 30, 120, 260, 700, 4000)] + [None, "", "a " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.f for r in fingerprints(docs, "text", "f").collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_likeness_takes_off_the_chance_agreements(spark):
    from tidemark.llm.fingerprint import likeness

    a, b = "0" * 256, "0" * 100 + "1" * 156
    rows = [(a, b), (a, "1" * 256), (a, a), ("", ""), ("", a), (None, a)]
    got = [r.x for r in spark.createDataFrame(rows, "a string, b string").select(likeness("a", "b").alias("x")).collect()]
    assert got == [pytest.approx((100 / 256 - 1 / 16) / (15 / 16)), 0.0, 1.0, 1.0, 0.0, None]


def test_least_id_crowded_ids_and_clashing_names(spark, monkeypatch):
    from tidemark.llm import fingerprint as M

    monkeypatch.setattr(M, "BUCKET_ROWS", 20)
    ids = [-(2**63), 2**63 - 1, *range(500), 10**15]
    docs = spark.createDataFrame([(i, f"t{i}", 1) for i in ids] + [(None, "n", 1)], "doc_id long, text string, bucket int")
    out = M.with_next(docs, "doc_id", "text", {"text": "n"})
    line = [*sorted(ids, reverse=True), None]
    assert out.columns == ["doc_id", "text", "bucket", "n"]
    assert {r.doc_id: r.n for r in out.collect()} == {i: "n" if nxt is None else f"t{nxt}" for i, nxt in zip(line, [*line[1:], line[0]])}
    assert fingerprint_edits(docs).count() == len(line)
