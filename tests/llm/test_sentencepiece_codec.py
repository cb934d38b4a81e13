"""Encoding against a plain dynamic programme over all pieces, and exact round trips."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.sentencepiece_codec import _OWN, SPACE, Codec, Pieces, decode, encode, encoded_documents

pytest.importorskip("public_tokenizers")
_codec = None


def codec():
    global _codec
    _codec = _codec or Codec(Pieces.load())
    return _codec


def total(c, ids):
    """Score of ids; runs of byte pieces count as characters that fell back."""
    score, i = 0.0, 0
    while i < len(ids):
        if ids[i] in c.byte_of:
            first = c.byte_of[ids[i]]
            i += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            score += c.fallback
        else:
            score += c.pieces.scores[ids[i]]
            i += 1
    return score


def brute(c, text):
    known = {t: s for t, s, u in zip(c.pieces.texts, c.pieces.scores, c.pieces.usable) if u}
    line = SPACE + text.replace(SPACE, _OWN).replace(" ", SPACE)
    best = [0.0] + [-1e300] * len(line)
    for e in range(1, len(line) + 1):
        for a in range(max(0, e - 16), e):
            if line[a:e] in known:
                best[e] = max(best[e], best[a] + known[line[a:e]])
        if line[e - 1] not in known:
            best[e] = max(best[e], best[e - 1] + c.fallback)
    return best[-1]


def test_best_score_on_texts():
    rng = random.Random(1)
    words = ["the", "Thinking", "über", "naïve", "日本", "🎉", "x\n\ty", "a.b,c", "ing", "▁", "e" * 20, "\x00"]
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(1, 12)))
        ids = codec().encode(text).tolist()
        assert total(codec(), ids) == pytest.approx(brute(codec(), text)) and codec().decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    assert codec().decode(codec().encode(text).tolist()) == text


def test_units_together_are_units_alone(monkeypatch):
    import tidemark.llm.sentencepiece_codec as M

    rng = random.Random(3)
    pool = ["thing", "Straße", "日本語", "🎉", "▁", "\x00", "\n", "é", "zq", "  ", "\u0378"]
    texts = [" ".join("".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(30))) for _ in range(60)]
    texts += ["", None, " ", "   ", "a" * 500, "\n" * 40]
    together = codec().encode_all(pa.array(texts))
    monkeypatch.setattr(M, "SHORT", -1)
    assert together.to_pylist() == codec().encode_all(pa.array(texts)).to_pylist()
    assert [None if x is None else x.decode() for x in codec().decode_all(together).to_pylist()] == texts
    part = pa.array(texts).slice(7, 20)
    assert codec().decode_all(codec().encode_all(part).slice(3, 9)).to_pylist() == [t.encode() for t in texts[10:19]]


def test_bytes_that_are_no_text_are_restored():
    raw = [b"ab \xff\xfe cd", b"\xe6\x97 x", "é".encode()[:1]]
    assert codec().decode_all(codec().encode_all(pa.array(raw, pa.binary()))).to_pylist() == raw


def test_ids_of_a_unigram_model_are_the_library_s():
    """A small model written by hand; the library's unigram encoder maximises the same total score."""
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    rng = random.Random(9)
    texts = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), SPACE, *"abcde", *sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6))) for _ in range(60)}), SPACE + "ab", SPACE + "c"]
    scores = [0.0 if k < 257 else -1 - 9 * rng.random() for k in range(len(texts))]
    own = Codec(Pieces(texts, scores, [k > 256 for k in range(len(texts))], list(range(1, 257))))
    theirs = Tokenizer(Unigram(list(zip(texts, scores)), unk_id=0, byte_fallback=True))
    for _ in range(400):
        text = "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 40)))
        assert own.encode(text).tolist() == theirs.encode(SPACE + text).ids


def test_frames(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "two  spaces ▁ and ünï"), (4, "two  spaces ▁ and ünï"), (None, "x"), (5, "long text " * 40_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_pieces int")
    back = decode(encode(docs.select("doc_id", "text"))).collect()
    assert all(r.text == r.decoded for r in back)
    out = encoded_documents(docs).collect()
    assert len(out) == len(rows) and all(r.restored for r in out)
    got = {r.doc_id: (r.n_chars, r.n_pieces) for r in out}
    assert got[1] == (0, 0) and got[2] == (0, 0) and got[3] == (1, 1)
    assert next(r.ids for r in out if r.doc_id == 1) is None and next(r.ids for r in out if r.doc_id == 2) == []
    assert encoded_documents(docs.limit(0)).count() == 0
    clash = docs.selectExpr("text", "'x' as ids", "1 as decoded")
    again = decode(encode(clash))
    assert again.columns == ["text", "ids", "decoded"] and all(r.text == r.decoded for r in again.collect())
