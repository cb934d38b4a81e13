"""Words of long texts, cut into chunks, against those of the whole."""

import random

import numpy as np

from tidemark.llm import hashing
from tidemark.llm.hashing import BLANKS, PUNCTUATION, Words


def test_chunks_change_nothing(monkeypatch):
    rng = random.Random(3)
    texts = [b"", b" ", b"one", b" a" * 3000, b"x" * 20_000, b" " * 9000 + b"end"]
    texts += ["".join(rng.choice(["é", "a", "B", " ", "\n", ".", "longer"]) for _ in range(6000)).encode() for _ in range(10)]
    for words in (Words(BLANKS, fold=True), Words(PUNCTUATION, fold=False)):
        whole = [words(t) for t in texts]
        with monkeypatch.context() as m:
            m.setattr(hashing, "_CHUNK", 64)
            for t, want in zip(texts, whole):
                got = words(t)
                assert all(np.array_equal(x, y) for x, y in zip(got, want))
        for t, (hashes, starts, ends) in zip(texts, whole):
            if words.inside[ord(".")]:
                assert [t[a:b] for a, b in zip(starts, ends)] == t.split() and len(set(hashes.tolist())) == len({w.lower() for w in t.split()})
