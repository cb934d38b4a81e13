"""Word hashes of a whole text at once, without a Python object for each word."""

from __future__ import annotations

import numpy as np

from .common import gram_hashes, mix64

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
#: Bytes of a text that are hashed at a time, up to the end of the word there.
_CHUNK = 1 << 18


def _powers(n: int) -> np.ndarray:
    """Powers 0 to n-1 of the base and of its inverse modulo 2**64."""
    steps = np.ones((2, n), np.uint64)
    steps[0, 1:], steps[1, 1:] = np.uint64(_P), np.uint64(_P_INVERSE)
    return np.multiply.accumulate(steps, axis=1)


_KEPT = _powers(_CHUNK)


class Words:
    """Finds words, runs of bytes that are not separators, and hashes each.

    separators: byte values; fold: whether A-Z count as a-z. The hash is a polynomial over
    64-bit random values of the bytes, mixed at the end.
    """

    def __init__(self, separators: bytes, fold: bool):
        values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        if fold:
            values[65:91] = values[97:123]
        self.values = values
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends) of the words of a text, starts and ends in bytes."""
        raw = np.frombuffer(text, np.uint8)
        if len(raw) <= _CHUNK:
            return self._chunk(raw)
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + _CHUNK)
            while end < len(raw) and (inside := self.inside[raw[end : end + 4096]]).any():
                if not inside.all():
                    end += int(inside.argmin())
                    break
                end += len(inside)
            hashes, starts, ends = self._chunk(raw[at:end])
            parts.append((hashes, starts + at, ends + at))
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _chunk(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flags = np.zeros(len(raw) + 2, np.int8)
        flags[1:-1] = self.inside[raw]
        edge = np.flatnonzero(np.diff(flags))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.empty(0, np.uint64), starts, ends
        power = _KEPT if len(raw) <= _CHUNK else _powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * power[0, : len(raw)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * power[1, starts]), starts, ends


#: Separators of the contracts: space and the ASCII controls 9 to 13.
BLANKS = bytes([32, *range(9, 14)])
#: For comparing prose: every ASCII byte but letters and digits.
PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of word hashes; fewer words: the whole sequence is the one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, min(n, len(words))))
