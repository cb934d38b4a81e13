"""Packfiles: the index (version 2), records, delta chains."""

from __future__ import annotations

import bisect
import mmap
import os
import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np

from ..functions.parsing import KINDS, OFS_DELTA, REF_DELTA, Malformed, apply_delta, inflate

#: Fixed value: what an index of version 2 begins with.
MAGIC = b"\xfftOc\x00\x00\x00\x02"
#: Bytes before the names in an index, and of an id.
_NAMES, _ID = 8 + 1024, 20
#: Contents that a reader keeps for the deltas to come, in bytes.
REMEMBER = 64 << 20


def _mapped(path: str) -> mmap.mmap:
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class Index:
    """A pack's index as it lies in its file: nothing is read but the entries that are asked for."""

    def __init__(self, raw):
        if raw[:8] != MAGIC or len(raw) < _NAMES + 40:
            raise Malformed("pack index of another version than 2")
        self.raw = raw
        self.fanout = np.frombuffer(raw, ">u4", 256, 8).astype(np.int64)
        self.n = int(self.fanout[-1])
        self._far = _NAMES + self.n * 28
        if (np.diff(self.fanout) < 0).any() or len(raw) < self._far + 40:
            raise Malformed("pack index is cut off or out of order")

    @staticmethod
    def open(path: str) -> Index:
        if os.path.getsize(path) == 0:
            raise Malformed("pack index is empty")
        return Index(_mapped(path))

    def oid(self, i: int) -> str:
        return self.raw[_NAMES + _ID * i : _NAMES + _ID * (i + 1)].hex()

    def oids(self) -> Iterator[str]:
        return map(self.oid, range(self.n))

    def offsets(self) -> np.ndarray:
        """The offset of every entry, in the order of ids."""
        small = np.frombuffer(self.raw, ">u4", self.n, _NAMES + self.n * 24).astype(np.int64)
        far = small >= 1 << 31
        if far.any():
            table = np.frombuffer(self.raw, ">u8", (len(self.raw) - 40 - self._far) // 8, self._far).astype(np.int64)
            places = small[far] - (1 << 31)
            if (places >= len(table)).any():
                raise Malformed("offset past the pack index")
            small[far] = table[places]
        return small

    def find(self, oid: str) -> int | None:
        """The offset of an object; None if it isn't here. Binary search among the ids of one first byte."""
        want = bytes.fromhex(oid)
        first, last = int(self.fanout[want[0] - 1]) if want[0] else 0, int(self.fanout[want[0]])
        at = bisect.bisect_left(range(last), want, lo=first, key=lambda i: self.raw[_NAMES + _ID * i : _NAMES + _ID * (i + 1)])
        if at == last or self.oid(at) != oid:
            return None
        place = struct.unpack_from(">I", self.raw, _NAMES + self.n * 24 + 4 * at)[0]
        if place < 1 << 31:
            return place
        far = self._far + 8 * (place - (1 << 31))
        if far + 8 > len(self.raw) - 40:
            raise Malformed("offset past the pack index")
        return struct.unpack_from(">Q", self.raw, far)[0]


def find_packs(git_dir: str) -> tuple[list[str], list[str]]:
    """(paths of packs, without suffix, whose index can be read; what is wrong with the others)."""
    folder, good, bad = os.path.join(git_dir, "objects", "pack"), [], []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
        stem = os.path.join(folder, name.removesuffix(".idx"))
        if name.endswith(".idx") and os.path.isfile(f"{stem}.pack"):
            try:
                Index.open(f"{stem}.idx").offsets()
                good.append(stem)
            except (Malformed, OSError) as e:
                bad.append(f"{name}: {e}")
    return good, bad


class Pack:
    """Reads objects of one pack; a chain of deltas is followed to its base and applied back."""

    def __init__(self, stem: str):
        self.index = Index.open(f"{stem}.idx")
        self.raw = _mapped(f"{stem}.pack")
        if self.raw[:4] != b"PACK" or struct.unpack(">I", self.raw[4:8])[0] not in (2, 3):
            raise Malformed("pack header")
        self._kept: OrderedDict[int, tuple[str, bytes]] = OrderedDict()
        self._size = 0

    @property
    def offsets(self) -> np.ndarray:
        return self.index.offsets()

    def header(self, at: int) -> tuple[int, int, int, int | str | None]:
        """(type, size, place of the data, base: offset or oid) of the record at an offset."""
        raw, start = self.raw, at
        try:
            kind, size, shift = raw[at] >> 4 & 7, raw[at] & 15, 4
            while raw[at] & 128:
                at += 1
                size |= (raw[at] & 127) << shift
                shift += 7
            at += 1
            if kind == REF_DELTA:
                return kind, size, at + _ID, raw[at : at + _ID].hex()
            if kind == OFS_DELTA:
                back = raw[at] & 127
                while raw[at] & 128:
                    at += 1
                    back = (back + 1 << 7) | raw[at] & 127
                if not 0 < back <= start:
                    raise Malformed("delta base before the pack")
                return kind, size, at + 1, start - back
        except IndexError as e:
            raise Malformed("pack record is cut off") from e
        if kind not in KINDS:
            raise Malformed(f"pack record of type {kind}")
        return kind, size, at, None

    def base_offset(self, base: int | str) -> int:
        if isinstance(base, int):
            return base
        if (at := self.index.find(base)) is None:
            raise Malformed("delta whose base is in another pack")
        return at

    def kind_at(self, at: int) -> str:
        """The kind of the object at an offset, without its contents."""
        for _ in range(self.index.n + 1):
            kind, _, _, base = self.header(at)
            if base is None:
                return KINDS[kind]
            at = self.base_offset(base)
        raise Malformed("deltas in a circle")

    def object_at(self, at: int) -> tuple[str, bytes]:
        chain = []
        while at not in self._kept:
            kind, size, data, base = self.header(at)
            if base is None:
                self._remember(at, KINDS[kind], inflate(self.raw, size, data)[0])
                break
            chain.append((at, data, size))
            at = self.base_offset(base)
            if len(chain) > self.index.n:
                raise Malformed("deltas in a circle")
        self._kept.move_to_end(at)
        kind, content = self._kept[at]
        for at, data, size in reversed(chain):
            content = apply_delta(content, inflate(self.raw, size, data)[0])
            self._remember(at, kind, content)
        return kind, content

    def find(self, oid: str) -> tuple[str, bytes] | None:
        at = self.index.find(oid)
        return None if at is None else self.object_at(at)

    def _remember(self, at: int, kind: str, content: bytes) -> None:
        self._kept[at] = kind, content
        self._size += len(content)
        while self._size > REMEMBER and len(self._kept) > 1:
            self._size -= len(self._kept.popitem(last=False)[1][1])

    def objects(self, kinds: set[str] | None, first: int = 0, last: int | None = None) -> Iterator[tuple[str, str, bytes]]:
        """(oid, kind, data) of the objects at offsets from first up to last, in the order of offsets; near bases stay remembered."""
        offsets = self.index.offsets()
        mine = np.flatnonzero((offsets >= first) & (offsets < (last or len(self.raw))))
        for i in mine[np.argsort(offsets[mine], kind="stable")].tolist():
            at = int(offsets[i])
            if kinds is None or self.kind_at(at) in kinds:
                yield self.index.oid(i), *self.object_at(at)
