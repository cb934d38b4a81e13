"""Parsing of git's objects: signatures, commits, trees, deltas, and the id of an object."""

from __future__ import annotations

import hashlib
import re
import zlib
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modes of a tree's entries that are directories and submodules; kinds by pack type.
DIRECTORY, SUBMODULE = 0o040000, 0o160000
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFS_DELTA, REF_DELTA = 6, 7
ZERO = "0" * 40
#: What counts as white space around names and between times and zones (Unicode's White_Space).
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Compressed bytes that are looked at in one go.
_FED = 1 << 16


class Malformed(ValueError):
    """An object, pack or ref that doesn't hold what its format says."""


class Signature(NamedTuple):
    name: str
    email: str
    time: int
    offset_minutes: int


class Commit(NamedTuple):
    tree: str
    parents: list[str]
    author: Signature
    committer: Signature
    summary: str


class Entry(NamedTuple):
    mode: int
    name: bytes
    oid: str


def object_id(kind: str, data: bytes) -> str:
    return hashlib.sha1(b"%s %d\0" % (kind.encode(), len(data)) + data, usedforsecurity=False).hexdigest()


def parse_oid(text: str) -> str | None:
    """40 hex digits in either case as lower case, else None."""
    return text.lower() if re.fullmatch(r"[0-9a-fA-F]{40}", text) else None


def parse_zone(text: str) -> int | None:
    """Minutes of +HHMM or -HHMM."""
    m = re.fullmatch(r"([+-])([0-9]{2})([0-9]{2})", text, re.A)
    return (int(m[2]) * 60 + int(m[3])) * (-1 if m[1] == "-" else 1) if m else None


def parse_signature(line: bytes) -> Signature:
    """``Name <mail> seconds zone``: the last ``<``, the first ``>`` after it; a bad time or zone is 0."""
    text = line.decode("utf-8", "replace")
    name, bracket, rest = text.rpartition("<")
    email, closing, stamp = rest.partition(">")
    if not bracket or not closing:
        raise Malformed("signature without an address")
    words = [w for w in re.split(f"[{BLANK}]", stamp) if w]
    try:
        seconds = int(words[0]) if words and re.fullmatch(r"[+-]?[0-9]+", words[0], re.A) else 0
    except ValueError:
        seconds = 0
    zone = parse_zone(words[1]) if len(words) > 1 else None
    return Signature(name.strip(BLANK), email, seconds if -(2**63) <= seconds < 2**63 else 0, zone or 0)


def parse_commit(data: bytes) -> Commit:
    """Headers up to an empty line, then the message; its first line with text is the summary."""
    head, _, message = data.partition(b"\n\n")
    found: dict[bytes, list[bytes]] = {}
    for line in head.split(b"\n"):
        if not line.startswith(b" "):  # else it continues the header before it
            key, _, value = line.partition(b" ")
            found.setdefault(key, []).append(value)
    oids = lambda key: [o for v in found.get(key, []) if (o := parse_oid(v.decode("ascii", "replace").strip()))]
    if not oids(b"tree") or b"author" not in found:
        raise Malformed("commit without tree or author")
    author = parse_signature(found[b"author"][-1])
    committer = parse_signature(found[b"committer"][-1]) if b"committer" in found else author
    lines = (x.strip() for x in message.decode("utf-8", "replace").splitlines())
    return Commit(oids(b"tree")[-1], oids(b"parent"), author, committer, next((x for x in lines if x), ""))


def parse_tree(data: bytes) -> list[Entry]:
    out, at = [], 0
    while at < len(data):
        blank, end = data.find(b" ", at), data.find(b"\0", at)
        if not at < blank < end or end + 21 > len(data) or not re.fullmatch(rb"[0-7]+", data[at:blank]):
            raise Malformed(f"tree entry at {at}")
        out.append(Entry(int(data[at:blank], 8), data[blank + 1 : end], data[end + 1 : end + 21].hex()))
        at = end + 21
    return out


def parse_loose(raw: bytes) -> tuple[str, bytes]:
    """(kind, data) of an inflated loose object."""
    head, nul, data = raw.partition(b"\0")
    kind, blank, size = head.partition(b" ")
    if not nul or not blank or kind.decode("ascii", "replace") not in KINDS.values() or not size.isdigit() or int(size) != len(data):
        raise Malformed("header of a loose object")
    return kind.decode(), data


def inflate(raw, size: int | None = None, at: int = 0) -> tuple[bytes, int]:
    """(contents, bytes read) of the zlib stream that begins at a place of raw (bytes or a mapped file); raw may go on after it."""
    stream, parts, read, end = zlib.decompressobj(), [], 0, at
    try:
        while not stream.eof and end < len(raw):
            part = raw[end : end + _FED]
            end += len(part)
            parts.append(stream.decompress(part))
            read += len(parts[-1])
            if size is not None and read > size:
                break
    except zlib.error as e:
        raise Malformed(f"zlib stream: {e}") from e
    if size is not None and (read > size or stream.eof and read < size):
        raise Malformed(f"zlib stream of other than {size} bytes")
    if not stream.eof:
        raise Malformed("zlib stream ends early")
    return b"".join(parts), end - at - len(stream.unused_data)


def adler32(data: bytes) -> int:
    return zlib.adler32(data)


def read_size(data: bytes, at: int) -> tuple[int, int]:
    """(number, next place) of a little-endian base-128 number."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Malformed("size in a delta")
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base."""
    expected, at = read_size(delta, 0)
    size, at = read_size(delta, at)
    if expected != len(base):
        raise Malformed("delta for another base")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            fields = []
            for bit in range(7):  # four bytes of offset, three of length, those that are there
                if op >> bit & 1:
                    if at >= len(delta):
                        raise Malformed("copy in a delta is cut off")
                    fields.append(delta[at])
                    at += 1
                else:
                    fields.append(0)
            start, n = int.from_bytes(fields[:4], "little"), int.from_bytes(fields[4:], "little") or 0x10000
            if start + n > len(base):
                raise Malformed("copy past the base")
            out += base[start : start + n]
        elif op:
            if at + op > len(delta):
                raise Malformed("insert in a delta is cut off")
            out += delta[at : at + op]
            at += op
        else:
            raise Malformed("reserved instruction in a delta")
    if len(out) != size:
        raise Malformed("delta gives another size")
    return bytes(out)


def signature_column(line: Column) -> Column:
    """``parse_signature`` over a column: a struct, null where there is no address."""
    rest = F.substring_index(line, "<", -1)  # after the last <; the whole where there is none
    email = F.substring_index(rest, ">", 1)
    stamp = F.substring(rest, F.length(email) + 2, F.length(rest))
    words = F.filter(F.split(stamp, f"[{BLANK}]"), lambda w: w != "")
    seconds, zone = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    signed = F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes)
    name = F.substring(line, F.lit(1), F.length(line) - F.length(rest) - 1)
    zero = F.lit(0).cast("long")
    found = F.struct(
        F.regexp_replace(name, rf"\A[{BLANK}]+|[{BLANK}]+\z", "").alias("name"),
        email.alias("email"),
        F.coalesce(F.when(F.regexp(seconds, F.lit(r"\A[+-]?[0-9]+\z")), seconds.try_cast("long")), zero).alias("time"),
        F.coalesce(F.when(F.regexp(zone, F.lit(r"\A[+-][0-9]{4}\z")), signed), F.lit(0)).cast("int").alias("offset_minutes"),
    )
    return F.when(F.contains(line, F.lit("<")) & F.contains(rest, F.lit(">")), found)
