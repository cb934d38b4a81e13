"""Scalar functions of the reports, on Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that are looked at for a NUL, and the levels of severity.
SNIFF = 8000
RED, YELLOW = 0.66, 0.33


def hotspot_score(revisions: Column, lines: Column, most_revisions: Column, most_lines: Column) -> Column:
    """Revisions and log-scaled size, each relative to the greatest; 0 for an empty file."""
    return revisions / most_revisions * F.log(lines + F.lit(1.0)) / F.log(most_lines + F.lit(1.0))


def degree(together: Column, a: Column, b: Column) -> Column:
    """Commits that touch both over commits that touch either."""
    either = a + b - together
    return F.when(either == 0, F.lit(0.0)).otherwise(together / either)


def top_level(path: Column) -> Column:
    """The first segment of a path; '' for a file at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit(""))


def crosses_directories(a: Column, b: Column) -> Column:
    return top_level(a) != top_level(b)


def identity_key(email: Column) -> Column:
    return F.lower(email)


def object_id(kind: Column, data: Column) -> Column:
    """Git's id of an object: SHA-1 of kind, a space, the size, a NUL and the bytes."""
    data = data.cast("binary")
    head = F.concat(kind, F.lit(" "), F.octet_length(data).cast("string"))
    return F.sha1(F.concat(head.cast("binary"), F.lit(bytearray(b"\x00")), data))


def short_id(oid: Column) -> Column:
    return F.substring(oid, 1, 7)


def is_binary(data: Column) -> Column:
    """A NUL among the first bytes."""
    return F.contains(F.substring(data.cast("binary"), 1, SNIFF), F.lit(bytearray(b"\x00")))


def line_count(data: Column) -> Column:
    """Line breaks, and one more for a last line without; 0 for binary and empty contents."""
    data = data.cast("binary")
    text = F.decode(data, "ISO-8859-1")  # a character a byte
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)
    return F.when(is_binary(data) | (F.octet_length(data) == 0), 0).otherwise(lines).cast("long")


def severity(level: Column) -> Column:
    return F.when(level >= RED, "red").when(level >= YELLOW, "yellow").otherwise("green")


def csv_field(text: Column) -> Column:
    """Quoted where a comma, a quote or a line break asks for it, quotes doubled."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.regexp(text, F.lit('[,"\n\r]')), quoted).otherwise(text)


def json_string(text: Column) -> Column:
    """A JSON string: quotes, backslashes and all control characters escaped."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    rare = text
    for c in (*range(8), 11, *range(14, 32)):
        rare = F.replace(rare, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    text = F.when(F.regexp(text, F.lit(r"[\x00-\x1f]")), rare).otherwise(text)
    return F.concat(F.lit('"'), text, F.lit('"'))


def display_path(path: Column) -> Column:
    """A Windows path without its verbatim prefix; a verbatim share keeps its two backslashes."""
    share = F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\")
    return F.when(share != path, share).otherwise(F.regexp_replace(path, r"^\\\\\?\\", ""))
