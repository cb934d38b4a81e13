"""Path globs, matched on the bytes of a path.

``?`` is one byte but ``/``; ``*`` any run without ``/``; ``**`` any run; ``**/`` also any run,
the empty one and one that doesn't end at a slash included. Nothing else is special. A pattern
without ``/`` is tried on the last segment too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each wild card becomes in a regular expression over Latin-1 text.
_WILD = {"**/": ".*", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def to_regex(pattern: str) -> str:
    """An anchored expression, for Java and Python, over the pattern's bytes read as Latin-1."""
    raw = pattern.encode("utf-8").decode("latin-1")
    quoted = lambda s: "".join(c if c.isalnum() and c.isascii() or c in "/_" else f"\\x{ord(c):02x}" for c in s)
    body = "".join(_WILD.get(piece) or quoted(piece) for piece in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", raw))
    return rf"(?s)\A{body}\z"


def matches(pattern: str, path: str) -> bool:
    rule = re.compile(to_regex(pattern).replace(r"\z", r"\Z"))
    raw = path.encode("utf-8").decode("latin-1")
    return bool(rule.match(raw)) or "/" not in pattern and bool(rule.match(raw.rpartition("/")[2]))


def matches_column(pattern: str, path: Column) -> Column:
    raw = F.decode(F.encode(path, "UTF-8"), "ISO-8859-1")
    rule = F.lit(to_regex(pattern))
    found = F.regexp(raw, rule)
    return found if "/" in pattern else found | F.regexp(F.substring_index(raw, "/", -1), rule)
