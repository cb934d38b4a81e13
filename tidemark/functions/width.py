"""Columns that text takes in a terminal: a subset of Unicode's East Asian Width."""

from __future__ import annotations

import bisect

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that take no column (first, last): controls, combining marks,
#: zero-width and formatting characters, variation selectors.
ZERO = [
    (0x0000, 0x001F), (0x007F, 0x009F), (0x0300, 0x036F), (0x0483, 0x0489), (0x0591, 0x05BD), (0x0610, 0x061A),
    (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC), (0x0E31, 0x0E31), (0x0E34, 0x0E3A), (0x0E47, 0x0E4E),
    (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x200B, 0x200F), (0x2028, 0x202E), (0x20D0, 0x20F0), (0xFE00, 0xFE0F),
    (0xFE20, 0xFE2F), (0xFEFF, 0xFEFF), (0xE0100, 0xE01EF),
]
#: Code points that take two columns (first, last): East Asian wide and
#: full-width forms, and the emoji blocks.
WIDE = [
    (0x1100, 0x115F), (0x2E80, 0x303E), (0x3041, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF),
    (0xA960, 0xA97F), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE10, 0xFE19), (0xFE30, 0xFE6F), (0xFF00, 0xFF60),
    (0xFFE0, 0xFFE6), (0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF),
    (0x20000, 0x2FFFD), (0x30000, 0x3FFFD),
]
ELLIPSIS = "…"


def _within(ranges: list[tuple[int, int]], code: int) -> bool:
    at = bisect.bisect_right(ranges, (code, 0x110000)) - 1
    return at >= 0 and code <= ranges[at][1]


def char_width(c: str) -> int:
    return 0 if _within(ZERO, ord(c)) else 2 if _within(WIDE, ord(c)) else 1


def text_width(text: str) -> int:
    return sum(map(char_width, text))


def truncate_start(text: str, columns: int) -> str:
    """The end of text after an ellipsis, in at most so many columns; 0 columns leave it whole."""
    if not columns or text_width(text) <= columns:
        return text
    left, at = columns - 1, len(text)
    while columns > 1 and at and char_width(text[at - 1]) <= left:
        at -= 1
        left -= char_width(text[at])
    return ELLIPSIS + text[at:]


def pad(text: str, columns: int, right: bool = False) -> str:
    fill = " " * max(0, columns - text_width(text))
    return fill + text if right else text + fill


def width_column(text: Column) -> Column:
    """Columns of a text: its characters, less those of no width, and the wide ones once more."""
    members = lambda ranges: "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    shown = F.regexp_replace(text, f"[{members(ZERO)}]", "")
    wide = F.regexp_replace(text, f"[^{members(WIDE)}]", "")
    return (F.length(shown) + F.length(wide)).cast("long")
