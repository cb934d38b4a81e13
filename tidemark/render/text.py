"""Sinks for report rows on the driver: aligned text, JSON, CSV; colours."""

from __future__ import annotations

import math
import os
import re
import sys
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from ..functions.columns import RED, YELLOW
from ..functions.width import pad, text_width, truncate_start

#: Codes of styles, columns between cells, least width of the column that gives way,
#: columns of a terminal that doesn't say.
STYLES = {"header": "1;4", "dim": "2", "red": "31", "yellow": "33", "green": "32", "cyan": "36"}
GAP, NARROWEST, COLUMNS, FEWEST_COLUMNS = 2, 12, 100, 40


@dataclass(frozen=True)
class Palette:
    on: bool = False

    @staticmethod
    def detect(off: bool) -> Palette:
        """Off on demand or with NO_COLOR; on with CLICOLOR_FORCE other than 0; else on a terminal."""
        if off or os.environ.get("NO_COLOR"):
            return Palette(False)
        return Palette(os.environ.get("CLICOLOR_FORCE", "0") != "0" or sys.stdout.isatty())

    def paint(self, style: str, text: str) -> str:
        return f"\x1b[{STYLES[style]}m{text}\x1b[0m" if self.on else text

    def severity(self, text: str, level: float) -> str:
        return self.paint("red" if level >= RED else "yellow" if level >= YELLOW else "green", text)


def strip_ansi(text: str) -> str:
    """Without escape sequences: CSI ones to their final byte, others to the next letter."""
    return re.sub(r"\x1b(?:\[[^@-~]*[@-~]?|[^\[][^A-Za-z]*[A-Za-z]?|$)", "", text, flags=re.S)


def terminal_columns() -> int:
    said = os.environ.get("COLUMNS", "")
    return int(said) if said.isdigit() and int(said) >= FEWEST_COLUMNS else COLUMNS


def table(header: list[str], right: str, rows: list[list[str]], palette: Palette, flexible: int = 0) -> str:
    """Aligned text; right has an ``r`` for each column aligned right. A too wide table loses the
    start of its flexible column's cells. Without rows nothing, not even a header."""
    if not rows:
        return ""
    widths = [max(text_width(strip_ansi(cell)) for cell in column) for column in zip(header, *rows, strict=True)]
    excess = sum(widths) + GAP * (len(widths) - 1) - terminal_columns()
    if excess > 0:
        widths[flexible] = max(NARROWEST, widths[flexible] - excess)

    def line(cells: list[str], fit: bool) -> str:
        out = []
        for i, (cell, width) in enumerate(zip(cells, widths, strict=True)):
            cell = truncate_start(cell, width) if fit and i == flexible else cell
            hidden = text_width(cell) - text_width(strip_ansi(cell))
            out.append(pad(cell, width + hidden, right[i] == "r"))
        return (" " * GAP).join(out).rstrip()

    return "".join(f"{x}\n" for x in [palette.paint("header", line(header, False)), *(line(r, True) for r in rows)])


def json_text(value, depth: int = 0) -> str:
    """Indented JSON in the order given, numbers with a fraction to four places, others than finite as null."""
    inner, outer = "  " * (depth + 1), "  " * depth
    if isinstance(value, Mapping):
        body = [f"{inner}{_quoted(k)}: {json_text(v, depth + 1)}" for k, v in value.items()]
        text = "{\n" + ",\n".join(body) + f"\n{outer}}}" if body else "{}"
    elif isinstance(value, str):
        text = _quoted(value)
    elif isinstance(value, bool) or value is None:
        text = {True: "true", False: "false", None: "null"}[value]
    elif isinstance(value, float):
        text = f"{value:.4f}" if math.isfinite(value) else "null"
    elif isinstance(value, Iterable):
        body = [inner + json_text(v, depth + 1) for v in value]
        text = "[\n" + ",\n".join(body) + f"\n{outer}]" if body else "[]"
    else:
        text = str(value)
    return text if depth else f"{text}\n"


#: Characters that JSON writes with a backslash and a letter.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _quoted(text: str) -> str:
    return '"' + re.sub(r'["\\\x00-\x1f]', lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


def csv_text(header: list[str], rows: Iterable[Iterable]) -> str:
    def cell(x) -> str:
        text = f"{x:.4f}" if isinstance(x, float) else str(x).lower() if isinstance(x, bool) else str(x)
        return '"' + text.replace('"', '""') + '"' if re.search('[,"\n\r]', text) else text

    return "".join(",".join(map(cell, r)) + "\n" for r in [header, *rows])


def plural(n: int, one: str, many: str) -> str:
    return f"{n} {one if n == 1 else many}"


def percent(part: int, whole: int) -> str:
    return f"{part / whole * 100:.0f}%" if whole else "0%"
