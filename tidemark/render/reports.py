"""The reports as text: each takes collected rows (at most as many as were asked for)."""

from __future__ import annotations

from ..functions.dates import DAY, civil, humanise_days
from .text import Palette, csv_text, json_text, percent, plural, table

#: Names and order of the columns in JSON and CSV.
COLUMNS = {
    "hotspots": ["path", "revisions", "authors", "lines", "score", "last_change"],
    "owners": ["path", "revisions", "authors", "main_author", "main_share", "bus_factor", "owner_silent_days", "orphaned"],
    "coupling": ["a", "b", "co_changes", "revisions_a", "revisions_b", "degree", "crosses_directories"],
    "age": ["path", "days_since_change", "revisions"],
}


def _plain(report: str, rows: list) -> list[dict]:
    out = [{c: r[c] for c in COLUMNS[report]} for r in rows]
    for r in out:
        if "last_change" in r:
            r["last_change"] = civil(r["last_change"])
    return out


def _hotspots(rows, palette, args):
    cells = [[r.path, palette.severity(f"{r.score:.2f}", r.score), str(r.revisions), str(r.lines), str(r.authors), civil(r.last_change)] for r in rows]
    return table(["path", "heat", "commits", "size", "people", "latest"], "lrrrrr", cells, palette), "heat 1.00: most commits and most lines of all files"


def _owners(rows, palette, args):
    silent = lambda r: palette.paint("yellow", humanise_days(r.owner_silent_days)) if r.orphaned else humanise_days(r.owner_silent_days)
    half = lambda r: palette.paint("red", "1") if r.bus_factor == 1 else str(r.bus_factor)
    cells = [[r.path, r.main_author, f"{r.main_share * 100:.0f}%", half(r), str(r.authors), str(r.revisions), silent(r)] for r in rows]
    note = f"half: how few people made over half of the commits; gone ({args.dormant_days} silent days): {sum(r.orphaned for r in rows)} of these {len(rows)} owners"
    return table(["path", "owner", "made", "half", "people", "commits", "silent for"], "llrrrrr", cells, palette), note


def _coupling(rows, palette, args):
    cells = [
        [r.a, r.b, palette.severity(f"{r.degree * 100:.0f}%", r.degree), f"{r.co_changes} of {r.revisions_a + r.revisions_b - r.co_changes}",
         palette.paint("cyan", "apart") if r.crosses_directories else ""]
        for r in rows
    ]
    return table(["path", "and", "shared", "commits", ""], "llrrl", cells, palette), "apart: their top folders differ"


def _age(rows, palette, args):
    cells = [[r.path, str(r.days_since_change), humanise_days(r.days_since_change), str(r.revisions)] for r in rows]
    return table(["path", "days", "that is", "commits"], "lrrr", cells, palette), "days without a commit, up to now"


_TABLES = {"hotspots": _hotspots, "owners": _owners, "coupling": _coupling, "age": _age}


def render(report: str, rows: list, args, palette: Palette) -> str:
    if args.format == "json":
        return json_text(_plain(report, rows))
    if args.format == "csv":
        return csv_text(COLUMNS[report], (r.values() for r in _plain(report, rows)))
    if not rows:
        return f"{report}: no rows" + (f" (--min-co is {args.min_co})\n" if report == "coupling" else "\n")
    body, note = _TABLES[report](rows, palette, args)
    return f"{body}\n{palette.paint('dim', note)}\n"


def render_summary(row, name: str, head: str, shallow: bool, args) -> str:
    """JSON on demand; otherwise text, for CSV too."""
    dates = {"first_commit": civil(row.first_commit), "last_commit": civil(row.last_commit)}
    if args.format == "json":
        return json_text({"head": head, "shallow": shallow} | row.asDict() | dates)
    days = max(row.last_commit - row.first_commit, 0) // DAY
    lines = [
        ("repository", name), ("at", head), ("commits", f"{row.commits}, {dates['first_commit']} to {dates['last_commit']} ({plural(days, 'day', 'days')})"),
        ("people", str(row.authors)), ("files", f"{row.files_now} of {row.files_ever} that ever were"), ("lines", str(row.lines_now)),
        ("by one person", f"{row.single_author_files} files, {percent(row.single_author_files, row.files_now)}"),
        ("owner gone", f"{row.orphaned_files} files, by {args.dormant_days} silent days"),
    ]
    return "".join(f"{key:<14}{value}\n" for key, value in lines)
