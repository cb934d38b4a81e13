"""Dates of the command line and of reports: UTC, whole days, proleptic Gregorian."""

from __future__ import annotations

import datetime
import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
#: Days that each unit of an offset stands for.
UNIT_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}


def now() -> int:
    """Seconds since the epoch; reports take it as a parameter, so that they can be repeated."""
    return int(time.time())


def to_epoch(year: int, month: int, day: int) -> int:
    """Start of a day; a day past the month's end runs on into the next month."""
    shift, year = divmod(year - 1, 400)  # the calendar repeats after 400 years; any year works
    first = datetime.date(year + 1, month, 1).toordinal() - datetime.date(1970, 1, 1).toordinal()
    return (first + day - 1 + shift * 146_097) * DAY


def civil(seconds: int) -> str:
    """YYYY-MM-DD of an instant, before 1970 too."""
    eras, days = divmod(seconds // DAY + datetime.date(1970, 1, 1).toordinal() - 1, 146_097)
    date = datetime.date.fromordinal(days + 1)
    return f"{date.year + 400 * eras:04d}-{date.month:02d}-{date.day:02d}"


def iso_seconds(seconds: int) -> str:
    rest = seconds % DAY
    return f"{civil(seconds)}T{rest // 3600:02d}:{rest // 60 % 60:02d}:{rest % 60:02d}Z"


def parse_since(text: str, at: int) -> int | None:
    """Epoch of ``2024-08-29`` or of an offset back from ``at`` like 30d, 6w, 3m, 1y; None if it is neither."""
    text = text.strip()
    if m := re.fullmatch(r"\+?([0-9]+)([dwmy])", text, re.A):
        return at - int(m[1]) * UNIT_DAYS[m[2]] * DAY
    if m := re.fullmatch(r"(\+?[0-9]+)-(\+?[0-9]+)-(\+?[0-9]+)", text, re.A):
        year, month, day = map(int, m.groups())
        if 1 <= month <= 12 and 1 <= day <= 31:
            return to_epoch(year, month, day)
    return None


def humanise_days(days: int) -> str:
    if days < 0:
        return "in the future"
    if days < 2:
        return ("today", "1 day")[days]
    if days < 60:
        return f"{days} days"
    if days < 730:
        return f"{int(days / 30.44 + 0.5)} months"
    return f"{days / 365.25:.1f} years"


def date_column(seconds: Column) -> Column:
    """YYYY-MM-DD of epoch seconds; floors, so instants before 1970 are right too."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / DAY).cast("int")), "yyyy-MM-dd")


def iso_column(seconds: Column) -> Column:
    return F.concat(date_column(seconds), F.date_format(F.timestamp_seconds(seconds), "'T'HH:mm:ss'Z'"))


def days_since(seconds: Column, at: int) -> Column:
    """Whole days from an instant to ``at``; 0 for later instants."""
    return F.floor(F.greatest(F.lit(at) - seconds, F.lit(0)) / DAY).cast("long")


def humanise_column(days: Column) -> Column:
    return (
        F.when(days < 0, "in the future").when(days == 0, "today").when(days == 1, "1 day")
        .when(days < 60, F.concat(days.cast("string"), F.lit(" days")))
        .when(days < 730, F.concat(F.floor(days / 30.44 + 0.5).cast("string"), F.lit(" months")))
        .otherwise(F.concat(F.format_string("%.1f", days / 365.25), F.lit(" years")))
    )


def since_column(text: Column, at: int) -> Column:
    """``parse_since`` over a column; null where the text is neither date nor offset."""
    text = F.trim(text)
    offset = F.regexp_extract(text, r"^\+?([0-9]{1,9})([dwmy])$", 1).try_cast("long")
    unit = F.substring(text, -1, 1)
    days = F.coalesce(*(F.when(unit == u, F.lit(n)) for u, n in UNIT_DAYS.items()))
    parts = [F.regexp_extract(text, r"^([0-9]{1,4})-([0-9]{1,2})-([0-9]{1,2})$", k).try_cast("int") for k in (1, 2, 3)]
    fits = parts[1].between(1, 12) & parts[2].between(1, 31)
    first = F.make_date(F.when(fits, parts[0]), F.when(fits, parts[1]), F.when(fits, F.lit(1)))
    return F.coalesce(F.lit(at) - offset * days * DAY, (F.unix_date(first) + parts[2] - 1).cast("long") * DAY)
