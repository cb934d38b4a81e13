"""The five reports, DataFrames in and out, and the aggregates that they are made of.

Per-path figures come from one aggregation by (path, author) and its roll-up. The snapshot isn't
hinted: adaptive execution broadcasts it where it is small and joins by a shuffle where it isn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as X
from ..functions.dates import days_since
from .history import History

TOP, MIN_CO, DORMANT_DAYS = 20, 3, 180


def tally_by_author(history: History) -> DataFrame:
    """(path, author_idx): n events and the last one's time; deletions don't count."""
    live = history.changes.filter("kind != 'Deleted'").select("commit_oid", "path")
    live = live.join(history.commits.select("commit_oid", "time", "author_idx"), "commit_oid")
    return live.groupBy("path", "author_idx").agg(F.count("*").alias("n"), F.max("time").alias("last"))


def tally(history: History) -> DataFrame:
    """path: revisions, authors, last_change."""
    return tally_by_author(history).groupBy("path").agg(
        F.sum("n").alias("revisions"), F.count("*").alias("authors"), F.max("last").alias("last_change")
    )


def author_last_seen(history: History) -> DataFrame:
    """author_idx: time of the last kept commit."""
    return history.commits.groupBy("author_idx").agg(F.max("time").alias("last_seen"))


def ownership(by_author: DataFrame) -> DataFrame:
    """path: revisions, authors, main author (most events, then least index), share and bus factor.

    The bus factor is the least number of authors, from the busiest on, who have more than half of
    the events.
    """
    line = Window.partitionBy("path").orderBy(F.desc("n"), "author_idx")
    whole = Window.partitionBy("path")
    ranked = by_author.select(
        "path", "author_idx", "n", F.row_number().over(line).alias("rank"),
        F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("running"),
        F.sum("n").over(whole).alias("revisions"),
    )
    over = F.when(F.expr("running > revisions div 2"), F.col("rank"))
    return ranked.groupBy("path").agg(
        F.max("revisions").alias("revisions"), F.count("*").alias("authors"),
        F.max(F.when(F.col("rank") == 1, F.col("author_idx"))).alias("author_idx"),
        (F.max(F.when(F.col("rank") == 1, F.col("n"))) / F.max("revisions")).alias("main_share"),
        F.coalesce(F.min(over), F.greatest(F.count("*"), F.lit(1))).cast("long").alias("bus_factor"),
    )


def top(frame: DataFrame, order: list, limit: int | None) -> DataFrame:
    return frame if limit is None else frame.orderBy(*order).limit(limit)


def hotspots(history: History, limit: int | None = TOP) -> DataFrame:
    """path, revisions, authors, lines, score, last_change of files that exist: much changed and large first."""
    rows = tally(history).join(history.snapshot.select("path", "lines"), "path")
    most = rows.agg(F.greatest(F.max("revisions"), F.lit(1)).alias("most_r"), F.greatest(F.max("lines"), F.lit(1)).alias("most_l"))
    score = X.hotspot_score(F.col("revisions"), F.col("lines"), F.col("most_r"), F.col("most_l"))
    rows = rows.crossJoin(F.broadcast(most)).select("path", "revisions", "authors", "lines", score.alias("score"), "last_change")  # one row
    return top(rows, [F.desc("score"), "path"], limit)


def owners(history: History, now: int, dormant_days: int = DORMANT_DAYS, limit: int | None = TOP) -> DataFrame:
    """path, revisions, authors, main_author, main_share, bus_factor, owner_silent_days, orphaned of files that exist."""
    rows = ownership(tally_by_author(history).join(history.snapshot.select("path"), "path", "left_semi"))
    rows = rows.join(author_last_seen(history), "author_idx", "left").join(history.authors.select("author_idx", "name"), "author_idx", "left")
    silent = days_since(F.coalesce("last_seen", F.lit(0)), now)
    rows = rows.select(
        "path", "revisions", "authors", F.col("name").alias("main_author"), "main_share", "bus_factor",
        silent.alias("owner_silent_days"), (silent >= dormant_days).alias("orphaned"),
    )
    return top(rows, [F.desc("orphaned"), "bus_factor", F.desc("revisions"), "path"], limit)


def co_changes(history: History) -> DataFrame:
    """(a, b), a before b: commits that touch both. A broad commit doesn't count; so a commit's paths, and its pairs, are few.

    Each commit's paths are gathered in one row and paired there: one shuffle by commit, and no join of the events with themselves.
    """
    narrow = history.commits.filter(~F.col("too_broad")).select("commit_oid")
    touched = history.changes.filter("kind != 'Deleted'").select("commit_oid", "path").join(narrow, "commit_oid", "left_semi")
    paths = touched.groupBy("commit_oid").agg(F.sort_array(F.collect_set("path")).alias("paths")).filter(F.size("paths") > 1)
    after = lambda a, i: F.transform(F.slice("paths", i + 2, F.size("paths")), lambda b: F.struct(a.alias("a"), b.alias("b")))
    pairs = paths.select(F.inline(F.flatten(F.transform("paths", after))))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("co_changes"))


def coupling(history: History, min_co: int = MIN_CO, limit: int | None = TOP) -> DataFrame:
    """a, b, co_changes, revisions_a, revisions_b, degree, crosses_directories of pairs of files that exist."""
    pairs = co_changes(history).filter(F.col("co_changes") >= min_co)
    known = tally(history).join(history.snapshot.select("path"), "path", "left_semi").select("path", "revisions")
    for side in ("a", "b"):
        pairs = pairs.join(known.select(F.col("path").alias(side), F.col("revisions").alias(f"revisions_{side}")), side)
    rows = pairs.select(
        "a", "b", "co_changes", "revisions_a", "revisions_b",
        X.degree(F.col("co_changes"), F.col("revisions_a"), F.col("revisions_b")).alias("degree"),
        X.crosses_directories(F.col("a"), F.col("b")).alias("crosses_directories"),
    )
    return top(rows, [F.desc("degree"), F.desc("co_changes"), "a", "b"], limit)


def age(history: History, now: int, limit: int | None = TOP) -> DataFrame:
    """path, days_since_change, revisions of files that exist, the longest untouched first."""
    rows = tally(history).join(history.snapshot.select("path"), "path", "left_semi")
    rows = rows.select("path", days_since(F.col("last_change"), now).alias("days_since_change"), "revisions")
    return top(rows, [F.desc("days_since_change"), "path"], limit)


def summary(history: History, now: int, dormant_days: int = DORMANT_DAYS) -> DataFrame:
    """One row: commits, authors, files_now, files_ever, lines_now, first_commit, last_commit (epoch), single_author_files, orphaned_files."""
    count = lambda frame, name: frame.agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = history.commits.agg(F.count("*").alias("commits"), zero(F.min("time")).alias("first_commit"), zero(F.max("time")).alias("last_commit"))
    files = history.snapshot.agg(F.count("*").alias("files_now"), zero(F.sum("lines")).alias("lines_now"))
    owned = owners(history, now, dormant_days, limit=None).agg(
        F.count_if(F.col("authors") == 1).alias("single_author_files"), F.count_if("orphaned").alias("orphaned_files")
    )
    for one in (count(history.authors, "authors"), files, count(history.paths_ever, "files_ever"), owned):
        rows = rows.crossJoin(F.broadcast(one))  # one row each
    return rows.select(
        "commits", "authors", "files_now", "files_ever", "lines_now", "first_commit", "last_commit", "single_author_files", "orphaned_files"
    )
