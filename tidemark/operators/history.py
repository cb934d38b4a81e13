"""Change events from commits and trees: renames, broad commits, filters.

The frames (every function takes and gives those it names):

commits   commit_oid, time, author_idx, is_merge, too_broad, ... one row a commit
changes   commit_oid, path, kind (Added, Modified, Deleted, Renamed), content_oid
authors   author_idx, email, name
snapshot  path, bytes, lines, is_binary: the files at the tip
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.globs import matches_column

#: Commits that touch more files than this say nothing of coupling.
BROAD = 50


@dataclass(frozen=True)
class History:
    commits: DataFrame
    changes: DataFrame
    authors: DataFrame
    snapshot: DataFrame
    #: every path that any kept commit touched, rename sources included; not narrowed by restrict
    paths_ever: DataFrame
    #: commits that are referred to but can't be read
    unreadable: int = 0


def keep_commits(commits: DataFrame, since: int | None = None, include_merges: bool = False) -> DataFrame:
    """The commits that count: not before ``since`` (author time), merges only on demand."""
    if since is not None:
        commits = commits.filter(F.col("time") >= since)
    return commits if include_merges else commits.filter(~F.col("is_merge"))


def collapse_renames(changes: DataFrame) -> DataFrame:
    """Within a commit an added and a deleted file of one content are one Renamed event at the new path.

    The n-th deletion (by path) meets the n-th addition (by path) of the same content; each is used once.
    """
    one = Window.partitionBy("commit_oid", "content_oid", "kind").orderBy("path")
    ranked = changes.withColumn("rn", F.when(F.col("kind").isin("Added", "Deleted"), F.row_number().over(one)))
    # of one (commit, content, rn) at most one Added and one Deleted: they pair off
    pair = Window.partitionBy("commit_oid", "content_oid", "rn")
    both = F.col("rn").isNotNull() & (F.size(F.collect_set("kind").over(pair)) == 2)
    kind = F.when(both & (F.col("kind") == "Added"), "Renamed").otherwise(F.col("kind"))
    gone = both & (F.col("kind") == "Deleted")
    return ranked.select("commit_oid", "path", kind.alias("kind"), "content_oid", gone.alias("gone")).filter("not gone").drop("gone")


def mark_broad(commits: DataFrame, changes: DataFrame, most: int = BROAD) -> DataFrame:
    """commits with too_broad: more than ``most`` events, deletions included."""
    broad = changes.groupBy("commit_oid").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    broad = broad.select("commit_oid", F.lit(True).alias("too_broad"))
    return commits.drop("too_broad").join(broad, "commit_oid", "left").fillna(False, ["too_broad"])


def restrict(history: History, pattern: str) -> History:
    """Events and files whose path matches a glob; commits left without events go. Authors and paths_ever stay."""
    changes = history.changes.filter(matches_column(pattern, F.col("path")))
    return replace(
        history,
        changes=changes,
        commits=history.commits.join(changes.select("commit_oid"), "commit_oid", "left_semi"),
        snapshot=history.snapshot.filter(matches_column(pattern, F.col("path"))),
    )


def diff_entries(before: DataFrame, after: DataFrame, key: list[str], content: str) -> DataFrame:
    """Full outer comparison of two listings: key columns, old, new, kind (Added, Deleted, Modified); equal entries are left out."""
    old = before.select(*key, F.col(content).alias("old"))
    new = after.select(*key, F.col(content).alias("new"))
    kind = F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Deleted").otherwise("Modified")
    both = old.join(new, key, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.withColumn("kind", kind)


def with_first_parent(commits: DataFrame, known: DataFrame) -> DataFrame:
    """commits (oid, parents, tree) with old, the tree of the first parent among known, and new, their own.

    A root commit and one whose first parent is missing have no old tree: all of their files are new.
    """
    parents = known.select(F.col("oid").alias("first"), F.col("tree").alias("old"))
    return commits.withColumn("first", F.get("parents", F.lit(0))).join(parents, "first", "left").withColumnRenamed("tree", "new")
