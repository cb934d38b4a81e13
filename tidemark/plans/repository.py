"""History and snapshot of a git repository as DataFrames.

The driver orders the walk: id, parents, author and time of every commit reach it, some 800 bytes
each as Python objects (a million commits take a gigabyte or less); executors decode objects, compare trees level by level and measure files.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.parsing import DIRECTORY, SUBMODULE, Malformed, parse_commit, parse_tree
from ..operators import history as H
from ..operators.lineage import mark, release, written
from ..sources.datasource import read_objects

COMMIT = "oid string, tree string, parents array<string>, author_name string, author_email string, time bigint, offset_minutes int, summary string"
ENTRY = "tree_oid string, pos int, mode int, name binary, segment string, oid string"


def _commits(batches):
    for batch in batches:
        rows = []
        for oid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                c = parse_commit(data)
            except Malformed:
                continue  # counts as unreadable where the walk meets it
            rows.append((oid, c.tree, c.parents, c.author.name, c.author.email, c.author.time, c.author.offset_minutes, c.summary))
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string())
        names = [field.split()[0] for field in COMMIT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _entries(batches):
    for batch in batches:
        rows = []
        for oid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            last = {e.name: (pos, e) for pos, e in enumerate(parse_tree(data))}  # of entries of one name the last counts
            rows += [(oid, pos, e.mode, e.name, e.name.decode("utf-8", "replace"), e.oid) for pos, e in last.values()]
            if not last:
                rows.append((oid, -1, None, None, None, None))  # an empty tree is there all the same
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
        names = [field.split()[0] for field in ENTRY.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def parse_commits(objects: DataFrame) -> DataFrame:
    return objects.filter("kind = 'commit'").select("oid", "data").mapInArrow(_commits, COMMIT)


def parse_trees(objects: DataFrame) -> DataFrame:
    return objects.filter("kind = 'tree'").select("oid", "data").mapInArrow(_entries, ENTRY)


@dataclass(frozen=True)
class Walk:
    rows: list[tuple]  # (oid, walk_seq, author_idx) of kept commits
    authors: list[tuple[int, str, str]]
    #: distinct ids that were referred to and couldn't be read
    unreadable: int


def walk(commits: dict[str, tuple], tip: str, since: int | None, include_merges: bool) -> Walk:
    """Each commit from tip on once, the last parent first; authors are numbered as they are met.

    commits: oid to (parents, name, email, time). An author, keyed by lower-cased e-mail, has the
    first name that isn't empty, else the e-mail.
    """
    stack, seen, missing = [tip], set(), 0
    rows, index, names = [], {}, {}
    while stack:
        oid = stack.pop()
        if oid in seen:
            continue
        seen.add(oid)
        if oid not in commits:
            missing += 1
            continue
        parents, name, email, time = commits[oid]
        stack += parents
        if (since is None or time >= since) and (include_merges or len(parents) < 2):
            who = index.setdefault(email.lower(), len(index))
            names[who] = names.get(who) or name
            rows.append((oid, len(rows), who))
    return Walk(rows, [(i, key, names[i] or key) for key, i in index.items()], missing)


def _is_dir(mode: str):
    return F.col(mode) == DIRECTORY


def tree_changes(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Events of tree pairs (root, old, new; null: no tree): root, path, kind, content_oid.

    A frontier of unequal pairs of folders goes down a level a round: entries of both meet by name
    in a full outer join, equal ones drop out, so only what differs is looked at. A folder that
    exists on both sides must be readable; one that came or went whole is skipped if it isn't.
    """
    known = written(entries.select(F.col("tree_oid").alias("tree")).distinct(), "trees")
    mine = entries.filter("name is not null").select("tree_oid", "name", "segment", "mode", "oid")
    frontier = written(pairs.filter("not (old <=> new)").select("root", F.lit("").alias("prefix"), "old", "new"), "frontier")
    found, key = None, ["root", "prefix", "name", "segment"]
    while frontier.take(1):
        needed = frontier.filter("new is not null and (old is not null or prefix = '')").select(F.explode(F.array_compact(F.array("old", "new"))).alias("tree"))
        if lost := needed.join(known, "tree", "left_anti").take(1):
            raise Malformed(f"tree {lost[0].tree} is missing")
        side = lambda s: frontier.join(mine, F.col(s) == F.col("tree_oid")).select(*key, F.struct("mode", "oid").alias("entry"))
        both = H.diff_entries(side("old"), side("new"), key, "entry")
        both = both.select("root", F.concat("prefix", "segment").alias("path"), *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("old", "new") for c in ("mode", "oid")))
        both = written(both, "level")
        old_dir, new_dir = F.coalesce(_is_dir("old_mode"), F.lit(False)), F.coalesce(_is_dir("new_mode"), F.lit(False))
        file = lambda s: F.col(f"{s}_mode").isNotNull() & ~_is_dir(f"{s}_mode")
        plain = lambda s: file(s) & (F.col(f"{s}_mode") != SUBMODULE)
        event = lambda kind, oid: F.struct(F.lit(kind).alias("kind"), F.col(oid).alias("content_oid"))
        events = F.array_compact(
            F.array(
                # a file on both sides is one event; a submodule now hides what was there before
                F.when(file("old") & plain("new"), event("Modified", "new_oid")),
                F.when(plain("old") & ~file("new"), event("Deleted", "old_oid")),
                F.when(plain("new") & ~file("old"), event("Added", "new_oid")),
            )
        )
        level = both.select("root", "path", F.explode(events).alias("e")).select("root", "path", "e.*")
        found = level if found is None else found.union(level)
        below = F.concat("path", F.lit("/"))
        frontier = both.filter(old_dir | new_dir).select(
            "root", below.alias("prefix"), F.when(old_dir, F.col("old_oid")).alias("old"), F.when(new_dir, F.col("new_oid")).alias("new")
        )
    empty = pairs.sparkSession.createDataFrame([], "root string, path string, kind string, content_oid string")
    return empty if found is None else found


def snapshot(tree: str, entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """path, bytes, lines, is_binary of every file under a tree; files whose blob isn't there are left out."""
    spark = entries.sparkSession
    start = spark.createDataFrame([("", None, tree)], "root string, old string, new string")
    files = tree_changes(start, entries).select("path", F.col("content_oid").alias("oid"))
    data = blobs.filter("kind = 'blob'").select("oid", "data")
    return files.join(data, "oid").select(
        "path", F.octet_length("data").cast("long").alias("bytes"), X.line_count(F.col("data")).alias("lines"), X.is_binary(F.col("data")).alias("is_binary")
    )


def read_history(spark: SparkSession, path: str, tip: str, since: int | None = None, include_merges: bool = False, broad: int = H.BROAD) -> H.History:
    """History from a commit on, and the files at it.

    Of the tables written on the way those that the result reads stay in the shared folder, until
    ``lineage.release`` is called.
    """
    began = mark()
    commits = written(parse_commits(read_objects(spark, path, "commit")), "commits")
    entries = written(parse_trees(read_objects(spark, path, "tree")), "entries")
    known = {r.oid: (r.parents, r.author_name, r.author_email, r.time) for r in commits.select("oid", "parents", "author_name", "author_email", "time").toLocalIterator()}
    walked = walk(known, tip, since, include_merges)
    order = spark.createDataFrame(walked.rows, "oid string, walk_seq bigint, author_idx bigint")
    kept = commits.join(order, "oid")
    kept = H.with_first_parent(kept, commits)
    kept = kept.withColumn("root", F.concat_ws(":", F.coalesce("old", F.lit("")), "new"))
    kept = written(kept, "kept")
    events = tree_changes(kept.select("root", "old", "new").distinct(), entries)
    raw = written(kept.select(F.col("oid").alias("commit_oid"), "root").join(events, "root").drop("root"), "events")
    changes = written(H.collapse_renames(raw), "changes")
    rows = kept.select(
        F.col("oid").alias("commit_oid"), "time", "author_idx", (F.size("parents") > 1).alias("is_merge"), "summary", "walk_seq"
    )
    tree = [r.tree for r in commits.filter(F.col("oid") == tip).select("tree").collect()]
    if not tree:
        raise Malformed(f"commit {tip} is missing")
    history = H.History(
        commits=written(H.mark_broad(rows, changes, broad), "history"),
        changes=changes,
        authors=spark.createDataFrame(walked.authors, "author_idx bigint, email string, name string"),
        snapshot=written(snapshot(tree[0], entries, read_objects(spark, path, "blob")), "snapshot"),
        paths_ever=raw.select("path").distinct(),
        unreadable=walked.unreadable,
    )
    release(spark, began, keep=("history", "changes", "snapshot", "events"))
    return history


def rehash(objects: DataFrame) -> DataFrame:
    """oid, actual: the id that an object is filed under, and the one that its contents have."""
    return objects.select("oid", X.object_id(F.col("kind"), F.col("data")).alias("actual"))


def mismatches(ids: DataFrame) -> DataFrame:
    return ids.filter("oid != actual")


def verify(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(objects, those whose contents hash to another id: oid, actual), loose and packed ones alike."""
    ids = written(rehash(read_objects(spark, path)), "ids")
    return ids.count(), mismatches(ids)
