"""Queries over a git repository that is written from the given tables, each with SQL over those tables.

Every nation is a commit, in order of its key, by its region: it adds a file of the nation and a line
to README.md. Some files are moved or deleted later; there is a branch of one commit, and a merge of
it. The first commit's parent is missing, one object is damaged. Objects lie loose and in two packs
(README.md as a chain of deltas), some in both. The tables have 25 nations and 5 regions at any scale.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import reports as R
from ..operators.lineage import shared_dir
from ..sources import datasource as D
from ..sources import gitdir
from ..sources.gitwriter import Writer
from . import repository as P
from .testdata import _AGE, _COUPLED, _HOT, _OWNED, _PAIRS, _REPORT, NOW, query, table

#: Fixed values of the fixture: time of the first commit and between two, the branch, ids that name nothing right.
START, STEP, FORK = 980_000_000, 864_000, 10
MISSING, DAMAGED = "a" * 40, "d" * 40
_built: dict[tuple[str, str], str] = {}
_read: dict[tuple[str, bool], H.History] = {}


def moved(j: int) -> bool:
    return j % 7 == 5


def dropped(j: int) -> bool:
    return j % 5 == 0 and not moved(j)


def build(folder: str, nations: list[tuple[int, str, str, str]]) -> None:
    """nations: key, name, a line, name of the region; keys count from 0."""
    w, readme, versions, commits, trees = Writer(folder), "", [], [], []
    blobs = [w.blob(f"{line}\n" * (k + 1)) for k, _, line, _ in nations]
    for k, name, _, region in nations:
        readme += f"nation {name}\n"
        versions.append(w.blob(readme))
        files = {"README.md": versions[-1]}
        for j, other, _, place in nations[: k + 1]:
            if not (dropped(j) and k >= j + 4):
                files[f"{place}/old/{other}.txt" if moved(j) and k > j else f"{place}/{other}.txt"] = blobs[j]
        trees.append(files)
        parents = commits[-1:] or [MISSING]
        commits.append(w.commit(w.files(files), parents, region, f"{region}@Example.org", START + k * STEP, f"add {name}"))
    side = {"side.txt": w.blob("side work\n")}
    last = START + len(nations) * STEP
    commits.append(w.commit(w.files(trees[FORK] | side), [commits[FORK]], "Side", "side@example.org", last, "side"))
    commits.append(w.commit(w.files(trees[-1] | side), commits[-2:], "Side", "SIDE@example.org", last + STEP, "merge"))
    w.pack(versions, dict(zip(versions[1:], versions)), keep=3)
    w.pack([*commits[:-1], *blobs[:9]], {blobs[2]: blobs[1]}, by_id=True, far=True)
    w.put("blob", b"damaged\n", DAMAGED)
    tags = "".join(f"{commits[k]} refs/tags/{name}\n" for k, name, _, _ in nations)
    w.file("packed-refs", f"# pack-refs with: peeled\n{commits[0]} refs/heads/main\n{tags}^{commits[1]}\n")
    w.file("refs/heads/main", f"{commits[-1]}\n")
    w.file("shallow", f"{commits[0]}\n")


def repository(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the repository, written once a session into the shared folder (a file system's)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built or not os.path.isdir(_built[key]):
        place = shared_dir(spark).removeprefix("file://").removeprefix("file:")
        if not place.startswith("/"):
            raise ValueError("objects are read through the file system: spark.checkpoint.dir must be on one")
        rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = rows.select("n_nationkey", "n_name", F.concat("n_name", F.lit(" in "), "r_name"), "r_name").orderBy("n_nationkey").collect()  # 25 rows
        folder = os.path.join(place, f"repository-{uuid.uuid4().hex}")
        build(folder, [tuple(r) for r in rows])
        _built[key] = folder
    return _built[key]


def history(spark: SparkSession, sf_dir: str, merges: bool = False) -> H.History:
    folder = repository(spark, sf_dir)
    if (folder, merges) not in _read:
        _read[folder, merges] = P.read_history(spark, folder, gitdir.Repository.discover(folder).head.oid, include_merges=merges)
    return _read[folder, merges]


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_commits(D.read_objects(spark, repository(spark, sf_dir), "commit"))


# ------------------------------------------------------------------------ SQL

_MOVED, _DROPPED = "k % 7 = 5", "(k % 5 = 0 AND k % 7 <> 5)"
_TABLES = f"""WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name, n_name || ' in ' || r_name AS line, r_name, (SELECT CAST(max(n_nationkey) AS BIGINT) FROM nation) AS top FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT *, r_name || '/' || n_name || '.txt' AS first_path, r_name || CASE WHEN {_MOVED} THEN '/old/' ELSE '/' END || n_name || '.txt' AS last_path, repeat(line || chr(10), CAST(k + 1 AS INTEGER)) AS content FROM n),
readme AS (SELECT n.k, string_agg('nation ' || m.n_name || chr(10), '' ORDER BY m.k) AS content FROM n JOIN n m ON m.k <= n.k GROUP BY 1),
c AS (SELECT k AS commit_oid, {START} + k * {STEP} AS time, r_name AS name, lower(r_name) || '@example.org' AS email, 'add ' || n_name AS summary, FALSE AS is_merge,
    CASE WHEN k <= {FORK} THEN {FORK} + 1 - k ELSE {FORK} + 2 + top - k END AS seq, k - 1 AS parent FROM n
  UNION ALL SELECT max(k) + 1, {START} + (max(k) + 1) * {STEP}, 'Side', 'side@example.org', 'side', FALSE, 0, {FORK} FROM n
  UNION ALL SELECT max(k) + 2, {START} + (max(k) + 2) * {STEP}, 'Side', 'side@example.org', 'merge', TRUE, -1, max(k) FROM n),
events AS (SELECT k AS commit_oid, first_path AS path, 'Added' AS kind FROM f
  UNION ALL SELECT k, 'README.md', CASE WHEN k = 0 THEN 'Added' ELSE 'Modified' END FROM n
  UNION ALL SELECT k + 1, last_path, 'Renamed' FROM f WHERE {_MOVED} AND k < top
  UNION ALL SELECT k + 4, first_path, 'Deleted' FROM f WHERE {_DROPPED} AND k + 4 <= top
  UNION ALL SELECT max(k) + 1, 'side.txt', 'Added' FROM n UNION ALL SELECT max(k) + 2, 'side.txt', 'Added' FROM n),
blobs AS (SELECT content FROM f UNION SELECT content FROM readme UNION SELECT 'side work' || chr(10)),
snap AS (SELECT CASE WHEN {_MOVED} AND k < top THEN last_path ELSE first_path END AS path, content FROM f WHERE NOT ({_DROPPED} AND k + 4 <= top)
  UNION ALL SELECT 'README.md', arg_max(content, k) FROM readme UNION ALL SELECT 'side.txt', 'side work' || chr(10))"""


def _base(keep: str = "NOT is_merge") -> str:
    base = _TABLES.replace("snap AS (", "snapshot AS (")
    return f"""{base},
customer AS (SELECT email, arg_min(name, seq) AS c_name, row_number() OVER (ORDER BY min(seq)) - 1 AS c_custkey FROM c WHERE {keep} GROUP BY 1),
kept AS (SELECT commit_oid, time, c_custkey AS author_idx, is_merge FROM c JOIN customer USING (email) WHERE {keep}),
changes AS (SELECT * FROM events WHERE commit_oid IN (SELECT commit_oid FROM kept)),
snap AS (SELECT path, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS lines FROM snapshot),
broad AS (SELECT commit_oid FROM changes GROUP BY 1 HAVING count(*) > {H.BROAD}),
ta AS (SELECT path, author_idx, count(*) AS n, max(time) AS last FROM changes JOIN kept USING (commit_oid) WHERE kind <> 'Deleted' GROUP BY 1, 2),
tally AS (SELECT path, CAST(sum(n) AS BIGINT) AS revisions, count(*) AS authors, max(last) AS last_change FROM ta GROUP BY 1),
"""


_OID = "sha1('blob ' || strlen(content) || chr(0) || content)"

query("git_hotspots", _base() + _HOT)(lambda s, d: R.hotspots(history(s, d), limit=None))
query("git_hotspots_with_merges", _base("TRUE") + _HOT)(lambda s, d: R.hotspots(history(s, d, True), limit=None))
query("git_owners", _base() + _OWNED + _REPORT)(lambda s, d: R.owners(history(s, d), NOW, limit=None))
query("git_coupling", _base() + _PAIRS + _COUPLED)(lambda s, d: R.coupling(history(s, d), min_co=2, limit=None))
query("git_age", _base() + "z AS (SELECT 1) " + _AGE)(lambda s, d: R.age(history(s, d), NOW, limit=None))
query(
    "git_summary",
    _base() + _OWNED + f""", report2 AS ({_REPORT})
SELECT (SELECT count(*) FROM kept) AS commits, (SELECT count(*) FROM customer) AS authors, (SELECT count(*) FROM snap) AS files_now,
  (SELECT count(DISTINCT path) FROM (SELECT path FROM changes UNION ALL SELECT first_path FROM f)) AS files_ever, (SELECT CAST(sum(lines) AS BIGINT) FROM snap) AS lines_now,
  (SELECT min(time) FROM kept) AS first_commit, (SELECT max(time) FROM kept) AS last_commit,
  (SELECT count(*) FROM report2 WHERE authors = 1) AS single_author_files, (SELECT count(*) FROM report2 WHERE orphaned) AS orphaned_files""",
)(lambda s, d: R.summary(history(s, d), NOW))
query("git_tree_changes", _TABLES + " SELECT summary, path, kind FROM events JOIN c USING (commit_oid)")(
    lambda s, d: (h := history(s, d, True)).changes.join(h.commits, "commit_oid").select("summary", "path", "kind")
)
query("git_commits", _base() + "z AS (SELECT 1) SELECT summary, c.time, email, c_custkey AS author_idx, seq AS walk_seq FROM c JOIN customer USING (email) WHERE NOT is_merge")(
    lambda s, d: (h := history(s, d)).commits.join(h.authors, "author_idx").select("summary", "time", "email", "author_idx", "walk_seq")
)
query(
    "git_snapshot",
    _TABLES + " SELECT path, CAST(strlen(content) AS BIGINT) AS bytes, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS lines, FALSE AS is_binary FROM snap",
)(lambda s, d: history(s, d).snapshot)
query("git_blobs", _TABLES + f" SELECT {_OID} AS oid, CAST(strlen(content) AS BIGINT) AS size, sha1(content) AS digest FROM blobs UNION ALL SELECT '{DAMAGED}', 8, sha1('damaged' || chr(10))")(
    lambda s, d: D.read_objects(s, repository(s, d), "blob").select("oid", "size", F.sha1("data").alias("digest"))
)
query("git_verify", f"SELECT '{DAMAGED}' AS oid, sha1('blob 8' || chr(0) || 'damaged' || chr(10)) AS actual")(lambda s, d: P.verify(s, repository(s, d))[1])
query("git_existing", _TABLES + f" SELECT {_OID} AS oid FROM blobs")(
    lambda s, d: D.existing(
        P.rehash(D.read_objects(s, repository(s, d), "blob").filter(F.col("oid") != DAMAGED)).select("oid").union(s.sql(f"SELECT '{MISSING}' AS oid")), s, repository(s, d)
    )
)
query("git_refs", _TABLES + " SELECT 'refs/tags/' || n_name AS name, 'add ' || n_name AS summary FROM n UNION ALL SELECT 'refs/heads/main', 'merge'")(
    lambda s, d: s.createDataFrame(gitdir.all_refs(gitdir.Repository.discover(repository(s, d)).git_dir), "name string, oid string").join(commits(s, d), "oid").select("name", "summary")
)
query("git_first_parents", _TABLES + " SELECT c.summary, p.summary AS first FROM c LEFT JOIN c p ON c.parent = p.commit_oid")(
    lambda s, d: H.with_first_parent(commits(s, d), known := commits(s, d)).select("summary", F.col("first").alias("oid"))
    .join(known.select("oid", F.col("summary").alias("first")), "oid", "left").select("summary", "first")
)
query("git_unreadable", "SELECT CAST(1 AS BIGINT) AS unreadable, TRUE AS shallow")(
    lambda s, d: s.createDataFrame([(history(s, d).unreadable, gitdir.Repository.discover(repository(s, d)).shallow)], "unreadable long, shallow boolean")
)
