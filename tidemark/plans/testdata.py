"""The registered queries over the parquet tables, each with the SQL that gives the same rows.

Orders stand for commits (customers for authors, status P for merges), the parts on them for
touched paths (the least return flag of an order's lines of a part gives the kind of change), the
parts over size 5 for the files that exist. Texts of documents stand for file contents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import dates, globs, parsing, udfs, width
from ..operators import history as H
from ..operators import reports as R
from ..sources.datasource import once
from .repository import mismatches, rehash

#: Fixed values of the adapter: the reports' clock (2001-10-01), and what a broad commit is here.
NOW, BROAD = 1_001_894_400, 8
SINCE = dates.to_epoch(2000, 1, 1)
GLOB = "ECONOMY/**/blue*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    path = F.concat("p_type", F.lit("/"), "p_brand", F.lit("/"), "p_name", F.lit("-"), F.col("p_partkey").cast("string"))
    return part.select("p_partkey", path.alias("path"), F.col("p_size").cast("long").alias("lines"))


def all_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("commit_oid"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("time"),
        F.col("o_custkey").alias("author_idx"), (F.col("o_orderstatus") == "P").alias("is_merge"),
    )


def all_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("flag"))
    lines = lines.join(files(spark, sf_dir), lines.l_partkey == F.col("p_partkey"))
    kind = F.when(F.col("flag") == "R", "Deleted").when(F.col("flag") == "A", "Added").otherwise("Modified")
    return lines.select(F.col("l_orderkey").alias("commit_oid"), "path", kind.alias("kind"), F.substring_index("path", "-", 1).alias("content_oid"))


def history(spark: SparkSession, sf_dir: str, since: int | None = None, include_merges: bool = False) -> H.History:
    kept = H.keep_commits(all_commits(spark, sf_dir), since, include_merges)
    changes = all_changes(spark, sf_dir).join(kept.select("commit_oid"), "commit_oid", "left_semi")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author_idx"), F.lower("c_name").alias("email"), F.col("c_name").alias("name"))
    return H.History(
        commits=H.mark_broad(kept, changes, BROAD),
        changes=changes,
        authors=people.join(kept.select("author_idx"), "author_idx", "left_semi"),
        snapshot=files(spark, sf_dir).filter("lines > 5").select("path", (F.col("lines") * 40).alias("bytes"), "lines", F.lit(False).alias("is_binary")),
        paths_ever=changes.select("path").distinct(),
    )


def rounded(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c, kind in frame.dtypes if kind == "double"})


_FILES = "files AS (SELECT p_partkey, p_type || '/' || p_brand || '/' || p_name || '-' || p_partkey AS path, CAST(p_size AS BIGINT) AS lines FROM part)"
_COMMITS = "commits AS (SELECT o_orderkey AS commit_oid, CAST(epoch(o_orderdate) AS BIGINT) AS time, o_custkey AS author_idx, o_orderstatus = 'P' AS is_merge FROM orders)"


def _base(keep: str = "NOT is_merge") -> str:
    return f"""WITH {_FILES}, {_COMMITS},
kept AS (SELECT * FROM commits WHERE {keep}),
line AS (SELECT l_orderkey, l_partkey, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
changes AS (SELECT l_orderkey AS commit_oid, path, CASE flag WHEN 'R' THEN 'Deleted' WHEN 'A' THEN 'Added' ELSE 'Modified' END AS kind,
  split_part(path, '-', 1) AS content_oid
  FROM line JOIN files ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT commit_oid FROM kept)),
snap AS (SELECT path, lines FROM files WHERE lines > 5),
broad AS (SELECT commit_oid FROM changes GROUP BY 1 HAVING count(*) > {BROAD}),
ta AS (SELECT path, author_idx, count(*) AS n, max(time) AS last FROM changes JOIN kept USING (commit_oid) WHERE kind <> 'Deleted' GROUP BY 1, 2),
tally AS (SELECT path, CAST(sum(n) AS BIGINT) AS revisions, count(*) AS authors, max(last) AS last_change FROM ta GROUP BY 1),
"""


_HOT = """rows AS (SELECT * FROM tally JOIN snap USING (path)),
most AS (SELECT greatest(max(revisions), 1) AS r, greatest(max(lines), 1) AS l FROM rows)
SELECT path, revisions, authors, lines, round(revisions / r * ln(1.0 + lines) / ln(1.0 + l), 6) AS score, last_change FROM rows, most"""

_OWNED = """ranked AS (SELECT path, author_idx, n, row_number() OVER w AS rk, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS running,
  sum(n) OVER (PARTITION BY path) AS total FROM ta WHERE path IN (SELECT path FROM snap) WINDOW w AS (PARTITION BY path ORDER BY n DESC, author_idx)),
owned AS (SELECT path, CAST(max(total) AS BIGINT) AS revisions, count(*) AS authors, max(author_idx) FILTER (rk = 1) AS author_idx,
  max(n) FILTER (rk = 1) / max(total) AS main_share, CAST(coalesce(min(rk) FILTER (running > total // 2), greatest(count(*), 1)) AS BIGINT) AS bus_factor FROM ranked GROUP BY 1),
seen AS (SELECT author_idx, max(time) AS last_seen FROM kept GROUP BY 1),
report AS (SELECT path, revisions, authors, c_name AS main_author, round(CAST(main_share AS DOUBLE), 6) AS main_share, bus_factor,
  CAST(greatest(%d - coalesce(last_seen, 0), 0) // 86400 AS BIGINT) AS owner_silent_days FROM owned LEFT JOIN seen USING (author_idx) LEFT JOIN customer ON c_custkey = author_idx)
""" % NOW  # noqa: UP031
_REPORT = f"SELECT *, owner_silent_days >= {R.DORMANT_DAYS} AS orphaned FROM report"

_PAIRS = """touched AS (SELECT DISTINCT commit_oid, path FROM changes WHERE kind <> 'Deleted' AND commit_oid NOT IN (SELECT commit_oid FROM broad)),
pairs AS (SELECT x.path AS a, y.path AS b, count(*) AS co_changes FROM touched x JOIN touched y ON x.commit_oid = y.commit_oid AND x.path < y.path GROUP BY 1, 2)
"""
_COUPLED = """SELECT a, b, co_changes, ra.revisions AS revisions_a, rb.revisions AS revisions_b,
  round(CASE WHEN ra.revisions + rb.revisions - co_changes = 0 THEN 0 ELSE co_changes / (ra.revisions + rb.revisions - co_changes) END, 6) AS degree,
  split_part(a, '/', 1) <> split_part(b, '/', 1) AS crosses_directories
FROM pairs JOIN tally ra ON a = ra.path JOIN tally rb ON b = rb.path
WHERE co_changes >= 2 AND a IN (SELECT path FROM snap) AND b IN (SELECT path FROM snap)"""
_AGE = f"SELECT path, CAST(greatest({NOW} - last_change, 0) // 86400 AS BIGINT) AS days_since_change, revisions FROM tally WHERE path IN (SELECT path FROM snap)"


def _strip(sql: str) -> str:
    """_base ends with a comma for the CTEs that follow; a query without any drops it."""
    return sql.rstrip().removesuffix(",") + "\n"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return register


# ------------------------------------------------------------------ reports

query("hotspots", _base() + _HOT)(lambda s, d: R.hotspots(history(s, d), limit=None))
query("hotspots_top", f"{_base()}{_HOT} ORDER BY score DESC, path LIMIT 20")(lambda s, d: rounded(R.hotspots(history(s, d))))
query("hotspots_since_with_merges", _base(f"time >= {SINCE}") + _HOT)(lambda s, d: R.hotspots(history(s, d, SINCE, True), limit=None))
query("owners", _base() + _OWNED + _REPORT)(lambda s, d: R.owners(history(s, d), NOW, limit=None))
query("owners_top", f"{_base()}{_OWNED}{_REPORT} ORDER BY orphaned DESC, bus_factor, revisions DESC, path LIMIT 20")(lambda s, d: R.owners(history(s, d), NOW))
query("coupling", _base() + _PAIRS + _COUPLED)(lambda s, d: R.coupling(history(s, d), min_co=2, limit=None))
query("coupling_top", f"{_base()}{_PAIRS}{_COUPLED} ORDER BY degree DESC, co_changes DESC, a, b LIMIT 20")(lambda s, d: R.coupling(history(s, d), min_co=2))
query("age", _base() + "z AS (SELECT 1) " + _AGE)(lambda s, d: R.age(history(s, d), NOW, limit=None))
query("age_top", f"{_base()}z AS (SELECT 1) {_AGE} ORDER BY days_since_change DESC, path LIMIT 20")(lambda s, d: R.age(history(s, d), NOW))
query(
    "summary",
    _base() + _OWNED + f""", report2 AS ({_REPORT})
SELECT (SELECT count(*) FROM kept) AS commits, (SELECT count(DISTINCT author_idx) FROM kept) AS authors, (SELECT count(*) FROM snap) AS files_now,
  (SELECT count(DISTINCT path) FROM changes) AS files_ever, (SELECT CAST(sum(lines) AS BIGINT) FROM snap) AS lines_now,
  (SELECT min(time) FROM kept) AS first_commit, (SELECT max(time) FROM kept) AS last_commit,
  (SELECT count(*) FROM report2 WHERE authors = 1) AS single_author_files, (SELECT count(*) FROM report2 WHERE orphaned) AS orphaned_files""",
)(lambda s, d: R.summary(history(s, d), NOW))

# ------------------------------------------------------- aggregates and filters

query("tally", _strip(_base()) + "SELECT * FROM tally")(lambda s, d: R.tally(history(s, d)))
query("tally_by_author", _strip(_base()) + "SELECT * FROM ta")(lambda s, d: R.tally_by_author(history(s, d)))
query("author_last_seen", _strip(_base()) + "SELECT author_idx, max(time) AS last_seen FROM kept GROUP BY 1")(lambda s, d: R.author_last_seen(history(s, d)))
query("bus_factor", _base() + _OWNED + "SELECT path, bus_factor FROM owned")(
    lambda s, d: R.ownership(R.tally_by_author(h := history(s, d)).join(h.snapshot, "path", "left_semi")).select("path", "bus_factor")
)
query("main_author", _base() + _OWNED + "SELECT path, author_idx, round(CAST(main_share AS DOUBLE), 6) AS main_share FROM owned")(
    lambda s, d: R.ownership(R.tally_by_author(h := history(s, d)).join(h.snapshot, "path", "left_semi")).select("path", "author_idx", "main_share")
)
query("co_change_pairs", _base() + _PAIRS + "SELECT * FROM pairs")(lambda s, d: R.co_changes(history(s, d)))
query("since_filter", f"WITH {_COMMITS} SELECT * FROM commits WHERE time >= {SINCE}")(lambda s, d: H.keep_commits(all_commits(s, d), SINCE, True))
query("merge_filter", f"WITH {_COMMITS} SELECT * FROM commits WHERE NOT is_merge")(lambda s, d: H.keep_commits(all_commits(s, d)))
query("broad_commit_filter", _strip(_base()) + "SELECT kept.*, commit_oid IN (SELECT commit_oid FROM broad) AS too_broad FROM kept")(lambda s, d: history(s, d).commits)
query("deleted_kind_filter", _strip(_base()) + "SELECT commit_oid, path, kind FROM changes WHERE kind <> 'Deleted'")(
    lambda s, d: history(s, d).changes.filter("kind != 'Deleted'").select("commit_oid", "path", "kind")
)
query("path_glob", f"WITH {_FILES} SELECT path FROM files WHERE regexp_full_match(path, 'ECONOMY/.*blue[^/]*')")(
    lambda s, d: files(s, d).select("path").filter(globs.matches_column(GLOB, F.col("path")))
)
query(
    "restrict_history",
    _strip(_base()) + "SELECT commit_oid, count(*) AS n FROM changes WHERE regexp_full_match(path, 'ECONOMY/.*blue[^/]*') GROUP BY 1",
)(lambda s, d: (h := H.restrict(history(s, d), GLOB)).commits.join(h.changes, "commit_oid").groupBy("commit_oid").agg(F.count("*").alias("n")))
query("still_exists_semi", _strip(_base()) + "SELECT DISTINCT path FROM changes WHERE path IN (SELECT path FROM snap)")(
    lambda s, d: (h := history(s, d)).changes.select("path").distinct().join(h.snapshot, "path", "left_semi")
)
query("snapshot_totals", f"WITH {_FILES} SELECT count(*) AS files_now, CAST(sum(lines) AS BIGINT) AS lines_now FROM files WHERE lines > 5")(
    lambda s, d: history(s, d).snapshot.agg(F.count("*").alias("files_now"), F.sum("lines").alias("lines_now"))
)
query(
    "exact_renames",
    _base() + """numbered AS (SELECT *, row_number() OVER (PARTITION BY commit_oid, content_oid, kind ORDER BY path) AS rn FROM changes),
dels AS (SELECT * FROM numbered WHERE kind = 'Deleted'), adds AS (SELECT * FROM numbered WHERE kind = 'Added')
SELECT commit_oid, path, kind FROM changes WHERE kind = 'Modified'
UNION ALL SELECT a.commit_oid, a.path, CASE WHEN d.path IS NULL THEN 'Added' ELSE 'Renamed' END FROM adds a LEFT JOIN dels d USING (commit_oid, content_oid, rn)
UNION ALL SELECT d.commit_oid, d.path, 'Deleted' FROM dels d LEFT JOIN adds a USING (commit_oid, content_oid, rn) WHERE a.path IS NULL""",
)(lambda s, d: H.collapse_renames(history(s, d).changes).select("commit_oid", "path", "kind"))
query(
    "content_renames",
    """WITH c AS (SELECT source AS commit_oid, CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 2 = 0 THEN 'Deleted' ELSE 'Added' END AS kind, sha1(text) AS content_oid FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY commit_oid, content_oid, kind ORDER BY path) AS rn FROM c),
dels AS (SELECT * FROM numbered WHERE kind = 'Deleted'), adds AS (SELECT * FROM numbered WHERE kind = 'Added')
SELECT a.commit_oid, a.path, CASE WHEN d.path IS NULL THEN 'Added' ELSE 'Renamed' END AS kind FROM adds a LEFT JOIN dels d USING (commit_oid, content_oid, rn)
UNION ALL SELECT d.commit_oid, d.path, 'Deleted' FROM dels d LEFT JOIN adds a USING (commit_oid, content_oid, rn) WHERE a.path IS NULL""",
)(
    lambda s, d: H.collapse_renames(
        table(s, d, "documents").select(
            F.col("source").alias("commit_oid"), F.col("doc_id").cast("string").alias("path"),
            F.when(F.col("doc_id") % 2 == 0, "Deleted").otherwise("Added").alias("kind"), F.sha1(F.col("text").cast("binary")).alias("content_oid"),
        )
    ).select("commit_oid", "path", "kind")
)


def _tree(s: SparkSession, d: str, parity: int) -> DataFrame:
    lines = table(s, d, "lineitem").filter(F.col("l_suppkey") % 2 == parity)
    return lines.groupBy("l_partkey").agg(F.max("l_quantity").cast("long").alias("oid"))


query(
    "tree_diff_full_outer",
    """WITH o AS (SELECT l_partkey, CAST(max(l_quantity) AS BIGINT) AS old FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1),
n AS (SELECT l_partkey, CAST(max(l_quantity) AS BIGINT) AS new FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY 1)
SELECT l_partkey, old, new, CASE WHEN old IS NULL THEN 'Added' WHEN new IS NULL THEN 'Deleted' ELSE 'Modified' END AS kind
FROM o FULL JOIN n USING (l_partkey) WHERE old IS DISTINCT FROM new""",
)(lambda s, d: H.diff_entries(_tree(s, d, 0), _tree(s, d, 1), ["l_partkey"], "oid"))
query("dup_objects_union_distinct", "SELECT sha1(text) AS oid FROM documents UNION SELECT sha1(text) FROM benchmark")(
    lambda s, d: once(table(s, d, "documents").select(F.sha1(F.col("text").cast("binary")).alias("oid")).union(table(s, d, "benchmark").select(F.sha1(F.col("text").cast("binary")))))
)

# ------------------------------------------------------------------- scalars

query("git_object_id", "SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS oid FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", X.object_id(F.lit("blob"), F.col("text")).alias("oid"))
)
query(
    "verify_mismatch",
    "SELECT count(*) AS objects, count(*) FILTER (doc_id % 10 = 3) AS mismatched FROM documents",
)(
    lambda s, d: (
        ids := rehash(table(s, d, "documents").select(
            X.object_id(F.lit("blob"), F.col("text")).alias("oid"), F.lit("blob").alias("kind"),
            F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("data"),
        ))
    ).agg(F.count("*").alias("objects")).crossJoin(mismatches(ids).agg(F.count("*").alias("mismatched")))  # one row each
)
query(
    "snapshot_measure",
    """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, FALSE AS is_binary,
CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS lines FROM documents""",
)(
    lambda s, d: table(s, d, "documents").select(
        "doc_id", F.octet_length("text").cast("long").alias("bytes"), X.is_binary(F.col("text")).alias("is_binary"), X.line_count(F.col("text")).alias("lines")
    )
)
query("date_from_epoch", f"WITH {_COMMITS} SELECT commit_oid, strftime(to_timestamp(time - 946684800) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, strftime(to_timestamp(time - 946684800 + commit_oid % 86400) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso FROM commits")(
    lambda s, d: all_commits(s, d).select(
        "commit_oid", dates.date_column(F.col("time") - 946_684_800).alias("day"), dates.iso_column(F.col("time") - 946_684_800 + F.col("commit_oid") % 86_400).alias("iso")
    )
)
query("days_since", f"WITH {_COMMITS} SELECT commit_oid, CAST(greatest(978307200 - time, 0) // 86400 AS BIGINT) AS days FROM commits")(
    lambda s, d: all_commits(s, d).select("commit_oid", dates.days_since(F.col("time"), 978_307_200).alias("days"))
)
query(
    "humanise_days",
    """WITH d AS (SELECT event_id, CAST(event_id % 2500 - 3 AS BIGINT) AS days FROM events)
SELECT event_id, CASE WHEN days < 0 THEN 'in the future' WHEN days = 0 THEN 'today' WHEN days = 1 THEN '1 day' WHEN days < 60 THEN days || ' days'
WHEN days < 730 THEN CAST(floor(days / 30.44 + 0.5) AS BIGINT) || ' months' ELSE printf('%.1f', days / CAST(365.25 AS DOUBLE)) || ' years' END AS said FROM d""",
)(lambda s, d: table(s, d, "events").select("event_id", dates.humanise_column((F.col("event_id") % 2500 - 3).cast("long")).alias("said")))
query(
    "parse_since",
    f"""SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN {NOW} - (event_id % 50) * 86400 WHEN 1 THEN {NOW} - (event_id % 50) * 7 * 86400
WHEN 2 THEN {NOW} - (event_id % 50) * 30 * 86400 WHEN 3 THEN {NOW} - (event_id % 50) * 365 * 86400
WHEN 4 THEN epoch(make_date(CAST(1990 + event_id % 50 AS BIGINT), CAST(1 + event_id % 12 AS BIGINT), 1)) + (event_id % 31) * 86400 END AS BIGINT) AS since FROM events""",
)(
    lambda s, d: table(s, d, "events").select(
        "event_id",
        dates.since_column(
            F.when(F.col("event_id") % 6 == 4, F.concat_ws("-", (1990 + F.col("event_id") % 50).cast("string"), (1 + F.col("event_id") % 12).cast("string"), (1 + F.col("event_id") % 31).cast("string")))
            .when(F.col("event_id") % 6 == 5, F.lit("yesterday"))
            .otherwise(F.concat((F.col("event_id") % 50).cast("string"), F.get(F.array(*map(F.lit, "dwmy")), (F.col("event_id") % 6).cast("int")))), NOW,
        ).alias("since"),
    )
)
query("top_level", f"WITH {_FILES} SELECT path, split_part(path, '/', 1) AS top FROM files UNION ALL SELECT p_name, '' FROM part")(
    lambda s, d: files(s, d).select("path").union(table(s, d, "part").select("p_name")).select("path", X.top_level(F.col("path")).alias("top"))
)
query(
    "display_width",
    "SELECT doc_id, CAST(2 * length(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g')) AS BIGINT) AS columns FROM documents",
)(
    # each text beside its full-width form would need a table in SQL; a wide mark for each character shown does
    lambda s, d: table(s, d, "documents").select("doc_id", width.width_column(F.regexp_replace("text", r"[^\x00-\x1f\x7f-\x9f]", "世")).alias("columns"))
)
query("identity_key", "SELECT c_custkey, lower(c_name || '@' || c_mktsegment) AS email FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", X.identity_key(F.concat("c_name", F.lit("@"), "c_mktsegment")).alias("email"))
)
query(
    "signature_parse",
    """SELECT o_orderkey, 'Customer ' || o_custkey AS name, 'c' || o_custkey || '@x.org' AS email, CAST(epoch(o_orderdate) AS BIGINT) AS time,
CAST(CASE WHEN o_orderkey % 3 = 0 THEN 330 WHEN o_orderkey % 3 = 1 THEN -480 ELSE 0 END AS INTEGER) AS offset_minutes FROM orders""",
)(
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey",
        parsing.signature_column(
            F.concat(F.lit(" Customer "), F.col("o_custkey").cast("string"), F.lit(" <c"), F.col("o_custkey").cast("string"), F.lit("@x.org> "),
                     F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"),
                     F.get(F.array(F.lit(" +0530"), F.lit(" -0800"), F.lit(" zone")), (F.col("o_orderkey") % 3).cast("int")))
        ).alias("s"),
    ).select("o_orderkey", "s.*")
)
query(
    "csv_escape",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""",
)(lambda s, d: table(s, d, "documents").select("doc_id", X.csv_field(F.col("text")).alias("field")))
query("severity_bucket", _base() + f"hot AS ({'{}'}) SELECT path, CASE WHEN score >= 0.66 THEN 'red' WHEN score >= 0.33 THEN 'yellow' ELSE 'green' END AS level FROM hot".replace("{}", "SELECT path, round(revisions / r * ln(1.0 + lines) / ln(1.0 + l), 6) AS score FROM rows, most").replace("hot AS", "rows AS (SELECT * FROM tally JOIN snap USING (path)), most AS (SELECT greatest(max(revisions), 1) AS r, greatest(max(lines), 1) AS l FROM rows), hot AS"))(
    lambda s, d: R.hotspots(history(s, d), limit=None).select("path", X.severity(F.round("score", 6)).alias("level"))
)
query("short_id", "SELECT DISTINCT left(sha1(source), 7) AS short FROM documents")(
    lambda s, d: table(s, d, "documents").select(X.short_id(F.sha1(F.col("source").cast("binary"))).alias("short")).distinct()
)
query("truncate_start", f"WITH {_FILES} SELECT path, CASE WHEN length(path) <= 18 THEN path ELSE '…' || right(path, 17) END AS short FROM files")(
    lambda s, d: files(s, d).select("path", udfs.truncate_start(F.col("path"), 18).alias("short"))
)
_JSON = "replace(replace(text || chr(1) || chr(31) || chr(11), chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
for _c in range(32):
    _JSON = f"replace({_JSON}, chr({_c}), chr(92) || '{({8: 'b', 9: 't', 10: 'n', 12: 'f', 13: 'r'}).get(_c, f'u{_c:04x}')}')"
query("json_escape", f"SELECT doc_id, '\"' || {_JSON} || '\"' AS field FROM documents")(
    # the texts hold no control characters that are written as numbers: three are put after them
    lambda s, d: table(s, d, "documents").select("doc_id", X.json_string(F.concat("text", F.lit("\x01\x1f\x0b"))).alias("field"))
)
query("inflate_roundtrip", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha1(text) AS digest FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", udfs.inflate(udfs.deflate(F.col("text").cast("binary"))).alias("data")).select(
        "doc_id", F.octet_length("data").cast("long").alias("bytes"), F.sha1("data").alias("digest")
    )
)


def _delta(data):
    """A delta, for bases of up to 127 bytes, that inserts an exclamation mark before a copy of the whole base."""
    n = F.octet_length(data)
    byte = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    return F.concat(byte(n), byte(n + 1), F.lit(bytearray(b"\x01!\x90")), byte(n))


query("apply_delta", f"WITH {_FILES} SELECT path, sha1('!' || path) AS digest FROM files")(
    lambda s, d: files(s, d).select("path", F.sha1(udfs.apply_delta(F.col("path").cast("binary"), _delta(F.col("path").cast("binary")))).alias("digest"))
)
query("padded", f"WITH {_FILES} SELECT path, lpad(path, CAST(greatest(40, length(path)) AS INTEGER), ' ') AS cell FROM files")(
    lambda s, d: files(s, d).select("path", udfs.pad(F.col("path"), 40, right=True).alias("cell"))
)
