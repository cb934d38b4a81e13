"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in each text by patterns. Each candidate value's hash is aggregated over
the corpus: in how many repositories and under how many owners it is found. A value that several
repositories hold, or many owners however few their repositories, is a widely copied example; one
that stays with few of both is owner-specific and looks live. In a small corpus half of its
repositories, or half of its owners, are several and many. Besides the patterns' own spans, opaque
tokens (24 or more letters, digits, ``-`` and ``_`` with upper and lower case and digits) count as
secrets where the frequencies say that they are owner-specific; by their looks alone they would not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, written

#: Kinds in their order of rank, with their patterns; the group that holds the
#: value and its least length, in characters. Shorter matches are dropped after matching.
KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("opaque", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])[A-Za-z0-9_-]{24,}", 0, 24),
]
BASE = ("assign", "access", "hex")
#: A value in this many repositories is a widely copied example (or in half of them, two at least, if they are fewer).
COPIED = 3
#: A value under this many owners is one too, though it stay within one or two repositories (or under half of them, as above).
COPIED_OWNERS = 50


_PLACED = "array<struct<start: int, rank: int, end: int, value: string, at: int, to: int>>"


def _steps(text: Column, rank: int) -> Column:
    """The matches of a kind, m, each with the text between the one before and itself, b: lengths in code points and bytes."""
    pattern = KINDS[rank][1]
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    step = lambda b, m: F.struct(F.length(b).alias("gap"), F.octet_length(b).alias("gap_b"), (F.length(b) + F.length(m)).alias("n"), (F.octet_length(b) + F.octet_length(m)).alias("n_b"), m.alias("m"))
    steps = F.filter(F.zip_with(F.split(text, pattern, -1), found, step), lambda s: s["m"].isNotNull())
    return F.when(F.size(found) > 0, steps)


def _blocks(steps: str) -> Column:
    """Steps in blocks of about the square root of their number: what is built up by adding to an array is copied as often as a block is long."""
    n = F.size(steps)
    width = F.ceil(F.sqrt(n)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda k: F.slice(steps, k * width + 1, width))


def _places(blocks: str, rank: int) -> Column:
    """Structs start, rank, end (code points), value, at, to (bytes) of the matches whose value is long enough."""
    _, pattern, group, least = KINDS[rank]
    total = lambda block, of: F.aggregate(block, F.lit(0), lambda n, s: n + s[of])
    begins = F.aggregate(
        blocks, F.struct(F.lit(0).alias("c"), F.lit(0).alias("b"), F.array().cast("array<struct<c: int, b: int>>").alias("out")),
        lambda acc, block: F.struct(
            (acc["c"] + total(block, "n")).alias("c"), (acc["b"] + total(block, "n_b")).alias("b"),
            F.concat(acc["out"], F.array(F.struct(acc["c"].alias("c"), acc["b"].alias("b")))).alias("out"),
        ),
    )["out"]
    value = lambda m: F.regexp_extract(m, pattern, 1) if group else m
    one = lambda acc, s: F.struct(
        (acc["c"] + s["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["c"] + s["n"]).alias("end"), value(s["m"]).alias("value"),
        (acc["b"] + s["gap_b"]).alias("at"), (acc["b"] + s["n_b"]).alias("to"),
    )
    within = lambda block, begin: F.aggregate(
        block, F.struct(begin["c"].alias("c"), begin["b"].alias("b"), F.array().cast(_PLACED).alias("out")),
        lambda acc, s: F.struct((acc["c"] + s["n"]).alias("c"), (acc["b"] + s["n_b"]).alias("b"), F.concat(acc["out"], F.array(one(acc, s))).alias("out")),
    )["out"]
    placed = F.filter(F.flatten(F.zip_with(blocks, begins, within)), lambda x: F.length(x["value"]) >= least)
    return F.when(F.col(blocks).isNotNull(), placed).otherwise(F.array().cast(_PLACED))


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs with column found: every candidate of column text by place, structs of start, rank, end, value, at, to (at and to in bytes).

    A column found that docs has already is replaced; null texts count as empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = range(len(KINDS))
    steps, blocks = fresh(docs, *(f"steps{k}" for k in kinds)), fresh(docs, *(f"blocks{k}" for k in kinds))
    docs = docs.withColumns({steps[k]: _steps(whole, k) for k in kinds})
    docs = docs.withColumns({blocks[k]: F.when(F.col(steps[k]).isNotNull(), _blocks(steps[k])) for k in kinds}).drop(*steps)
    return docs.withColumn("found", F.array_sort(F.flatten(F.array(*(_places(blocks[k], k) for k in kinds))))).drop(*blocks)


def _spans(found: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    one = lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def _found(docs: DataFrame, repo: str, owner: str) -> DataFrame:
    """A written table: key (of the text), doc_id, repo, owner, found; values only as hashes."""
    rows = docs.select("doc_id", F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
    rows = candidates(rows.withColumn("key", F.md5("text")), "text").drop("text")
    hashed = F.transform(
        "found",
        lambda x: F.struct(x["start"], x["rank"], x["end"], (x["to"] - F.octet_length(x["value"])).alias("at"), x["to"], F.sha2(x["value"], 256).alias("hash")),
    )
    return written(rows.withColumn("found", hashed), "secrets")


def _many(found: DataFrame, column: str, most: int) -> int:
    """most, or half of the corpus' distinct values of a column (two at least) if that is less."""
    about = found.agg(F.approx_count_distinct(column).alias("n")).first().n
    if about > 4 * most:
        return most
    return max(2, min(most, (found.agg(F.countDistinct(column).alias("n")).first().n + 1) // 2))


def frequencies(found: DataFrame, copied: int = COPIED, copied_owners: int | None = COPIED_OWNERS) -> DataFrame:
    """For each candidate hash: n_repos, n_owners (distinct, nulls not counted), live.

    copied, copied_owners: from how many repositories, owners on a value is a copied example, or half of
    them in a corpus that has less than twice as many; None: repositories alone decide.
    """
    each = found.select(F.explode("found.hash").alias("hash"), "repo", "owner").distinct()
    repos = each.select("hash", "repo").distinct().groupBy("hash").agg(F.count("repo").alias("n_repos"))
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count("owner").alias("n_owners"))
    few = F.lit(True) if copied_owners is None else F.col("n_owners") < _many(found, "owner", copied_owners)
    return repos.join(owners, "hash").withColumn("live", (F.col("n_repos") < _many(found, "repo", copied)) & few)


def _judged(found: DataFrame, copied: int, copied_owners: int | None) -> DataFrame:
    """A row for each span of each text (key): its base spans and the live opaque ones that touch none of these, with n_repos, n_owners, live."""
    texts = found.filter(F.size("found") > 0).groupBy("key").agg(F.first("found").alias("found"))
    each = texts.select("key", F.explode("found").alias("x")).select("key", "x.*")
    each = each.join(frequencies(found, copied, copied_owners), "hash")
    base = F.col("rank") < len(BASE)
    # base spans that begin before a span, and after it: one sort each, whatever their number
    place = ("start", "rank", "end")
    before = Window.partitionBy("key").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("key").orderBy(*map(F.desc, place)).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("upto", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(after))
    apart = (F.coalesce("upto", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    return each.filter(base | F.col("live") & apart).drop("upto", "next")


def scan(docs: DataFrame, repo: str = "source", owner: str = "doc_id", copied: int = COPIED, copied_owners: int | None = COPIED_OWNERS) -> DataFrame:
    """For each row of docs (doc_id, text, repo, owner): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_live, n_copied, most_owners.

    owner: the column of who owns a document; the given tables have none, so that by default each
    document counts as one. Places are code points, ends exclusive. base_sha256 digests the base kinds'
    kind:start:end, by start, then kind, comma-joined; ``spans`` lists them with the added ones in the
    same form. n_live and n_copied count the listed values by their corpus-wide frequency; most_owners
    is the largest number of owners of a listed value, 0 without one. copied and copied_owners as in
    ``frequencies``. Null texts count as empty; null repositories and null owners aren't counted;
    repeated rows come back as they are. An empty table gives no rows; other columns are ignored.
    """
    found = _found(docs, repo, owner)
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    number = lambda rank: F.size(F.filter("found", lambda x: x["rank"] == rank)).cast("long")
    rows = found.select(
        "doc_id", *(number(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(_spans(base), 256).alias("base_sha256"),
        F.when(F.size("found") > 0, F.col("key")).alias("key"),
    )
    spans = _judged(found, copied, copied_owners).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("all"), F.count_if(F.col("rank") >= len(BASE)).alias("n_added"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"), F.max("n_owners").alias("most_owners"),
    )
    spans = spans.select("key", _spans(F.col("all")).alias("spans"), "n_added", "n_live", "n_copied", "most_owners")
    # only rows that have candidates need the join
    some = rows.filter("key is not null").join(spans, "key", "left").drop("key").fillna({"spans": "", "n_added": 0, "n_live": 0, "n_copied": 0, "most_owners": 0})
    zero = F.lit(0).cast("long")
    none = rows.filter("key is null").drop("key").withColumns({"spans": F.lit(""), "n_added": zero, "n_live": zero, "n_copied": zero, "most_owners": zero})
    return some.union(none)


def redact(docs: DataFrame, repo: str = "source", owner: str = "doc_id", mark: str = "[SECRET]", copied: int = COPIED, copied_owners: int | None = COPIED_OWNERS) -> DataFrame:
    """docs with live-looking values in text replaced by mark, n_chars (if there is one) counted anew; columns as given, whatever their names.

    Live values that overlap share one mark. Widely copied examples stay as they are, and so do null texts and all rows.
    """
    found = _found(docs, repo, owner)
    key, cuts, end = fresh(docs, "key", "cuts", "end")
    # bytes from the end of what is cut before to each live value; those within it add nothing
    line = Window.partitionBy("key").orderBy("at", "to").rowsBetween(Window.unboundedPreceding, -1)
    live = _judged(found, copied, copied_owners).filter("live").select("key", "at", "to", F.coalesce(F.max("to").over(line), F.lit(0)).alias("from"))
    live = live.groupBy(F.col("key").alias(key)).agg(
        F.sort_array(F.collect_list(F.when(F.col("at") >= F.col("from"), F.struct("at", "from")))).alias(cuts), F.max("to").alias(end)
    )
    raw = F.col("text").cast("binary")
    kept = F.transform(cuts, lambda c: F.substring(raw, c["from"] + 1, c["at"] - c["from"]).cast("string"))
    rest = F.substring(raw, F.col(end) + 1, F.octet_length("text")).cast("string")
    new = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.array_join(F.concat(kept, F.array(rest)), mark))
    out = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")))).join(live, key, "left").withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
