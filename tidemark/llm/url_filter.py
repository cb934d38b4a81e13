"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL is expanded into expressions: every suffix of its host with as many labels as some rule's
host has, with every prefix of its path whose length some rule's path has. The expressions meet the rules in an equi-join on
the first ``PREFIX`` hex digits of their SHA-256; full digests confirm; the longest rule wins.

URLs are judged once each: a page takes the verdict of its URL, so that copies of one page
or a host with a third of all pages cost no more than one URL each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a digest that the join compares (32 bits).
PREFIX = 8
#: Rules up to this many are broadcast (some 200 bytes each); more are joined by a shuffle.
FEW_RULES = 50_000
DEFAULT = "allow"
#: The rules that the registered query applies, (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def split_url(url):
    """Columns (host, path): host after the first ``://`` up to / ? # or the end, A-Z lower-cased; path from there up to ? # or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """For each row of pages (page_id, url, other columns ignored): page_id, host, path, rule, verdict, n_rules.

    rules: host, path, verdict. A rule fits its host and all subdomains if the path starts with
    the rule's. Of the fitting rules the longest (host and path together) wins; of equally long
    ones the longer host, then block before allow. ``rule`` is its host and path, else null;
    ``verdict`` the rule's, else ``default``. Rules with a null or empty host, or a null path, fit nothing.
    A null URL or one without ``://`` has empty host and path; rows and ids repeat as given.
    An empty table of rules leaves every URL to the default.
    """
    host, path = split_url(F.col("url"))
    pages = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rules = rules.filter("host != '' and path is not null and verdict is not null")
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("said")).distinct()
    counted = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("rule_path")).alias("lengths"), F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels")).first()
    expression = F.concat_ws("\n", "rule_host", "rule_path")
    rules = rules.withColumn("digest", F.sha2(expression, 256))
    rules = rules.withColumn("short", F.substring("digest", 1, PREFIX))

    # distinct lengths of rules' paths and hosts: no more than the longest has characters or labels
    lengths = F.array(*(F.lit(n) for n in sorted(counted.lengths))) if counted.lengths else F.array().cast("array<int>")
    urls = pages.select("host", "path").filter("host != ''").distinct()
    dots = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit("")))
    # the last n labels, where the host has as many
    suffixes = F.explode(F.array_compact(F.array(*(F.when(dots >= n - 1, F.substring_index("host", ".", -n)) for n in sorted(counted.labels)), F.lit(None).cast("string"))))
    prefixes = F.explode(F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)))
    said = urls.withColumn("suffix", suffixes).withColumn("prefix", prefixes)
    said = said.withColumn("full", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256))
    said = said.withColumn("short", F.substring("full", 1, PREFIX)).select("host", "path", "short", "full")
    few = counted.n <= FEW_RULES
    hits = said.join(F.broadcast(rules) if few else rules, "short").filter("full = digest")
    best = hits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("long"), F.length("rule_host").alias("hosts"),
                (F.col("said") == "block").alias("block"), F.concat("rule_host", "rule_path").alias("rule"), F.col("said").alias("verdict"),
            )
        ).alias("best"),
        F.count("*").alias("n"),
    )
    return pages.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.coalesce("n", F.lit(0)).cast("long").alias("n_rules"),
    )
