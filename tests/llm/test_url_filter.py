"""URL rules against a plain loop, and the odd inputs."""

import re

from tidemark.llm.url_filter import RULES, judge, rule_table

URLS = [
    "http://a.example.com/en/7817?utm=1", "https://example.com/en/6", "HTTP://EXAMPLE.COM/en/7", "http://x.net/de/1", "http://m.example.net/de/81#z",
    "http://example.net/de/9", "http://org/es/", "http://org/es", "http://badcom/en/1", "ftp://com/en/", "no scheme com/en/", "", None, "://com/en/x",
    "http://a.com?x=/en/", "http://a.com#/en/", "http://com", "http://com./en/1", "x://y://com/en/", "http://é.COM/en/\n7", "http://example.com/EN/7",
    "http://www.example.com/en/" + "7" * 5000, "http://" + "a." * 200 + "com/en/q",
]


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def test_against_a_loop(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] * 2 + [(None, URLS[0], "x")], "page_id long, url string, verdict string")
    more = [*RULES, ("com", "/en/", "allow"), ("a.com", "", "block"), ("", "", "block"), (None, "/", "block")]
    for rules in (RULES, more):
        got = judge(pages, rule_table(spark, rules)).collect()
        assert len(got) == 2 * len(URLS) + 1
        known = [r for r in rules if r[0]]
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == plain(URLS[r.page_id or 0], known), URLS[r.page_id or 0]


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in judge(pages, rule_table(spark, [])).collect()] == [(None, "allow")]
    assert judge(pages.limit(0), rule_table(spark, RULES)).count() == 0


def test_a_host_of_many_labels(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "com/en/q"), (2, "http://" + "." * 20_000 + "/en/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in judge(pages, rule_table(spark, RULES)).orderBy("page_id").collect()] == [("com/en/", "block"), (None, "allow")]
