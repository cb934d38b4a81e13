"""Scalar functions, parsing, rendering and the command line, case by case."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions import columns as X
from tidemark.functions import dates, globs, parsing, width
from tidemark.operators import history as H
from tidemark.operators import reports as R
from tidemark.render import text
from tidemark.sources import gitdir, packs

NOW = 1_711_929_600


def test_dates():
    assert [dates.civil(t) for t in (0, -1, 951_782_400, 1_711_929_600, -62_135_596_800 - 1)] == ["1970-01-01", "1969-12-31", "2000-02-29", "2024-04-01", "0000-12-31"]
    assert dates.to_epoch(2024, 2, 31) == dates.to_epoch(2024, 3, 2) and dates.iso_seconds(-1) == "1969-12-31T23:59:59Z"
    assert dates.parse_since(" 30d ", NOW) == NOW - 30 * 86_400 and dates.parse_since("1y", NOW) == NOW - 365 * 86_400
    assert dates.parse_since("2024-04-01", NOW) == NOW and dates.parse_since("0w", NOW) == NOW
    assert all(dates.parse_since(x, NOW) is None for x in ("", "d", "-3d", "2024-13-01", "2024-01-32", "2024-1", "1-2-3-4", "soon"))
    said = {-1: "in the future", 0: "today", 1: "1 day", 59: "59 days", 60: "2 months", 729: "24 months", 730: "2.0 years", 3652: "10.0 years"}
    assert {d: dates.humanise_days(d) for d in said} == said


def test_date_columns(spark):
    times = [0, -1, 951_782_400, NOW, -86_401]
    rows = spark.createDataFrame([(t,) for t in times], "t long").select(dates.date_column(F.col("t")), dates.iso_column(F.col("t")), dates.days_since(F.col("t"), NOW)).collect()
    assert [tuple(r) for r in rows] == [(dates.civil(t), dates.iso_seconds(t), max(NOW - t, 0) // 86_400) for t in times]
    days = [-5, 0, 1, 2, 59, 60, 61, 729, 730, 5000]
    rows = spark.createDataFrame([(d,) for d in days], "d long").select(dates.humanise_column(F.col("d"))).collect()
    assert [r[0] for r in rows] == [dates.humanise_days(d) for d in days]
    words = ["30d", "6w", " 3m", "1y", "2024-08-29", "2024-02-31", "x", "2024-13-01", "5h"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(dates.since_column(F.col("w"), NOW)).collect()
    assert [r[0] for r in rows] == [dates.parse_since(w, NOW) for w in words]


GLOBS = [
    ("*.rs", "src/a.rs", True), ("*.rs", "a.rsx", False), ("src/*.rs", "src/a/b.rs", False), ("src/**/mod.rs", "src/mod.rs", True),
    ("src/**/mod.rs", "src/foomod.rs", True), ("src/**/mod.rs", "src/a/b/mod.rs", True), ("**", "any/thing", True), ("a?b", "aéb", False),
    ("a??b", "aéb", True), ("a?b", "a/b", False), ("docs", "x/docs", True), ("a/docs", "x/a/docs", False), ("[a].md", "[a].md", True),
    ("a.b", "axb", False), ("", "", True), ("é*", "x/éa", True), ("*", "a/b", True), ("x/*", "x/", True),
]


def test_globs(spark):
    assert [globs.matches(p, s) for p, s, _ in GLOBS] == [w for *_, w in GLOBS]
    for pattern, path, want in GLOBS:
        assert spark.createDataFrame([(path,)], "p string").select(globs.matches_column(pattern, F.col("p"))).first()[0] == want


def test_width(spark):
    texts = ["abc", "漢字", "é", "😀x", "\t\x7f", "ｆｕｌｌ", ""]
    assert [width.text_width(t) for t in texts] == [3, 4, 1, 3, 0, 8, 0]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(width.width_column(F.col("t"))).collect()
    assert [r[0] for r in rows] == [width.text_width(t) for t in texts]
    assert width.truncate_start("src/engine.py", 8) == "…gine.py" and width.truncate_start("漢字漢字", 4) == "…字"
    assert width.truncate_start("abc", 0) == "abc" and width.truncate_start("abc", 1) == "…"
    assert width.pad("é漢", 5) == "é漢  " and width.pad("ab", 4, right=True) == "  ab" and width.pad("abcd", 2) == "abcd"


def test_object_ids_and_measures(spark):
    assert parsing.object_id("tree", b"") == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
    data = [b"hello", b"", b"a\n", b"a\nb", b"x\x00y\n", b"a" * 8000 + b"\x00\n", "é\n".encode(), b"\xff\n\n"]
    rows = spark.createDataFrame([(bytearray(d),) for d in data], "d binary").select(
        X.object_id(F.lit("blob"), F.col("d")), X.line_count(F.col("d")), X.is_binary(F.col("d"))
    )
    want = [(1, False), (0, False), (1, False), (2, False), (0, True), (1, False), (1, False), (2, False)]
    assert [tuple(r) for r in rows.collect()] == [(parsing.object_id("blob", d), *w) for d, w in zip(data, want)]


def test_display_path_and_adler(spark):
    from tidemark.functions import udfs

    paths = ["\\\\?\\C:\\x", "\\\\?\\UNC\\host\\x", "/usr/x", "C:\\y", None]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(X.display_path(F.col("p")), udfs.adler32(F.col("p").cast("binary"))).collect()
    assert [r[0] for r in rows] == ["C:\\x", "\\\\host\\x", "/usr/x", "C:\\y", None]
    assert [r[1] for r in rows] == [None if p is None else zlib.adler32(p.encode()) for p in paths]


def test_scalars(spark):
    paths = spark.createDataFrame([("src/a/b.rs", "README.md"), ("a/b", "a/c")], "a string, b string")
    rows = paths.select(X.top_level(F.col("a")), X.top_level(F.col("b")), X.crosses_directories(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("src", "", True), ("a", "a", False)]
    one = spark.range(1)
    score = lambda r, n: one.select(X.hotspot_score(F.lit(r), F.lit(n), F.lit(13), F.lit(48_181))).first()[0]
    assert score(13, 3720) > score(2, 48_181) and score(5, 0) == 0
    assert one.select(X.degree(F.lit(1), F.lit(1), F.lit(11)), X.degree(F.lit(0), F.lit(0), F.lit(0))).first()[:] == (1 / 11, 0.0)


@pytest.mark.parametrize(("counts", "want"), [([10], 1), ([9, 1], 1), ([5, 5], 2), ([4, 3, 3], 2), ([1] * 5, 3), ([2] * 4, 3)])
def test_bus_factor(spark, counts, want):
    rows = spark.createDataFrame([("p", i, n) for i, n in enumerate(counts)], "path string, author_idx long, n long")
    got = R.ownership(rows).first()
    assert got.bus_factor == want and got.author_idx == 0 and got.revisions == sum(counts)


def test_renames(spark):
    changes = [("c", "old", "Deleted", "x"), ("c", "n1", "Added", "x"), ("c", "n2", "Added", "x"), ("c", "n3", "Added", "x"), ("d", "n4", "Added", "x"), ("c", "m", "Modified", "x")]
    frame = spark.createDataFrame(changes, "commit_oid string, path string, kind string, content_oid string")
    got = sorted((r.commit_oid, r.path, r.kind) for r in H.collapse_renames(frame).collect())
    assert got == [("c", "m", "Modified"), ("c", "n1", "Renamed"), ("c", "n2", "Added"), ("c", "n3", "Added"), ("d", "n4", "Added")]


def test_parsing(spark):
    s = parsing.parse_signature(b"A < B  <a@b.c> 1704067200 +0130")
    assert s == ("A < B", "a@b.c", 1_704_067_200, 90) and parsing.parse_signature(b"\xe9 <x> soon west") == ("�", "x", 0, 0)
    assert parsing.parse_zone("-0800") == -480 and parsing.parse_zone("0800") is None
    tree, parent = "a" * 40, "b" * 40
    data = f"tree {tree}\nparent {parent}\nparent zz\nauthor A <a@x> 5 +0000\ngpgsig one\n two\n\n\n  first \nsecond".encode()
    c = parsing.parse_commit(data)
    assert (c.tree, c.parents, c.committer, c.summary) == (tree, [parent], c.author, "first")
    for bad in (b"author A <a@x> 1 +0000\n\n", f"tree {tree}\n\nx".encode()):
        with pytest.raises(parsing.Malformed):
            parsing.parse_commit(bad)
    entry = b"100644 a b\0" + b"\x01" * 20
    assert parsing.parse_tree(entry + b"40000 d\0" + b"\x02" * 20) == [(0o100644, b"a b", "01" * 20), (parsing.DIRECTORY, b"d", "02" * 20)]
    for bad in (entry[:-1], b"9 x\0" + b"\x01" * 20):
        with pytest.raises(parsing.Malformed):
            parsing.parse_tree(bad)
    lines = [" Ann <a@b> 12 -0130", "x <y> <z@w> bad +0000", "no address", "N <e>"]
    rows = spark.createDataFrame([(x,) for x in lines], "l string").select(parsing.signature_column(F.col("l")).alias("s")).collect()
    assert [tuple(r.s) if r.s else None for r in rows] == [("Ann", "a@b", 12, -90), ("x <y>", "z@w", 0, 0), None, ("N", "e", 0, 0)]


def test_deltas():
    base = bytes(range(256)) * 300
    copy = lambda start, n: bytes([0xFF]) + start.to_bytes(4, "little") + n.to_bytes(3, "little")

    def size(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    assert parsing.apply_delta(base, size(len(base)) + size(14) + copy(5, 10) + b"\x04four") == base[5:15] + b"four"
    assert parsing.apply_delta(base, size(len(base)) + size(65_536) + b"\x80") == base[:65_536]
    for bad in (size(3) + size(0), size(len(base)) + size(1) + b"\x00", size(len(base)) + size(9) + b"\x04four", size(len(base)) + size(9) + b"\x09four",
                size(len(base)) + size(4) + copy(len(base), 4), size(len(base)) + size(4) + b"\x81", b"\x80"):
        with pytest.raises(parsing.Malformed):
            parsing.apply_delta(base, bad)


def test_inflate():
    rng = random.Random(9)
    noise = rng.randbytes(200_000)
    payloads = [b"", b"x", b"hello world", b"a" * 70_000, b"ab" * 40_000, b"xyz" * 30_000, bytes(range(256)) * 200, noise, b"q" * 65_535,
                noise[:32_768] + b"MARKER" + noise[:1000] + b"MARKER", b"tree 1\nparent 2\nauthor x\n\n" * 500]
    for raw in payloads:
        for level in (0, 1, 6, 9):
            packed = zlib.compress(raw, level)
            assert parsing.inflate(packed + b"rest", len(raw)) == (raw, len(packed))
    good = zlib.compress(noise)
    for bad in (good[:-1], good[:50], b"\x00" + good[1:], good[:-1] + bytes([good[-1] ^ 1]), b""):
        with pytest.raises(parsing.Malformed):
            parsing.inflate(bad)
    with pytest.raises(parsing.Malformed):
        parsing.inflate(good, 5)
    assert parsing.adler32(b"Wikipedia") == 0x11E60398
    with pytest.raises(parsing.Malformed):
        packs.Index(b"\xfftOc\x00\x00\x00\x01" + b"\0" * 2000)
    assert parsing.parse_loose(b"blob 2\0hi") == ("blob", b"hi")
    for bad in (b"blob 3\0hi", b"blub 2\0hi", b"blob 2", b"blob2\0hi"):
        with pytest.raises(parsing.Malformed):
            parsing.parse_loose(bad)


def test_config_refs_and_discovery(tmp_path):
    config = gitdir.parse_config('# c\n[Core]\n bare\n Name = "a # b" ; c\n[remote "Up"]\nurl = x\\y # z\nq = "say \\"hi\\""\n[x]\n')
    assert config == {"core.bare": "true", "core.name": "a # b", "remote.Up.url": "x\\y", "remote.Up.q": 'say "hi"'}
    assert gitdir.config_bool(config, "core.bare") and not gitdir.config_bool(config, "core.none")
    work = tmp_path / "w"
    (tmp_path / "g" / "refs" / "heads").mkdir(parents=True)
    (tmp_path / "g" / "objects").mkdir()
    (work / "deep").mkdir(parents=True)
    (work / ".git").write_text("gitdir: ../g\n")
    (tmp_path / "g" / "HEAD").write_text("ref: refs/heads/main\n")
    repo = gitdir.Repository.discover(str(work / "deep"))
    assert repo.name == "w" and repo.head.oid is None and repo.head.describe() == "main (no commits yet)"
    (tmp_path / "g" / "packed-refs").write_text(f"# x\n{'a' * 40} refs/heads/main\n^{'b' * 40}\n{'c' * 40} refs/tags/t\n")
    assert repo.head.oid == "a" * 40
    (tmp_path / "g" / "refs" / "heads" / "main").write_text("D" * 40 + "\n")
    assert repo.refs == [("refs/heads/main", "d" * 40), ("refs/tags/t", "c" * 40)]
    (tmp_path / "g" / "HEAD").write_text("e" * 40)
    assert repo.head.describe() == "detached at eeeeeee"
    (tmp_path / "g" / "HEAD").write_text("ref: ../../etc/passwd")
    with pytest.raises(parsing.Malformed):
        _ = repo.head
    (tmp_path / "g" / "config").write_text("[extensions]\nobjectformat = SHA256\n")
    with pytest.raises(gitdir.Unsupported):
        gitdir.Repository.discover(str(work))
    with pytest.raises(gitdir.NotARepository):
        gitdir.Repository.discover(str(tmp_path / "missing"))
    bare = gitdir.Repository.discover(str(tmp_path / "g" / "objects" / "..")) if not (tmp_path / "g" / "config").unlink() else None
    assert bare.work_tree is None and bare.name == "repository"


def test_render(monkeypatch):
    monkeypatch.setenv("COLUMNS", "40")
    plain, colour = text.Palette(False), text.Palette(True)
    out = text.table(["file", "n"], "lr", [["a/very/long/path/that/does/not/fit/in.py", "1"], ["漢.py", "10"]], plain)
    assert out.splitlines()[0] == "file" + " " * 34 + " n" and all(width.text_width(x) <= 40 for x in out.splitlines()) and "…" in out
    assert text.table(["a"], "l", [], plain) == ""
    assert text.strip_ansi(colour.severity("x", 0.7) + colour.paint("dim", "y")) == "xy" and "31m" in colour.severity("x", 0.66) and "32m" in colour.severity("x", 0.1)
    assert text.json_text({"a": [1, 0.5, float("nan"), True, None], "b": {}, "c": [], "d": 'q"\n\x01é'}) == (
        '{\n  "a": [\n    1,\n    0.5000,\n    null,\n    true,\n    null\n  ],\n  "b": {},\n  "c": [],\n  "d": "q\\"\\n\\u0001é"\n}\n')
    assert text.csv_text(["a", "b"], [["x,y", 0.25], ['say "hi"', True]]) == 'a,b\n"x,y",0.2500\n"say ""hi""",true\n'
    assert text.percent(1, 3) == "33%" and text.percent(1, 0) == "0%" and text.percent(1, 8) == "12%" and text.plural(1, "c", "cs") == "1 c"
    monkeypatch.setenv("NO_COLOR", "1")
    monkeypatch.setenv("CLICOLOR_FORCE", "1")
    assert not text.Palette.detect(False).on
    monkeypatch.delenv("NO_COLOR")
    assert text.Palette.detect(False).on and not text.Palette.detect(True).on


def test_command_lines():
    args = cli.parse(["owners", "repo", "--top=5", "--since", "30d", "--json", "--csv", "--path=src/**", "--dormant-days=-3", "--no-colour"], NOW)
    assert (args.command, args.path, args.top, args.since, args.format, args.glob, args.dormant_days, args.no_color) == (
        "owners", "repo", 5, NOW - 30 * 86_400, "csv", "src/**", -3, True)
    assert cli.parse(["some/path", "age"], NOW).command == "age" and cli.parse(["some/path", "age"], NOW).path == "some/path"
    assert cli.parse([], NOW) == cli.Args() and cli.parse(["--", "-x"], NOW).path == "-x"
    assert (a := cli.parse(["owners", "age"], NOW)).command == "owners" and a.path == "age"
    assert "hotspots" in cli.parse(["-h"], NOW) and cli.VERSION in cli.parse(["-V"], NOW)
    for bad in (["--top", "0"], ["--top"], ["-n", "x"], ["--since", "soon"], ["--wat"], ["a", "b"], ["age", "b", "c"], ["--min-co=-1"]):
        with pytest.raises(cli.Usage):
            cli.parse(bad, NOW)


def test_streaming_tally(spark, tmp_path):
    from tidemark.streaming.tally import daily_changes, tally_stream

    rows = [("a/x", 1, "Added", 10, "2024-01-01 10:00:00"), ("a/x", 1, "Modified", 20, "2024-01-01 11:00:00"), ("b", 2, "Deleted", 30, "2024-01-02 10:00:00")]
    frame = spark.createDataFrame(rows, "path string, author_idx long, kind string, time long, at string").withColumn("at", F.to_timestamp("at"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    for name, build, mode in (("tallied", tally_stream, "complete"), ("daily", daily_changes, "complete")):
        q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert [tuple(r) for r in spark.table("tallied").collect()] == [("a/x", 1, 2, 20)]
    assert [(r.top, r.n) for r in spark.table("daily").collect()] == [("a", 2)]
