"""Written repositories: every case of comparing trees, damage, missing parents, look-ups, odd packs."""

import io
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions import columns as X
from tidemark.functions import parsing
from tidemark.functions.parsing import DIRECTORY, SUBMODULE, Malformed
from tidemark.plans import gitdata
from tidemark.plans import repository as P
from tidemark.render.text import json_text
from tidemark.sources import datasource as D
from tidemark.sources.gitdir import Repository
from tidemark.sources.gitwriter import FILE, Writer, delta
from tidemark.sources.packs import Index, Pack, find_packs

NOW = 1_711_929_600
LINK = "c" * 40


def changes(spark, folder, pairs):
    """{name: {(path, kind)}} of pairs of trees."""
    entries = P.parse_trees(D.read_objects(spark, folder, "tree"))
    frame = spark.createDataFrame([(name, old, new) for name, old, new in pairs], "root string, old string, new string")
    out = {name: set() for name, *_ in pairs}
    for r in P.tree_changes(frame, entries).collect():
        out[r.root].add((r.path, r.kind))
    return out


def test_cases_of_comparing_trees(spark, tmp_path):
    w = Writer(str(tmp_path))
    a, b = w.blob("a\n"), w.blob("b\n")
    folder = w.tree({"in": (FILE, a), "deep": (DIRECTORY, w.tree({"er": (FILE, b)}))})
    one = lambda mode, oid: w.tree({"x": (mode, oid), "same": (FILE, a)})
    nothing, lost = w.tree({"same": (FILE, a)}), "e" * 40
    trees = {"file": one(FILE, a), "other": one(FILE, b), "run": one(0o100755, a), "link": one(0o120000, a), "module": one(SUBMODULE, LINK),
             "module2": one(SUBMODULE, "b" * 40), "folder": one(DIRECTORY, folder), "none": nothing, "lost": one(DIRECTORY, lost),
             "changed": one(DIRECTORY, w.tree({"in": (FILE, b), "deep": (DIRECTORY, w.tree({"er": (FILE, b)}))}))}
    inside = {"x/in", "x/deep/er"}
    gone, new = {(p, "Deleted") for p in inside}, {(p, "Added") for p in inside}
    want = {
        ("file", "file"): set(), ("file", "other"): {("x", "Modified")}, ("file", "run"): {("x", "Modified")}, ("file", "link"): {("x", "Modified")},
        ("file", "folder"): {("x", "Deleted")} | new, ("folder", "file"): gone | {("x", "Added")}, ("folder", "changed"): {("x/in", "Modified")},
        ("file", "module"): set(), ("module", "module2"): set(), ("module", "file"): {("x", "Modified")}, ("folder", "module"): gone, ("module", "folder"): new,
        ("none", "module"): set(), ("module", "none"): set(), ("none", "file"): {("x", "Added")}, ("folder", "none"): gone, ("none", "lost"): set(), ("lost", "none"): set(),
        ("file", "lost"): {("x", "Deleted")},
    }
    got = changes(spark, str(tmp_path), [(f"{p} {q}", trees[p], trees[q]) for p, q in want])
    assert got == {f"{p} {q}": found for (p, q), found in want.items()}
    whole = changes(spark, str(tmp_path), [("new", None, trees["folder"]), ("gone", trees["folder"], None)])
    assert whole == {"new": new | {("same", "Added")}, "gone": gone | {("same", "Deleted")}}
    with pytest.raises(Malformed, match=lost):
        changes(spark, str(tmp_path), [("x", trees["folder"], trees["lost"])])


def test_files_at_a_commit_leave_submodules_and_lost_blobs_out(spark, tmp_path):
    w = Writer(str(tmp_path))
    tree = w.tree({"a": (FILE, w.blob("one\ntwo")), "m": (SUBMODULE, LINK), "gone": (FILE, "f" * 40), "bin": (FILE, w.blob(b"\0\n\n"))})
    head = w.commit(tree, [], "A", "a@x", NOW, "start")
    w.file("refs/heads/main", head + "\n")
    h = P.read_history(spark, str(tmp_path), head)
    assert sorted(h.snapshot.collect()) == [("a", 7, 2, False), ("bin", 3, 0, True)]
    assert {(r.path, r.kind) for r in h.changes.collect()} == {("a", "Added"), ("bin", "Added"), ("gone", "Added")}


def run(spark, folder, *argv):
    out, err = io.StringIO(), io.StringIO()
    code = cli.run(spark, cli.parse([*argv, folder], NOW), NOW, out, err)
    return code, out.getvalue(), err.getvalue()


def test_shallow_and_missing_parents_warn(spark, tmp_path):
    w = Writer(str(tmp_path))
    first, second = w.files({"a": w.blob("1\n")}), w.files({"a": w.blob("1\n"), "b": w.blob("2\n")})
    edge = w.commit(first, ["9" * 40, "8" * 40][:1], "A", "a@x", NOW - 86_400, "edge")
    head = w.commit(second, [edge], "B", "b@x", NOW, "tip")
    w.file("refs/heads/main", head + "\n")
    code, out, err = run(spark, str(tmp_path), "hotspots", "--csv")
    assert code == 0 and "shallow" not in err and "1 commit " in err
    w.file("shallow", edge + "\n")
    assert Repository.discover(str(tmp_path)).shallow
    code, out, err = run(spark, str(tmp_path), "age", "--csv")
    assert code == 0 and "shallow" in err and out.splitlines()[1:] == ["a,1,1", "b,0,1"]


def test_damaged_objects_are_found(spark, tmp_path):
    w = Writer(str(tmp_path))
    head = w.commit(w.files({"a": w.blob("1\n")}), [], "A", "a@x", NOW, "tip")
    w.file("refs/heads/main", head + "\n")
    assert run(spark, str(tmp_path), "--verify")[0] == 0
    wrong = [w.put("blob", b"%d" % k, f"{k:040x}") for k in range(12)]
    code, out, err = run(spark, str(tmp_path), "--verify")
    assert code == 1 and out == "" and "12 of 15" in err and sum(oid in err for oid in wrong) == 10
    total, bad = P.verify(spark, str(tmp_path))
    assert total == 15 and {r.oid for r in bad.collect()} == set(wrong)


def test_a_broken_index_is_a_warning(spark, tmp_path):
    w = Writer(str(tmp_path))
    head = w.commit(w.files({"a": w.blob("1\n")}), [], "A", "a@x", NOW, "tip")
    w.file("refs/heads/main", head + "\n")
    w.file("objects/pack/pack-bad.idx", "no index")
    w.file("objects/pack/pack-bad.pack", "")
    assert "pack-bad.idx" in run(spark, str(tmp_path), "age")[2] and find_packs(w.git_dir)[0] == []


@pytest.mark.parametrize(("by_id", "far"), [(False, False), (True, True)])
def test_look_ups_and_runs_of_a_pack(spark, tmp_path, by_id, far):
    w = Writer(str(tmp_path))
    versions, text = [], b""
    for k in range(40):
        text += b"line %d of some length\n" % (k * 7919) * 40
        versions.append(w.blob(text if k % 7 else text[: len(text) // 2]))
    loose = w.blob("loose")
    w.pack(versions, dict(zip(versions[1:], versions)), by_id=by_id, far=far, keep=5)
    stem = find_packs(w.git_dir)[0][0]
    index, pack = Index.open(f"{stem}.idx"), Pack(stem)
    assert list(index.oids()) == sorted(versions) and all(pack.header(int(o))[3] is not None for o in pack.offsets[1:] if o != pack.offsets.min())
    for oid in versions:
        assert pack.find(oid) == w.known[oid] == D.read_object(w.git_dir, oid) and D.contains(w.git_dir, oid)
    for absent in ("0" * 40, "f" * 40, versions[0][:-1] + ("0" if versions[0][-1] != "0" else "1")):
        assert index.find(absent) is None and not D.contains(w.git_dir, absent)
        with pytest.raises(Malformed):
            D.read_object(w.git_dir, absent)
    assert D.all_oids(w.git_dir) == sorted([*versions, loose]) and D.contains(w.git_dir, loose)
    for size in (1, 7, 1000):
        spark.dataSource.register(D.GitObjects)
        rows = spark.read.format("git_objects").option("path", str(tmp_path)).option("run", size).load().collect()
        assert len(rows) == 40 + 5 + 1 and {r.oid: bytes(r.data) for r in rows} == {o: d for o, (_, d) in w.known.items()}
    some = spark.createDataFrame([(versions[3], 1), ("0" * 40, 2), (loose, 3), (loose, 4)], "oid string, n int")
    assert sorted(r.n for r in D.existing(some, spark, str(tmp_path)).collect()) == [1, 3, 4]
    assert D.read_ids(spark, str(tmp_path)).count() == 41


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400), st.integers(0, 400))
def test_deltas_give_the_object_again(base, extra, at):
    data = base[:at] + extra + base[at:]
    assert parsing.apply_delta(base, delta(base, data)) == data


def test_a_stream_of_another_size_is_refused():
    import zlib

    raw = b"xx" + zlib.compress(b"a" * 300_000) + b"rest"
    assert parsing.inflate(raw, 300_000, 2) == (b"a" * 300_000, len(raw) - 6)
    for size in (299_999, 300_001):
        with pytest.raises(Malformed):
            parsing.inflate(raw, size, 2)
    with pytest.raises(Malformed):
        parsing.inflate(raw[:50], None, 2)


def test_signatures_as_columns_are_signatures(spark):
    import random

    rng = random.Random(5)
    parts = ["<", ">", " ", "a", "Ada L", "a@b.c", "1704067200", "-5", "+7", "+0130", "-0800", "+1", "x", "\t", " ", "99999999999999999999", "\n", "9" * 18]
    lines = ["a <b> <c", "", "<>", "a <b>", "x <y> 5 +0000", " n <e>1 +0100", "<a>\n7\n-0030"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    rows = spark.createDataFrame([(x,) for x in lines], "l string").select("l", parsing.signature_column(F.col("l")).alias("s")).collect()
    for r in rows:
        try:
            want = tuple(parsing.parse_signature(r.l.encode()))
        except Malformed:
            want = None
        assert (None if r.s is None else tuple(r.s)) == want, r.l


def test_json_columns_are_json(spark):
    import json

    texts = ["".join(map(chr, range(128))), "é \x7f", "", "\\u000B", '"', "\x00"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.json_string(F.col("t")).alias("j")).collect()
    assert all(json.loads(r.j) == r.t and r.j == json_text({"k": r.t})[9:-3] for r in rows)


def test_nothing_is_left_in_the_shared_folder(spark, tmp_path):
    from tidemark.operators import lineage

    w = Writer(str(tmp_path))
    head = w.commit(w.files({"d/a": w.blob("1\n")}), [], "A", "a@x", NOW, "tip")
    place = lineage.shared_dir(spark).removeprefix("file://")
    before, began = set(os.listdir(place)), lineage.mark()
    h = P.read_history(spark, str(tmp_path), head)
    assert len(set(os.listdir(place)) - before) == 4 and h.changes.count() == 1
    lineage.release(spark, began)
    assert set(os.listdir(place)) == before


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from tidemark.operators.lineage import shared_dir

    session = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, applicationId="a"))
    assert shared_dir(session("local[2]")).startswith("file:///") and shared_dir(session("local[2]")) == shared_dir(session("local[2]"))
    for master in ("yarn", "spark://x:1", "local-cluster[1,1,512]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session(master))


def test_the_fixture_is_what_git_reads(tmp_path):
    """Git itself, where it is installed, finds the written repository sound."""
    import shutil
    import subprocess

    if not shutil.which("git"):
        pytest.skip("no git here")
    gitdata.build(str(tmp_path), [(k, f"n{k}", f"line {k}", f"r{k % 5}") for k in range(25)])
    os.remove(os.path.join(tmp_path, ".git", "objects", "dd", "d" * 38))
    done = subprocess.run(["git", "-c", "safe.directory=*", "fsck", "--full", "--no-dangling"], cwd=tmp_path, capture_output=True, text=True)
    assert "error" not in done.stderr.replace("missing", ""), done.stderr
    log = subprocess.run(["git", "-c", "safe.directory=*", "log", "--format=%s"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split("\n")
    assert log[0] == "merge" and len(log) == 28
