"""Near-duplicates against all pairs in Python, and the odd inputs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

import numpy as np
import pytest

from tidemark.llm import near_dedup
from tidemark.llm.near_dedup import bands_for, keep_one, near_duplicates, overlaps, spanning


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        m = min(n, len(w))
        sets[i] = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in by[s]:
                common[j] += 1
            by[s].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies(seed=5, groups=12, size=14, words=60):
    """Groups of edited copies, from nearly equal to just below the threshold."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{g}x{rng.randrange(500)}" for _ in range(words)]
        for k in range(size):
            text = base[:]
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(words)] = f"e{rng.randrange(40)}"
            rows.append((g * 100 + k, " ".join(text)))
    return rows


def test_against_all_pairs(spark):
    rows = copies() + [(9000, "One two THREE"), (9001, "one Two three"), (9002, "one two"), (9003, "É a"), (9004, "é a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (4, 5):
        out = near_duplicates(docs, ngram=n, percent=80).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, n, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \t\n", 7), (None, "a b c d e f", 7), (4, "a b c d e f", 7), (5, "A b c d e f", 7), (5, "A b c d e f", 7),
            (None, None, 7), (6, "x " * 30_000, 7), (7, "x " * 30_000 + "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long").withColumn("component_id", F.lit("clash")).withColumn("bands", F.lit(1))
    out = near_duplicates(docs, ngram=4)
    assert out.count() == len(rows)
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in out.collect()}
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(3, 0)] == (3, True)
    assert got[(None, 3)] == (None, True) and got[(None, 0)] == (None, True)
    assert got[(4, 3)] == (4, True) and got[(5, 3)] == (4, False)
    assert got[(6, 1)] == (6, True) and got[(7, 2)] == (7, True)
    kept = keep_one(docs, ngram=4)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7]


def test_empty_and_twins(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0
    twins = spark.createDataFrame([(3, "same words here"), (2, "same words here"), (1, "other")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(twins).collect()) == [(1, 1), (2, 2), (3, 2)]


@pytest.mark.parametrize("percent", [50, 65, 95])
def test_other_thresholds(spark, percent):
    rows = copies(seed=percent, groups=8, words=40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    assert got == brute(rows, 5, percent)


def test_bands_follow_from_the_threshold():
    assert bands_for(80) == (32, 5)
    for percent in range(8, 101):
        bands, rows = bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISS and bands * rows <= near_dedup.COORDINATES
    for percent in (0, 1, 101):
        with pytest.raises(ValueError):
            bands_for(percent)


def family(n=400, words=50):
    """One group of copies of one text, many of them edited too much to be linked to it, some linked among themselves."""
    rng = random.Random(11)
    base, rows = [f"w{k}" for k in range(words)], []
    for i in range(n):
        text, r = base[:], random.Random(i // 3)
        for _ in range(r.randrange(5)):
            text[r.randrange(words)] = f"e{r.randrange(6)}"
        if rng.random() < 0.5:
            text[rng.randrange(words)] = f"f{rng.randrange(4)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("tile", [1 << 16, 600])
def test_a_large_group_gives_links_in_proportion(spark, monkeypatch, tile):
    rows, across, handed = family(), [], []
    monkeypatch.setattr(near_dedup, "TILE", tile)
    plain = near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda *a: across.append(plain(*a)) or across[0])
    linked = near_dedup._linked
    monkeypatch.setattr(near_dedup, "_linked", lambda pairs, *a: handed.append(pairs.count()) or linked(pairs, *a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ngram=4).collect()}
    assert got == brute(rows, 4, 80)
    assert len({c for _, c in got.values()}) > 40  # components in the one group
    # of the 79,800 pairs: no more than a few for each document
    assert sum(handed) <= 33 * len(rows) and 0 < across[0].count() <= len(rows) * (1 if tile > 600 else 33)


def test_tiles_count_overlaps_exactly():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000))).astype(np.uint64) for _ in range(9)]
    want = [[len(np.intersect1d(x, y)) for y in sets[4:]] for x in sets[:4]]
    assert overlaps(sets[:4], sets[4:]).tolist() == want
    same = [sets[0], sets[0], sets[1]]
    assert spanning(np.array([5, 6, 7]), np.array([5, 6, 7]), same, np.array([0, 0, 0]), 80) == [(5, 6)]
    assert spanning(np.array([5, 6, 7]), np.array([5, 5, 7]), same, np.array([0, 1, 1]), 80) == []
    assert spanning(np.array([5]), np.array([5]), same[:1], np.array([1]), 80) == []


def test_rows_without_an_id_all_stay(spark):
    docs = spark.createDataFrame([(None, "same words here now"), (None, "same words here now"), (1, "same words here now"), (1, "same words here now")], "doc_id long, text string")
    assert sorted(keep_one(docs).collect(), key=repr) == sorted([(1, "same words here now"), (None, "same words here now"), (None, "same words here now")], key=repr)
