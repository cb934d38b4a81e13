"""Near-duplicate documents by circulant MinHash.

Method (C-MinHash, Li and Li 2021): a first permutation sigma scatters a shingle over a
universe of 2**32 places; a second permutation pi, circularly shifted by k, gives the k-th
signature coordinate, h_k(S) = min over s in S of pi(sigma(s) - k mod 2**32). Two
permutations so generate all coordinates. Coordinates go into bands; documents that agree
in a band are candidates; candidates are confirmed on their full shingle sets.

Candidates are not expanded into all pairs of a band's bucket:

1. Documents with equal sets form one class; its smallest doc_id stands for all.
2. Shingles that only one candidate has can't be shared: with n shingles, own of them its own, a
   document overlaps another in n - own at most. Documents that so can't reach the threshold
   with anything (texts that share a passage only, for one) go.
3. Each document is held against the most central document (least share of own shingles) of its
   buckets, one pair a document; then against that of each of its buckets, unless linked already.
4. The buckets of one central document (its hub) form a group. Where a group still holds several
   components, those outside its largest one are held against all others in tiles: blocks of
   members with ``TILE`` shingles or so a side, whose overlaps a task counts at once, exactly.
   A tile gives only links that join components, fewer than it has members. No bucket is capped.

Rows are linear in a bucket's members but for the blocks that a member is sent to: as many as the
members outside the largest component fill. The bands follow from the threshold (``bands_for``): of
160 coordinates a pair at the threshold shares a band but for a chance of ``MISS`` (at 0.8: 32 bands
of 5, missed with probability 3e-6). Links are decided exactly, ``100 * intersection >= percent *
union``, on sets of 64-bit shingle hashes (two different shingles of one pair coincide with probability 1e-13).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, is_empty, mix64, slices, written
from .hashing import BLANKS, Words, shingles

COORDINATES, MISS = 160, 1e-5
#: Shingles of a tile's side, about; one document with more of them makes a side of its own.
TILE = 1 << 16
_BLOCK = 1024
_words = Words(BLANKS, fold=True)


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows): the most selective bands that miss a pair at the threshold with a chance of MISS at most."""
    if not 0 < percent <= 100:
        raise ValueError("percent is over 0, to 100")
    t = percent / 100
    for rows in range(COORDINATES // 8, 0, -1):
        bands = COORDINATES // rows
        if (1 - t**rows) ** bands <= MISS:
            return bands, rows
    raise ValueError(f"{COORDINATES} coordinates can't find pairs at {percent} %")


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """The first k coordinates of a non-empty set of 64-bit shingles."""
    placed = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(1, k + 1, dtype=np.uint32)[:, None]
    least = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(placed), _BLOCK):
        x = placed[None, at : at + _BLOCK] - shift  # circular shift; then pi, a bijection of 2**32
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = mix64(np.arange(1, bands + 1, dtype=np.uint64))
    for column in sig.reshape(bands, rows).T:
        acc = mix64(acc ^ column.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return acc.view(np.int64)


def _sets_of(batch, n: int) -> list[np.ndarray]:
    return [shingles(_words(t or b"")[0], n) for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _signatures(batches, n: int, bands: int, rows: int):
    for batch in slices(batches, "text"):
        sets = _sets_of(batch, n)
        size = pa.array([len(s) for s in sets], pa.int64())
        key = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
        keys = pa.array([band_keys(signature(s, bands * rows), bands, rows) if len(s) else None for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, key, keys], ["doc_id", "n_shingles", "set_key", "bands"])


def _sets(batches, n: int):
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in _sets_of(batch, n)], pa.binary())], ["doc_id", "shingles"])


def _confirm(batches, percent: int):
    for batch in slices(batches, "x"):
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= percent * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets confirm the link."""
    left = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    size = F.octet_length
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y")
    # sizes alone rule out most chance pairs
    both = both.filter(
        (size("x") * 100 >= size("y") * percent) & (size("y") * 100 >= size("x") * percent)
    )
    return both.mapInArrow(lambda it: _confirm(it, percent), "a long, b long")


def _labelled(frame: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    known = labels.select(F.col("node").alias(column), F.col("root").alias(out))
    return frame.join(known, column, "left").withColumn(out, F.coalesce(out, column))


def _shingles(batches):
    """(shingle, doc) of every set."""
    for batch in slices(batches, "shingles"):
        found = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        docs = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(docs)], ["shingle", "doc"])


def _own(sets: DataFrame) -> DataFrame:
    """doc, own: how many of its shingles no other document has; no row where there are none, nor for a doc_id of several texts."""
    each = sets.mapInArrow(_shingles, "shingle long, doc long").groupBy("shingle").agg(F.count("*").alias("c"), F.min("doc").alias("doc"))
    texts = sets.groupBy(F.col("doc_id").alias("doc")).agg(F.count("*").alias("texts")).filter("texts > 1")
    return each.filter("c = 1").groupBy("doc").agg(F.count("*").alias("own")).join(texts, "doc", "left_anti")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, by products of their incidence matrices."""
    sides = []
    for sets in (left, right):
        flat = np.concatenate(sets)
        sides.append((flat, np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    common = np.intersect1d(sides[0][0], sides[1][0])
    total = np.zeros((len(left), len(right)), np.float32)  # exact up to 2**24 shingles
    places = [(np.searchsorted(common, flat), flat, owner) for flat, owner in sides]
    places = [(at[hit], owner[hit]) for at, flat, owner in places for hit in [(at < len(common)) & (common[np.minimum(at, len(common) - 1)] == flat)]] if len(common) else []
    for first in range(0, len(common), 4 * _BLOCK):
        width = min(4 * _BLOCK, len(common) - first)
        matrix = []
        for (at, owner), sets in zip(places, (left, right), strict=True):
            some = (at >= first) & (at < first + width)
            m = np.zeros((len(sets), width), np.float32)
            m[owner[some], at[some] - first] = 1
            matrix.append(m)
        total += matrix[0] @ matrix[1].T
    return total


def spanning(docs: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) between rows of side 0 and of side 1 (of side 0 alone, if there is no other) that join components, a spanning forest of them."""
    one, two = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    if not len(one):
        return []
    two = two if len(two) else one
    both = overlaps([sets[k] for k in one], [sets[k] for k in two])
    size = np.array([len(s) for s in sets], np.float64)
    linked = 100 * both >= percent * (size[one][:, None] + size[two][None] - both)
    linked &= roots[one][:, None] != roots[two][None]
    out, parent = [], {r: r for r in roots.tolist()}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(*(side[at].tolist() for side, at in zip((one, two), np.nonzero(linked), strict=True)), strict=True):
        p, q = top(int(roots[x])), top(int(roots[y]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(docs[x]), int(docs[y])))
    return out


def _tile(table: pa.Table, percent: int) -> pa.Table:
    column = lambda c: table.column(c).to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    found = spanning(column("doc"), column("root"), sets, column("side"), percent)
    return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})


def _across(grouped: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of a group; grouped: hub, doc, n."""
    rows = _labelled(grouped, labels, "doc", "root")
    parts = rows.groupBy("hub", "root").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    parts = parts.groupBy("hub").agg(
        F.count("*").alias("roots"), F.max_by("root", F.struct("docs", "root")).alias("major"),
        F.max_by("n", F.struct("docs", "root")).alias("major_n"), F.sum("n").alias("n_all"),
    ).filter("roots > 1")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(TILE))).cast("int")
    parts = parts.select("hub", "major", blocks(F.col("major_n")).alias("majors"), blocks(F.col("n_all") - F.col("major_n")).alias("minors"))
    rows = rows.join(parts, "hub")
    # members outside the largest component meet each other (kind 0) and those inside (kind 1)
    inside = F.col("root") == F.col("major")
    mine = F.pmod(F.xxhash64("doc"), F.when(inside, F.col("majors")).otherwise(F.col("minors"))).cast("int")
    rows = rows.select("hub", "doc", "root", "majors", "minors", inside.alias("inside"), mine.alias("mine"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    me = F.col("mine")
    place = lambda i, j, kind, side: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), side.alias("side"))
    among = F.transform(upto("minors"), lambda o: place(F.least(me, o), F.greatest(me, o), 0, (me > o).cast("int")))
    against = F.transform(upto("majors"), lambda o: place(me, o, 1, F.lit(0)))
    within = F.transform(upto("minors"), lambda o: place(o, me, 1, F.lit(1)))
    rows = rows.select("hub", "doc", "root", F.explode(F.when(F.col("inside"), within).otherwise(F.concat(among, against))).alias("p"))
    tiles = rows.join(sets.withColumnRenamed("doc_id", "doc"), "doc").select("hub", "p.i", "p.j", "p.kind", "p.side", "doc", "root", "shingles")
    # tiles are of one size: as many tasks as there are partitions, whatever adaptive execution makes of their bytes
    tiles = tiles.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "hub", "i", "j", "kind")
    return tiles.groupBy("hub", "i", "j", "kind").applyInArrow(lambda table: _tile(table, percent), "a long, b long")


def near_duplicates(docs: DataFrame, ngram: int = 5, percent: int = 80, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """For each row of docs (doc_id, text, any other columns): doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased, words are runs of other than ASCII white space, a document's set holds
    its distinct ngram-word shingles (with fewer words the whole sequence as one). Documents are
    linked if ``100 * intersection >= percent * union``; component_id is the smallest doc_id
    reachable over links, kept tells whether the document is that one. bands and rows of a band follow
    from percent unless given; a percent that no bands can serve is a ValueError.

    Null or blank texts have the empty set and are linked with nothing. Rows that share a doc_id
    are one document for linking, each with its own n_shingles. A null doc_id is linked with
    nothing: component_id null, kept true. Other columns are ignored, whatever their names.
    An empty table gives no rows.
    """
    if bands is None or rows is None:
        bands, rows = bands_for(percent)
    docs = docs.select("doc_id", "text")
    sig = written(docs.mapInArrow(lambda it: _signatures(it, ngram, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signatures")
    sets_of = sig.filter("set_key is not null and doc_id is not null")
    classes = written(sets_of.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    heads = sets_of.join(classes, "set_key").filter("doc_id = rep").dropDuplicates(["doc_id", "set_key"])
    banded = heads.select(F.explode("bands").alias("key"), F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"))
    # equal sets under several doc_ids are links already; rows of one doc_id join its classes
    same = sets_of.join(classes, "set_key").filter("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = [same]
    several = lambda rows: rows.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("key")
    members = written(banded.join(several(banded), "key"), "members")
    if not is_empty(members):
        needed = members.select(F.col("doc").alias("doc_id")).distinct()
        sets = docs.join(needed, "doc_id", "left_semi").mapInArrow(lambda it: _sets(it, ngram), "doc_id long, shingles binary")
        sets = written(sets.filter(F.octet_length("shingles") > 0).dropDuplicates(["doc_id", "shingles"]), "sets")
        members = members.join(_own(sets), "doc", "left").fillna(0, ["own"])
        members = written(members.filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent), "members")
        central = F.struct((F.col("own") / F.col("n")).alias("share"), "doc")
        hubs = members.groupBy("key").agg(F.min(central).alias("hub"), F.max(central).alias("last")).filter("hub.doc != last.doc")
        grouped = members.join(hubs.select("key", "hub"), "key").groupBy("hub", "doc").agg(F.max("n").alias("n"))
        grouped = written(grouped, "grouped")
        stars = grouped.filter("doc != hub.doc")

        first = stars.groupBy("doc").agg(F.min("hub").alias("hub")).select(F.col("hub.doc").alias("a"), F.col("doc").alias("b"))
        first = written(_linked(first, sets, percent), "first")
        tied = first.select(F.col("b").alias("node"), F.col("a").alias("root"))
        rest = stars.select(F.col("hub.doc").alias("a"), F.col("doc").alias("b")).distinct()
        rest = _labelled(_labelled(rest, tied, "a", "ra"), tied, "b", "rb").filter("ra != rb").select("a", "b")
        second = written(_linked(rest, sets, percent), "second")
        near = first.union(second)
        labels = written(components(near, "a", "b"), "labels")
        groups = grouped.select(F.col("hub.doc").alias("hub"), "doc", "n")
        links += [near, written(_across(groups, sets, labels, percent), "across")]
    all_links = links[0]
    for more in links[1:]:
        all_links = all_links.union(more)
    final = components(all_links, "a", "b")
    out = _labelled(sig.select("doc_id", "n_shingles").filter("doc_id is not null"), final, "doc_id", "component_id")
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    alone = sig.filter("doc_id is null").select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")
    )
    return out.union(alone)


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group of near-duplicates (its smallest doc_id); columns as given.

    Rows that repeat both doc_id and text count as one document. Rows without a doc_id stay, all of them.
    """
    gone = near_duplicates(docs, **how).filter(~F.col("kept")).select("doc_id").distinct()
    known = docs.filter("doc_id is not null").join(gone, "doc_id", "left_anti").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return known.union(docs.filter("doc_id is null"))
