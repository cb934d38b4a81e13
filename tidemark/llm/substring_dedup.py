"""Repeated passages by seed and extend.

1. Seeds: of every ``window - SEED + 1`` consecutive seed grams (SEED words each) the one with
   the least hash is an anchor (winnowing). The choice depends on the window's words alone, so
   two equal windows choose the same anchor at the same place.
2. Anchors that occur more than once, anywhere, are joined back to their documents.
3. Extend: each such anchor is extended both ways, by up to ``window - SEED`` words, to the
   windows that contain it; a window whose words start anywhere else too is a repeat.
   Overlapping repeats merge into the maximal ones, which are removed.

Nothing is compared pairwise: occurrences meet in counts by hash, so a passage in a third of
all documents costs as many rows as it has occurrences. Texts are equal or not as 64-bit
window hashes: of n candidate windows about n*n / 2**65 pairs coincide by chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, slices
from .hashing import BLANKS, Words

SEED = 8
_words = Words(BLANKS, fold=False)


def anchors(hashes: np.ndarray, window: int, seed: int = SEED) -> np.ndarray:
    """Positions of the anchors of a text's word hashes, each once, in order."""
    grams, span = gram_hashes(hashes, seed), window - seed + 1
    if len(grams) < span:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    found = [views[at : at + 8192].argmin(axis=1) + np.arange(at, min(at + 8192, len(views))) for at in range(0, len(views), 8192)]
    return np.unique(np.concatenate(found))


def spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of words covered by windows at these sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    first, last = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + window
    return list(zip(first.tolist(), last.tolist(), strict=True))


def _texts(batch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _seeds(batches, window: int):
    """(key, anchor, often): each distinct anchor of a text once; often: it is there more than once."""
    for batch in slices(batches, "text"):
        keys, all_hashes, often = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), _texts(batch), strict=True):
            hashes = _words(text)[0]
            found, times = np.unique(gram_hashes(hashes, SEED)[anchors(hashes, window)], return_counts=True)
            keys += [key] * len(found)
            all_hashes.append(found.view(np.int64))
            often.append(times > 1)
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(np.concatenate(all_hashes)), pa.array(np.concatenate(often))], ["key", "anchor", "often"]
            )


def _windows(batches, window: int):
    """(key, hash, often) of each distinct window that holds an anchor known to repeat."""
    for batch in slices(batches, "text"):
        keys, found, often = [], [], []
        for key, text, seeds in zip(batch.column(0).to_pylist(), _texts(batch), batch.column(2), strict=True):
            hashes = _words(text)[0]
            at = anchors(hashes, window)
            at = at[np.isin(gram_hashes(hashes, SEED)[at].view(np.int64), seeds.values.to_numpy())]
            near = np.zeros(len(hashes) - window + 2, np.int64)
            np.add.at(near, np.maximum(at - (window - SEED), 0), 1)
            np.add.at(near, np.minimum(at, len(near) - 2) + 1, -1)
            held = gram_hashes(hashes, window)[np.cumsum(near)[:-1] > 0]
            held, times = np.unique(held, return_counts=True)
            keys += [key] * len(held)
            found.append(held.view(np.int64))
            often.append(times > 1)
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(np.concatenate(found)), pa.array(np.concatenate(often))], ["key", "hash", "often"]
            )


def _cut(batches, window: int, texts: bool):
    for batch in slices(batches, "text"):
        rows = []
        for text, copies, repeats in zip(_texts(batch), batch.column(2).to_pylist(), batch.column(3), strict=True):
            hashes, starts, ends = _words(text)
            n = len(hashes)
            if copies > 1 and n >= window:  # every window starts in the copy too
                where = [(0, n)]
            elif repeats.is_valid and len(repeats.values):
                mine = gram_hashes(hashes, window).view(np.int64)
                where = spans(np.flatnonzero(np.isin(mine, repeats.values.to_numpy())), window)
            else:
                where = []
            stays = np.ones(n, bool)
            for a, b in where:
                stays[a:b] = False
            kept = b" ".join([text[a:b] for a, b in zip(starts[stays].tolist(), ends[stays].tolist(), strict=True)])
            rows.append(
                (n, n - int(stays.sum()), hashlib.sha256(kept).hexdigest(), [{"first": a, "last": b} for a, b in where], kept.decode() if texts else None)
            )
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_CUT.values())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_CUT])


_CUT = {
    "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(),
    "repeats": pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), "kept": pa.string(),
}


def _recurring(found: DataFrame, column: str) -> DataFrame:
    """(key, all of its values of column that start elsewhere too): with another key, or often with one."""
    counts = found.groupBy(column).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("often").alias("often"))
    shared = counts.filter("often or lo < hi").select(column)
    return found.select("key", column).join(shared, column).groupBy("key").agg(F.collect_set(column).alias(column))


def remove_repeats(docs: DataFrame, window: int = 35, texts: bool = True) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, repeats, kept.

    Words are runs of other than ASCII white space, unchanged. Each word covered by a window of
    ``window`` words whose sequence also starts anywhere else (same text included) is removed.
    ``kept`` has the other words joined by one space (null unless texts), kept_sha256 its digest,
    ``repeats`` the maximal removed runs [first, last) in words. Windows are judged on the input.
    A null text has no words and keeps the empty string. Rows with equal texts are copies of each
    other, whatever their doc_ids; null and repeated ids come back as they are. Other columns are
    ignored. An empty table gives no rows. window must be over SEED.
    """
    if window <= SEED:
        raise ValueError(f"window must be over {SEED}")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("key"), text.alias("text"), F.md5(text).alias("digest"), "doc_id")
    # copies are told by both hashes; of each only the row with the least id gives windows
    copies = rows.groupBy("key", "digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    copies = copies.groupBy("key").agg(F.collect_list(F.struct("digest", "copies", "rep")).alias("kinds"))
    kind = F.element_at(F.filter("kinds", lambda k: k["digest"] == F.col("digest")), 1)

    seeds = rows.select("key", "text").mapInArrow(lambda it: _seeds(it, window), "key long, anchor long, often boolean")
    marked = copies.join(_recurring(seeds, "anchor"), "key")
    near = rows.join(marked, "key").filter(F.col("doc_id").eqNullSafe(kind["rep"]))
    held = near.select("key", "text", "anchor").mapInArrow(lambda it: _windows(it, window), "key long, hash long, often boolean")
    marked = copies.join(_recurring(held, "hash"), "key", "left")
    final = rows.join(marked, "key").select("doc_id", "text", kind["copies"].alias("copies"), "hash")
    return final.mapInArrow(
        lambda it: _cut(it, window, texts),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<first: long, last: long>>, kept string",
    )
