"""Benchmark decontamination: seeds of word pairs, then Smith-Waterman alignment.

1. A seed is a pair of an item's neighbouring words; a document has it where the two stand side by
   side or with one word between. Every item's seeds are counted over the corpus, by documents.
2. Each edit of a copy costs score, so an alignment that reaches ``THRESHOLD`` keeps a number of the
   item's pairs, ``Items.need``, within a number of words, ``Items.width``. A document is compared
   with an item only where it has so many; no alignment that reaches the threshold is lost. The most
   frequent pairs are left out and the number lowered by as many, so that it stays 1 at least.
3. The passages around such hits are aligned with the item word by word (match 2, mismatch and gap
   -1, local). A passage leaks an item if the score reaches ``THRESHOLD`` of what the whole item
   would score.

With n words, a least score c and k words of the item unmatched, matches are n - k and edits at most
2 (n - k) - c. An unmatched word costs an edit and breaks two pairs, or at an end none and one; a pair
of matched words is broken by two inserted words. So at most 2 (2 n - c) / 3 pairs are broken. Where
no pair need be left (three words or fewer, or a low threshold) the seeds are single words, of which
c / 2 are matched. Matches and edits are 3 n - c at most, which is the width.

Words are runs of letters and digits, lower-cased in ASCII. Items of ``MOST_BLOCKS`` blocks of
``BLOCK_CHARS`` characters are looked up: each block is sent to executors, for two passes over the
documents. More items meet the documents in a join on their rare seeds, in four passes however many
there are: of an item's pairs the most frequent are left out, ``need`` less one, so that a copy still
has one of the rest. A seed that many items and many documents have would join all with all; the
items that can't do without such a seed are looked up in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, gram_hashes, slices, written
from .hashing import PUNCTUATION, Words

THRESHOLD = 0.5
BLOCK_CHARS = 16_000_000
#: Blocks that are looked up one by one; beyond that, the join.
MOST_BLOCKS = 4
#: Items, and documents, that may share a seed of the join: where both are more, its items are looked up.
MOST_SHARED = 64
#: 64-bit words of the join's filter at most (32 MB), and items in a row of its last step.
FILTER_WORDS, ITEMS_A_ROW = 1 << 22, 50
_words = Words(PUNCTUATION, fold=True)


def align(item: np.ndarray, passage: np.ndarray, stop: float = 0.0) -> tuple[int, int, int]:
    """Best local alignment of two sequences of word hashes: (score, first, last) in passage, last exclusive.

    A cell's best over gaps in its own row comes from a running maximum, so that a row is a few
    vector operations. The first word is that of the best path's start.
    """
    m = len(passage)
    column = np.arange(m + 1)
    score, start = np.zeros(m + 1, np.int64), column.copy()
    best = (0, 0, 0)
    for word in item:
        step = score[:-1] + np.where(passage == word, 2, -1)
        up = score - 1
        new, begin = up, start
        better = step >= new[1:]
        new, begin = new.copy(), begin.copy()
        new[1:][better], begin[1:][better] = step[better], start[:-1][better]
        low = new <= 0
        new[low], begin[low] = 0, column[low]
        line = new + column
        top = np.maximum.accumulate(line)
        source = np.maximum.accumulate(np.where(line == top, column, 0))
        score, start = top - column, begin[source]
        dead = score <= 0
        score[dead], start[dead] = 0, column[dead]
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at)
    return best


def _seeds(words: np.ndarray, single: bool) -> list[tuple[np.ndarray, int, int]]:
    """The seeds that a text has, as runs (hashes, first position, step); single: whether words count too."""
    found = [(gram_hashes(words, 2), 0, 1), (gram_hashes(words[::2], 2), 0, 2), (gram_hashes(words[1::2], 2), 1, 2)]
    return [*found, (gram_hashes(words, 1), 0, 1)] if single else found


class Items:
    """A block of test items with their seeds, sorted, as one lookup."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float = THRESHOLD):
        self.ids = [i for i, _ in items]
        self.words = [_words(t)[0] for _, t in items]
        self.least = [math.ceil(threshold * 2 * len(w)) for w in self.words]
        size = np.array([len(w) for w in self.words], np.int64)
        least = np.array(self.least, np.int64)
        pairs = size - 1 - 2 * (2 * size - least) // 3
        self.single = pairs < 1
        self.need = np.where(self.single, np.maximum(1, (least + 1) // 2), pairs)
        self.width = 3 * size - least
        grams, owners, times = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, w in enumerate(self.words):
            own, n = np.unique(gram_hashes(w, 1 if self.single[at] else 2), return_counts=True)
            grams.append(own)
            owners.append(np.full(len(own), at))
            times.append(n)
        order = np.argsort(np.concatenate(grams), kind="stable")
        self._keep(*(np.concatenate(x)[order] for x in (grams, owners, times)))

    def _keep(self, grams: np.ndarray, items: np.ndarray, times: np.ndarray) -> None:
        self.grams, self.items, self.times = grams, items, times
        self.runs = np.searchsorted(grams, grams, "right") - np.arange(len(grams))

    def rare(self, counts: dict[int, int] | tuple[np.ndarray, np.ndarray]) -> Items:
        """Only the seeds that occur, and of these up to half of what need allows left out, the most frequent first.

        counts: documents by gram (signed), a dict or two arrays.
        """
        known, n = counts if isinstance(counts, tuple) else (np.array([*counts.keys()], np.int64), np.array([*counts.values()], np.int64))
        often, at = np.zeros(len(self.grams), np.int64), np.argsort(known)
        if len(known):
            place = np.minimum(np.searchsorted(known[at], self.grams.view(np.int64)), len(known) - 1)
            often = np.where(known[at][place] == self.grams.view(np.int64), n[at][place], 0)
        order = np.lexsort((-often, self.items))
        bounds = np.searchsorted(self.items[order], np.arange(len(self.ids) + 1))
        keep = often > 0
        for at, (first, last) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            mine = order[first:last]
            lost = np.cumsum(self.times[mine])  # no alignment has lost more pairs than that
            out = int(np.searchsorted(lost, (self.need[at] - 1) // 2, "right"))
            if out:
                keep[mine[:out]] = False
                self.need[at] -= lost[out - 1]
        self._keep(self.grams[keep], self.items[keep], self.times[keep])
        return self

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, first index into grams) of each seed that a text has; a pair's position is its first word's."""
        where, index = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for grams, first, step in _seeds(words, bool(self.single.any())) if len(self.grams) else ():
            at = np.searchsorted(self.grams, grams)
            at[at == len(self.grams)] = 0
            some = np.flatnonzero(self.grams[at] == grams)
            where.append(first + step * some)
            index.append(at[some])
        return np.concatenate(where), np.concatenate(index)

    def passages(self, words: np.ndarray) -> dict[int, list[list[int]]]:
        """For each item (its place), the passages [first, last) that can hold an alignment of the least score."""
        where, index = self.hits(words)
        runs = self.runs[index]
        entry = np.repeat(index - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        item, at = np.divmod(np.unique(self.items[entry] * len(words) + np.repeat(where, runs)), max(1, len(words)))
        end = np.arange(len(item)) + self.need[item] - 1
        inside = np.flatnonzero(end < len(item))
        end = end[inside]
        near = (item[end] == item[inside]) & (at[end] - at[inside] < self.width[item[inside]])
        inside, end = inside[near], end[near]
        width = self.width[item[inside]]
        first, last = np.maximum(0, at[end] + 1 - width), np.minimum(len(words), at[inside] + width)
        out: dict[int, list[list[int]]] = {}
        for k, a, b in zip(item[inside].tolist(), first.tolist(), last.tolist(), strict=True):
            mine = out.setdefault(k, [])
            if mine and a <= mine[-1][1]:
                mine[-1][1] = b
            else:
                mine.append([a, b])
        return out

    def leaks(self, text: bytes) -> list[tuple[int, float, int, int]]:
        """(item, score, first, last) for each item that the text leaks, its best passage in words."""
        words = _words(text)[0]
        out = []
        for at, passages in self.passages(words).items():
            item, least, best = self.words[at], self.least[at], (0, 0, 0)
            for first, last in passages:
                part = words[first:last]
                if 2 * int(np.isin(item, part).sum()) < least:
                    continue  # even with all common words in order the score stays below
                score, a, b = align(item, part)
                if score > best[0]:
                    best = (score, first + a, first + b)
            if best[0] >= least:
                out.append((self.ids[at], best[0] / (2 * len(item)), best[1], best[2]))
        return out


def _texts(batch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _count(batches, items):
    """(gram, documents that hold it), summed over a partition."""
    items = items.value
    total = np.zeros(len(items.grams), np.int64)
    for batch in slices(batches, "text"):
        for text in _texts(batch):
            total[np.unique(items.hits(_words(text)[0])[1])] += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(items.grams[some].view(np.int64)), pa.array(total[some])], ["gram", "n"])


def _leaks(batches, items):
    for batch in slices(batches, "text"):
        rows = [(i, *x) for i, t in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True) for x in items.value.leaks(t)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "score", "first", "last"])


def _clean(batches, items):
    for batch in slices(batches, "text"):
        yield batch.filter(pa.array([not items.value.leaks(t) for t in _texts(batch)], pa.bool_()))


def _some(frame: DataFrame) -> DataFrame:
    return frame.filter("text is not null and text != ''")


def _block_count(benchmark: DataFrame) -> int:
    return 1 + (_some(benchmark).agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS


def _blocks(docs: DataFrame, benchmark: DataFrame, threshold: float):
    """The seeds of each block of items, broadcast."""
    spark = docs.sparkSession
    items = _some(benchmark.select("item_id", "text"))
    n = _block_count(items)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect() if n > 1 else items.distinct().collect()
        block = Items(sorted(((r.item_id, r.text.encode()) for r in rows), key=lambda r: (r[0] is None, r)), threshold)
        if not len(block.grams):
            continue
        shipped = spark.sparkContext.broadcast(block)
        counts = docs.select("text").mapInArrow(lambda it, s=shipped: _count(it, s), "gram long, n long")
        counts = counts.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most the block's n-grams, 16 bytes each
        yield spark.sparkContext.broadcast(block.rare((counts.column("gram").to_numpy(), counts.column("n").to_numpy())))


# ---------------------------------------------------------------- the join


def _key() -> Column:
    return F.unhex(F.sha2("text", 256))


def _filter(grams: DataFrame) -> np.ndarray:
    """A Bloom filter of the column gram: three bits in one 64-bit word for each, a word for two to four grams while FILTER_WORDS allow."""
    words = min(FILTER_WORDS, 1 << max(6, (grams.count() // 4).bit_length()))
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(gram, {at}) & 63L as int))" for at in (0, 6, 12))
    rows = grams.groupBy(F.expr(f"shiftrightunsigned(gram, 20) & {words - 1}L").alias("word")).agg(F.expr(f"bit_or({bits})").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _passing(text: bytes, single: bool, bits: np.ndarray) -> np.ndarray:
    """The distinct seeds of a text that the filter lets through."""
    grams = np.concatenate([g for g, _, _ in _seeds(_words(text)[0], single)])
    asked = np.zeros(len(grams), np.uint64)
    for at in (0, 6, 12):
        asked |= np.uint64(1) << (grams >> np.uint64(at) & np.uint64(63))
    found = bits[grams >> np.uint64(20) & np.uint64(len(bits) - 1)]
    return np.unique(grams[found & asked == asked])


def _item_seeds(batches, threshold):
    """(item, gram, times, need, single) for each seed of each item."""
    for batch in slices(batches, "text"):
        block = Items(list(zip(batch.column("item").to_pylist(), _texts(batch), strict=True)), threshold)
        ids = np.array(block.ids, np.int64)
        own = [ids[block.items], block.grams.view(np.int64), block.times, block.need[block.items], block.single[block.items]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], ["item", "gram", "times", "need", "single"])


def _seed_counts(batches, bits, single):
    """(gram, documents that hold it) for each slice of texts."""
    for batch in slices(batches, "text"):
        grams, n = np.unique(np.concatenate([np.empty(0, np.uint64), *(_passing(t, single, bits.value) for t in _texts(batch))]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])


def _present(batches, bits, single):
    """(key, gram) for each text and each of its seeds."""
    for batch in slices(batches, "text"):
        found = [_passing(t, single, bits.value) for t in _texts(batch)]
        keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["key", "gram"])


def _aligned(batches, threshold):
    """(key, item, score, first, last) for each text and each of its row's items that it leaks."""
    for batch in slices(batches, "text"):
        keys, own, rows = batch.column("key").to_pylist(), batch.column("own"), []
        for at, text in enumerate(_texts(batch)):
            block = Items([(x["item"], x["item_text"].encode()) for x in own[at].as_py()], threshold)
            rows += [(keys[at], *x) for x in block.leaks(text)]
        kinds = (pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["key", "item", "score", "first", "last"])


def _by_seed(docs: DataFrame, benchmark: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(the items to be looked up, what distinct texts leak of the others: key, item_id, score, first, last).

    Equal items and equal texts are joined and aligned once. A pair of text and item comes from a seed that
    at most MOST_SHARED items or at most so many documents have, so pairs are linear in both tables.
    """
    spark = docs.sparkSession
    ship = spark.sparkContext.broadcast
    asked = _some(benchmark.select(F.col("item_id").cast("long"), "text")).distinct()
    items = written(asked.select("text").distinct().select(F.monotonically_increasing_id().alias("item"), "text"), "items")
    seeds = items.mapInArrow(lambda it: _item_seeds(it, threshold), "item long, gram long, times long, need long, single boolean")
    seeds = written(seeds, "seeds")
    single = bool(seeds.agg(F.max("single")).first()[0])
    texts = _some(docs.select("text")).select(_key().alias("key"), "text")

    bits = ship(_filter(seeds.select("gram").distinct()))
    often = texts.select("text").mapInArrow(lambda it: _seed_counts(it, bits, single), "gram long, n long")
    often = often.groupBy("gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("item").orderBy(F.desc("n"), "gram").rowsBetween(Window.unboundedPreceding, 0)
    rare = seeds.join(often, "gram").withColumn("lost", F.sum("times").over(order)).filter("lost >= need").select("gram", "item", "n")
    rare = written(rare, "rare")
    crowded = rare.groupBy("gram").agg(F.count("*").alias("m"), F.max("n").alias("n")).filter((F.col("m") > MOST_SHARED) & (F.col("n") > MOST_SHARED))
    looked_up = written(rare.join(crowded.select("gram"), "gram", "left_semi").select("item").distinct(), "crowded")
    rare = rare.join(looked_up, "item", "left_anti").select("gram", "item")

    kept = ship(_filter(rare.select("gram").distinct()))
    present = texts.mapInArrow(lambda it: _present(it, kept, single), "key binary, gram long").distinct()
    pairs = written(present.join(rare, "gram").select("key", "item").distinct(), "pairs")
    place = F.row_number().over(Window.partitionBy("key").orderBy("item"))
    rows = pairs.withColumn("part", F.floor((place - 1) / ITEMS_A_ROW)).join(items.withColumnRenamed("text", "item_text"), "item")
    rows = rows.groupBy("key", "part").agg(F.collect_list(F.struct("item", "item_text")).alias("own"))
    wanted = texts.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    leaks = wanted.join(rows, "key").select("key", "text", "own")
    leaks = leaks.mapInArrow(lambda it: _aligned(it, threshold), "key binary, item long, score double, first long, last long")
    names = asked.join(items, "text")
    leaks = written(leaks.join(names.select("item", "item_id"), "item").drop("item"), "leaks")
    return names.join(looked_up, "item", "left_semi").select("item_id", "text"), leaks


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each document and each item that it leaks: doc_id, item_id, score (0 to 1), first, last (words, last exclusive).

    docs has doc_id, text; benchmark item_id, text; other columns are ignored. Null and empty texts
    leak nothing, null and empty items are leaked by nothing. Repeated rows are reported as often as
    they are there. An empty table on either side gives no rows. Lookup and join give the same rows.
    """
    schema = "doc_id long, item_id long, score double, first long, last long"
    out = None
    if _block_count(benchmark) > MOST_BLOCKS:
        benchmark, found = _by_seed(docs, benchmark, threshold)
        out = docs.select(F.col("doc_id").cast("long"), _key().alias("key")).join(found, "key")
        out = out.select("doc_id", "item_id", "score", "first", "last")
    for seeds in _blocks(docs, benchmark, threshold):
        part = docs.select("doc_id", "text").mapInArrow(lambda it, s=seeds: _leaks(it, s), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that leak an item; columns as given."""
    out = docs
    if _block_count(benchmark) > MOST_BLOCKS:
        benchmark, found = _by_seed(docs, benchmark, threshold)
        (key,) = fresh(docs, "key")
        out = docs.withColumn(key, _key()).join(found.select(F.col("key").alias(key)).distinct(), key, "left_anti").select(*docs.columns)
    for seeds in _blocks(docs, benchmark, threshold):
        out = out.mapInArrow(lambda it, s=seeds: _clean(it, s), docs.schema)
    return out
