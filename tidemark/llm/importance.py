"""Quality by importance resampling (DSIR, Xie et al. 2023).

Two generative models over hashed word uni- and bigrams, one of target texts (labelled good and
not toxic), one of the raw corpus; a text's log importance is the mean over its n-grams of the
log ratio of the two, times ``GRAMS`` (texts of all lengths count as samples of that many
n-grams, as the method draws its examples at one length). Documents are drawn without
replacement by Gumbel top-k: log importance plus Gumbel noise, the k greatest stay. The noise
comes from a hash of doc_id and seed, so that a lost task draws the same again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, slices, written
from .hashing import BLANKS, PUNCTUATION, Words

BUCKETS = 1 << 16
GRAMS = 200
#: The target model is fitted on so many good labelled documents at most: the default of most_targets.
MOST_TARGETS = 100_000
#: Counts that each bucket has in advance, spread like the raw text: keeps rare n-grams at a ratio near 1.
PRIOR = 10.0
_BINS = 1024
_word, _mark = Words(PUNCTUATION, fold=False), Words(bytes(sorted(set(range(256)) - set(PUNCTUATION) | set(BLANKS))), fold=False)


def features(text: bytes | None) -> np.ndarray:
    """Buckets of all uni- and bigrams of a text's tokens: runs of letters and digits, and runs of punctuation."""
    words, at, _ = _word(text or b"")
    marks, also, _ = _mark(text or b"")
    words = np.concatenate([words, marks])[np.argsort(np.concatenate([at, also]), kind="stable")]
    both = np.concatenate([gram_hashes(words, 1), gram_hashes(words, 2)])
    return (both >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _texts(batch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _count(batches, targets):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    good = targets.value
    for batch in slices(batches, "text"):
        found = [features(text) for text in _texts(batch)]
        raw += np.bincount(np.concatenate(found), minlength=BUCKETS)
        aimed = [x for i, x in zip(batch.column("doc_id").to_pylist(), found, strict=True) if i in good]
        if aimed:
            target += np.bincount(np.concatenate(aimed), minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, most_targets: int = MOST_TARGETS) -> np.ndarray:
    """The log ratio of target to raw model of each bucket. Raw counts cover every row of docs (doc_id, text).

    The target model is fitted on most_targets good labelled documents at most, those of least hash. labels: doc_id, quality, toxic; rows with nulls say nothing. Without target texts all ratios are 0.
    """
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_targets).collect()
    targets = docs.sparkSession.sparkContext.broadcast(frozenset(r.doc_id for r in good))
    counts = docs.select("doc_id", "text").mapInArrow(lambda it: _count(it, targets), "bucket int, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BUCKETS rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + PRIOR) / (raw * (target.sum() / raw.sum()) + PRIOR))


def _score(batches, ratio):
    for batch in slices(batches, "text"):
        n, value = [], []
        for text in _texts(batch):
            found = features(text)
            n.append(len(found))
            value.append(float(ratio.value[found].mean() * GRAMS) if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(value, pa.float64())], ["doc_id", "n_grams", "log_weight"])


def _nth(rows: DataFrame, column: str, need: int) -> tuple[float, int]:
    """(the need-th greatest value of a column without nulls, how many rows are greater), by ever narrower histograms.

    At most _BINS counts, or 10 * _BINS values, reach the driver at a time.
    """
    value, passed = F.col(column), 0
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = ends.lo, ends.hi
    while lo < hi:
        inside = rows.filter(value.between(lo, hi))
        few = [r[0] for r in inside.select(column).limit(10 * _BINS + 1).collect()]
        if len(few) <= 10 * _BINS:
            lo = hi = sorted(few, reverse=True)[need - passed - 1]
            break
        width = (float(hi) - float(lo)) / _BINS
        at = F.least(F.floor((value.cast("double") - F.lit(float(lo))) / F.lit(width)), F.lit(_BINS - 1))
        bins = {r.b: r for r in inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            lo, hi = bins[b].lo, bins[b].hi
            if need <= passed + bins[b].n:
                break
            passed += bins[b].n
    return lo, rows.filter(value > F.lit(lo)).count()


def _cutoff(scored: DataFrame, k: int) -> tuple[float, int | None]:
    """(key, doc_id) of the k-th row by key, descending, then doc_id, null last."""
    key, before = _nth(scored, "key", k)
    ties = scored.filter((F.col("key") == key) & F.col("doc_id").isNotNull())
    known = ties.count()
    if known < k - before:
        return key, None  # it is a row without an id
    return key, _nth(ties, "doc_id", known - (k - before) + 1)[0]


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, seed: int = 1, most_targets: int = MOST_TARGETS) -> DataFrame:
    """The documents drawn: doc_id, n_grams, log_weight, key, kept (true).

    k is ``fraction`` of the rows that have words, by default the share of quality 1 among labels. Texts that are null or have no word are never drawn. Rows that
    repeat a doc_id share its noise, and so do those without one; rows equal in key and id to the last drawn are all drawn.
    An empty table, or labels without rows and no fraction, draws nothing.
    """
    if fraction is None:
        fraction = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0] or 0.0
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most_targets))  # BUCKETS numbers
    scored = docs.select("doc_id", "text").mapInArrow(lambda it: _score(it, ratio), "doc_id long, n_grams long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    scored = scored.filter("n_grams > 0").withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))
    scored = written(scored, "importance")
    k = round(fraction * scored.count())
    if not k:
        return scored.limit(0).withColumn("kept", F.lit(True))
    key, last = _cutoff(scored, k)
    tie = F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= last, F.lit(False))
    return scored.filter((F.col("key") > key) | ((F.col("key") == key) & tie)).withColumn("kept", F.lit(True))
