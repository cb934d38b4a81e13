"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's shingles (``SHINGLE`` words, lower-cased) are hashed once; the top bits of a hash
choose one of ``BINS`` bins, the least hash of a bin is its value. An empty bin takes the value
of the first filled bin on a walk of pseudo-random bins that depends on the empty bin alone:
optimal densification (Shrivastava 2017); there the value is hashed with the bin, so that one
value in many bins doesn't agree by chance in all of them at once. Of each value the low 4 bits
are stored, one hex digit a bin. Two fingerprints agree in a bin with probability J + (1 - J) / 16; likeness takes
the chance agreements off again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh

SHINGLE = 5
#: Bins of a fingerprint, a power of two; its length in hex digits.
BINS = 256
_SHIFT = 64 - BINS.bit_length() + 1
#: Documents that one bucket of the order by doc_id holds, about, up to MOST_BUCKETS buckets.
BUCKET_ROWS, MOST_BUCKETS = 100, 1 << 16


def _hashes(words: Column) -> Column:
    """Hash of each shingle of an array of words' hashes; with fewer words one of the whole."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(n >= SHINGLE, each).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, _SHIFT)


def _densified(dense: Column, filled: Column, b: Column) -> Column:
    """The value for empty bin b: of the first filled bin on its walk. After eight times the
    steps that a walk takes on average, the filled bin of least hash is taken instead.

    The walk is looked at in stretches of once, twice and five times that average: the next one
    only if the one before ends without a filled bin.
    """
    mean = F.ceil(F.lit(BINS) / F.greatest(F.size(filled), F.lit(1))).cast("int")
    walk = lambda first, last: F.aggregate(
        F.sequence(first, last), F.lit(None).cast("bigint"),
        lambda at, j: F.coalesce(at, F.get(dense, F.pmod(F.xxhash64(b, j), F.lit(BINS)).cast("int"))),
    )
    rest = F.array_min(F.transform(filled, lambda h: F.struct(F.xxhash64(b, _bin(h)).alias("o"), h.alias("h"))))
    return F.xxhash64(F.coalesce(walk(F.lit(1), mean), walk(mean + 1, 3 * mean), walk(3 * mean + 1, 8 * mean), rest["h"]), b)


def fingerprints(frame: DataFrame, text: str, out: str) -> DataFrame:
    """frame with column out: the fingerprint of column text, BINS hex digits; '' for a text without words.

    Words are runs of other than ASCII white space, lower-cased. Null texts count as empty.
    Equal texts have equal fingerprints.
    """
    words, ordered, filled, dense = fresh(frame, "words", "ordered", "filled", "dense")
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    frame = frame.withColumn(words, F.transform(split, lambda w: F.xxhash64(w)))
    frame = frame.withColumn(ordered, F.sort_array(_hashes(F.col(words)))).drop(words)
    # unsigned order of the bins isn't needed: equal bins lie together, a bin's least hash first
    first = lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(F.col(ordered), i - 1)))
    frame = frame.withColumn(filled, F.filter(F.col(ordered), first)).drop(ordered)
    # from the signed order to the bins' own: the negative hashes have the upper bins
    upper = F.size(F.filter(F.col(filled), lambda h: h < 0))
    frame = frame.withColumn(filled, F.concat(F.slice(filled, upper + 1, F.size(filled)), F.slice(F.col(filled), F.lit(1), upper)))
    none = F.lit(None).cast("bigint")
    gap = lambda h, i: F.coalesce(_bin(F.get(F.col(filled), i + 1)), F.lit(BINS)) - _bin(h) - 1
    runs = F.transform(F.col(filled), lambda h, i: F.concat(F.array(h), F.array_repeat(none, gap(h, i).cast("int"))))
    lead = F.array_repeat(none, F.coalesce(_bin(F.get(F.col(filled), F.lit(0))), F.lit(BINS)).cast("int"))
    frame = frame.withColumn(dense, F.concat(lead, F.flatten(runs)))
    digit = lambda h: F.substring(F.lit("0123456789abcdef"), (h.bitwiseAND(F.lit(15)) + 1).cast("int"), F.lit(1))
    packed = F.transform(F.col(dense), lambda h, b: digit(F.coalesce(h, _densified(F.col(dense), F.col(filled), b))))
    return frame.withColumn(out, F.when(F.size(filled) > 0, F.array_join(packed, "")).otherwise(F.lit(""))).drop(filled, dense)


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity, 0 to 1, of two fingerprints; null if either is null.

    Two empty ones are alike (1), an empty and another are not (0).
    """
    x, y = F.col(a), F.col(b)
    ones = F.lit(0x1111111111111111)
    sixteen = lambda s, k: F.conv(F.substring(s, 16 * k + 1, 16), 16, -10).cast("long")  # noqa: E731  digits as bits
    # a digit agrees where none of its four bits differs
    differ = lambda d: F.bit_count((d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))).bitwiseAND(ones))
    agree = F.lit(BINS)
    for k in range(BINS // 16):
        agree = agree - differ(sixteen(x, k).bitwiseXOR(sixteen(y, k)))
    corrected = (agree / F.lit(BINS) - F.lit(1 / 16)) / F.lit(1 - 1 / 16)
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).when(x.isNotNull() & y.isNotNull(), F.greatest(corrected, F.lit(0.0)))


def _numbers(values: list, kind: str) -> Column:
    """An array of numbers as one constant, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def with_next(frame: DataFrame, key: str, tie: str, carry: dict[str, str], prepare: Callable[[DataFrame], DataFrame] = lambda f: f) -> DataFrame:
    """frame with, from the next row in descending order of key (then tie), the columns carry as named there.

    After the last row comes the first again; null keys come last. The order is cut at quantiles of
    key (a sketch of them) into buckets, each a task's; a bucket also gets the first rows of the one
    after it. Only the quantiles and one row a bucket (MOST_BUCKETS at most) meet in one place. Rows of
    one key, and those without one, are in one bucket. prepare: columns to add once the rows are dealt
    to their buckets, so that they needn't be shuffled.
    """
    cuts = max(1, min(MOST_BUCKETS, frame.count() // BUCKET_ROWS))
    bounds = []
    if cuts > 1:
        shares = _numbers([k / cuts for k in range(1, cuts)], "double")
        found = frame.agg(F.percentile_approx(key, shares, max(10_000, 2 * cuts)).alias("q")).first().q
        bounds = sorted({*found}) if found else []
    bucket, to, top, place, inside = fresh(frame, "bucket", "to", "top", "place", "inside")
    # how many bounds are at most the key: binary search, from the largest step on
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    line = _numbers(bounds, "bigint")
    below = F.aggregate(
        F.array(*map(F.lit, steps)) if steps else F.array().cast("array<int>"), F.lit(0),
        lambda at, s: F.when(F.get(line, at + s - 1) <= F.col(key), at + s).otherwise(at),
    )
    frame = frame.withColumn(bucket, F.when(F.col(key).isNull(), -1).otherwise(below))
    tops = frame.groupBy(bucket).agg(F.max(key).alias(top))
    # the greatest key of each bucket is also the end of the bucket above it; of the highest bucket, of the lowest
    above = F.lead(bucket).over(Window.orderBy(bucket))
    lowest = F.min(bucket).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select(top, F.coalesce(above, lowest).alias(to))
    frame = frame.join(F.broadcast(tops), F.col(key).eqNullSafe(F.col(top)), "left").drop(top)  # MOST_BUCKETS rows
    places = F.array(F.struct(F.col(bucket).alias("b"), F.lit(False).alias("end")), F.struct(F.col(to).alias("b"), F.lit(True).alias("end")))
    frame = frame.withColumn(place, F.explode(F.filter(places, lambda p: p["b"].isNotNull()))).withColumn(inside, F.col(f"{place}.b"))
    # what follows is long work on few bytes: as many tasks as there are partitions, not as many as their bytes ask for
    frame = prepare(frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), inside))
    order = Window.partitionBy(inside).orderBy(F.col(f"{place}.end"), F.desc_nulls_last(key), F.desc_nulls_last(tie))
    frame = frame.withColumns({new: F.lead(old).over(order) for old, new in carry.items()})
    return frame.filter(~F.col(f"{place}.end")).drop(place, inside, bucket, to)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or
    all) of the next document's, in descending order of doc_id, after the last the first. Rows with
    one doc_id are ordered by text, descending; null ids come last. Null texts count as empty. A
    sole document is its own next. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(
        rows, "doc_id", "text", {"text": "next_text", "fingerprint": "next_fingerprint"}, lambda f: fingerprints(f, "text", "fingerprint")
    )
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - m), F.substring(F.col("next_text"), F.lit(1), m))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = fingerprints(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fingerprint").drop("edited")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
