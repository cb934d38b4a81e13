"""What several operators share: reading, written tables, Arrow batches, hashing of words, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import lineage
from ..operators.lineage import release, shared_dir

#: The separators of words in every contract: space and the ASCII controls 9 to 13.
#: ``bytes.split()`` without arguments splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, through Spark's reader only (the folder may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of texts that a Python worker turns into objects at a time, and rows that it is handed while a table is written.
SLICE_BYTES, BATCH_ROWS = 2 << 20, 2000


def slices(batches, column: str, most: int = SLICE_BYTES):
    """Arrow batches cut so that the texts of column have at most so many bytes in each, or one row; as many rows, in order."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, at = np.cumsum(sizes), 0
        while at < len(sizes):
            before = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def adding(frame: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    """The schema of frame with these fields at its end; columns of frame that have such a name are replaced by them."""
    new = {name for name, _ in fields}
    return T.StructType([*(f for f in frame.schema.fields if f.name not in new), *(T.StructField(*x) for x in fields)])


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """An Arrow batch in the shape of ``adding``."""
    kept = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *new.values()], [*kept, *new])


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Names like these that frame has no columns of (in any case)."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``lineage.written``, with Arrow batches of BATCH_ROWS rows at most while it runs: both ends hold a batch for each task.

    The session's own setting is in force again afterwards.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    before = conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    try:
        return lineage.written(df, name)
    finally:
        conf.set(key, before)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


# ---------------------------------------------------------------- hashing (numpy)

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _ODD = np.uint64(33), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words, in order; empty if there are fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(m, n, np.uint64)
    for k in range(n):
        acc *= _ODD
        acc += hashes[k : k + m]
    return mix64(acc)


# ---------------------------------------------------------------- components


def _star(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step (Kiveris et al., 2014)."""
    both = edges.union(edges.select("v", "u")).distinct()
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u != v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    hung = large.join(low, "u")
    return (
        hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(hung.select("u", F.col("m").alias("v")))
        .filter("u != v")
        .distinct()
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected links: rows (node, root), root the smallest node.

    Large-star and small-star alternate until nothing changes; each step is written to the
    shared folder, so that a lost executor costs one step. Only counts reach the driver.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v")
    mark = None
    while True:
        e = written(_star(e), "links")
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == new:
            break
        mark = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()


__all__ = [
    "WORD", "adding", "components", "fresh", "gram_hashes", "is_empty", "mix64", "read", "release", "shared_dir", "slices", "with_columns", "written",
]
