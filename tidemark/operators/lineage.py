"""Tables in the folder that driver and executors share, to cut the lineage of step-by-step plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset a session with a local master gets a temporary folder (the session's settings
    stay as they are); on a cluster executors would write to folders of their own, so that is a ValueError.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _local[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back.

    A plan that reads it is short again, and a lost executor costs no more than the step that reads.
    The rows are computed once, where ``checkpoint()`` of an uncached frame computes them twice. The
    table stays until it is released: ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the line of written tables, for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables written since a mark, but for those of the names in keep; frames that read them are void then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made[since:]:
        if os.path.basename(path).rpartition("-")[0] not in keep:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
            _made.remove(path)
