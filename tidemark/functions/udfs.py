"""Functions that Spark lacks, as Arrow-batched UDFs over whole columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import parsing, width


def _each(kind: str, f: Callable) -> Callable[..., Column]:
    """A UDF that applies f to the values of a row; null where one of them is null."""

    @F.pandas_udf(kind)
    def apply(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([None if any(x is None for x in r) else f(*r) for r in rows], dtype=object)

    return apply


def inflate(data: Column) -> Column:
    """Contents of a zlib stream; bytes after it are ignored, a broken one fails the query."""
    return _each("binary", lambda x: parsing.inflate(bytes(x))[0])(data)


def deflate(data: Column, level: int = 6) -> Column:
    return _each("binary", lambda x: zlib.compress(bytes(x), level))(data)


def adler32(data: Column) -> Column:
    return _each("long", lambda x: parsing.adler32(bytes(x)))(data)


def apply_delta(base: Column, delta: Column) -> Column:
    return _each("binary", lambda b, d: parsing.apply_delta(bytes(b), bytes(d)))(base, delta)


def truncate_start(text: Column, columns: int) -> Column:
    """The end of a text after an ellipsis, in at most so many terminal columns."""
    return _each("string", lambda x: width.truncate_start(x, columns))(text)


def pad(text: Column, columns: int, right: bool = False) -> Column:
    return _each("string", lambda x: width.pad(x, columns, right))(text)
