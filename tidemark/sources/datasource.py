"""Spark data source ``git_objects``: (oid, kind, size, data) of a repository's objects.

Options: ``path`` (anything inside the repository, or its git folder), ``kinds`` (comma-separated;
others are not inflated where their record tells the kind), ``ids`` (true: ids alone, nothing is
decoded), ``run`` (objects a task reads, about). A partition is a range of a pack's offsets, cut by
the driver, or some of the 256 folders of loose objects; a task that is lost reads its own run again.
The folder must be readable by all executors.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.parsing import Malformed, inflate, parse_loose
from .gitdir import Repository
from .packs import Index, Pack, find_packs

SCHEMA = "oid string, kind string, size bigint, data binary"
#: Folders of loose objects that one task lists.
FOLDERS = 32


@dataclass
class Loose(InputPartition):
    shards: list[str]


@dataclass
class Run(InputPartition):
    stem: str
    first: int
    last: int


def loose_oids(git_dir: str, shards: list[str] | None = None) -> list[str]:
    """Names of loose objects, in order."""
    folder = os.path.join(git_dir, "objects")
    known = shards if shards is not None else [f"{i:02x}" for i in range(256)]
    return sorted(
        s + n for s in known if os.path.isdir(os.path.join(folder, s)) for n in os.listdir(os.path.join(folder, s)) if re.fullmatch("[0-9a-f]{38}", n)
    )


def read_loose(git_dir: str, oid: str) -> tuple[str, bytes] | None:
    try:
        with open(os.path.join(git_dir, "objects", oid[:2], oid[2:]), "rb") as f:
            return parse_loose(inflate(f.read())[0])
    except FileNotFoundError:
        return None


def packed_oids(git_dir: str) -> list[str]:
    return sorted({o for stem in find_packs(git_dir)[0] for o in Index.open(f"{stem}.idx").oids()})


def all_oids(git_dir: str) -> list[str]:
    """Every object, loose or packed, once, in order."""
    return sorted({*loose_oids(git_dir), *packed_oids(git_dir)})


def contains(git_dir: str, oid: str) -> bool:
    """Whether an object is there; nothing of it is read."""
    if os.path.isfile(os.path.join(git_dir, "objects", oid[:2], oid[2:])):
        return True
    return any(Index.open(f"{stem}.idx").find(oid) is not None for stem in find_packs(git_dir)[0])


def read_object(git_dir: str, oid: str) -> tuple[str, bytes]:
    """(kind, data) of one object: loose first, then each pack."""
    found = read_loose(git_dir, oid)
    for stem in () if found else find_packs(git_dir)[0]:
        if found := Pack(stem).find(oid):
            break
    if not found:
        raise Malformed(f"object {oid} is missing")
    return found


class Reader(DataSourceReader):
    def __init__(self, options):
        self.git_dir = Repository.discover(options["path"]).git_dir
        self.kinds = set(options["kinds"].split(",")) if options.get("kinds") else None
        self.ids = options.get("ids", "false").lower() == "true"
        self.run = int(options.get("run", 20_000))

    def partitions(self):
        shards = [f"{i:02x}" for i in range(256)]
        out: list[InputPartition] = [Loose(shards[i : i + FOLDERS]) for i in range(0, 256, FOLDERS)]
        for stem in find_packs(self.git_dir)[0]:
            offsets = np.sort(Index.open(f"{stem}.idx").offsets())
            cuts = [0, *offsets[self.run :: self.run].tolist(), os.path.getsize(f"{stem}.pack")]
            out += [Run(stem, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, partition):
        if self.ids:
            yield from ((oid, None, None, None) for oid in self._ids(partition))
        elif isinstance(partition, Loose):
            for oid in loose_oids(self.git_dir, partition.shards):
                found = read_loose(self.git_dir, oid)
                if found and (self.kinds is None or found[0] in self.kinds):
                    yield oid, found[0], len(found[1]), found[1]
        else:
            for oid, kind, data in Pack(partition.stem).objects(self.kinds, partition.first, partition.last):
                yield oid, kind, len(data), data

    def _ids(self, partition):
        if isinstance(partition, Loose):
            return loose_oids(self.git_dir, partition.shards)
        index = Index.open(f"{partition.stem}.idx")
        offsets = index.offsets()
        return map(index.oid, np.flatnonzero((offsets >= partition.first) & (offsets < partition.last)).tolist())


class GitObjects(DataSource):
    @classmethod
    def name(cls):
        return "git_objects"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def once(objects: DataFrame) -> DataFrame:
    """Objects, each once: those that are both loose and packed hold the same bytes."""
    return objects.dropDuplicates(["oid"])


def read_objects(spark: SparkSession, path: str, kinds: str | None = None) -> DataFrame:
    """Every object once."""
    spark.dataSource.register(GitObjects)
    reader = spark.read.format("git_objects").option("path", path)
    return once((reader.option("kinds", kinds) if kinds else reader).load())


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """oid of every object once; no object is decoded."""
    spark.dataSource.register(GitObjects)
    return spark.read.format("git_objects").option("path", path).option("ids", "true").load().select("oid").distinct()


def existing(oids: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """The rows of a frame with a column oid whose object is in the repository."""
    return oids.join(read_ids(spark, path), "oid", "left_semi")


__all__ = [
    "GitObjects", "Malformed", "all_oids", "contains", "existing", "loose_oids", "once", "packed_oids", "read_ids", "read_loose", "read_object", "read_objects",
]
