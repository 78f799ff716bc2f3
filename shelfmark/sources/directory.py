"""A directory tree as a table, and snapshots of it as observations.

Spark's own file sources leave out empty files and names that start with a dot or
an underscore, so listing is a Python data source; each reader partition walks one
part of the tree with ``os.scandir``. Folders are listed breadth first on the driver until
there are enough of them to share out; the names of files are never gathered there.

    spark.dataSource.register(DirectorySource)
    spark.read.format("directory").option("root", path).load()

``scan`` and ``legacy_scan`` add the bounds that hold for a whole scan.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = (
    "path string, name string, size long, modified_at_ns long, changed_at_ns long, created_at_ns long, platform string, "
    "volume_id string, native_file_id string, generation string, depth int, issue string"
)
MOST_ISSUES = 100
#: Rows of a batch, if the caller says nothing, and at most.
BATCH, MOST_BATCH = 256, 2_048
#: Folders that a scan is shared out by, if there are as many.
PARTS = 64
#: An older scan refuses more files.
MOST_FILES = 10_000


def platform() -> str:
    return {"darwin": "macos", "linux": "linux", "win32": "windows"}.get(__import__("sys").platform, "other")


def _row(path: str, name: str, depth: int, state: os.stat_result | None, issue: str | None) -> tuple:
    if state is None:
        return (path, name, None, None, None, None, None, None, None, None, depth, issue)
    born = getattr(state, "st_birthtime_ns", None)
    return (path, name, state.st_size, state.st_mtime_ns, state.st_ctime_ns, born, platform(), str(state.st_dev), str(state.st_ino), None, depth, issue)


def walk(top: str, depth: int, options: dict) -> Iterator[tuple]:
    """Files below ``top``, depth first; links and special files are skipped, trouble becomes an issue."""
    hidden, excluded, deepest = options["hidden"], options["exclude"], options["max_depth"]
    issues = 0
    todo = [(top, depth)]
    while todo:
        folder, level = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as trouble:
            if issues < MOST_ISSUES:
                issues += 1
                yield _row(folder, os.path.basename(folder), level, None, f"unreadable: {trouble.strerror}")
            continue
        for entry in entries:
            if not hidden and entry.name.startswith("."):
                continue
            try:
                entry.name.encode("utf-8")
                state = entry.stat(follow_symlinks=False)
            except UnicodeEncodeError:
                issue, state = "name is not UTF-8", None
            except OSError as trouble:
                issue, state = f"unreadable: {trouble.strerror}", None
            if state is None:
                if issues < MOST_ISSUES:
                    issues += 1
                    yield _row(os.fsencode(entry.path).decode("utf-8", "replace"), os.fsencode(entry.name).decode("utf-8", "replace"), level, None, issue)
            elif stat.S_ISDIR(state.st_mode):
                if entry.name not in excluded and (deepest is None or level < deepest):
                    todo.append((entry.path, level + 1))
            elif stat.S_ISREG(state.st_mode):
                yield _row(entry.path, entry.name, level, state, None)


class Part(InputPartition):
    def __init__(self, folder: str, depth: int, files_only: bool):
        self.folder, self.depth, self.files_only = folder, depth, files_only


class DirectoryReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root = os.path.realpath(options["root"])
        names = lambda key: set(options.get(key, "").split(",")) - {""}
        depth = options.get("maxDepth")
        self.options = {
            "hidden": options.get("hidden", "true").lower() == "true",
            "exclude": names("exclude"),
            "max_depth": int(depth) if depth is not None else None,
        }
        self.top_exclude = names("topExclude")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.batch = min(max(int(options.get("batchSize", BATCH)), 1), MOST_BATCH)
        self.schema = schema

    def below(self, folder: str, depth: int) -> list[str]:
        """The folders in ``folder`` that the scan goes into."""
        deepest = self.options["max_depth"]
        if not self.recursive or (deepest is not None and depth >= deepest):
            return []
        excluded = self.options["exclude"] | (self.top_exclude if not depth else set())
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return []  # the part that walks the folder's files tells
        shown = (e for e in entries if self.options["hidden"] or not e.name.startswith("."))
        return [e.path for e in shown if e.name not in excluded and e.is_dir(follow_symlinks=False)]

    def partitions(self) -> list[InputPartition]:
        """The files of the upper folders, and the whole of each folder below them."""
        parts: list[InputPartition] = []
        level, depth = [self.root], 0
        while level:
            parts += [Part(folder, depth, True) for folder in level]
            level, depth = [x for folder in level for x in self.below(folder, depth)], depth + 1
            if len(level) >= PARTS:
                return parts + [Part(folder, depth, False) for folder in level]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        options = {**self.options, "max_depth": part.depth} if part.files_only else self.options
        rows, names = walk(part.folder, part.depth, options), self.schema.names
        kinds = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}
        types = [kinds[f.dataType.simpleString()] for f in self.schema]
        while batch := list(islice(rows, self.batch)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), types)], names=names)


class DirectorySource(DataSource):
    """Options: ``root``; ``hidden`` (true), ``recursive`` (true), ``exclude`` (names, by comma), ``topExclude``
    (names of folders at the top), ``maxDepth``, ``batchSize`` (256, from 1 to 2048)."""

    @classmethod
    def name(cls) -> str:
        return "directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DirectoryReader:
        return DirectoryReader(self.options, schema)


def scan(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The tree as a table, with at most ``MOST_ISSUES`` issues, those of the first paths."""
    spark.dataSource.register(DirectorySource)
    rows = spark.read.format("directory").options(root=root, **options).load()
    return rows.where("issue is null").union(rows.where("issue is not null").orderBy("path").limit(MOST_ISSUES))


def legacy_scan(spark: SparkSession, root: str, reserved: tuple[str, ...] = (), recursive: bool = False, ignore_hidden: bool = True, most: int = MOST_FILES) -> DataFrame:
    """The files of the older scan: flat and without hidden names by default, never in the folders at the top it sorts into.

    ``ValueError`` if a folder can't be read or there are more than ``most`` files.
    """
    options = {"recursive": str(recursive), "hidden": str(not ignore_hidden), "topExclude": ",".join(reserved)}
    rows = scan(spark, root, **options)
    issues, files = rows.agg(F.count("issue"), F.count_if(F.col("issue").isNull())).first()
    if issues:
        raise ValueError(f"{issues} folders or names can't be read")
    if files > most:
        raise ValueError(f"{files} files are more than {most}")
    return rows
