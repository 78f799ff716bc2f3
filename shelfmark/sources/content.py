"""Reading contents: first bytes, previews and hashes of whole files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension
from .written import written

HEADER = 16
PREVIEW = 256 * 1024
BLOCK = 1 << 20
SAMPLE = 64 * 1024
#: Bytes of a file that one task reads for a hash tree.
SEGMENT = 64 * 1024 * 1024
# Extensions whose text can be shown.
TEXT_EXTENSIONS = ("txt", "md", "csv", "tsv", "json", "xml", "yaml", "yml", "toml", "rs", "py", "js", "ts", "html", "css", "log")


def header(content: Column) -> Column:
    """The first 16 bytes of a binary column."""
    return F.substring(content, 1, HEADER)


def preview(path: Column, content: Column) -> Column:
    """Struct of ``kind`` (text or metadata), ``text`` and ``truncated``; invalid UTF-8 is replaced."""
    shown = extension(path).isin(*TEXT_EXTENSIONS)
    cut = F.substring(content, 1, PREVIEW)
    return F.struct(
        F.when(shown, "text").otherwise("metadata").alias("kind"),
        F.when(shown, F.make_valid_utf8(cut.cast("string"))).alias("text"),
        (shown & (F.octet_length(content) > PREVIEW)).alias("truncated"),
    )


def opened(path: str):
    """A file of any store that Arrow opens (a path, or an address such as ``hdfs://`` or ``s3://``), for random access."""
    from pyarrow import fs

    store, own = fs.FileSystem.from_uri(path)
    return store, own, store.open_input_file(own)


def _list(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands in each folder; links of the local file system are left out."""
    import os

    from pyarrow import fs

    for folder in (p for frame in frames for p in frame["path"]):
        store, own = fs.FileSystem.from_uri(folder)
        start = folder.removesuffix(own) if folder.endswith(own) else ""
        found = store.get_file_info(fs.FileSelector(own, allow_not_found=True))
        rows = [i for i in found if i.type in (fs.FileType.File, fs.FileType.Directory) and not (store.type_name == "local" and os.path.islink(i.path))]
        yield pd.DataFrame(
            [(start + i.path, i.size, i.mtime_ns, i.type == fs.FileType.Directory) for i in rows], columns=["path", "size", "modified_at_ns", "folder"]
        ).astype({"size": "Int64", "modified_at_ns": "Int64"})


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``size`` and ``modified_at_ns`` of every file below ``folder``, hidden and empty ones too.

    Each round lists the folders that the round before has found, dealt anew to all tasks, so a
    deep or crowded part of the tree is not one task; there are as many rounds as levels.
    """
    frontier, files = spark.createDataFrame([(folder.rstrip("/"),)], "path string"), []
    folders = 1
    while folders:
        tasks = min(folders, 4 * spark.sparkContext.defaultParallelism)
        found = written(frontier.repartition(tasks).mapInPandas(_list, "path string, size long, modified_at_ns long, folder boolean"))
        files.append(found.where("not folder").drop("folder"))
        frontier = found.where("folder").select("path")
        folders = frontier.count()
    return reduce(DataFrame.union, files)


def whole_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``size``, ``header`` and ``full`` of every file below a folder, read in blocks where Spark runs the tasks."""
    return file_hashes(listed(spark, folder)).select("path", "size", "header", "full")


def file_hashes(files: DataFrame) -> DataFrame:
    """``files`` (path, size) with ``header``, ``quick`` and ``full``, read in blocks of 1 MiB, however large a file is.

    ``quick`` covers the size and 64 KiB at the start, the middle and the end. For a
    file that changes while it is read, or can't be, all three are null.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, size in zip(frame["path"], frame["size"]):
                try:
                    store, own, file = opened(path)
                    with file:
                        before = store.get_file_info(own)
                        first = file.read_at(HEADER, 0) if before.size else b""
                        quick = hashlib.sha256(str(before.size).encode())
                        for at in sorted({0, max(0, (before.size - SAMPLE) // 2), max(0, before.size - SAMPLE)}):
                            quick.update(at.to_bytes(8, "little") + file.read_at(min(SAMPLE, before.size - at), at))
                        whole = hashlib.sha256()
                        file.seek(0)
                        while block := file.read(BLOCK):
                            whole.update(block)
                    after = store.get_file_info(own)
                    steady = (before.size, before.mtime_ns) == (after.size, after.mtime_ns) and before.size == size
                    out.append((first, quick.hexdigest(), whole.hexdigest()) if steady else (None, None, None))
                except OSError:
                    out.append((None, None, None))
            yield pd.DataFrame({"path": frame["path"], "size": frame["size"], "header": [x[0] for x in out], "quick": [x[1] for x in out], "full": [x[2] for x in out]})

    return files.select("path", "size").mapInPandas(read, "path string, size long, header binary, quick string, full string")


def tree_hashes(files: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``path``, ``size`` and ``tree``: the SHA-256 over the hex digests of a file's segments, each read by itself.

    A large file is read by as many tasks as it has segments. An empty file has one, empty segment. Null
    for a file of which a segment can't be read whole.
    """
    number = F.greatest(F.ceil(F.col("size") / segment), F.lit(1))
    parts = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("part"))
    spread = parts.repartition("path", "part")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, size, part in zip(frame["path"], frame["size"], frame["part"]):
                left, found = min(segment, size - part * segment), hashlib.sha256()
                try:
                    with opened(path)[2] as file:
                        file.seek(part * segment)
                        while left and (block := file.read(min(BLOCK, left))):
                            found.update(block)
                            left -= len(block)
                    out.append(None if left else found.hexdigest())
                except OSError:
                    out.append(None)
            yield frame.assign(digest=out)

    digests = spread.mapInPandas(read, "path string, size long, part long, digest string")
    every = F.array_sort(F.collect_list(F.struct("part", "digest")))
    grouped = digests.groupBy("path", "size").agg(F.bool_and(F.col("digest").isNotNull()).alias("all"), F.array_join(F.transform(every, lambda x: x["digest"]), "").alias("digests"))
    return grouped.select("path", "size", F.when(F.col("all"), F.sha2("digests", 256)).alias("tree"))


def cached_hashes(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``files`` (path, size, modified_at_ns) with the cached hash, if the file is still the same."""
    known = cache.select("path", "size", F.col("mtime_ns").alias("modified_at_ns"), "partial_hash", "content_hash")
    return files.join(known, ["path", "size", "modified_at_ns"], "left")
