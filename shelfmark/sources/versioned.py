"""Parquet tables whose state is one manifest: what it names is the table, and nothing else is.

Rows lie in buckets by a hash of their key. A commit writes new files beside the old ones, then
publishes a manifest with the next number by a rename that fails if that number is taken. So a
reader sees all of a commit or nothing, a writer that lost a race starts over from the winner's
state, and files that a failed writer left are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"
TRIES = 20


@dataclass(frozen=True)
class Manifest:
    """``parts``: table, bucket, folders. ``batches``: the last batch each writer has committed. ``properties``: what users of the tables note."""

    number: int = 0
    parts: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    properties: dict[str, int] = field(default_factory=dict)


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    _, where, store = _hadoop(spark, path)
    return [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []


def manifest(spark: SparkSession, root: str) -> Manifest:
    """The newest state of the tables at ``root``; without any commit the empty one."""
    numbers = [n for n in _names(spark, f"{root}/_manifests") if n.endswith(".json")]
    if not numbers:
        return Manifest()
    jvm, where, store = _hadoop(spark, f"{root}/_manifests/{max(numbers)}")
    stream = store.open(where)
    try:
        return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, new: Manifest) -> bool:
    """Make ``new`` the state of the tables, unless another writer took its number."""
    jvm, where, store = _hadoop(spark, f"{root}/_manifests/{new.number:012d}.json")
    _, staged, _ = _hadoop(spark, f"{root}/_staged/{uuid.uuid4().hex}")
    stream = store.create(staged, False)
    stream.write(json.dumps(vars(new)).encode())
    stream.close()
    store.mkdirs(where.getParent())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, where, options)
    except Py4JJavaError as failed:
        if "FileAlreadyExists" not in str(failed.java_exception.getClass().getName()):
            raise
        store.delete(staged, False)
        return False
    return True


def stage(rows: DataFrame, root: str) -> dict[str, list[str]]:
    """Write ``rows`` with a column ``BUCKET`` in one job to a new folder; the folder of each bucket that has rows."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    rows.write.partitionBy(BUCKET).parquet(folder)
    prefix = f"{BUCKET}="
    return {n.removeprefix(prefix): [f"{folder}/{n}"] for n in _names(rows.sparkSession, folder) if n.startswith(prefix)}


def read(spark: SparkSession, state: Manifest, table: str, schema, buckets: list[str] | None = None) -> DataFrame:
    """The rows of ``table`` (of some buckets only, if given) in that state."""
    found = state.parts.get(table, {})
    paths = [p for b in (found if buckets is None else buckets) for p in found.get(b, [])]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def commit(spark: SparkSession, root: str, change: Callable[[Manifest], Manifest | None]) -> Manifest:
    """Publish what ``change`` makes of the newest state, again from the start if another writer was faster; None: nothing to do."""
    for _ in range(TRIES):
        state = manifest(spark, root)
        new = change(state)
        if new is None:
            return state
        if publish(spark, root, new):
            return new
    raise RuntimeError(f"{root}: other writers were faster {TRIES} times")


def replaced(state: Manifest, tables: dict[str, dict[str, list[str]]], touched: list[str], properties: dict[str, int] | None = None, batch: tuple[str, int] | None = None) -> Manifest:
    """The state after ``state`` in which the ``touched`` buckets of ``tables`` have the folders given, none where none are."""
    parts = {t: {b: p for b, p in state.parts.get(t, {}).items() if b not in set(touched)} | new for t, new in tables.items()}
    return Manifest(state.number + 1, state.parts | parts, state.batches | dict([batch] if batch else []), state.properties | (properties or {}))


def appended(state: Manifest, tables: dict[str, dict[str, list[str]]], batch: tuple[str, int] | None = None) -> Manifest:
    """The state after ``state`` with more folders."""
    parts = {t: {b: [*state.parts.get(t, {}).get(b, []), *new.get(b, [])] for b in {*state.parts.get(t, {}), *new}} for t, new in tables.items()}
    return Manifest(state.number + 1, state.parts | parts, state.batches | dict([batch] if batch else []), state.properties)
