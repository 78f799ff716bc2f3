"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_recorded = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all
    executors run in the driver, as in local tests, a temporary folder of our own is
    chosen and recorded there; it is removed when the driver ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="shelfmark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = "file://" + own
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet, with the writer's ``options``, to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, never the
    stages before the written table. The files go with ``discard`` or when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfmark-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append((spark, path))
    for paths in getattr(_recorded, "open", []):
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the tables that this thread writes meanwhile."""
    paths: list[str] = []
    _recorded.open = [*getattr(_recorded, "open", []), paths]
    try:
        yield paths
    finally:
        _recorded.open = [x for x in _recorded.open if x is not paths]


def discard(*paths: str) -> None:
    """Delete tables that nothing will read any more."""
    for entry in [e for e in _written if e[1] in paths]:
        _written.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(hadoop).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs whose DataFrames are out of use.

    Spark deletes them when the driver collects its garbage, which can be long after
    a written table has made them superfluous. What the first collection lets go of
    can hold others, so there are two.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def discard_written() -> None:
    """Delete all tables that ``materialize`` wrote."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


atexit.register(discard_written)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that do not clash with ``df``'s, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


_caches: dict[str, Callable[[], None]] = {}


def worker_cache(owner: str, clear: Callable[[], None]) -> None:
    """Register what an operator remembers in a Python worker from one task to the next."""
    _caches[owner] = clear


def enter(owner: str) -> None:
    """At the start of an operator's task: what others left in this worker, which Spark uses again, goes."""
    for other, clear in _caches.items():
        if other != owner:
            clear()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, though the optimizer may inline it.

    A plain column that a lambda refers to is computed again for each element once
    filters are pushed below the projection that defines it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
