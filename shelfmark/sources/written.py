"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset and all executors run in the driver, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="shelfmark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        path = "file://" + made
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing else uses; what is there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _own.append((spark, path))
    return path


def written(df: DataFrame, *partitions: str) -> DataFrame:
    """``df``, written once as Parquet and read back: a lost executor repeats its own tasks only.

    With ``partitions`` the files lie in a folder for each value of those columns.
    """
    path = new_path(df.sparkSession)
    df.write.partitionBy(*partitions).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def delete_own() -> None:
    while _own:
        try:
            delete(*_own.pop())
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


atexit.register(delete_own)
