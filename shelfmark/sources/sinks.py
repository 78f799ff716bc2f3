"""Writing: journals that a retry does not repeat, and upserts of tables that are kept as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from . import versioned
from .versioned import BUCKET, Manifest
from .written import written

BUCKETS = 16


def _there(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(rows: DataFrame, path: str, *key: str) -> None:
    """Append the rows whose key is not there yet, so that a repeated append adds nothing."""
    known = _there(rows.sparkSession, path, rows.schema).select(*key)
    rows.join(known, list(key), "left_anti").select(*rows.columns).write.mode("append").parquet(path)


def journal(header: DataFrame, items: DataFrame, root: str, buckets: int = BUCKETS) -> Manifest:
    """Append operations (``id``) with all their items (``operation_id``) in one commit: a reader sees all of them or none.

    Operations that are journalled already are left out with their items, so a retry adds nothing. However
    many operations there are, each table is written by one job.
    """
    spark = header.sparkSession

    def change(state: Manifest) -> Manifest | None:
        known = versioned.read(spark, state, "operations", header.schema).select("id")
        new = written(header.join(known, "id", "left_anti"))
        if new.isEmpty():
            return None
        own = items.join(new.select(F.col("id").alias("operation_id")), "operation_id", "left_semi").select(*items.columns)
        parts = {"operations": new.withColumn(BUCKET, versioned.bucket(F.col("id"), buckets)), "operation_items": own.withColumn(BUCKET, versioned.bucket(F.col("operation_id"), buckets))}
        return versioned.appended(state, {name: versioned.stage(rows.repartition(BUCKET), root) for name, rows in parts.items()})

    return versioned.commit(spark, root, change)


def journalled(spark: SparkSession, root: str, header_schema: StructType, item_schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Operations and items of one state of the journal."""
    state = versioned.manifest(spark, root)
    return versioned.read(spark, state, "operations", header_schema), versioned.read(spark, state, "operation_items", item_schema)


def append_events(events: DataFrame, path: str) -> None:
    """Append the events of jobs that are not logged yet: a job logs a state once at one time."""
    append_new(events, path, "job_id", "event", "created_at_ms")


def upserted(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key, of both tables."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_from")))
    rows = current.withColumn("_from", F.lit(0)).unionByName(changes.withColumn("_from", F.lit(1)))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n", "_from")


def merge(changes: DataFrame, root: str, key: str, version: str, batch: tuple[str, int] | None = None, buckets: int = BUCKETS) -> Manifest:
    """Upsert ``changes`` into the table at ``root``: the newest row of each key stays, of equally new ones the later merged.

    Only buckets that hold a changed key are read and written again. ``batch``: a writer's name and the
    number of its batch; what that writer has merged up to that number is not merged again. The
    number of buckets is fixed by the first merge.
    """
    spark = changes.sparkSession
    schema = changes.schema

    def change(state: Manifest) -> Manifest | None:
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return None
        number = state.properties.get("buckets", buckets)
        fresh = written(changes.withColumn(BUCKET, versioned.bucket(F.col(key), number)))
        touched = [str(r[0]) for r in fresh.select(BUCKET).distinct().collect()]
        current = versioned.read(spark, state, "rows", schema, touched)
        rows = upserted(current, fresh.drop(BUCKET), key, version).withColumn(BUCKET, versioned.bucket(F.col(key), number))
        staged = versioned.stage(rows.repartition(BUCKET), root) if touched else {}
        return versioned.replaced(state, {"rows": staged}, touched, {"buckets": number}, batch)

    return versioned.commit(spark, root, change)


def merged(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The table that ``merge`` keeps."""
    return versioned.read(spark, versioned.manifest(spark, root), "rows", schema)


def merge_stream(rows: DataFrame, root: str, key: str, version: str, writer: str, checkpoint: str, buckets: int = BUCKETS):
    """Merge a stream of changes, each micro-batch by its number, so that one that is run again changes nothing."""

    def each(changes: DataFrame, number: int) -> None:
        merge(changes, root, key, version, (writer, number), buckets)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object a row, keys in the order of the columns; nulls are left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias(name))
