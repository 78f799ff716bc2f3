"""Change streams on Structured Streaming: dirty directories and settled files, with state that forgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.paths import parent, within
from ..operators.reconcile import dirty_directories

EVENT = "path string, event string, observed_at_ms long"
#: Looks of an automation are numbered from 0 without gaps; each lists every file that is there then.
SIGHTING = "automation_id string, path string, size long, mtime_ns long, look long, seen_at timestamp"
SETTLED = "automation_id string, path string, look long"
#: ``change``: dirty, absorbed (by a directory above) or clean; ``step`` counts the changes below one part of the root.
CHANGE = "part string, directory string, change string, step long"
OVERFLOW, RECONCILED = "overflow", "reconciled"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, schema: str = EVENT, files_at_once: int | None = None) -> DataFrame:
    """File events that arrive as Parquet files in a folder, at most ``files_at_once`` new files in a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def keyed_state(spark: SparkSession) -> None:
    """Keyed state of arbitrary processors is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def dirty_batches(events: DataFrame, root: str, handle: Callable[[DataFrame, int], None], checkpoint: str, overflow: str = OVERFLOW):
    """Hand each micro-batch's least set of dirty directories to ``handle``.

    If a batch holds an ``overflow`` event, some were lost: the whole root is dirty.
    """

    def each(batch: DataFrame, number: int) -> None:
        lost = not batch.where(batch["event"] == overflow).isEmpty()
        found = batch.sparkSession.createDataFrame([(root,)], "directory string") if lost else dirty_directories(batch, root)
        handle(found, number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SettledFiles(StatefulProcessor):
    """One file of one automation: it settles at the first look that finds it unchanged since the look before.

    Files of the first look count as handled. A file that a look has missed starts anew when it
    is back. State goes once the watermark is ``grace_ms`` past the last look that found the file.
    """

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "size long, mtime_ns long, handled boolean, look long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.known.get() if self.known.exists() else None
        seen_at = None
        for row in sorted(rows, key=lambda r: r.look):
            if known is not None and row.look <= known[3]:
                continue  # seen before, or late
            same = known is not None and row.look == known[3] + 1 and (row.size, row.mtime_ns) == (known[0], known[1])
            if same and not known[2]:
                yield Row(automation_id=key[0], path=key[1], look=row.look)
            known = (row.size, row.mtime_ns, row.look == 0 or same, row.look)
            seen_at = row.seen_at
        if seen_at is not None:
            self.known.update(known)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(seen_at.timestamp() * 1000) + self.grace_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def settled_files(sightings: DataFrame, grace_ms: int = 3_600_000, delay: str = "0 seconds") -> DataFrame:
    """``automation_id``, ``path`` and ``look`` of files that have settled, from a stream of ``SIGHTING``.

    The state is kept for each file, so a large automation is spread over all tasks. ``grace_ms``
    must be longer than the time between two looks; ``delay``: how late sightings may come.
    """
    keyed_state(sightings.sparkSession)
    grouped = sightings.withWatermark("seen_at", delay).groupBy("automation_id", "path")
    return grouped.transformWithState(SettledFiles(grace_ms), SETTLED, "Append", "EventTime")


class DirtyTrie(StatefulProcessor):
    """The dirty directories below one part of the root, as a trie over their path components.

    A directory under a dirty one changes nothing; one above dirty ones absorbs them, and their
    nodes go. What has been reconciled is clean again, and the nodes it leaves empty go.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", "path string", "dirty boolean, children array<string>")
        self.step = handle.getValueState("step", "n long")

    def node(self, path: str) -> tuple[bool, list[str]] | None:
        found = self.nodes.getValue((path,)) if self.nodes.containsKey((path,)) else None
        return None if found is None else (found[0], list(found[1] or []))

    def below(self, path: str) -> Iterator[str]:
        """Dirty directories under ``path``; all nodes there go."""
        waiting = list(self.node(path)[1])
        while waiting:
            at = waiting.pop()
            dirty, children = self.node(at)
            self.nodes.removeKey((at,))
            waiting += children
            if dirty:
                yield at

    def mark(self, path: str, root: str) -> Iterator[tuple[str, str]]:
        parts = path[len(root) :].strip("/").split("/") if path != root else []
        above = [root + "".join(f"/{p}" for p in parts[:n]) for n in range(len(parts) + 1)]
        if any(found and found[0] for found in map(self.node, above)):
            return
        if self.node(path) is not None:
            yield from ((p, "absorbed") for p in self.below(path))
        self.nodes.updateValue((path,), (True, []))
        for child, at in zip(reversed(above), reversed(above[:-1])):
            found = self.node(at)
            if found and child in found[1]:
                break
            self.nodes.updateValue((at,), (False, [*(found[1] if found else []), child]))
        yield path, "dirty"

    def clean(self, path: str, root: str) -> Iterator[tuple[str, str]]:
        found = self.node(path)
        if not found or not found[0]:
            return
        self.nodes.removeKey((path,))
        yield path, "clean"
        while path != root:
            path, child = path.rsplit("/", 1)[0], path
            dirty, children = self.node(path)
            children.remove(child)
            if children:
                self.nodes.updateValue((path,), (dirty, children))
                break
            self.nodes.removeKey((path,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        step = self.step.get()[0] if self.step.exists() else 0
        for row in sorted(rows, key=lambda r: (r.observed_at_ms, r.event == RECONCILED, r.directory)):
            work = self.clean if row.event == RECONCILED else self.mark
            for directory, change in work(row.directory, key[0]):
                step += 1
                yield Row(part=key[0], directory=directory, change=change, step=step)
        self.step.update((step,))

    def close(self) -> None:
        pass


def dirty_changes(events: DataFrame, root: str) -> DataFrame:
    """A stream of ``CHANGE`` from a stream of ``EVENT``: what becomes dirty, is absorbed, or is clean again.

    Each directory right below ``root`` has a trie of its own, kept from batch to batch. Events
    outside the root go; an ``overflow`` makes the root itself dirty. A ``reconciled`` event names
    a directory as its path, all others a file in one.
    """
    keyed_state(events.sparkSession)
    base = root.rstrip("/")
    directory = F.when(F.col("event") == OVERFLOW, F.lit(base)).when(F.col("event") == RECONCILED, F.col("path")).otherwise(parent(F.col("path")))
    rows = events.withColumn("directory", directory).where((F.col("directory") == base) | within(F.col("directory"), base))
    first = F.substring_index(F.substr(F.col("directory"), F.lit(len(base) + 2)), "/", 1)
    part = F.when(F.col("directory") == base, F.lit(base)).otherwise(F.concat(F.lit(f"{base}/"), first))
    keyed = rows.select(part.alias("part"), "directory", "event", "observed_at_ms").groupBy("part")
    return keyed.transformWithState(DirtyTrie(), CHANGE, "Append", "None")


def still_dirty(changes: DataFrame, root: str) -> DataFrame:
    """``directory``: the least set that covers what is dirty after all ``changes`` of the stream; a dirty root stands for all."""
    base = root.rstrip("/")
    last = changes.groupBy("directory").agg(F.max_by("change", "step").alias("change")).where("change = 'dirty'").select("directory")
    whole = last.where(F.col("directory") == base)
    return last.where(F.col("directory") != base).join(whole.select(F.lit(1).alias("all")).limit(1), F.lit(True), "left_anti").union(whole)
