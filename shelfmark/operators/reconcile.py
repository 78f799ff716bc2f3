"""Reconciling a snapshot of observed files with the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import parent, within

KEY = ("library_id", "platform", "volume_id", "native_file_id", "generation")


def same_identity(left: str, right: str) -> Column:
    """Equality of the five parts; a null generation is equal to an empty one."""
    out = None
    for name in KEY:
        a, b = F.col(f"{left}.{name}"), F.col(f"{right}.{name}")
        if name == "generation":
            a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
        out = (a == b) if out is None else out & (a == b)
    return out


def last_observations(observed: DataFrame) -> DataFrame:
    """One row an identity: the last path in scan order wins, as for hard links."""
    best = F.max_by(F.struct(*[c for c in observed.columns if c not in KEY]), F.struct("observed_at_ms", "path"))
    return observed.groupBy(*KEY).agg(best.alias("_best")).select(*KEY, "_best.*")


def kinds(files: DataFrame, observed: DataFrame) -> DataFrame:
    """Each observation with ``file_id`` and ``kind``: inserted, moved, metadata_updated or unchanged.

    One shuffle join on the identity; a birth time that differs is no change.
    """
    joined = observed.alias("o").join(files.alias("f"), same_identity("o", "f"), "left")
    changed = F.lit(False)
    for name in ("size", "modified_at_ns", "changed_at_ns"):
        changed |= F.col(f"o.{name}") != F.col(f"f.{name}")
    kind = F.when(F.col("f.id").isNull(), "inserted").when(F.col("o.path") != F.col("f.path"), "moved").when(changed, "metadata_updated").otherwise("unchanged")
    return joined.select("o.*", F.coalesce("f.id", "o.new_file_id").alias("file_id"), kind.alias("kind"), F.col("f.path").alias("previous_path"))


def apply(files: DataFrame, observed: DataFrame, directory: str, observed_at_ms: int, complete: bool = True) -> DataFrame:
    """The catalogue (``id``, identity, ``path``, times, ``last_seen_at_ms``, ``missing_since_ms``) after a scan.

    What was seen is refreshed and no longer missing. If the scan was complete, files
    below ``directory`` that it did not see are missing since now, or since they
    first were. One full outer join does all of it.
    """
    joined = files.alias("f").join(observed.alias("o"), same_identity("o", "f"), "full_outer")
    seen = F.col("o.new_file_id").isNotNull()

    def pick(name: str) -> Column:
        return F.when(seen, F.col(f"o.{name}")).otherwise(F.col(f"f.{name}")).alias(name)

    unseen = within(F.col("f.path"), directory) & (F.col("f.last_seen_at_ms") < observed_at_ms) & F.lit(complete)
    missing = F.when(seen, F.lit(None)).when(unseen, F.coalesce("f.missing_since_ms", F.lit(observed_at_ms))).otherwise(F.col("f.missing_since_ms"))
    return joined.select(
        F.coalesce("f.id", "o.new_file_id").alias("id"), *[pick(n) for n in (*KEY, "path", "size", "modified_at_ns", "changed_at_ns")],
        F.when(seen, F.col("o.observed_at_ms")).otherwise(F.col("f.last_seen_at_ms")).alias("last_seen_at_ms"), missing.cast("long").alias("missing_since_ms"),
    )


def path_history(observed: DataFrame, *identity: str) -> DataFrame:
    """Intervals in which an identity had a path: closed when the next path is seen."""
    order = Window.partitionBy(*identity).orderBy("observed_at_ms", "path")
    changed = observed.withColumn("_before", F.lag("path").over(order)).where("_before is null or _before <> path")
    return changed.select(*identity, "path", F.col("observed_at_ms").alias("valid_from_ms"), F.lead("observed_at_ms").over(order).alias("valid_until_ms"))


def history_after(history: DataFrame, changes: DataFrame) -> DataFrame:
    """Path history after reconciliation: a move closes the open interval and opens one."""
    moved = changes.where(F.col("kind").isin("moved", "inserted")).select("file_id", F.col("path").alias("_path"), "observed_at_ms")
    closing = moved.select("file_id", F.col("observed_at_ms").alias("_closed"))
    kept = history.join(closing, "file_id", "left").withColumn("valid_until_ms", F.when(F.col("valid_until_ms").isNull(), F.col("_closed")).otherwise(F.col("valid_until_ms"))).drop("_closed")
    opened = moved.select("file_id", F.col("_path").alias("path"), F.col("observed_at_ms").alias("valid_from_ms"), F.lit(None).cast("long").alias("valid_until_ms"))
    return kept.unionByName(opened)


def counters(changes: DataFrame) -> DataFrame:
    """One row of scan counters; moves count as updates."""
    kind = F.col("kind")
    return changes.agg(
        F.count(F.lit(1)).alias("indexed"), F.count_if(kind == "inserted").alias("inserted"),
        F.count_if(kind.isin("moved", "metadata_updated")).alias("updated"), F.count_if(kind == "unchanged").alias("unchanged"),
    )


def dirty_directories(events: DataFrame, root: str) -> DataFrame:
    """The least set of directories that covers the events below ``root``: no one lies in another.

    Each directory is joined with its own ancestors, a handful, so the join is an equi-join.
    """
    base = root.rstrip("/")
    folders = events.select(parent(F.col("path")).alias("directory")).where(within(F.col("directory"), base)).distinct()
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ancestors = folders.select("directory", F.explode(above).alias("above"))
    covered = ancestors.join(folders.select(F.col("directory").alias("above")), "above").select("directory").distinct()
    return folders.join(covered, "directory", "left_anti")


def watch(previous: DataFrame, current: DataFrame, has_run: Column) -> DataFrame:
    """The watch state after one look, with ``candidate`` for files that have settled.

    ``previous``: (automation_id, path, size, mtime_ns, stable_count, handled); ``current``:
    (automation_id, path, size, mtime_ns). The first look takes all as handled; new
    and changed files start at 0; an unchanged one that is not handled settles.
    Files that are gone leave the state.
    """
    p, c = previous.alias("p"), current.alias("c")
    joined = c.join(p, (F.col("c.automation_id") == F.col("p.automation_id")) & (F.col("c.path") == F.col("p.path")), "left")
    known = F.col("p.path").isNotNull()
    same = known & (F.col("p.size") == F.col("c.size")) & (F.col("p.mtime_ns") == F.col("c.mtime_ns"))
    settles = same & ~F.col("p.handled")
    count = F.when(settles, F.col("p.stable_count") + 1).when(same, F.col("p.stable_count")).otherwise(0)
    handled = F.when(~has_run, F.lit(True)).when(settles, F.lit(True)).when(same, F.col("p.handled")).otherwise(F.lit(False))
    return joined.select("c.*", count.cast("int").alias("stable_count"), handled.alias("handled"), (settles & has_run).alias("candidate"))


def register_roots(roots: DataFrame, libraries: DataFrame, wanted: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """``roots`` and ``libraries`` after roots are registered.

    ``wanted``: ``path``, ``library_id``, ``root_id``, ``name``; one row for a path. A root that is
    known keeps its ids and name, is enabled, and its library counts as updated now; an
    unknown one is added, with its library.
    """
    asked = wanted.select(F.col("path").alias("w_path"), F.col("library_id").alias("w_library"), F.col("root_id").alias("w_root"), F.col("name").alias("w_name"))
    here = roots.join(asked.select("w_path"), F.col("path") == F.col("w_path"), "left")
    known = here.withColumn("enabled", F.col("w_path").isNotNull() | F.col("enabled")).select(*roots.columns)
    new = asked.join(roots, F.col("path") == F.col("w_path"), "left_anti")
    now = F.lit(now_ms).cast("long")
    values = {"id": F.col("w_root"), "library_id": F.col("w_library"), "path": F.col("w_path"), "enabled": F.lit(True), "created_at_ms": now}
    fill = lambda table, given: [given.get(c, F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    touched = roots.join(asked, F.col("path") == F.col("w_path"), "left_semi").select(F.col("library_id").alias("t_id")).distinct()
    renewed = libraries.join(touched, F.col("id") == F.col("t_id"), "left")
    renewed = renewed.withColumn("updated_at_ms", F.when(F.col("t_id").isNotNull(), now).otherwise(F.col("updated_at_ms"))).select(*libraries.columns)
    named = {"id": F.col("w_library"), "name": F.col("w_name"), "created_at_ms": now, "updated_at_ms": now}
    return known.union(new.select(*fill(roots, values))), renewed.union(new.select(*fill(libraries, named)))
