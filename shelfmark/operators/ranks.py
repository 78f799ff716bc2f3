"""Row numbers within groups of any size, without a window over a whole group.

Rows are dealt to tasks by ranges of (group, order) whose borders are sampled, so a group
that holds most rows is spread over many tasks. Each task numbers its own rows; a row's
number in its group is its local number plus the rows of that group in earlier ranges,
which a table with one row for each group and range tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written

LOCAL = (1 << 33) - 1


def _free(rows: DataFrame, *names: str) -> list[str]:
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def positions(rows: DataFrame, group: list[str], order: list[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """``rows`` with ``name``: their number from 0 (long) in their group, by ``order``.

    ``group``: column names (none: all rows are one group); a null is a value like others.
    ``order`` should tell the rows of a group apart: rows that tie are numbered in any order,
    and lie in one task. A column called ``name`` is replaced. The rows move once and are
    written once, so the numbers are the same each time the result is read.
    """
    rows = rows.drop(name)
    part, at, first, before = _free(rows, "part", "at", "first", "before")
    keys = [*[F.col(f"`{g}`").asc_nulls_first() for g in group], *order]
    ranges = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    local = ranges.sortWithinPartitions(*keys).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL))})
    local = written(local)
    counts = local.groupBy(*[F.col(f"`{g}`") for g in group], part).agg(F.count(F.lit(1)).alias(before), F.min(at).alias(first))
    earlier = Window.partitionBy(*[F.col(f"`{g}`") for g in group]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    on = F.col(f"l.{part}") == F.col(f"s.{part}")
    for g in group:
        on &= F.col(f"l.`{g}`").eqNullSafe(F.col(f"s.`{g}`"))
    joined = local.alias("l").join(starts.alias("s"), on)
    return joined.select(*[F.col(f"l.`{c}`") for c in rows.columns], (F.col(f"l.{at}") - F.col(f"s.{first}") + F.col(f"s.{before}")).alias(name))
