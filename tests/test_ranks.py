"""Distributed row numbers against a sort of all rows."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.ranks import positions


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions(spark, partitions):
    """One group holds nine tenths of the rows, one is null, names clash, and rows repeat."""
    group = F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 20 == 19, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 70))
    rows = spark.range(4000).select(group.alias("g"), (F.xxhash64("id") % 1000).alias("o"), "id", F.lit(1).alias("part"), F.lit(2).alias("At"), F.lit(3).alias("position"))
    found = positions(rows, ["g"], [F.col("o").desc(), F.col("id").asc()], partitions=partitions)
    assert found.columns == ["g", "o", "id", "part", "At", "position"]
    each = defaultdict(list)
    for r in found.collect():
        assert (r.part, r.At) == (1, 2)
        each[r.g].append(r)
    assert len(each["hot"]) == 3600 and None in each
    for own in each.values():
        own.sort(key=lambda r: (-r.o, r.id))
        assert [r.position for r in own] == list(range(len(own)))
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x]
    assert windows and all("part" in w for w in windows)


def test_positions_without_group(spark):
    found = positions(spark.range(500).select((F.col("id") * 7919 % 500).alias("x")), [], [F.col("x").asc()], "n", partitions=5).collect()
    assert sorted((r.x, r.n) for r in found) == [(i, i) for i in range(500)]
    assert positions(spark.range(0), [], [F.col("id").asc()]).isEmpty()
