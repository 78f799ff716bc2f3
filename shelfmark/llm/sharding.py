"""Sharding by a Feistel permutation of global row numbers (DataFrame functions only).

Every row gets its number in an order that depends on its content alone, the
permutation maps numbers to places, and place ``p`` lies in shard ``p mod n`` at
slot ``p div n``. Both can be computed for any row number, without a table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, table

BUCKET_BITS = 14
ROUNDS = 8
WALK = 64
HEAVY_SHARE = 512
HEAVY_LEAST = 2_000
SALTS = 16


def feistel(number: Column, rows: int, seed: int = 0) -> Column:
    """``number``'s place under a permutation of 0 .. ``rows`` - 1.

    Numbers are written as ``left * b + right`` with ``a`` about ``sqrt(rows)`` and
    ``b = ceil(rows / a)``; each round adds a keyed hash of one half to the other,
    modulo that half's range. That permutes 0 .. a*b - 1, and results of ``rows`` or
    more walk on along their cycle. Only ``a*b - rows < a`` results are too large,
    so ``a*b - rows + 1`` steps always suffice. Where that is over ``WALK``, the
    chance that ``WALK`` steps don't is below ``rows * (a / rows) ** WALK``; the
    query then fails rather than give a wrong place.
    """
    a = max(1, math.isqrt(max(rows, 1)))
    b = -(-max(rows, 1) // a)
    size_a, size_b = F.lit(a).cast("long"), F.lit(b).cast("long")

    def halves(left: Column, right: Column) -> Column:
        return F.struct(left.alias("left"), right.alias("right"))

    def turn(state: Column, i: Column) -> Column:
        left, right = state["left"], state["right"]
        into_left = halves(F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), i, right), size_a), size_a), right)
        into_right = halves(left, F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), i, left), size_b), size_b))
        return F.when(i % 2 == 0, into_left).otherwise(into_right)

    def once(x: Column) -> Column:
        right = F.pmod(x, size_b)
        left = ((x - right) / size_b).cast("long")
        rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(rounds, halves(left, right), turn, lambda s: s["left"] * size_b + s["right"])

    steps = F.sequence(F.lit(1), F.lit(min(a * b - rows + 1, WALK)))
    walked = F.aggregate(steps, number.cast("long"), lambda x, i: F.when((i > 1) & (x < rows), x).otherwise(once(x)))
    failed = F.raise_error(F.lit("the Feistel walk left its range")).cast("long")
    return F.when(walked < rows, walked).otherwise(failed)


def number_rows(df: DataFrame, by: list[str], name: str = "row_number") -> DataFrame:
    """Number the rows of ``df`` from 0 without gaps, in the order of a hash of ``by``.

    The order depends on the values in ``by`` alone, not on files or partitions;
    rows that agree in all of ``by`` get neighbouring numbers in any order. A row is
    sent once, to one of 2**14 hash ranges, with the range's first number from a
    table of counts whose size is bounded. Rows of one value that is more than
    1/512 of all are dealt to 16 ranges of their own.
    """
    h, g, bucket, heavy, part, n = fresh(df, "h", "g", "bucket", "heavy", "part", "n")
    keyed = df.withColumn(h, F.xxhash64(*by)).withColumn(g, F.xxhash64(F.lit(1), *by))
    keyed = keyed.withColumn(bucket, F.shiftrightunsigned(h, 64 - BUCKET_BITS))
    sizes = keyed.groupBy(bucket).agg(F.count(F.lit(1)).alias(n))
    rows = sizes.agg(F.sum(n)).first()[0] or 0
    least = max(HEAVY_LEAST, rows // HEAVY_SHARE)
    # At most 512 values, and a range that is too small for one holds none.
    large = [r[0] for r in sizes.where(F.col(n) >= least).select(bucket).collect()]
    values = []
    if large:
        values = [r[0] for r in keyed.where(F.col(bucket).isin(large)).groupBy(h).count().where(F.col("count") >= least).select(h).collect()]
    if values:
        # The salts are drawn once: they must be the same in the counts and below.
        salted = F.when(F.col(h).isin(values), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        keyed = materialize(keyed.withColumn(heavy, F.when(F.col(h).isin(values), F.col(h))).withColumn(part, salted))
    else:
        keyed = keyed.withColumn(heavy, F.lit(None).cast("long")).withColumn(part, F.lit(None).cast("long"))
    keys = [bucket, heavy, part]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    first = F.sum(n).over(Window.orderBy(*[F.asc_nulls_first(k) for k in keys]).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, F.coalesce(first, F.lit(0)).alias(n))
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(h, g))
    placed = keyed.withColumn(name, inner.cast("long") - 1).alias("rows")
    on = [F.col(f"rows.{k}").eqNullSafe(F.col(f"starts.{k}")) for k in keys]
    joined = placed.join(F.broadcast(starts.alias("starts")), on)
    return joined.select(*[F.col(f"rows.`{c}`") for c in df.columns], (F.col(f"rows.{name}") + F.col(f"starts.{n}")).alias(name))


def shard(df: DataFrame, shards: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Deal the rows of ``df`` into ``shards`` shards in a reproducible random order.

    Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard); the
    shards' sizes are at most one apart. ``by``: the columns that tell rows apart
    (default: all). Columns of ``df`` keep their names and values, nulls and empty
    texts are values like any other, repeated rows get places of their own, an
    empty table gives an empty table. ``df`` must not have columns ``shard``,
    ``slot``: rename them first.
    """
    if clash := {c for c in df.columns if c.lower() in ("shard", "slot")}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    (number,) = fresh(df, "row_number")
    numbered = number_rows(df, by or df.columns, number)
    rows = df.count()
    place = feistel(F.col(number), rows, seed)
    (at,) = fresh(df, "place")
    placed = numbered.withColumn(at, place).drop(number)
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.pmod(at, F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col(at) / shards).cast("long").alias("slot"),
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15; law ``rows``: the counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("content")
    )
    dealt = shard(materialize(docs), 16, seed=1)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
