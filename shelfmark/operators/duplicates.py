"""Exact duplicates in three tiers: sizes, a hash of samples, a hash of everything.

Only files of a repeated size are sampled, and only those that share their samples too are hashed
whole. What is repeated is a set that is broadcast if it is small, and a bitmap of hashes
of bounded size if it is not: contents are never shuffled, and never hashed for nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import written

SAMPLE = 64 * 1024
#: So many repeated values are broadcast as they are; more as 2**26 bits in 2048 rows.
SET_ROWS = 2_000_000
BITMAP = 1 << 26


def sampled(content: Column, size: Column, sample: int = SAMPLE) -> Column:
    """SHA-256 over the size and samples at the start, the middle and the end."""
    middle = F.greatest(F.floor((size - sample) / 2), F.lit(0)).cast("int")
    end = F.greatest(size - sample, F.lit(0)).cast("int")
    parts = [content.substr(F.lit(1), F.lit(sample)), content.substr(middle + 1, F.lit(sample)), content.substr(end + 1, F.lit(sample))]
    return F.sha2(F.concat_ws("\0", size.cast("string"), *parts), 256)


def whole(content: Column) -> Column:
    return F.sha2(content, 256)


def buckets(files: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``n`` where more than one row has them."""
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def among(rows: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """The rows whose ``keys`` are in the written table ``found``; of many, a few more rows, whose hash agrees with a found one's."""
    if found.count() <= SET_ROWS:
        on = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
        return rows.alias("r").join(F.broadcast(found.select(*keys).alias("f")), on, "left_semi")
    at = F.pmod(F.xxhash64(*keys), F.lit(BITMAP))
    maps = found.groupBy(F.bitmap_bucket_number(at).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    placed = rows.withColumns({"_part": F.bitmap_bucket_number(at), "_bit": F.bitmap_bit_position(at)}).join(F.broadcast(maps), "_part")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return placed.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*rows.columns)


@dataclass(frozen=True)
class Tiers:
    """Written tables: ``sampled`` has the files of repeated sizes with ``quick``, ``hashed`` those hashed whole with ``full``."""

    sampled: DataFrame
    hashed: DataFrame


def _candidates(files: DataFrame, sample: int, skip_empty: bool) -> DataFrame:
    """Files of repeated sizes with ``quick``; the first pass reads sizes only."""
    rows = files.where("size > 0") if skip_empty else files
    sizes = written(buckets(rows.select("size"), "size"))
    return among(rows, sizes, "size").withColumn("quick", sampled(F.col("content"), F.col("size"), sample))


def samples(files: DataFrame, sample: int = SAMPLE, skip_empty: bool = False) -> DataFrame:
    """The second tier alone: the files of repeated sizes with ``quick`` in place of their contents."""
    return written(_candidates(files, sample, skip_empty).drop("content"))


def tiers(files: DataFrame, sample: int = SAMPLE, skip_empty: bool = False, full: Callable[[Column], Column] = whole) -> Tiers:
    """``files`` (size, content and more) through the tiers, without their contents.

    Empty files have one size and form a group like others, unless they are skipped. Null sizes
    and contents are values like others.
    """
    some = _candidates(files, sample, skip_empty)
    first = written(some.drop("content"))
    pairs = written(buckets(first, "size", "quick"))
    return Tiers(first, written(among(some, pairs, "size", "quick").withColumn("full", full(F.col("content"))).drop("content")))


def _classes(hashed: DataFrame) -> DataFrame:
    found = hashed.groupBy("full", "size").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("suggested_keep")).where("n > 1")
    return found.select(F.col("full").alias("content_hash"), "size", "n", "suggested_keep", (F.col("size") * (F.col("n") - 1)).alias("potential_savings"))


def classes(files: DataFrame, sample: int = SAMPLE, skip_empty: bool = False) -> DataFrame:
    """``content_hash``, ``size``, ``n``, ``suggested_keep`` and ``potential_savings`` of each group, without its members."""
    return _classes(tiers(files, sample, skip_empty).hashed)


def members(files: DataFrame, sample: int = SAMPLE, skip_empty: bool = False) -> DataFrame:
    """``content_hash``, ``size``, ``path`` and ``keep`` (the group's first path) of each file in a group, one row a file: a group may be of any size."""
    hashed = tiers(files, sample, skip_empty).hashed
    found = _classes(hashed).select(F.col("content_hash").alias("of"), F.col("size").alias("of_size"), "suggested_keep")
    joined = hashed.join(found, F.col("full").eqNullSafe(F.col("of")) & F.col("size").eqNullSafe(F.col("of_size")))
    return joined.select(F.col("full").alias("content_hash"), "size", "path", (F.col("path") == F.col("suggested_keep")).alias("keep"))


def groups(files: DataFrame, sample: int = SAMPLE, skip_empty: bool = False) -> DataFrame:
    """``classes`` with the sorted ``paths`` of each group, for a display; ``members`` is for groups without bound."""
    found = tiers(files, sample, skip_empty).hashed.groupBy("full", "size").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("path")).alias("paths"))
    return found.where("n > 1").select(
        F.col("full").alias("content_hash"), "size", "n", "paths", F.get("paths", F.lit(0)).alias("suggested_keep"), (F.col("size") * (F.col("n") - 1)).alias("potential_savings")
    )


def statistics(files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """How many files entered, were sampled, were hashed whole, and were skipped as not ``ordinary``: counted on what was really read."""
    done = tiers(files.where("ordinary"), sample)
    number = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    entered = files.agg(F.count(F.lit(1)).alias("input_files"), F.count_if(~F.col("ordinary")).alias("skipped_files"))
    return entered.join(F.broadcast(number(done.sampled, "quick_hashed_files"))).join(F.broadcast(number(done.hashed, "fully_hashed_files")))
