"""Benchmark decontamination by MinHash containment search (DataFrame functions only).

A test item is in a document if the document contains at least 0.8 of the item's
distinct five-word shingles. Of an item with n shingles that are ordered by hash,
the n - ceil(0.8 n) + 1 smallest form its sketch: a document that misses all of
them misses more than a fifth, so documents that share one are the only
candidates, and none is lost. Items stand in partitions by size, the power of two
below n; a document looks only into partitions whose items it is large enough to
contain. Candidates are verified with the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialize, table

WIDTH = 5
#: Containment of NEED / OF or more.
NEED, OF = 4, 5
#: Only tables of at most so many values (some 16 MB) are broadcast.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def over_runs(listed: Column, use) -> Column:
    """``use(words, i)`` for each run of five of the words ``listed``, from place ``i`` (from 0) on."""

    def runs(own: Column) -> Column:
        starts = F.when(F.size(own) >= WIDTH, F.sequence(F.lit(0), F.size(own) - WIDTH)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: use(own, i))

    return let(listed, runs)


def shingles(listed: Column) -> Column:
    return over_runs(listed, lambda own, i: F.array_join(F.slice(own, i + 1, WIDTH), " "))


def shingle_hashes(listed: Column) -> Column:
    """A hash of each shingle, without building it."""
    return over_runs(listed, lambda own, i: F.xxhash64(*[F.get(own, i + k) for k in range(WIDTH)]))


def bounded(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """``df``, written, and marked for broadcast only if it is small enough.

    ``weight``: how many values a row holds, for rows of arrays.
    """
    written = materialize(df)
    size = written.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    out = F.broadcast(written) if size <= BROADCAST_ROWS else written
    out.written_path = written.written_path
    return out


def least(n: Column) -> Column:
    """How many of ``n`` shingles are enough."""
    return F.ceil(n * NEED / OF)


def contained_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a document and a test item that it contains.

    ``documents``: ``doc_id`` and ``text``; ``items``: ``item_id`` and ``text``; further
    columns are left out. Returns ``doc_id``, ``item_id``, ``n_shingles`` and ``n_found``
    (longs, of the item's distinct shingles) and ``containment``. Null and empty texts,
    items of fewer than five words, and items without an id, match nothing. Rows that repeat an id with
    another text are searched by themselves and give a pair each; wholly repeated
    rows give one.
    """
    listed = words(F.col("text"))
    own = items.select("item_id", F.array_distinct(shingles(listed)).alias("own"), F.sort_array(F.array_distinct(shingle_hashes(listed))).alias("hashes")).distinct()
    own = materialize(own.where(F.size("own") > 0).select("item_id", "own", "hashes", F.size("own").cast("long").alias("n")))
    part = F.floor(F.log2("n")).cast("int")
    sketch = own.select("item_id", part.alias("part"), F.explode(F.slice("hashes", F.lit(1), (F.col("n") - least(F.col("n")) + 1).cast("int"))).alias("h"))
    source = documents.select("doc_id", F.xxhash64("text").alias("content"), "text")
    probes = source.select("doc_id", "content", shingle_hashes(listed).alias("own"))
    # The largest partition whose smallest items fit: 0.8 * 2**part <= size.
    room = F.floor(F.log2(F.size("own") * OF / NEED)).cast("int")
    probes = probes.select("doc_id", "content", room.alias("room"), F.explode_outer("own").alias("h"))
    met = probes.join(bounded(sketch), "h").where("part <= room").select("doc_id", "content", "item_id").distinct()
    candidates = bounded(met.select(F.col("doc_id").alias("d"), F.col("content").alias("c"), "item_id"))
    pairs = source.join(candidates, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")))
    pairs = pairs.join(bounded(own.select(F.col("item_id").alias("i"), "own", "n"), F.size("own")), F.col("item_id") == F.col("i"))
    found = F.size(F.array_intersect("own", shingles(listed))).cast("long")
    counted = pairs.select("doc_id", "content", "item_id", F.col("n").alias("n_shingles"), found.alias("n_found"))
    good = counted.where(F.col("n_found") * OF >= F.col("n_shingles") * NEED).distinct()
    return good.select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def decontaminate(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``documents`` that contain no item; rows without an id or text stay as they are judged.

    A null ``doc_id`` is an id like others: all rows of an id of which one row contains
    an item are removed. All columns stay, whatever they are called.
    """
    (leak,) = fresh(documents, "leak")
    leaks = contained_items(documents, items).select(F.col("doc_id").alias(leak)).distinct()
    return documents.join(bounded(leaks), F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item it contains."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dw),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM bw),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM hit JOIN n USING (item_id) WHERE n_found * 5 >= n_shingles * 4
"""
