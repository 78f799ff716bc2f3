"""A search index that outlives the query, and a top-k over it that skips blocks.

Files are dealt to shards by a hash of their id, and stand in each shard by the number of their
words, in blocks of 1024. For every word and every window of three characters a block has one
row with the places where it occurs; rows of a shard are sorted by word, so that a search
reads the row groups of its words only. Blocks know their shortest file, and each row its largest
frequency, which bounds the score of any file of the block: blocks that can't reach the k-th
best score so far are not read.

A search finds the same rows as ``search.search``, without the table of files. An update
rebuilds the shards of changed files and publishes them with one manifest.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import versioned
from ..sources.versioned import BUCKET, Manifest
from ..sources.written import written
from .query import SEARCH_ROWS, SearchSpec, active, clamp, filters, parse_search
from .search import B, K1, LEAST_IDF, _query_tokens, mode, terms, tokens, trigrams

BLOCK_BITS = 10
#: Files of a shard, about.
SHARD_ROWS = 200_000
#: Blocks whose files are scored first, best bounds first; their number is bounded, so they are named in the scan.
FIRST_BLOCKS = 16
POSTINGS = "_bucket int, token string, block int, docs array<int>, places array<int>, n int, most int"
BLOCKS = "_bucket int, block int, n int, words long, grams long, fewest_words int, fewest_grams int"
KINDS = {"prefix": ("words", 2), "substring": ("grams", 1)}


def _tables(files: DataFrame) -> dict[str, DataFrame]:
    """Documents, blocks and postings of ``files`` with ``BUCKET``; one shuffle, by shard."""
    dealt = files.withColumns({"_words": F.size(tokens(F.col("path"))), "_grams": F.size(trigrams(F.col("path")))})
    number = F.row_number().over(Window.partitionBy(BUCKET).orderBy("_words", "_grams", "id")) - 1
    documents = dealt.withColumn("_n", number).withColumns({"_block": F.shiftright("_n", BLOCK_BITS), "_doc": F.col("_n").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))}).drop("_n")
    # The stored shard and block are columns of the files themselves, so that scans can use them.
    documents = written(documents.withColumn("_shard", F.col(BUCKET)))
    blocks = documents.groupBy(BUCKET, F.col("_shard"), F.col("_block").alias("block")).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.sum("_words").alias("words"), F.sum("_grams").alias("grams"), F.min("_words").alias("fewest_words"), F.min("_grams").alias("fewest_grams")
    )

    def postings(listed: Column) -> DataFrame:
        spread = documents.repartition(BUCKET).select(BUCKET, "_shard", F.col("_block").alias("block"), F.col("_doc").alias("doc"), F.posexplode(listed).alias("place", "token"))
        each = spread.groupBy(BUCKET, "_shard", "block", "token", "doc").agg(F.sort_array(F.collect_list("place")).alias("p"), F.count(F.lit(1)).alias("tf"))
        rows = F.sort_array(F.collect_list(F.struct("doc", "p")))
        block = each.groupBy(BUCKET, "_shard", "token", "block").agg(rows.alias("r"), F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").cast("int").alias("most"))
        docs = F.flatten(F.transform("r", lambda r: F.transform(r["p"], lambda _: r["doc"])))
        flat = block.select(BUCKET, "_shard", "token", "block", docs.alias("docs"), F.flatten(F.transform("r", lambda r: r["p"])).alias("places"), "n", "most")
        return flat.sortWithinPartitions(BUCKET, "token", "block")

    return {"documents": documents.repartition(BUCKET).sortWithinPartitions(BUCKET, "_block", "_doc"), "blocks": blocks, "words": postings(tokens(F.col("path"))), "grams": postings(trigrams(F.col("path")))}


def build(files: DataFrame, root: str, shards: int | None = None) -> Manifest:
    """Index ``files`` (id, path and further columns) at ``root``, in place of what is there.

    Ids must be unique, and ids and paths not null.
    """
    spark = files.sparkSession
    shards = shards or max(1, -(-files.count() // SHARD_ROWS))
    staged = {t: versioned.stage(rows, root) for t, rows in _tables(files.withColumn(BUCKET, versioned.bucket(F.col("id"), shards))).items()}
    every = lambda state: list({b for parts in state.parts.values() for b in parts})
    return versioned.commit(spark, root, lambda state: versioned.replaced(state, staged, every(state), {"shards": shards}))


def _documents(spark: SparkSession, state: Manifest, schema: StructType, shards: list[str] | None = None) -> DataFrame:
    more = StructType.fromDDL("_words int, _grams int, _block int, _doc int, _shard int")
    return versioned.read(spark, state, "documents", StructType([*schema.fields, *more.fields]), shards)


def update(spark: SparkSession, root: str, changed: DataFrame, gone: DataFrame) -> Manifest:
    """Rows of ``changed`` replace those of their id or are added; rows of the ids in ``gone`` go. Only the shards of these ids are read and rebuilt."""

    def change(state: Manifest) -> Manifest | None:
        shards = state.properties["shards"]
        shard = versioned.bucket(F.col("id"), shards)
        ids = written(changed.select("id").union(gone.select("id")).distinct().withColumn(BUCKET, shard))
        touched = [str(r[0]) for r in ids.select(BUCKET).distinct().collect()]
        if not touched:
            return None
        kept = _documents(spark, state, changed.schema, touched).select(*changed.columns).join(ids.select("id"), "id", "left_anti")
        rows = kept.select(*changed.columns).union(changed.select(*changed.columns)).withColumn(BUCKET, shard)
        staged = {t: versioned.stage(new, root) for t, new in _tables(rows).items()}
        return versioned.replaced(state, staged, touched)

    return versioned.commit(spark, root, change)


def _read(spark: SparkSession, state: Manifest, table: str, schema: str) -> DataFrame:
    return versioned.read(spark, state, table, schema.replace("_bucket int", "_shard int"))


def _phrases(text: str, kind: str) -> list[list[str]] | None:
    """For each term the tokens that must follow each other; of words the last one is a beginning. None: a term without any."""
    if kind == "prefix":
        found = [_query_tokens(t) for t in terms(text)]
    else:
        found = [[t.lower()[i : i + 3] for i in range(len(t.lower()) - 2)] for t in terms(text)]
    return found if all(found) else None


def _hit(token: str, prefix: bool) -> Column:
    return F.col("token").startswith(token) if prefix else F.col("token") == token


def _occurrences(postings: DataFrame, phrase: list[str], prefix: bool) -> DataFrame:
    """``_shard``, ``block``, ``doc`` and ``tf``: how often the phrase stands in each file.

    Every token of the phrase votes for the place where the phrase would begin.
    """
    parts = []
    for k, token in enumerate(phrase):
        rows = postings.where(_hit(token, prefix and k == len(phrase) - 1))
        found = rows.select("_shard", "block", F.inline(F.arrays_zip("docs", "places"))).toDF("_shard", "block", "doc", "place")
        parts.append(found.select("_shard", "block", "doc", (F.col("place") - k).alias("start"), F.lit(k).alias("k")))
    votes = reduce(DataFrame.union, parts)
    if len(phrase) > 1:
        votes = votes.groupBy("_shard", "block", "doc", "start").agg(F.count_distinct("k").alias("k")).where(F.col("k") == len(phrase))
    return votes.groupBy("_shard", "block", "doc").agg(F.count(F.lit(1)).alias("tf"))


def _blocks(postings: DataFrame, phrase: list[str], prefix: bool) -> DataFrame:
    """``_shard``, ``block``, ``most``: a bound of how often the phrase stands in any file of the block.

    A file may have several words with one beginning, so their largest frequencies are added; of
    a phrase no token is rarer than the phrase.
    """
    parts = [
        postings.where(_hit(token, prefix and k == len(phrase) - 1)).groupBy("_shard", "block").agg(F.sum("most").alias("most")).withColumn("k", F.lit(k))
        for k, token in enumerate(phrase)
    ]
    both = reduce(DataFrame.union, parts).groupBy("_shard", "block").agg(F.min("most").alias("most"), F.count(F.lit(1)).alias("k"))
    return both.where(F.col("k") == len(phrase)).drop("k")


def _frequency(postings: DataFrame, phrase: list[str], prefix: bool) -> int:
    """In how many files the phrase stands: by the rows' counts if one token is meant, else file by file."""
    if len(phrase) == 1:
        rows = postings.where(_hit(phrase[0], prefix))
        if not prefix:
            return rows.agg(F.sum("n")).first()[0] or 0
        each = rows.groupBy("_shard", "block").agg(F.size(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("n"))
        return each.agg(F.sum("n")).first()[0] or 0
    return _occurrences(postings, phrase, prefix).count()


def _score(idf: float, tf: Column, length: Column, average: float) -> Column:
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


class Search:
    """One search of an index; ``read_blocks`` and ``all_blocks`` tell how many blocks with all terms were scored, and are there."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, query: str | SearchSpec, library: str | None = None, limit: int = SEARCH_ROWS):
        """``schema``: of the files that were indexed."""
        self.spark, self.schema, self.limit = spark, schema, clamp(limit, SEARCH_ROWS)
        self.spec = parse_search(query) if isinstance(query, str) else query
        self.conditions = [active(), *filters(self.spec), *([F.col("library_id") == library] if library is not None else [])]
        self.state = versioned.manifest(spark, root)
        self.kind = mode(self.spec.text) if self.spec.text else "none"
        self.all_blocks = self.read_blocks = 0
        self.phrases = _phrases(self.spec.text, self.kind) if self.kind != "none" else None
        if not self.phrases:
            return
        self.prefix = self.kind == "prefix"
        table, self.times = KINDS[self.kind]
        self.postings = _read(spark, self.state, table, POSTINGS)
        self.blocks = _read(spark, self.state, "blocks", BLOCKS).withColumn("shortest", F.col(f"fewest_{table}") * self.times)
        n, total = self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(table), F.lit(0))).first()
        self.average = self.times * total / n if n else 1.0
        self.idf = []
        for phrase in self.phrases:
            df = _frequency(self.postings, phrase, self.prefix)
            idf = math.log((n - df + 0.5) / (df + 0.5))
            self.idf.append(idf if idf > 0 else LEAST_IDF)
        self.length = F.col(f"_{table}") * float(self.times)

    def _bounds(self) -> DataFrame:
        """``_shard``, ``block``, ``bound``: the best score that a file of a block with all terms may have."""
        rows = self.blocks.select("_shard", "block", "shortest")
        bound = F.lit(0.0)
        for i, (phrase, idf) in enumerate(zip(self.phrases, self.idf)):
            rows = rows.join(_blocks(self.postings, phrase, self.prefix).withColumnRenamed("most", f"most{i}"), ["_shard", "block"])
            bound += _score(idf, F.col(f"most{i}") * self.times, F.col("shortest"), self.average)
        # A little more, as sums of doubles may differ in their last digits.
        return rows.select("_shard", "block", (bound * (1 + 1e-9)).alias("bound"))

    def _scored(self, chosen) -> DataFrame:
        """The best rows of the blocks that ``chosen`` (a function of a table with _shard and a block column) keeps."""
        rows = chosen(_documents(self.spark, self.state, self.schema), "_block")
        for condition in self.conditions:
            rows = rows.where(condition)
        rank = F.lit(0.0)
        for i, (phrase, idf) in enumerate(zip(self.phrases, self.idf)):
            found = _occurrences(chosen(self.postings, "block"), phrase, self.prefix).select("_shard", F.col("block").alias("_block"), F.col("doc").alias("_doc"), (F.col("tf") * self.times).cast("double").alias(f"_tf{i}"))
            rows = rows.join(found, ["_shard", "_block", "_doc"])
            rank -= _score(idf, F.col(f"_tf{i}"), self.length, self.average)
        best = rows.withColumn("rank", rank).select(*[f"`{c}`" for c in self.schema.names], "rank")
        return best.orderBy("rank", "path", "id").limit(self.limit)

    def rows(self) -> DataFrame:
        """The files found, best first, with ``rank``."""
        empty = self.spark.createDataFrame([], StructType([*self.schema.fields, *StructType.fromDDL("rank double").fields]))
        if self.spec.empty or (self.spec.text and not self.phrases):
            return empty
        if not self.spec.text:
            files = _documents(self.spark, self.state, self.schema).select(*[f"`{c}`" for c in self.schema.names])
            return reduce(DataFrame.where, self.conditions, files).withColumn("rank", F.lit(0.0)).orderBy("rank", "path", "id").limit(self.limit)
        bounds = written(self._bounds())
        first = bounds.orderBy(F.desc("bound"), "_shard", "block").limit(FIRST_BLOCKS).collect()
        self.all_blocks = bounds.count()
        if not first:
            return empty
        named = {(r["_shard"], r["block"]) for r in first}

        def in_first(table: DataFrame, block: str) -> DataFrame:
            shards = sorted({s for s, _ in named})
            either = reduce(Column.__or__, [(F.col("_shard") == s) & F.col(block).isin(sorted(b for t, b in named if t == s)) for s in shards])
            return table.where(either)

        best = written(self._scored(in_first))
        # Whatever is not among the first must reach the last of ``limit`` rows.
        worst = -best.agg(F.max("rank")).first()[0] if best.count() >= self.limit else 0.0
        unseen = ~reduce(Column.__or__, [(F.col("_shard") == s) & (F.col("block") == b) for s, b in named])
        rest = written(bounds.where((F.col("bound") >= worst) & unseen).select("_shard", "block"))
        left = rest.count()
        self.read_blocks = len(named) + left
        if not left:
            return best.orderBy("rank", "path", "id")

        def in_rest(table: DataFrame, block: str) -> DataFrame:
            return table.join(rest.withColumnRenamed("block", block), ["_shard", block], "left_semi")

        return best.union(self._scored(in_rest)).orderBy("rank", "path", "id").limit(self.limit)
