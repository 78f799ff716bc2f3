"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before has
kept and returns a DataFrame; it is written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import discard, materialize, recorded, table
from shelfmark.llm.decontaminate import decontaminate
from shelfmark.llm.lines import dedup_lines
from shelfmark.llm.packing import pack_documents
from shelfmark.llm.quality import keep_selected
from shelfmark.llm.simhash import keep_first


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go, and toxic ones.

    Null, empty and wordless texts stay, as there is no evidence against them. Rows of one
    id and text share their fate. Long texts are judged whole. Equal keys: smaller ids stay.
    """
    return keep_selected(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier line alike go, however short; ``n_chars`` follows the text.

    Every row stays: null and empty texts as they are, a text all of whose lines go becomes
    empty. Earlier is a smaller id (null: the largest), then a smaller line number; rows
    that repeat an id lose the same line numbers.
    """
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    A null id is larger than any; of equal ids the row with the smaller hash stays, of
    wholly equal rows one. Null, empty and wordless texts are copies of each other.
    """
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts contain none. All rows of an id of which one contains an item go,
    a null id being an id like others. Without items all rows stay.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in sequences of 2048 tokens.

    Null and empty texts are one piece of the end token; longer texts than a sequence are cut.
    Repeated rows are packed each. No documents, no pieces.
    """
    import public_tokenizers

    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language models of hashed n-grams and tokenizers are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's tables go once its result is written."""
    docs, old = table(spark, sf_dir, "documents"), []
    for _, work in STAGES[:-1]:
        with recorded() as used:
            docs = materialize(work(spark, docs, sf_dir))
        discard(*old, *[path for path in used if path != docs.written_path])
        old = [docs.written_path]
    return STAGES[-1][1](spark, docs, sf_dir)
