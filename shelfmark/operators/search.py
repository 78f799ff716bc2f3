"""Full-text search over paths: prefix and substring modes with BM25 ranks.

The index takes each path twice (as name and as path), so frequencies and lengths
of the prefix mode are doubled; statistics cover every row of the table that is
given, missing files and other libraries too, and filters apply afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fold_diacritics
from .query import SEARCH_ROWS, SearchSpec, active, clamp, filters, parse_search

MOST_TERMS = 12
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def terms(text: str) -> list[str]:
    return text.split()[:MOST_TERMS]


def mode(text: str) -> str:
    """Substring if every term has three characters, else prefix for the whole query."""
    found = terms(text)
    return "none" if not found else "substring" if all(len(t) >= 3 for t in found) else "prefix"


def tokens(text: Column, fold: bool = True) -> Column:
    """Runs of letters and digits, in lower case and without diacritics."""
    plain = fold_diacritics(text) if fold else F.lower(text)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def trigrams(text: Column) -> Column:
    """Windows of three characters, in lower case."""
    low = F.lower(text)
    last = F.greatest(F.length(low) - 2, F.lit(0))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def _query_tokens(term: str) -> list[str]:
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", term) if unicodedata.category(c) != "Mn").lower()
    return [t for t in re.split(r"[\W_]+", plain) if t]


def _phrase_count(listed: Column, phrase: list[str]) -> Column:
    """Places where the phrase stands, its last token as a prefix."""
    starts = F.sequence(F.lit(0), F.size(listed) - 1)

    def here(i: Column) -> Column:
        found = F.get(listed, i + (len(phrase) - 1)).startswith(phrase[-1])
        for k, word in enumerate(phrase[:-1]):
            found &= F.get(listed, i + k) == word
        return F.coalesce(found, F.lit(False))

    return F.when(F.size(listed) > 0, F.size(F.filter(starts, here))).otherwise(0)


def _overlapping(text: Column, part: str) -> Column:
    """Occurrences of ``part``, overlapping ones too."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - len(part) + 1, F.lit(1)))
    return F.size(F.filter(starts, lambda i: F.substring(text, i, F.lit(len(part))) == part))


def ranked(files: DataFrame, text: str) -> DataFrame:
    """Rows that contain every term, with ``rank`` (smaller is better).

    One narrow pass finds the statistics as a single row of 2 + n numbers; the
    second pass scores. Neither shuffles more than one row a task.
    """
    kind, wanted = mode(text), terms(text)
    if kind == "none":
        return files.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    if kind == "prefix":
        phrases = [_query_tokens(t) for t in wanted]
        if not all(phrases):
            return files.where(F.lit(False)).withColumn("rank", F.lit(0.0))
        base = files.withColumn("_tokens", tokens(F.col("path")))
        counts = [(2 * _phrase_count(F.col("_tokens"), p)).cast("double") for p in phrases]
        length = (2 * F.size("_tokens")).cast("double")
    else:
        base = files.withColumn("_tokens", F.lower("path"))
        counts = [F.when(F.col("_tokens").contains(t.lower()), _overlapping(F.col("_tokens"), t.lower())).otherwise(0).cast("double") for t in wanted]
        length = F.greatest(F.length("_tokens") - 2, F.lit(0)).cast("double")
    names = [f"_tf{i}" for i in range(len(wanted))]
    scored = base.withColumns(dict(zip(names, counts)) | {"_length": length})
    stats = scored.agg(F.count(F.lit(1)).alias("_n"), F.avg("_length").alias("_avg"), *[F.count_if(F.col(n) > 0).alias(f"_df{n}") for n in names])
    joined = scored.where(F.array_min(F.array(*names)) > 0).join(F.broadcast(stats))
    rank = F.lit(0.0)
    for n in names:
        idf = F.log((F.col("_n") - F.col(f"_df{n}") + 0.5) / (F.col(f"_df{n}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        rank -= idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("_length") / F.col("_avg")))
    return joined.withColumn("rank", rank).select(*files.columns, "rank")


def token_table(files: DataFrame, grams: bool = False) -> DataFrame:
    """``id`` and ``token``: one row for each distinct word (or window of three) of a path."""
    listed = trigrams(F.col("path")) if grams else tokens(F.col("path"))
    return files.select("id", F.explode_outer(F.array_distinct(listed)).alias("token")).where("token is not null")


def matching(files: DataFrame, index: DataFrame, wanted: list[str], prefix: bool = True) -> DataFrame:
    """Files that have all of the tokens (or words that begin with them), by one semi-join for each."""
    for token in wanted:
        hit = F.col("token").startswith(token) if prefix else F.col("token") == token
        files = files.join(index.where(hit).select("id"), "id", "left_semi")
    return files


def search(files: DataFrame, query: str | SearchSpec, library: str | None = None, limit: int = SEARCH_ROWS) -> DataFrame:
    """``files`` (id, path, size, library_id, missing_since_ms ...) that match, best first.

    Without words only the filters count and the rank is 0; an empty search finds nothing.
    """
    spec = parse_search(query) if isinstance(query, str) else query
    if spec.empty:
        return files.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    rows = ranked(files, spec.text) if spec.text else files.withColumn("rank", F.lit(0.0))
    for condition in [active(), *filters(spec), *([F.col("library_id") == library] if library is not None else [])]:
        rows = rows.where(condition)
    return rows.orderBy("rank", "path", "id").limit(clamp(limit, SEARCH_ROWS))


def index_statistics(files: DataFrame) -> DataFrame:
    """``token``, ``df``, ``tf``, ``n`` and ``average_length``: what ranking needs of names and paths, which are indexed both."""
    listed = files.select("id", tokens(F.col("path")).alias("t"))
    totals = listed.agg(F.count(F.lit(1)).alias("n"), F.avg((2 * F.size("t")).cast("double")).alias("average_length"))
    each = listed.select("id", F.explode("t").alias("token")).groupBy("token", "id").count()
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"), (2 * F.sum("count")).alias("tf"))
    return counted.join(F.broadcast(totals)).select("token", "df", "tf", "n", "average_length")
