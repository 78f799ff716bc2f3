"""The search language, filters, listings, overview and top-k operators."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, has_extension, within

MOST_TOKENS, MOST_EXTENSION = 24, 16
LARGEST = 2**64 - 1
#: Upper bounds of the page, search, history and job listings.
PAGE_ROWS, SEARCH_ROWS, HISTORY_ROWS, JOB_ROWS = 500, 200, 100, 200


class InvalidSearch(ValueError):
    """A search that the language does not allow."""


class FileTooLarge(ValueError):
    """A size beyond 64 bits."""


@dataclass(frozen=True)
class SearchSpec:
    text: str = ""
    extension: str | None = None
    minimum_size: int | None = None
    maximum_size: int | None = None

    @property
    def empty(self) -> bool:
        return not self.text and self.extension is None and self.minimum_size is None and self.maximum_size is None


_SIZE = re.compile(r"(>=|<=|>|<|=)?((?:[0-9]+\.?[0-9]*|\.[0-9]+))([a-z]*)", re.I | re.A)
_UNITS = {unit: 1024**power for power, units in enumerate((("", "b"), ("kb",), ("mb",), ("gb",), ("tb",))) for unit in units}


def parse_size(literal: str) -> tuple[int | None, int | None]:
    """Inclusive bounds of ``>10MB`` and the like; units are binary, halves round up."""
    match = _SIZE.fullmatch(literal)
    if not match or match[3].lower() not in _UNITS:
        raise InvalidSearch(f"size: {literal!r} is no comparison, number and unit B, KB, MB, GB or TB")
    size = float(match[2]) * _UNITS[match[3].lower()]
    if size > LARGEST:
        raise FileTooLarge(literal)
    size = min(math.floor(size + 0.5), LARGEST)
    compare = match[1] or "="
    if compare == "<" and size == 0:
        raise InvalidSearch("size: nothing is smaller than 0")
    low = {">": min(size + 1, LARGEST), ">=": size, "=": size}.get(compare)
    high = {"<": size - 1, "<=": size, "=": size}.get(compare)
    return low, high


def parse_search(query: str) -> SearchSpec:
    """Words, at most one ``ext:`` and one ``size:``; what follows the 24th token is left out."""
    found: dict[str, str] = {}
    words = []
    for token in query.split()[:MOST_TOKENS]:
        prefix = next((p for p in ("ext:", "size:") if token.startswith(p)), None)
        if prefix is None:
            words.append(token)
        elif prefix in found:
            raise InvalidSearch(f"{prefix} can be given once only")
        else:
            found[prefix] = token[len(prefix) :]
    wanted = found.get("ext:")
    if wanted is not None:
        wanted = wanted.lstrip(".").lower()
        if not re.fullmatch(rf"[a-z0-9]{{1,{MOST_EXTENSION}}}", wanted, re.A):
            raise InvalidSearch("ext: takes 1 to 16 ASCII letters and digits")
    low, high = parse_size(found["size:"]) if "size:" in found else (None, None)
    if low is not None and high is not None and low > high:
        raise InvalidSearch("size: the range is empty")
    return SearchSpec(" ".join(words), wanted, low, high)


def active() -> Column:
    return F.col("missing_since_ms").isNull()


def filters(spec: SearchSpec) -> list[Column]:
    """Only the conditions that are given, so each one can be pushed to the scan."""
    found = []
    if spec.extension is not None:
        found.append(has_extension(F.col("path"), spec.extension))
    if spec.minimum_size is not None:
        found.append(F.col("size") >= spec.minimum_size)
    if spec.maximum_size is not None:
        found.append(F.col("size") <= min(spec.maximum_size, 2**63 - 1))
    return found


def scoped(files: DataFrame, library: str | None = None) -> DataFrame:
    """Files that are not missing, of one library or of all."""
    rows = files.where(active())
    return rows if library is None else rows.where(F.col("library_id") == library)


def clamp(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def page(files: DataFrame, library: str, limit: int, cursor: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A page in the order of (path, id), and the cursor of the next one: no row at the end."""
    limit = clamp(limit, PAGE_ROWS)
    rows = scoped(files, library)
    if cursor:
        path, id_ = cursor
        rows = rows.where((F.col("path") > path) | ((F.col("path") == path) & (F.col("id") > id_)))
    ahead = rows.orderBy("path", "id").limit(limit + 1)
    last = ahead.orderBy("path", "id").limit(limit)
    more = ahead.agg(F.count(F.lit(1)).alias("n"))
    end = last.agg(F.max(F.struct("path", "id")).alias("cursor"))
    return last, more.join(end).where(F.col("n") > limit).select("cursor.*")


def overview(files: DataFrame, library: str | None = None) -> DataFrame:
    """Number, bytes and latest change; one row even if there are no files."""
    return scoped(files, library).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"),
        F.max("modified_at_ns").alias("latest_modified_at_ns"),
    )


def file_view(files: DataFrame) -> DataFrame:
    return files.select("id", basename(F.col("path")).alias("name"), "path", "size", "modified_at_ns")


def under(files: DataFrame, directory: str) -> DataFrame:
    return files.where(within(F.col("path"), directory))


def top(rows: DataFrame, limit: int, most: int, *order: Column | str) -> DataFrame:
    """The first rows of an order that should end in a unique key."""
    return rows.orderBy(*order).limit(clamp(limit, most))


NAME_CHARACTERS, QUERY_CHARACTERS = 80, 300


def smart_folder(name: str, query: str) -> dict:
    """A saved search in the form it is stored in, or ``InvalidSearch``."""
    name, query = name.strip(), query.strip()
    if not 0 < len(name) <= NAME_CHARACTERS or not 0 < len(query) <= QUERY_CHARACTERS:
        raise InvalidSearch("a smart folder needs a name of 1 to 80 and a query of 1 to 300 characters")
    spec = parse_search(query)
    rule = {"version": 1, "text": spec.text, "extension": spec.extension, "minimum_size": spec.minimum_size, "maximum_size": spec.maximum_size}
    return {"name": name, "query": query, "rule_version": 1, "rule": rule}


def smart_folders(name: Column, query: Column) -> Column:
    """``smart_folder`` for rows: a struct of ``name`` and ``query`` as they are stored and ``wrong``, null where nothing is."""

    @F.pandas_udf("name string, query string, wrong string")
    def run(names: pd.Series, queries: pd.Series) -> pd.DataFrame:
        out = []
        for given in zip(names, queries):
            try:
                saved = smart_folder(*(text or "" for text in given))
                out.append((saved["name"], saved["query"], None))
            except (InvalidSearch, FileTooLarge) as wrong:
                out.append((None, None, str(wrong)))
        return pd.DataFrame(out, columns=["name", "query", "wrong"])

    return run(name, query)


def from_rule(rule: dict) -> SearchSpec:
    return SearchSpec(rule["text"], rule["extension"], rule["minimum_size"], rule["maximum_size"])


def natural_key(name: Column) -> Column:
    """A key that sorts numbers in names by their value, whatever their length; case does not matter."""

    def part(x: Column) -> Column:
        number = F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0"))
        return F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(number).cast("string"), 6, "0"), number)).otherwise(x)

    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), 0), part), "")


def natural_order(path: Column, descending: bool = False) -> list[Column]:
    """By name, then by path; the tiebreak turns with the direction."""
    keys = [natural_key(basename(path)), path]
    return [k.desc() for k in keys] if descending else keys
