"""File names that are safe to create, and text folding that SQL functions lack."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNNAMED = "未命名文件"
STEM_BYTES = 220
#: Device names that some systems reserve.
DEVICES = frozenset(["con", "prn", "aux", "nul", *[f"{port}{n}" for port in ("com", "lpt") for n in range(1, 10)]])
FORBIDDEN = frozenset('/\\:*?"<>|')


def safe_filename(stem: str, extension: str | None = None) -> str:
    """A name in NFC that every common file system takes."""
    usable = "".join(c for c in unicodedata.normalize("NFC", stem) if c not in FORBIDDEN and unicodedata.category(c) != "Cc")
    name = " ".join(usable.split()).strip(" .") or UNNAMED
    if name.lower() in DEVICES and name.isascii():
        name = f"_{name}"
    cut = name.encode("utf-8")[:STEM_BYTES].decode("utf-8", "ignore")
    suffix = (extension or "").lstrip(".")
    return f"{cut}.{suffix}" if suffix else cut


def split_name(name: str) -> tuple[str, str]:
    """Stem and extension; a leading dot starts no extension."""
    stem, dot, extension = name.rpartition(".")
    return (stem, extension) if dot and stem else (name, "")


def numbered_name(name: str, number: int) -> str:
    stem, extension = split_name(name)
    return safe_filename(f"{stem} ({number})", extension)


def safe_filename_column(stem: Column, extension: Column) -> Column:
    @F.pandas_udf("string")
    def safe(stems: pd.Series, extensions: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else safe_filename(s, e) for s, e in zip(stems, extensions)])

    return safe(stem, extension)


def normalize(text: Column, form: str) -> Column:
    """Unicode normalisation, which Spark's functions lack. Null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return run(text)


def fold_diacritics(text: Column) -> Column:
    """Lower case without combining marks, as the word index folds its tokens."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()
        return values.map(lambda t: None if t is None else plain(t))

    return run(text)


def fold_case(text: Column) -> Column:
    """Full case folding by SQL functions: ``Straße`` and ``STRASSE`` become equal.

    Upper case expands what folding expands; a dotless i, which folding keeps, has no
    part in that, and there is one sigma only. The optimizer merges case mappings
    that follow each other, but none that a replacement parts.
    """
    dotless, kept = F.lit("\u0131"), F.lit("\ue131")
    upper = F.upper(F.replace(F.lower(text), dotless, kept))
    return F.replace(F.lower(F.replace(upper, kept, dotless)), F.lit("\u03c2"), F.lit("\u03c3"))
