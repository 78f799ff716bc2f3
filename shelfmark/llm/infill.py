"""Fill-in-the-middle: texts cut at two of their units and put together in another order.

Texts are decomposed into chunks of bytes that overlap by one, so whether a unit begins at a
byte is told from two adjacent bytes of one chunk. All chunks of a batch count their
units at once; prefix sums of the counts tell which chunk of a text owns the rank of a cut, and
only those chunks are scanned again for the cut's place. The rest is column expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

#: Bytes of a chunk, and of the chunks that are looked at in one go.
CHUNK, WINDOW = 1 << 12, 1 << 22
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Whether a unit begins at a byte, by the byte before it and itself.
UNITS = {"lines": lambda before, here: before == 10, "characters": lambda before, here: (here & 0xC0) != 0x80}


def _marks(data: np.ndarray, lo: int, hi: int, unit: str) -> np.ndarray:
    """Which of the bytes ``lo`` to ``hi`` begin a unit; the byte before ``lo`` is looked at too. Beginnings of texts are the caller's."""
    before = data[lo - 1 : hi - 1] if lo else np.concatenate([data[:1], data[: hi - 1]])
    return UNITS[unit](before, data[lo:hi]).copy()


def cut_places(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str = "lines") -> tuple[np.ndarray, np.ndarray]:
    """The number n of units of each text, and the bytes (2 for each text) where its units of rank
    ``first`` and ``second`` modulo n + 1 begin, the smaller first; rank n is the end.

    ``bounds``: where the texts in ``data`` begin, and where the last one ends.
    """
    sizes = np.diff(bounds)
    chunks = -(-sizes // CHUNK)
    own = np.repeat(np.arange(len(sizes)), chunks)
    begin = bounds[own] + (np.arange(len(own)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
    end = np.minimum(begin + CHUNK, bounds[own + 1])
    counts = np.zeros(len(own), np.int64)
    for i in range(0, len(own), WINDOW // CHUNK):
        some = slice(i, i + WINDOW // CHUNK)
        lo, hi = begin[some][0], end[some][-1]
        marks = _marks(data, lo, hi, unit)
        marks[begin[some][begin[some] == bounds[own[some]]] - lo] = True
        counts[some] = np.add.reduceat(marks, begin[some] - lo, dtype=np.int64)
    sums = np.cumsum(counts)
    n = np.bincount(own, counts, len(sizes)).astype(np.int64)
    ranks = np.sort(np.stack([first % (n + 1), second % (n + 1)], 1), 1)
    places = np.repeat(bounds[1:, None], 2, 1)
    inside = ranks < n[:, None]
    wanted = (ranks + (np.cumsum(n) - n)[:, None])[inside]
    owner = np.searchsorted(sums, wanted, "right")
    found = np.empty(len(wanted), np.int64)
    for i, (chunk, rank) in enumerate(zip(owner.tolist(), (wanted - sums[owner] + counts[owner]).tolist())):
        lo = int(begin[chunk])
        marks = _marks(data, lo, int(end[chunk]), unit)
        marks[0] |= lo == bounds[own[chunk]]
        found[i] = lo + np.flatnonzero(marks)[rank]
    places[inside] = found
    return n, places


def cut(text: Column, first: Column, second: Column, unit: str = "lines") -> Column:
    """``n``, ``prefix``, ``middle`` and ``suffix`` of ``text`` (no nulls), cut at the ranks ``first`` and ``second`` modulo n + 1."""

    @F.arrow_udf("n long, prefix string, middle string, suffix string")
    def run(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        n, places = cut_places(data, bounds, first.to_numpy(), second.to_numpy(), unit)
        # The parts of a text lie one behind the other, so they share its bytes.
        edges = np.append(np.column_stack([bounds[:-1], places]).ravel(), bounds[-1])
        parts = pa.LargeStringArray.from_buffers(3 * len(texts), pa.py_buffer(edges), pa.py_buffer(data))
        columns = [parts.take(pa.array(np.arange(k, 3 * len(texts), 3))).cast(pa.string()) for k in range(3)]
        return pa.StructArray.from_arrays([pa.array(n), *columns], names=["n", "prefix", "middle", "suffix"])

    return run(text, first, second)


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from; exact, as texts that contain a sentinel are left plain."""

    def parts(marks: tuple[str, str, str]) -> list[Column]:
        out, rest = [], F.substr(output, F.lit(len(marks[0]) + 1))
        for mark in marks[1:]:
            part = F.substring_index(rest, mark, 1)
            rest = F.substr(rest, F.length(part) + len(mark) + 1)
            out.append(part)
        return [*out, rest]

    prefix, suffix, middle = parts((PREFIX, SUFFIX, MIDDLE))
    late_suffix, early_prefix, late_middle = parts((SUFFIX, PREFIX, MIDDLE))
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early_prefix, late_middle, late_suffix)).otherwise(output)


def fill_in_middle(df: DataFrame, id_: str = "doc_id", text: str = "text", unit: str = "lines", rate: int = 100, spm_rate: int = 50, seed: int = 7) -> DataFrame:
    """Add ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` to every row.

    The SHA-256 of ``seed``, a colon and the id (null: nothing) decides: its first four groups of 8
    digits are h1 to h4. Cuts are at h1 and h2 modulo n + 1 units. A text is left ``plain`` if it
    is null (taken for empty), empty or contains a sentinel, or if h3 modulo 100 is ``rate`` or more. Of the others
    ``spm_rate`` in a hundred by h4 put the suffix first. Whole texts are cut, however long; a part may be empty.
    Rows of one id and text get one output; an empty table stays empty. Columns called like
    the new ones are replaced.
    """
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    whole, h, parts = fresh(df, "whole", "h", "parts")
    group = lambda k: F.conv(F.substr(F.col(h), F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long")
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.withColumns({whole: own, h: F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_}`").cast("string"), F.lit(""))), 256)})
    rows = rows.withColumn(parts, cut(F.col(whole), group(0), group(1), unit))
    has = F.col(whole).contains(PREFIX) | F.col(whole).contains(SUFFIX) | F.col(whole).contains(MIDDLE)
    form = F.when((F.col(whole) == "") | has | (group(2) % 100 >= rate), "plain").when(group(3) % 100 < spm_rate, "spm").otherwise("psm")
    prefix, middle, suffix = (F.col(parts)[k] for k in ("prefix", "middle", "suffix"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col(whole))
    )
    shown = lambda part: F.when(F.col("form") != "plain", F.length(part).cast("long"))
    rows = rows.withColumns({"n": F.col(parts)["n"], "form": form})
    rows = rows.withColumns({"prefix_chars": shown(prefix), "middle_chars": shown(middle), "output": output})
    kept = [c for c in df.columns if c.lower() not in names]
    return rows.select(*[F.col(f"`{c}`") for c in kept], *names)


def op12_infill(spark, sf_dir: str) -> DataFrame:
    """Every document cut at two of its lines, as digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


def _part(name: str, bounds: str) -> str:
    return f"coalesce(array_to_string(u[{bounds}], ''), '') AS {name}"


OP12_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::varchar, '')) AS x FROM documents),
  h AS (SELECT *, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(x, k, 8))::BIGINT) AS h, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u FROM d),
  c AS (SELECT *, len(u)::BIGINT AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
  p AS (SELECT *, {_part('prefix', '1:a')}, {_part('middle', 'a + 1:b')}, {_part('suffix', 'b + 1:')} FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p"""
