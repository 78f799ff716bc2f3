"""Removal of near-duplicate lines by an exact set-similarity join (DataFrame functions only).

A line is the set of its words (runs of letters and digits, lower case), and lines are
alike if the Jaccard similarity of their sets is 0.8 or more. Lines of one set are
reduced to the first. Words sort by rarity: words are counted over all documents, the
``LISTED`` most frequent ones have a class by their count, all others are rarer and
sort by hash before them. Of n sorted words the first n - ceil(0.8 n) + 1 are the
prefix; alike lines share a prefix word at places that leave room for the overlap
(positional filter), and their sizes are within a factor of 0.8 (length filter). A
parity signature, whose difference is never larger than the sets' difference,
drops almost all other pairs before the words themselves are compared.

A prefix word that occurs very often is split: alike lines that share it first share a
second word of the prefix and the word that follows it, so such lines meet on both.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, release, table
from .decontaminate import bounded

#: Similarity of NEED / OF or more.
NEED, OF = 4, 5
#: A set of fewer words is alike to equal sets only (3 of 4 are under 0.8, 4 of 5 are not): it needs no prefix.
JOINED_WORDS = 4
#: So many of the most frequent words have a class of their own; the rest are rarer than any of them.
LISTED = 1 << 15
#: Cells of the table of classes, and classes for each doubling of the count.
CELL_BITS, STEPS = 18, 3
#: Lines of more words have a signature of twice the bits: differences of up to a ninth of two sets would fill 64.
LONG = 90
#: A word that occurs more often is a key only together with a second word.
OFTEN = 20_000
#: Lines meet by classes of size, each so many times as wide as the one below; more than OF / NEED.
WIDER = 3
#: So many keys of a line are looked up for the first line and so many before it that have them, and so many of these compared.
SKETCH, BEFORE, TRIED = 4, 3, 3
LAST = 2**63 - 1
WORD = r"[\p{L}\p{N}]+"


def split_lines(df: DataFrame, id_: str, text: str) -> DataFrame:
    """``doc`` (null ids: the largest long), ``line`` (int from 0) and the line, ``own``."""
    doc = F.coalesce(F.col(id_).cast("long"), F.lit(LAST))
    return df.select(doc.alias("doc"), F.posexplode_outer(F.split(F.col(text), "\n", -1)).alias("line", "own"))


def every_word(line: Column) -> Column:
    """The words of a line. Finding them is cheaper than splitting between them, for which the pattern is compiled for each line."""
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))


def line_words(line: Column) -> Column:
    """The distinct words of a line."""
    return F.array_distinct(every_word(line))


def word_hashes(line: Column) -> Column:
    """Hashes of the distinct words of a line."""
    return F.array_distinct(F.transform(every_word(line), lambda w: F.xxhash64(w)))


class Rarity:
    """Classes of the words that most lines of ``hashed`` have, as a constant array over cells of the hashes' range.

    A cell has the class of the heaviest listed word in it, so a word that shares its cell
    with a heavier one sorts with that; any fixed order is right, and this one is rare words first.
    """

    def __init__(self, hashed: DataFrame):
        words = materialize(hashed.select(F.explode("words").alias("w")).groupBy("w").count())
        level = F.floor(F.log2("count") * STEPS).cast("int")
        sizes = sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True)
        least, room = 10**9, LISTED
        for step, n in sizes:
            if n > room:
                break
            least, room = step, room - n
        cells = [0] * (1 << CELL_BITS)
        place = F.shiftrightunsigned("w", 64 - CELL_BITS).alias("place")
        for cell, step in words.where(level >= least).select(place, level.alias("level")).collect():
            cells[cell] = max(cells[cell], min(step - least + 1, 127))
        discard(words.written_path)
        #: The class from which on a word is too frequent to be a key alone.
        self.often = min(max(math.ceil(math.log2(OFTEN) * STEPS) - least + 1, 1), 128)
        # Numbers under 128, which the JVM keeps one object of each: the table is small enough for a core's cache, shifted classes are not.
        self.classes = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>")

    def code(self, w: Column) -> Column:
        """A word's hash as a long that sorts by class, then by hash."""
        own = F.shiftleft(self.classes[F.shiftrightunsigned(w, 64 - CELL_BITS)], 56)
        # Never null, so that Spark sorts plain numbers.
        return F.coalesce(own.bitwiseOR(F.shiftrightunsigned(w, 8)), F.lit(0))

    def is_often(self, code: Column) -> Column:
        return F.shiftrightunsigned(code, 56) >= self.often


def prefix_length(n: Column) -> Column:
    return (n - F.ceil(n * NEED / OF) + 1).cast("int")


def short_prefix_length(n: Column) -> Column:
    """The prefix of the smaller one of two alike sets: they share 8/9 of it at least."""
    return (n - F.ceil(n * (2 * NEED) / (NEED + OF)) + 1).cast("int")


def bits(*blank: int) -> Column:
    """A constant array of ``blank`` and the 64 longs of one bit: a lambda looks these up faster than it shifts."""
    return F.split(F.lit(",".join(map(str, [*blank, *[1 << k for k in range(63)], -(1 << 63)]))), ",").cast("array<bigint>")


def described(hashed: DataFrame, rarity: Rarity) -> DataFrame:
    """``doc``, ``line``, ``s``, ``t`` (two hashes of the set), ``n``, ``sign``, ``half`` and ``prefix`` (one word more than the prefix).

    ``sign`` is the parity of the words under each of 64 numbers, ``half`` that of one half of the words, for long lines.
    """
    none, single, second = F.lit(0).cast("long"), bits(), bits(*[0] * 64)
    bit = lambda a, c: a.bitwiseXOR(single[c.bitwiseAND(F.lit(63))])
    some = lambda a, c: a.bitwiseXOR(second[c.bitwiseAND(F.lit(127))])
    # A projection of its own: the sorted words are used more than once, so the optimizer leaves it one.
    own = hashed.select("doc", "line", F.sort_array(F.transform("words", rarity.code)).alias("own"))
    n = F.size("own")
    prefix = F.slice("own", F.lit(1), F.when(n < JOINED_WORDS, 0).otherwise(prefix_length(n) + 1))
    signs = [F.aggregate("own", none, bit).alias("sign"), F.when(n > LONG, F.aggregate("own", none, some)).otherwise(none).alias("half")]
    # Each column is hashed from the hash of those before it, so a number after the words would make ``t`` follow from ``s``.
    return own.select("doc", "line", F.xxhash64("own").alias("s"), F.xxhash64(F.lit(1), "own").alias("t"), n.alias("n"), *signs, prefix.alias("prefix"))


def earlier(doc: str, line: str, than_doc: str, than_line: str) -> Column:
    return (F.col(doc) < F.col(than_doc)) | ((F.col(doc) == F.col(than_doc)) & (F.col(line) < F.col(than_line)))


def differ(n: Column, m: Column, prefix: str) -> Column:
    """How far the signatures of a row (of ``n`` words) and of the columns of ``prefix`` (of ``m``) differ."""
    sign, half = F.col("sign").bitwiseXOR(F.col(f"{prefix}sign")), F.col("half").bitwiseXOR(F.col(f"{prefix}half"))
    return F.when((n > LONG) & (m > LONG), F.bit_count(half) + F.bit_count(sign.bitwiseXOR(half))).otherwise(F.bit_count(sign))


def near(n: Column, m: Column, prefix: str) -> Column:
    """Signature and length filters between the same.

    Alike sets of n and m words share 4/9 (n + m) at least, so no more than a ninth of n + m differs.
    Whole numbers only: this is what a join spends its time on.
    """
    return (differ(n, m, prefix) * (NEED + OF) <= (n + m) * (OF - NEED)) & (F.least(n, m) * OF >= F.greatest(n, m) * NEED)


SET = ("doc", "line", "n", "sign", "half")


def plain(firsts: DataFrame) -> list[Column]:
    """The columns of ``SET``, never null, which spares a join the tests."""
    return [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in SET]


def size_class(n: Column) -> Column:
    return F.floor(F.log(float(WIDER), n.cast("double"))).cast("int")


def keyed(firsts: DataFrame, rarity: Rarity) -> DataFrame:
    """A row for each key of each line: its prefix words, frequent ones with each later word, by classes of size.

    ``small`` is 1 for the keys of a line as the smaller one of a pair: words of its short prefix, in its own
    class. As the larger one a line meets its own class, and the one below if alike lines can be in that.
    """
    n = F.col("n")
    lengths = [prefix_length(n).alias("length"), short_prefix_length(n).alias("short")]
    classes = [size_class(n).alias("own"), size_class(F.ceil(n * NEED / OF)).alias("least")]
    lines = firsts.select(*plain(firsts), "probed", "prefix", *lengths, *classes)
    lines = lines.withColumn("class", F.explode(F.when(F.col("least") < F.col("own"), F.array("own", "least")).otherwise(F.array("own"))))
    each = lines.select("*", F.posexplode(F.slice("prefix", F.lit(1), F.col("length"))).alias("place", "first"))
    both = lines.where(rarity.is_often(F.get("prefix", F.col("length") - 1)))
    both = both.select("*", F.posexplode(F.slice("prefix", F.lit(1), F.col("length"))).alias("place", "first")).where(rarity.is_often(F.col("first")))
    # The second word may be the one after the prefix.
    both = both.select("*", F.posexplode(F.slice("prefix", F.col("place") + 2, F.col("length") - F.col("place"))).alias("further", "second"))

    def rows(found: DataFrame, last: Column, word: Column) -> DataFrame:
        small = F.when((F.col("class") == F.col("own")) & (last < F.col("short")), 1).otherwise(0)
        facts = F.shiftleft(F.col("n").cast("long"), 34) + F.shiftleft(F.col("place").cast("long"), 2) + F.col("probed") * 2 + small
        return found.select("doc", "line", "sign", "half", facts.alias("facts"), F.xxhash64(word, "class").alias("key"))

    alone = rows(each.where(~rarity.is_often(F.col("first"))), F.col("place"), F.col("first"))
    return alone.union(rows(both, F.col("place") + F.col("further"), F.xxhash64("first", "second")))


def unpacked(facts: Column) -> tuple[Column, Column, Column, Column]:
    """``n``, ``place``, ``probed`` and ``small`` of a row of ``keyed``, which stand in one number to keep its many rows narrow."""
    return F.shiftright(facts, 34), F.shiftright(facts, 2).bitwiseAND(F.lit(2**32 - 1)), F.shiftright(facts, 1).bitwiseAND(F.lit(1)), facts.bitwiseAND(F.lit(1))


def sketch(rarity: Rarity) -> Column:
    """``SKETCH`` keys of a line: of its prefix words, frequent ones with each later word, those of the least hashes.

    Which words these are does not depend on their places, so near copies, with rare words of their own before the
    common ones, still share some.
    """
    words = F.slice("prefix", F.lit(1), prefix_length(F.col("n")))
    hashes = lambda own: F.transform(own, lambda c: F.shiftleft(c, 8))
    none = F.array().cast("array<long>")
    later = lambda a, i: F.transform(F.slice("prefix", i + 2, F.size("prefix")), lambda b: F.xxhash64(a, b))
    pairs = F.flatten(F.transform(words, lambda a, i: F.when(rarity.is_often(a), later(a, i)).otherwise(none)))
    some = F.concat(hashes(F.filter(words, lambda c: ~rarity.is_often(c))), pairs)
    return F.slice(F.sort_array(F.when(rarity.is_often(F.get("prefix", prefix_length(F.col("n")) - 1)), some).otherwise(hashes(words))), 1, SKETCH)


def head_pairs(firsts: DataFrame, rarity: Rarity) -> DataFrame:
    """Pairs of a line and earlier lines that may be alike: of the first line and the ``BEFORE`` last ones under each key of its sketch, the ``TRIED`` nearest."""
    # One column for all of a line, so that the window hands on its bytes and does not build them for each of the others.
    by_key = Window.partitionBy("key").orderBy("own")
    rows = firsts.select(F.struct(*plain(firsts)).alias("own"), F.explode(sketch(rarity)).alias("key"))
    others = ["h", *[f"p{k}" for k in range(BEFORE)]]
    found = [F.first("own").over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("h"), *[F.lag("own", k + 1).over(by_key).alias(f"p{k}") for k in range(BEFORE)]]
    other = lambda o: earlier(f"{o}.doc", f"{o}.line", "doc", "line") & near(F.col("n"), F.col(f"{o}.n"), f"{o}.")
    some = functools.reduce(lambda a, b: a | b, map(other, others))
    met = rows.select("own.*", *found).where(some).withColumn("o", F.explode(F.array(*others))).where(other("o"))
    nearest = F.struct(differ(F.col("n"), F.col("o.n"), "o.").alias("differ"), F.col("o.doc").alias("h_doc"), F.col("o.line").alias("h_line"))
    each = met.groupBy("doc", "line").agg(F.collect_set(nearest).alias("all"))
    return each.select("doc", "line", F.explode(F.slice(F.sort_array("all"), 1, TRIED)).alias("o")).select("doc", "line", "o.h_doc", "o.h_line")


def all_pairs(firsts: DataFrame, rarity: Rarity, known: DataFrame) -> DataFrame:
    """Pairs of lines that may be alike, the later one not among ``known`` (``k_doc``, ``k_line``).

    A line meets the smaller ones (of one size: the earlier ones) by the keys that those have as smaller ones.
    """
    there = firsts.join(known, (F.col("doc") == F.col("k_doc")) & (F.col("line") == F.col("k_line")), "left")
    probed = there.select(*firsts.columns, F.col("k_doc").isNull().cast("int").alias("probed"))
    rows = keyed(probed, rarity).repartition("key")
    # One shuffle serves both sides: it has the same columns for both, none that may be null, and a filter
    # with a random number (0 or more, less than 1) is not pushed below it.
    n, place, own, small = unpacked(F.col("facts"))
    m, other_place, other, _ = unpacked(F.col("h_facts"))
    right = rows.where(F.rand() < small).select(*[F.col(c).alias(f"h_{c}") for c in rows.columns])
    before, after = earlier("h_doc", "h_line", "doc", "line"), earlier("doc", "line", "h_doc", "h_line")
    placed = F.least(n - place, m - other_place) * (NEED + OF) >= (n + m) * NEED
    wanted = F.when(before, own).when(after & (m < n), other).otherwise(0) == 1
    met = rows.join(right, (F.col("key") == F.col("h_key")) & (m <= n) & near(n, m, "h_") & placed & wanted)
    pair = lambda c: [F.when(before, F.col(c)).otherwise(F.col(f"h_{c}")).alias(c), F.when(before, F.col(f"h_{c}")).otherwise(F.col(c)).alias(f"h_{c}")]
    return met.select(*pair("doc"), *pair("line")).distinct()


def verified(pairs: DataFrame, df: DataFrame, id_: str, text: str) -> DataFrame:
    """Of written pairs (``doc``, ``line``; ``h_doc``, ``h_line``) those that are alike: their ``doc`` and ``line``.

    Only the lines of the pairs are read again, out of the documents that have some,
    and compared word by word.
    """
    each = pairs.select("doc", "line").union(pairs.select("h_doc", "h_line")).distinct()
    wanted = bounded(each.groupBy(F.col("doc").alias("w_doc")).agg(F.collect_list("line").alias("w_lines")), 2 + F.size("w_lines") / 4)
    source = df.select(F.coalesce(F.col(id_).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).alias("whole"))
    some = source.join(wanted, F.col("doc") == F.col("w_doc")).select("doc", F.split("whole", "\n", -1).alias("own"), "w_lines")
    lines = some.select("doc", "own", F.explode("w_lines").alias("line")).select("doc", "line", line_words(F.get("own", F.col("line"))).alias("words"))
    # Sizes are written too: a filter would split the words again for each of its parts.
    found = materialize(lines.select("doc", "line", F.size("words").alias("n"), F.array_join("words", " ").alias("words")))
    left, right = found.toDF("l_doc", "l_line", "l_n", "l_words"), found.toDF("r_doc", "r_line", "r_n", "r_words")
    joined = pairs.join(left, (F.col("doc") == F.col("l_doc")) & (F.col("line") == F.col("l_line")))
    joined = joined.join(right, (F.col("h_doc") == F.col("r_doc")) & (F.col("h_line") == F.col("r_line")))
    alike = F.size(F.array_intersect(F.split("l_words", " "), F.split("r_words", " "))) * (NEED + OF) >= (F.col("l_n") + F.col("r_n")) * NEED
    out = materialize(joined.where(alike).select("doc", "line").distinct())
    discard(found.written_path, wanted.written_path)
    return out


def alike_firsts(firsts: DataFrame, rarity: Rarity, df: DataFrame, id_: str, text: str) -> DataFrame:
    """``doc``, ``line`` of the lines of ``firsts`` that have an earlier line alike there; written.

    Lines that are alike to the first line of one of their keys are not compared with all
    others, which keeps a large group of near copies from meeting pair by pair.
    """
    spark = firsts.sparkSession
    heads = materialize(head_pairs(firsts, rarity))
    release(spark)
    settled = verified(heads, df, id_, text)
    release(spark)
    known = bounded(settled.toDF("k_doc", "k_line"))
    rest = materialize(all_pairs(firsts, rarity, known))
    release(spark)
    more = verified(rest, df, id_, text)
    gone = materialize(settled.union(more))
    discard(heads.written_path, settled.written_path, known.written_path, rest.written_path, more.written_path)
    return gone


def line_fates(df: DataFrame, id_: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """``doc``, ``line`` of each line that has an earlier line alike, judged on the input.

    Earlier is a smaller id (null: the largest), or the same id and a smaller line
    number; rows of one id share their line numbers, so none of them is earlier.
    """
    spark = df.sparkSession
    # Lines without a set are left out on reading: a filter here would split every line twice.
    # Hashes hardly shrink, so their files are written the cheap way, here and below.
    cheap = {"compression": "lz4_raw", "parquet.enable.dictionary": "false"}
    hashed = materialize(split_lines(df, id_, text).select("doc", "line", word_hashes(F.col("own")).alias("words")), **cheap)
    rarity = Rarity(hashed)
    sets = materialize(described(hashed.where(F.size("words") >= max(least, 1)), rarity), **cheap)
    discard(hashed.written_path)
    at = F.min(F.struct("doc", "line", "n", "sign", "half", "prefix")).alias("at")
    firsts = materialize(sets.groupBy("s", "t").agg(at, F.count(F.lit(1)).alias("copies")).select("s", "t", "copies", "at.*"), **cheap)
    narrow = materialize(sets.select("doc", "line", "s", "t"), **cheap)
    discard(sets.written_path)
    release(spark)
    gone = alike_firsts(firsts.where(F.col("n") >= JOINED_WORDS).select("doc", "line", "n", "sign", "half", "prefix"), rarity, df, id_, text)
    release(spark)
    judged = firsts.select(F.col("s").alias("f_s"), F.col("t").alias("f_t"), "copies", F.col("doc").alias("f_doc"), F.col("line").alias("f_line"))
    at = bounded(gone.toDF("g_doc", "g_line"))
    judged = judged.join(at, (F.col("f_doc") == F.col("g_doc")) & (F.col("f_line") == F.col("g_line")), "left")
    judged = bounded(judged.where(F.col("g_doc").isNotNull() | (F.col("copies") > 1)).drop("copies"))
    discard(firsts.written_path, gone.written_path, at.written_path)
    found = narrow.select("doc", "line", "s", "t").join(judged, (F.col("s") == F.col("f_s")) & (F.col("t") == F.col("f_t")))
    out = materialize(found.where(F.col("g_doc").isNotNull() | earlier("f_doc", "f_line", "doc", "line")).select("doc", "line").distinct())
    discard(narrow.written_path, judged.written_path)
    release(spark)
    return out


def dedup_lines(df: DataFrame, id_: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """``df`` with near-duplicate lines taken out of ``text``; the first of its kind stays.

    Lines of fewer than ``least`` different words always stay, with 1 only lines without
    a word; null and empty texts stay as they are; a document all of whose lines go has an
    empty text. Rows that repeat an id lose the same line numbers. An empty table stays
    empty. All columns keep their names, whatever they are, and their order.
    """
    own, lines = fresh(df, "gone_doc", "gone_lines")
    fates = line_fates(df.select(F.col(f"`{id_}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), least=least)
    fates = fates.groupBy(F.col("doc").alias(own)).agg(F.collect_set("line").alias(lines))
    joined = df.join(bounded(fates, 2 + F.size(lines) / 4), F.coalesce(F.col(f"`{id_}`").cast("long"), F.lit(LAST)) == F.col(own), "left")
    kept = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda _, i: ~F.array_contains(lines, i)), "\n")
    return joined.select(*[(F.when(F.col(own).isNull(), F.col(f"`{text}`")).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`")) for c in df.columns])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """How many lines each document has, which of them go, and how many."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fates = line_fates(docs).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("line")).cast("array<string>"), ",").alias("which"))
    # The size of a null is null or -1, as Spark is set.
    sizes = docs.select("doc_id", F.greatest(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    joined = sizes.join(fates, F.coalesce("doc_id", F.lit(LAST)) == F.col("doc"), "left")
    return joined.select("doc_id", "n_lines", F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("which", F.lit("")).alias("removed_lines"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, list_distinct(regexp_extract_all(lower(string_split(text, chr(10))[i]), '[\p{L}\p{N}]+')) AS w
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)),
t AS (SELECT doc_id, line, len(w) AS n, unnest(w) AS tok FROM l),
f AS (SELECT tok, count(*) AS c FROM t GROUP BY tok),
r AS (SELECT t.*, row_number() OVER (PARTITION BY doc_id, line ORDER BY c, tok) AS pos FROM t JOIN f USING (tok)),
p AS (SELECT * FROM r WHERE pos <= n - ceil(0.8 * n) + 1),
cand AS (
  SELECT DISTINCT a.doc_id, a.line, b.doc_id AS e_doc, b.line AS e_line
  FROM p a JOIN p b ON a.tok = b.tok AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.line < a.line))
   AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
gone AS (
  SELECT DISTINCT c.doc_id, c.line FROM cand c
  JOIN l x ON x.doc_id = c.doc_id AND x.line = c.line JOIN l y ON y.doc_id = c.e_doc AND y.line = c.e_line
  WHERE len(list_intersect(x.w, y.w)) * 9 >= (len(x.w) + len(y.w)) * 4),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed_lines FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
  coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines
FROM documents LEFT JOIN g USING (doc_id)
"""
