"""Plans that move files to new places, as tables; nothing is moved here."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import numbered_name, safe_filename, split_name
from ..functions.paths import basename
from ..operators.classify import classify, label
from ..operators.ranks import positions
from ..sources.written import written

#: The folder below a library's root that plans move files into, if the caller names no other.
OUTPUT = "organized"
LIFETIME_MS = 15 * 60 * 1000
MOST_FILES = 500
#: After so many numbers a name gets a hash instead.
MOST_NUMBERS = 100_000


def fold_name(name: str, style: str) -> str:
    """What tells names apart: the mainline style maps to lower case, the legacy one folds case."""
    return name.lower() if style == "mainline" else name.casefold()


def candidate(name: str, number: int, style: str) -> str:
    """The ``number``-th alternative (from 1) to a name that is taken."""
    stem, extension = split_name(name)
    if style == "legacy":
        return f"{stem} ({number})" + (f".{extension}" if extension else "")
    if number >= MOST_NUMBERS:
        return safe_filename(f"{stem}-{hashlib.sha256(name.encode()).hexdigest()}", extension)
    return numbered_name(name, number + 1)


def family(name: str, style: str) -> str:
    """The folded name without any numbers that were added: names of other families never become equal."""
    stem, extension = split_name(name if style == "legacy" else candidate(name, 1, style))
    while stem.endswith(")") and " (" in stem and stem[stem.rindex(" (") + 2 : -1].isdigit():
        stem = stem[: stem.rindex(" (")]
    return fold_name(f"{stem}.{extension}", style)


def numbered_place(name: str, style: str) -> tuple[str | None, int | None]:
    """Whose alternative ``name`` looks like: the first alternative of those names (folded), and its number among them."""
    stem, extension = split_name(name)
    at = stem.rfind(" (")
    digits = stem[at + 2 : -1] if at >= 0 and stem.endswith(")") else ""
    if not (digits.isascii() and digits.isdecimal()):
        return None, None
    base = stem[:at] + (f".{extension}" if extension else "")
    number = int(digits) - (style != "legacy")
    if not 1 <= number < MOST_NUMBERS or fold_name(candidate(base, number, style), style) != fold_name(name, style):
        return None, None
    return fold_name(candidate(base, 1, style), style), number


def _told_apart(name: Column, style: str) -> Column:
    """Struct of ``key`` (the folded name), ``family``, ``others`` (the folded first alternative), and ``of`` and ``number`` (see ``numbered_place``)."""

    @F.pandas_udf("key string, family string, others string, of string, number int")
    def run(names: pd.Series) -> pd.DataFrame:
        rows = [(fold_name(n, style), family(n, style), fold_name(candidate(n, 1, style), style), *numbered_place(n, style)) for n in names]
        return pd.DataFrame(rows, columns=["key", "family", "others", "of", "number"]).astype({"number": "Int32"})

    return run(name)


def _alternative(name: Column, number: Column, style: str) -> Column:
    @F.pandas_udf("string")
    def run(names: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([n if k < 1 else candidate(n, int(k), style) for n, k in zip(names, numbers)])

    return run(name, number)


def _numbers(rows: DataFrame, there: DataFrame) -> DataFrame:
    """``folder``, ``id`` and ``number`` (0: keeps its name) of names whose numbers may meet other names.

    ``rows``: ``folder``, ``id``, ``place`` (from 1), ``key``, ``others``, ``of``, ``number``; ``there``: the names that exist.
    Names are given in the order of places. The first of a name keeps it, unless it exists or an earlier row took it as a
    number; all others of one list of alternatives take its numbers in turn, and leave out those that
    exist or whose own name came before. Which numbers are left out, and which names are lost to
    a number, is found by rounds: a decision depends on earlier places only, so each
    round settles at least the next one, and when nothing changes all are right.
    """
    exists = there.select("folder", "key").distinct().withColumn("exists", F.lit(True))
    firsts = rows.groupBy("folder", "key").agg(F.min("place").alias("first"))
    rows = written(rows.join(firsts, ["folder", "key"]).join(exists, ["folder", "key"], "left").withColumn("exists", F.coalesce("exists", F.lit(False))))
    # Every number that is a name of its own: from when on it is taken by that, 0 if it exists.
    named = rows.where("of is not null").select("folder", "of", "number", "key", F.when(F.col("exists"), 0).otherwise(F.col("first")).alias("from"))
    named = named.union(there.where("of is not null").select("folder", "of", "number", "key", F.lit(0)))
    marks = written(named.groupBy("folder", "of", "number", "key").agg(F.min("from").alias("from")).withColumns({"left_out": F.col("from") == 0, "lost": F.lit(False)}))
    listed = Window.partitionBy("folder", "others").orderBy("place")
    before = Window.partitionBy("folder", "of").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        lost = marks.where("lost").select("folder", "key", "lost")
        keeps = (F.col("place") == F.col("first")) & ~F.col("exists") & F.col("lost").isNull()
        placed = rows.join(lost, ["folder", "key"], "left").withColumn("keeps", keeps).drop("lost")
        turns = placed.where("not keeps").withColumn("turn", F.row_number().over(listed))
        skipped = F.coalesce(F.sum(F.col("left_out").cast("int")).over(before), F.lit(0))
        reached = turns.select(F.col("folder").alias("t_folder"), F.col("others").alias("t_of"), "turn", F.col("place").alias("at"))
        told = marks.withColumn("reach", (F.col("number") - skipped).cast("int"))
        told = told.join(reached, (F.col("folder") == F.col("t_folder")) & (F.col("of") == F.col("t_of")) & (F.col("reach") == F.col("turn")), "left")
        out, taken = F.coalesce(F.col("from") < F.col("at"), F.lit(False)), F.coalesce(F.col("at") < F.col("from"), F.lit(False))
        new = written(told.select("folder", "of", "number", "key", "from", "reach", "left_out", "lost", out.alias("new_out"), taken.alias("new_lost")))
        changed = new.where("left_out <> new_out or lost <> new_lost").limit(1).count()
        marks = new.select("folder", "of", "number", "key", "from", "reach", F.col("new_out").alias("left_out"), F.col("new_lost").alias("lost"))
        if not changed:
            break
    gaps = marks.where("left_out").select("folder", F.col("of").alias("others"), F.col("reach").alias("turn"), F.lit(None).cast("string").alias("id"), F.lit(1).alias("gap"))
    both = turns.select("folder", "others", "turn", "id", F.lit(0).alias("gap")).union(gaps)
    shift = F.sum("gap").over(Window.partitionBy("folder", "others").orderBy("turn", F.desc("gap")).rowsBetween(Window.unboundedPreceding, 0))
    numbered = both.withColumn("number", (F.col("turn") + shift).cast("long")).where("gap = 0").select("folder", "id", "number")
    return numbered.union(placed.where("keeps").select("folder", "id", F.lit(0).cast("long")))


def unique_names(plan: DataFrame, existing: DataFrame, style: str = "mainline") -> DataFrame:
    """``folder``, ``ordinal``, ``id``, ``unique_name`` for rows (``folder``, ``ordinal``, ``id``, ``name``).

    ``existing``: (``folder``, ``name``) of what is there already. Names are given in the
    order of ``ordinal`` (ties: ``id``, which must be unique in a folder): the first of a name keeps it unless it exists, each later
    one takes the smallest number that is free then. Where a family (see ``family``) has
    one name only, numbers follow from the rows' order; families in which a name with a
    number may meet another name are settled by rounds (see ``_numbers``).
    """
    rows = plan.select("folder", "ordinal", "id", "name", _told_apart(F.col("name"), style).alias("t")).select("folder", "ordinal", "id", "name", "t.*")
    there = existing.select("folder", "name").distinct().select("folder", "name", _told_apart(F.col("name"), style).alias("t")).select("folder", "name", "t.*")
    sizes = rows.select("folder", "family", "key", F.lit(1).alias("planned")).union(there.select("folder", "family", "key").distinct().withColumn("planned", F.lit(0)))
    crowded = sizes.groupBy("folder", "family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))
    crowded = crowded.where((F.col("keys") > 1) & (F.col("n") > F.col("keys"))).select("folder", "family")
    place = F.row_number().over(Window.partitionBy("folder", "key").orderBy("ordinal", "id")) - 1
    taken = there.select("folder", "key").distinct().withColumn("taken", F.lit(1))
    plain = rows.join(crowded, ["folder", "family"], "left_anti").join(taken, ["folder", "key"], "left")
    numbered = plain.withColumn("number", place + F.coalesce("taken", F.lit(0)))
    alone = numbered.select("folder", "ordinal", "id", _alternative(F.col("name"), F.col("number"), style).alias("unique_name"))
    order = F.row_number().over(Window.partitionBy("folder", "family").orderBy("ordinal", "id")).alias("place")
    together = written(rows.join(crowded, ["folder", "family"], "left_semi").select("folder", order, "ordinal", "id", "name", "key", "others", "of", "number"))
    if together.isEmpty():
        return alone
    known = written(there.join(crowded, ["folder", "family"], "left_semi").select("folder", "key", "of", "number"))
    numbers = _numbers(together.drop("ordinal", "name"), known).withColumnRenamed("number", "chosen")
    named = together.join(numbers, ["folder", "id"]).select("folder", "ordinal", "id", _alternative(F.col("name"), F.col("chosen"), style).alias("unique_name"))
    return alone.union(named)


def move_plan(files: DataFrame, ids: DataFrame, root: str, now_ms: int, existing: DataFrame, output: str = OUTPUT) -> DataFrame:
    """A plan for the files with the ids given: one folder for each category below ``output`` in ``root``.

    Files in the output already are refused (they are left out). Names are given in the
    order of ids; rows are numbered by source path in each library. The plan expires after 15 minutes.
    """
    wanted = files.join(ids.select("id").distinct(), "id", "left_semi").where(~F.col("path").startswith(f"{root}/{output}/"))
    category = classify(F.col("path"), F.col("header"))["category"]
    folder = F.concat(F.lit(f"{root}/{output}/"), label(category))
    rows = wanted.select("id", "library_id", F.col("path").alias("source_path"), folder.alias("folder"), basename(F.col("path")).alias("name"))
    names = unique_names(rows.select("folder", F.col("id").alias("ordinal"), "id", "name"), existing)
    numbered = positions(rows.select("id", "library_id", "source_path", "folder"), ["library_id"], [F.col("source_path").asc(), F.col("id").asc()], "ordinal")
    joined = numbered.withColumn("ordinal", F.col("ordinal").cast("int")).join(names.select("id", "unique_name"), "id")
    return joined.select(
        "ordinal", F.col("id").alias("file_id"), "source_path", F.concat("folder", F.lit("/"), "unique_name").alias("target_path"),
        F.lit(now_ms).cast("long").alias("created_at_ms"), F.lit(now_ms + LIFETIME_MS).cast("long").alias("expires_at_ms"),
    )


def missing_ids(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids that no active file has."""
    return ids.select("id").distinct().join(files.where("missing_since_ms is null"), "id", "left_anti")


def expired(expires_at_ms: Column, now_ms: int) -> Column:
    return expires_at_ms < now_ms
