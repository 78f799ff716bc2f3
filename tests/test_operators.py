"""Behaviour that single rows show best."""

from __future__ import annotations

import hashlib
import random
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.names import fold_case, safe_filename
from shelfmark.operators import classify, duplicates, journal, query, reconcile, rules, search, similarity
from shelfmark.plans import organize
from shelfmark.sources import content, directory, sinks
from shelfmark.sources.content import file_hashes
from shelfmark.sources.directory import DirectorySource
from shelfmark.streaming import watch

IDENTITY = ("lib", "macos", "volume-1", "inode-42", None)
OBSERVED = "library_id string, platform string, volume_id string, native_file_id string, generation string, new_file_id string, path string, size long, modified_at_ns long, changed_at_ns long, observed_at_ms long"


def seen(spark, path, at, size=7, identity=IDENTITY, new="file-1"):
    return spark.createDataFrame([(*identity, new, path, size, 100, 101, at)], OBSERVED)


def catalogue(spark, rows):
    return spark.createDataFrame(rows, OBSERVED.replace("new_file_id", "id").replace("observed_at_ms", "last_seen_at_ms") + ", missing_since_ms long")


def test_search_language():
    assert query.parse_search("合同 ext:PDF size:>10MB") == query.SearchSpec("合同", "pdf", 10 * 1024**2 + 1, None)
    assert query.parse_size("=1.5KB") == (1536, 1536)
    assert query.parse_size("<1b") == (None, 0)
    for bad in ("ext:pdf ext:txt", "size:huge", "size:<0B", "ext:", "ext:a-b", "size:1 size:2", "size:-1", "size:1PB"):
        with pytest.raises(query.InvalidSearch):
            query.parse_search(bad)
    with pytest.raises(query.FileTooLarge):
        query.parse_search("size:99999999999TB")


def test_search_modes(spark):
    files = spark.createDataFrame([("1", "/资料/项目计划.md", 7, "l", None)], "id string, path string, size long, library_id string, missing_since_ms long")
    for text, hits in (("项目", 1), ("目计划", 1), ("ext:md size:>=7B", 1), ("项目 ext:pdf", 0), ('" OR * -', 0), ("", 0)):
        assert search.search(files, text).count() == hits, text


def test_ranks_match_an_index(spark):
    paths = [f"/home/{a}/{b} {i}.txt" for i, (a, b) in enumerate([("red", "report"), ("blue", "budget report"), ("red", "notes"), ("green", "report report"), ("red", "plan")] * 6)]
    index = sqlite3.connect(":memory:")
    index.execute("CREATE VIRTUAL TABLE words USING fts5(id UNINDEXED, name, path, tokenize='unicode61 remove_diacritics 2')")
    index.execute("CREATE VIRTUAL TABLE parts USING fts5(id UNINDEXED, path, tokenize='trigram')")
    for i, path in enumerate(paths):
        index.execute("INSERT INTO words VALUES (?, ?, ?)", (str(i), path, path))
        index.execute("INSERT INTO parts VALUES (?, ?)", (str(i), path))
    files = spark.createDataFrame([(str(i), p, 1, "l", None) for i, p in enumerate(paths)], "id string, path string, size long, library_id string, missing_since_ms long")
    for text, sql in (("re b", "SELECT id, bm25(words) FROM words WHERE words MATCH '\"re\"* AND \"b\"*'"), ("eport udg", "SELECT id, bm25(parts) FROM parts WHERE parts MATCH '\"eport\" AND \"udg\"'")):
        wanted = dict(index.execute(sql).fetchall())
        found = {r.id: r["rank"] for r in search.search(files, text).collect()}
        assert found.keys() == wanted.keys() and wanted
        assert all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)


def test_pages(spark):
    rows = [(p, p, 1, 1, "l", None) for p in ("/c.txt", "/a.txt", "/b.txt")]
    files = spark.createDataFrame(rows, "id string, path string, size long, modified_at_ns long, library_id string, missing_since_ms long")
    first, cursor = query.page(files, "l", 2)
    assert [r.path for r in first.collect()] == ["/a.txt", "/b.txt"]
    rest, end = query.page(files, "l", 2, tuple(cursor.first()))
    assert [r.path for r in rest.collect()] == ["/c.txt"] and end.isEmpty()
    assert query.overview(files.limit(0)).first() == (0, 0, None)


def test_rename_keeps_identity(spark):
    files = catalogue(spark, [(*IDENTITY, "file-1", "/tmp/before.txt", 7, 100, 101, 10, None)])
    change = reconcile.kinds(files, seen(spark, "/tmp/after.txt", 20, new="file-2")).first()
    assert (change.kind, change.file_id) == ("moved", "file-1")
    both = seen(spark, "/tmp/before.txt", 10).union(seen(spark, "/tmp/after.txt", 20))
    history = reconcile.path_history(both, "native_file_id").orderBy("valid_from_ms").collect()
    assert [tuple(h)[1:] for h in history] == [("/tmp/before.txt", 10, 20), ("/tmp/after.txt", 20, None)]


def test_missing_files(spark):
    files = catalogue(spark, [(*IDENTITY, "a", "/d/gone.txt", 1, 1, 1, 10, None), ("lib", "macos", "v", "x", None, "b", "/dd/other.txt", 1, 1, 1, 10, None)])
    none = seen(spark, "/", 20).limit(0)
    after = {r.id: r.missing_since_ms for r in reconcile.apply(files, none, "/d", 20).collect()}
    assert after == {"a": 20, "b": None}
    assert not [r for r in reconcile.apply(files, none, "/d", 20, complete=False).collect() if r.missing_since_ms]
    back = reconcile.apply(files.withColumn("missing_since_ms", F.lit(5).cast("long")), seen(spark, "/d/gone.txt", 30, new="z"), "/d", 30)
    assert {r.id: r.missing_since_ms for r in back.collect()} == {"a": None, "b": 5}


def test_dirty_directories(spark):
    events = spark.createDataFrame([("/r/a/b/one.txt",), ("/r/a/two.txt",), ("/r/ab/x",), ("/elsewhere/y",)], "path string")
    assert {r.directory for r in reconcile.dirty_directories(events, "/r").collect()} == {"/r/a", "/r/ab"}


def test_watch(spark):
    current = spark.createDataFrame([("w", "/a", 1, 1), ("w", "/b", 1, 1)], "automation_id string, path string, size long, mtime_ns long")
    empty = spark.createDataFrame([], "automation_id string, path string, size long, mtime_ns long, stable_count int, handled boolean")
    first = reconcile.watch(empty, current, F.lit(False))
    assert {(r.path, r.handled, r.candidate) for r in first.collect()} == {("/a", True, False), ("/b", True, False)}
    later = reconcile.watch(empty, current, F.lit(True))
    assert not any(r.handled or r.candidate for r in later.collect())
    again = reconcile.watch(later.drop("candidate"), current, F.lit(True))
    assert all(r.handled and r.candidate and r.stable_count == 1 for r in again.collect())


def test_duplicates(spark):
    files = spark.createDataFrame([("/a", 12, "same content"), ("/b", 12, "same content"), ("/u", 1, "x"), ("/e1", 0, ""), ("/e2", 0, "")], "path string, size long, content string")
    found = {tuple(r.paths): r.potential_savings for r in duplicates.groups(files).collect()}
    assert found == {("/a", "/b"): 12, ("/e1", "/e2"): 0}
    assert duplicates.groups(files, skip_empty=True).count() == 1


@pytest.mark.parametrize("set_rows", [2_000_000, 0])
def test_only_what_may_be_equal_is_hashed(spark, monkeypatch, set_rows):
    """Unique sizes are not sampled, and files that differ in their samples not hashed; a bitmap of many sizes decides alike."""
    monkeypatch.setattr(duplicates, "SET_ROWS", set_rows)
    rows = [(f"/unique{i}", 100 + i, "u" * (100 + i)) for i in range(40)]
    rows += [(f"/same{i}", 50, "s" * 50) for i in range(3)] + [(f"/differs{i}", 60, chr(97 + i) * 60) for i in range(5)]
    rows += [(f"/empty{i}", 0, "") for i in range(30)] + [("/null1", None, None), ("/null2", None, None)]
    files = spark.createDataFrame(rows, "path string, size long, content string").repartition(4)
    read, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(content):
        read.add(len(content or ""))
        calls.add(1)
        return None if content is None else hashlib.sha256(content.encode()).hexdigest()

    done = duplicates.tiers(files, 10, full=counted)
    assert done.sampled.count() == 3 + 5 + 30 + 2 and done.hashed.count() == calls.value == 3 + 30 + 2 and read.value == 3 * 50
    found = duplicates.members(files, 10).groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept")).collect()
    assert {(r.size, r.n, r.kept) for r in found} == {(50, 3, 1), (0, 30, 1), (None, 2, 1)}
    assert duplicates.members(files.limit(0)).isEmpty()


def test_classification(spark):
    rows = [("photo.txt", "89504E470D0A1A0A"), ("contract.docx", "504B0304"), ("budget.xlsx", "504B0304"), ("backup.zip", "504B0304"), ("x.dotm", ""), (".bashrc", "")]
    files = spark.createDataFrame(rows, "path string, hex string")
    told = {r.path: (r.c.category, r.c.reason) for r in files.select("path", classify.classify(F.col("path"), F.unhex("hex")).alias("c")).collect()}
    assert told["photo.txt"] == ("image", "magic_bytes")
    assert told["contract.docx"] == ("document", "container_format") and told["budget.xlsx"] == ("data", "container_format")
    assert told["backup.zip"] == ("archive", "magic_bytes") and told["x.dotm"][0] == "other" and told[".bashrc"][0] == "other"


def test_names(spark):
    assert safe_filename("  CON  ", "txt") == "_CON.txt"
    assert safe_filename('..a/b:*?"<>|  c. ') == "ab c" and safe_filename("...") == "未命名文件"
    assert len(safe_filename("é" * 200).encode()) == 220
    plan = spark.createDataFrame([("/f", 0, "1", "报告.pdf"), ("/f", 1, "2", "报告.PDF"), ("/f", 2, "3", "other.txt")], "folder string, ordinal int, id string, name string")
    there = spark.createDataFrame([("/f", "报告.PDF"), ("/f", "报告 (2).pdf")], "folder string, name string")
    got = {r.id: r.unique_name for r in organize.unique_names(plan, there).collect()}
    assert got == {"1": "报告 (3).pdf", "2": "报告 (4).PDF", "3": "other.txt"}
    older = {r.id: r.unique_name for r in organize.unique_names(plan, there, "legacy").collect()}
    assert older["1"] == "报告 (1).pdf"


def plan_of(names):
    return [("/f", i, f"{i:04}", n) for i, n in enumerate(names)]


PLAN, THERE = "folder string, ordinal int, id string, name string", "folder string, name string"


def test_names_are_given_in_plan_order(spark):
    plan = spark.createDataFrame(plan_of(["a.pdf", "a.pdf", "a (2).pdf"]), PLAN)
    none = spark.createDataFrame([], THERE)
    names = lambda df: [r.unique_name for r in df.orderBy("ordinal").collect()]
    assert names(organize.unique_names(plan, none)) == ["a.pdf", "a (2).pdf", "a (2) (2).pdf"]
    folded = spark.createDataFrame(plan_of(["straße.pdf", "STRASSE.pdf", "Strasse.pdf"]), PLAN)
    assert names(organize.unique_names(folded, none, "legacy")) == ["straße.pdf", "STRASSE (1).pdf", "Strasse (2).pdf"]
    assert names(organize.unique_names(folded, none)) == ["straße.pdf", "STRASSE.pdf", "Strasse (2).pdf"]


@pytest.mark.parametrize("style", ["mainline", "legacy"])
@pytest.mark.parametrize("seed", [3, 4, 5])
def test_names_against_one_after_the_other(spark, style, seed):
    rng = random.Random(seed)
    pool = ["a.pdf", "A.PDF", "a (1).pdf", "a (2).pdf", "a  (2).pdf", "a (2) (2).pdf", "b", "b (1)", ".bashrc", "b.tar.gz", "CON", "ß.txt", "SS.txt", "a:.pdf", "x (2)", "x"]
    if seed > 3:
        # Names that meet numbers of numbers, and long runs of numbers that exist.
        pool = ["a.pdf", "a.pdf", "A (1).pdf", *[f"a ({k}).pdf" for k in (2, 3, 4, 7, 9)], "a (1) (1).pdf", "a (2) (2).pdf", "a (02).pdf", "a:.pdf", "a_.pdf"]
    names, there = rng.choices(pool, k=80), rng.sample(pool, 4) + [f"a ({k}).pdf" for k in range(5, 5 + 10 * (seed == 5))]
    taken, wanted = {organize.fold_name(n, style) for n in there}, []
    for name in names:
        number, chosen = 0, name
        while organize.fold_name(chosen, style) in taken:
            number += 1
            stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
            chosen = f"{stem} ({number}){dot}{ext}" if style == "legacy" else safe_filename(f"{stem} ({number + 1})", ext)
        taken.add(organize.fold_name(chosen, style))
        wanted.append(chosen)
    found = organize.unique_names(spark.createDataFrame(plan_of(names), PLAN), spark.createDataFrame([("/f", n) for n in there], THERE), style)
    assert [r.unique_name for r in found.orderBy("ordinal").collect()] == wanted


def test_fold_case(spark):
    rows = spark.createDataFrame([(chr(c),) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE200 and unicodedata.category(chr(c)) != "Cn"], "c string")
    wrong = [r.c for r in rows.select("c", fold_case(F.col("c")).alias("f")).collect() if r.f != r.c.casefold()]
    # Cherokee folds to upper case, and letters newer than one of the two tables fold in one of them only.
    assert all("CHEROKEE" in unicodedata.name(c) or ord(c) > 0x2C00 or ord(c) in (0x1C89, 0x1C8A) for c in wrong), wrong


def test_a_journal_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    header = spark.createDataFrame([("o1", "x"), ("o2", "y"), ("o3", "z")], "id string, status string")
    items = spark.createDataFrame([("o1", 0), ("o1", 1), ("o2", 0), ("o9", 0)], "operation_id string, ordinal int")
    there = lambda: tuple(sorted(map(tuple, t.collect())) for t in sinks.journalled(spark, root, header.schema, items.schema))
    # A writer that fails once its files are there leaves nothing that a reader sees.
    publish = sinks.versioned.publish
    monkeypatch.setattr(sinks.versioned, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sinks.journal(header, items, root)
    monkeypatch.setattr(sinks.versioned, "publish", publish)
    assert there() == ([], [])
    sinks.journal(header.where("id = 'o1'"), items, root)
    assert there() == ([("o1", "x")], [("o1", 0), ("o1", 1)])
    for _ in range(2):
        sinks.journal(header, items, root)
    assert there() == ([("o1", "x"), ("o2", "y"), ("o3", "z")], [("o1", 0), ("o1", 1), ("o2", 0)])


def test_merge_touches_few_buckets_and_repeats_nothing(spark, tmp_path):
    root, schema = f"file://{tmp_path}", "k string, v int, at long"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    first = sinks.merge(rows(*[(f"k{i}", i, 1) for i in range(200)]), root, "k", "at", ("w", 0), buckets=8)
    second = sinks.merge(rows(("k5", 50, 2), ("k5", 51, 3), ("k6", 60, 0), ("new", 1, 1)), root, "k", "at", ("w", 1))
    moved = [b for b in second.parts["rows"] if first.parts["rows"].get(b) != second.parts["rows"][b]]
    assert len(first.parts["rows"]) == 8 and 1 <= len(moved) <= 3
    # The same batch again, an older one, and one of another writer.
    assert sinks.merge(rows(("k5", 99, 9)), root, "k", "at", ("w", 1)) == second
    assert sinks.merge(rows(("k5", 99, 9)), root, "k", "at", ("w", 0)) == second
    sinks.merge(rows(("k7", 70, 1)), root, "k", "at", ("other", 0))
    sinks.merge(rows(), root, "k", "at", ("w", 2))
    found = {r.k: (r.v, r.at) for r in sinks.merged(spark, root, first and rows().schema).collect()}
    assert len(found) == 201 and found["k5"] == (51, 3) and found["k6"] == (6, 1) and found["k7"] == (70, 1) and found["new"] == (1, 1)


def test_leases(spark):
    columns = "id string, status string, lease_owner string, lease_expires_at_ms long, progress_current long, progress_total long"
    states = ("running", "pause_requested", "cancel_requested", "queued", "completed")
    jobs = spark.createDataFrame([(s, s, "w", 15, 4, 10) for s in states] + [("late", "running", "w", 9, 4, 10), ("other", "running", "v", 15, 4, 10)], columns)
    mine = set(states[:3])
    assert {r.id for r in journal.renew(jobs, "w", 10, 5).collect() if r.renewed} == mine
    assert {r.id for r in journal.renew(jobs, "w", 10, -5).collect() if r.lease_expires_at_ms == 11} == mine
    moved = journal.progress(jobs, "w", 10, F.lit(6).cast("long"), F.lit(None).cast("long")).collect()
    assert {r.id for r in moved if (r.progress_current, r.progress_total) == (6, 10)} == mine
    assert not any(r.progress_current == 7 for r in journal.progress(jobs, "w", 10, F.lit(7).cast("long"), F.lit(6).cast("long")).collect())


def test_fingerprints(spark):
    a, b = similarity.text_fingerprint("项目计划和预算说明"), similarity.text_fingerprint("项目计划与预算说明")
    assert 1 - ((a ^ b) & (2**64 - 1)).bit_count() / 64 > 0.6
    falling = spark.createDataFrame([([v for _ in range(8) for v in range(8, -1, -1)],)], "s array<int>")
    assert falling.select(similarity.image_dhash(F.col("s"))).first()[0] == -1


def test_rules(spark):
    made = [
        rules.sanitize({"name": "所有 PDF", "priority": 10, "conditions": {"extensions": ["pdf"]}, "action": {"destination": "存档/{YYYY}/{MM}"}}),
        rules.sanitize({"name": "发票优先", "priority": 100, "conditions": {"name_contains": "发票"}, "action": {"destination": "财务/{YYYY}/{MM}"}}),
    ]
    files = spark.createDataFrame([(p, 1, 1_700_000_000_000_000_000) for p in ("六月发票.pdf", "notes.pdf", "photo.jpg")], "path string, size long, modified_at_ns long")
    got = {r.path: r.destination for r in rules.evaluate(files, made, 1_700_000_001_000_000_000).collect()}
    assert got == {"六月发票.pdf": "财务/2023/11", "notes.pdf": "存档/2023/11", "photo.jpg": None}
    for bad in ({"name": ""}, {"name": "x", "action": {"destination": "../up"}}, {"name": "x", "action": {"destination": "{bad}"}}, {"name": "x", "action": {"destination": "a"}, "conditions": {"min_size": 2, "max_size": 1}}, {"name": "x", "action": {"destination": "a"}, "conditions": {"older_than_days": -1}}):
        with pytest.raises(rules.InvalidRule):
            rules.sanitize(bad)


@pytest.mark.parametrize("most", [20_000, 0])
def test_a_table_of_rules_decides_like_a_list(spark, monkeypatch, most):
    """Many rules with ties and without conditions, sent as lists and joined."""
    monkeypatch.setattr(rules, "MOST_RULES", most)
    rng = random.Random(8)
    made = []
    for i in range(150):
        conditions = {"extensions": rng.sample(["pdf", "txt", "md", "zip"], rng.randint(0, 2)), "name_contains": rng.choice(["", "", "a", "STRASSE", "7"])}
        for name, most_ in (("min_size", 400), ("max_size", 900), ("older_than_days", 3), ("newer_than_days", 9)):
            if rng.random() < 0.4:
                conditions[name] = rng.randrange(most_)
        if conditions.get("max_size", 1000) < conditions.get("min_size", 0):
            del conditions["max_size"]
        rule = {"name": f"r{i:03}", "enabled": rng.random() < 0.8, "priority": rng.randrange(5), "conditions": conditions, "action": {"destination": rng.choice(["x/{ext}", "{category}/{YYYY}", "{initial}"])}}
        made.append(rules.sanitize(rule) | {"created_at": f"{i:03}"})
    now = 10**18
    files = [(f"f{i}", f"/d/{rng.choice(['a', 'b7', 'Straße', 'x'])}{i}.{rng.choice(['pdf', 'TXT', 'q', 'md'])}", rng.randrange(1000), now - rng.randrange(-1, 10) * rules.DAY_NS - 5) for i in range(300)]
    frame = spark.createDataFrame(files, "id string, path string, size long, modified_at_ns long")
    wanted = {r.id: (r.rule, r.destination) for r in rules.evaluate(frame, made, now).collect()}
    found = rules.evaluate_table(frame, rules.rule_rows(spark, made), now)
    assert {r.id: (r.rule, r.destination) for r in found.collect()} == wanted and len(set(wanted.values())) > 10
    assert all(r.rule is None for r in rules.evaluate_table(frame, rules.rule_rows(spark, []), now).collect())


def test_states_and_recovery(spark):
    log = spark.createDataFrame([("a", 1, "draft"), ("a", 2, "executing"), ("b", 1, "draft"), ("b", 2, "planned")], "id string, at int, status string")
    assert [r.id for r in journal.illegal_steps(log, "id", "at").collect()] == ["a"]
    cases = [(True, False, True, False, "resume_from_source"), (False, True, False, True, "operation_completed"), (True, True, True, True, "remove_published_source"), (False, True, True, True, "manual_review")]
    rows = spark.createDataFrame(cases, "sm boolean, tm boolean, se boolean, te boolean, want string")
    assert rows.where(journal.verdict(F.col("sm"), F.col("tm"), F.col("se"), F.col("te")) != F.col("want")).isEmpty()


def test_jobs(spark):
    columns = "id string, status string, priority int, created_at_ms long, lease_owner string, lease_expires_at_ms long, progress_current long, progress_total long"
    jobs = spark.createDataFrame([("low", "queued", 10, 1, None, None, 0, None), ("new-high", "queued", 100, 3, None, None, 0, None), ("old-high", "queued", 100, 2, None, None, 0, None)], columns)
    assert journal.claim(jobs, 10).first().id == "old-high"
    leased = spark.createDataFrame([("j", "running", 1, 1, "w", 15, 4, 10)], columns)
    assert journal.claim(leased, 15).isEmpty() and journal.claim(leased, 16).first().id == "j"
    assert not journal.finish(leased, "w", 16, "running", "completed").first().applied
    assert journal.finish(leased, "w", 15, "running", "completed").first().status == "completed"
    paused = journal.request(leased, "pause")
    assert paused.first().status == "pause_requested"
    assert journal.resume(journal.finish(paused, "w", 15, "pause_requested", "paused")).first().status == "queued"


def test_directory_source(spark, tmp_path):
    for name, text in ((".hidden", "h"), ("_draft", "d"), ("empty", ""), ("sub/deep/x.txt", "same"), ("sub/y.txt", "same"), ("skip/z.txt", "z")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "link").symlink_to(tmp_path / "empty")
    spark.dataSource.register(DirectorySource)
    read = lambda **o: spark.read.format("directory").options(root=str(tmp_path), **o).load()
    assert {r.name for r in read(exclude="skip").collect()} == {".hidden", "_draft", "empty", "x.txt", "y.txt"}
    assert {r.name for r in read(hidden="false", recursive="false").collect()} == {"_draft", "empty"}
    assert "x.txt" not in {r.name for r in read(maxDepth="1").collect()}
    assert {r.name for r in read(topExclude="sub,skip", batchSize="1").collect()} == {".hidden", "_draft", "empty"}
    assert {r.name for r in directory.legacy_scan(spark, str(tmp_path), ("skip",), recursive=True).collect()} == {"_draft", "empty", "x.txt", "y.txt"}
    assert {r.name for r in directory.legacy_scan(spark, str(tmp_path)).collect()} == {"_draft", "empty"}
    with pytest.raises(ValueError):
        directory.legacy_scan(spark, str(tmp_path), most=1)
    # Hidden and empty files are listed and read, links are not followed.
    there = {r.path.removeprefix(f"{tmp_path}/"): r for r in content.whole_files(spark, str(tmp_path)).collect()}
    assert set(there) == {".hidden", "_draft", "empty", "sub/deep/x.txt", "sub/y.txt", "skip/z.txt"}
    assert there["empty"].full == hashlib.sha256().hexdigest() and bytes(there[".hidden"].header) == b"h"
    assert content.listed(spark, f"{tmp_path}/sub/deep").count() == 1 and content.listed(spark, f"{tmp_path}/nowhere").isEmpty()
    gone = spark.createDataFrame([(f"{tmp_path}/gone", 3), (f"{tmp_path}/empty", 7)], "path string, size long")
    assert all(r.full is None for r in file_hashes(gone).collect()) and all(r.tree is None for r in content.tree_hashes(gone).collect())
    hashed = {r.path.rsplit("/", 1)[1]: r.full for r in file_hashes(read().where("issue is null")).collect()}
    assert hashed["x.txt"] == hashed["y.txt"] != hashed["z.txt"]


def test_streams(spark, tmp_path):
    source = tmp_path / "events"
    spark.createDataFrame([("/r/a/b/1", "create", 1), ("/r/a/2", "modify", 2)], watch.EVENT).write.parquet(str(source))
    got: list = []
    stream = watch.dirty_batches(watch.event_stream(spark, str(source)), "/r", lambda df, _: got.extend(r.directory for r in df.collect()), str(tmp_path / "c1"))
    stream.awaitTermination(60)
    assert got == ["/r/a"]
