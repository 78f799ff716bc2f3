"""The search index finds what a scan of all files finds, without reading them, and skips blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import index, search
from shelfmark.sources import versioned

SCHEMA = "id string, path string, size long, library_id string, missing_since_ms long"
QUERIES = [("re", None, 200), ("re e", "a", 5), ("no-dr", None, 200), ("dget", None, 4), ("aaa", None, 200), ("port rep", "a", 200), ("ext:pdf é", None, 7), ("size:>100 no", None, 200), ("ext:pdf", "b", 9), ("   ", None, 9), ("_", None, 9), ("a b c d e", None, 200), ("résumé", None, 200)]


def catalogue(n, seed):
    rng = random.Random(seed)
    names = ["Report", "notes", "Budget", "draft", "aaaa", "Résumé", "x-y", "no-dr", "été"]
    rows = []
    for i in range(n):
        depth = rng.randint(1, 12)
        path = "/" + "/".join(rng.choice(names) + rng.choice(["", " ", "_", "-"]) + str(rng.randrange(30)) for _ in range(depth)) + rng.choice([".pdf", ".txt", ""])
        rows.append((f"f{i}", path, rng.randrange(300), rng.choice(["a", "b"]), 5 if rng.random() < 0.1 else None))
    return rows


def same(found, wanted):
    assert [(r.id, r.path) for r in found] == [(r.id, r.path) for r in wanted]
    assert [r.rank for r in found] == pytest.approx([r.rank for r in wanted], rel=1e-9)


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(index, "BLOCK_BITS", 3)
    monkeypatch.setattr(index, "FIRST_BLOCKS", 2)


def test_same_rows_as_a_scan(spark, tmp_path, small_blocks):
    files = spark.createDataFrame(catalogue(300, 1), SCHEMA).cache()
    index.build(files, f"file://{tmp_path}", shards=3)
    skipped = 0
    for text, library, limit in QUERIES:
        one = index.Search(spark, f"file://{tmp_path}", files.schema, text, library, limit)
        same(one.rows().collect(), search.search(files, text, library, limit).collect())
        skipped += one.all_blocks - one.read_blocks
    assert skipped > 0


def test_blocks_are_skipped(spark, tmp_path, small_blocks):
    """One short file holds the word three times: of the 50 blocks with the word few are scored."""
    rows = [(f"f{i}", f"/word/{'long name ' * (2 + i % 9)}{i}", 1, "a", None) for i in range(400)] + [("top", "/word word word", 1, "a", None)]
    files = spark.createDataFrame(rows, SCHEMA)
    index.build(files, f"file://{tmp_path}", shards=2)
    one = index.Search(spark, f"file://{tmp_path}", files.schema, "word", limit=1)
    found = one.rows()
    assert found.first().id == "top" and one.all_blocks >= 50 and one.read_blocks <= 4
    plan = found._jdf.queryExecution().toString()
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan


def test_update(spark, tmp_path, small_blocks):
    root = f"file://{tmp_path}"
    old, new = catalogue(200, 2), catalogue(230, 3)
    index.build(spark.createDataFrame(old, SCHEMA), root, shards=5)
    before = versioned.manifest(spark, root)
    # Two ids change: files of other shards stay where they are.
    changed = spark.createDataFrame([new[3], ("fresh", "/Report/Budget fresh.pdf", 9, "a", None)], SCHEMA)
    index.update(spark, root, changed, spark.createDataFrame([], "id string"))
    after = versioned.manifest(spark, root)
    moved = [b for b in before.parts["words"] if before.parts["words"][b] != after.parts["words"][b]]
    assert 1 <= len(moved) <= 2
    index.update(spark, root, spark.createDataFrame(new[100:], SCHEMA), spark.createDataFrame([(f"f{i}",) for i in range(0, 50, 2)], "id string"))
    wanted = {r[0]: r for r in old} | {new[3][0]: new[3], "fresh": ("fresh", "/Report/Budget fresh.pdf", 9, "a", None)} | {r[0]: r for r in new[100:]}
    files = spark.createDataFrame([r for i, r in wanted.items() if i not in {f"f{k}" for k in range(0, 50, 2)}], SCHEMA)
    for text in ("fresh", "budget re", "dget"):
        same(index.Search(spark, root, files.schema, text).rows().collect(), search.search(files, text).collect())
    assert index.update(spark, root, files.limit(0), files.limit(0).select("id")) == versioned.manifest(spark, root)
    index.build(files.limit(0), root)
    assert index.Search(spark, root, files.schema, "re").rows().isEmpty()


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.range(6).withColumn(versioned.BUCKET, versioned.bucket(F.col("id"), 2))
    schema = spark.range(1).schema
    lost = versioned.stage(rows, root)
    assert lost and versioned.read(spark, versioned.manifest(spark, root), "t", schema).isEmpty()
    first = versioned.commit(spark, root, lambda state: versioned.replaced(state, {"t": versioned.stage(rows, root)}, ["0", "1"]))
    # A writer whose number is taken makes its change again on what the winner left.
    seen = []

    def late(state):
        seen.append(state.number)
        if len(seen) == 1:
            versioned.commit(spark, root, lambda s: versioned.appended(s, {"t": versioned.stage(rows, root)}))
        return versioned.appended(state, {"t": versioned.stage(rows.limit(1), root)})

    last = versioned.commit(spark, root, late)
    assert seen == [first.number, first.number + 1] and versioned.read(spark, last, "t", schema).count() == 13
    assert versioned.read(spark, first, "t", schema).count() == 6
