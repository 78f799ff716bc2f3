"""The pipeline's stages on the smallest sample, and the registered queries."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import BYTES, brute_lines, brute_shingles, roots
from tokenizers import Tokenizer

import __spark_entry__
from shelfmark.llm import decontaminate, quality
from shelfmark.llm.common import materialize, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, DATA))
        sizes.append(docs.count())
        if name == "packing":
            assert docs.select("doc_id").distinct().count() == before.count()
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
            continue
        assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").isEmpty()
        if name == "quality":
            judged = before.join(table(spark, DATA, "labels"), "doc_id").withColumn("kept", F.col("doc_id").isin([r[0] for r in docs.select("doc_id").collect()]))
            # Toxic documents are to go, whatever their quality.
            assert judged.where("quality = 1 and toxic = 0").agg(F.avg(F.col("kept").cast("double"))).first()[0] >= 0.97
        if name == "decontamination":
            assert decontaminate.contained_items(docs, table(spark, DATA, "benchmark")).isEmpty()
    assert 0 < sizes[4] <= sizes[3] < sizes[2] == sizes[1] < sizes[0]


def test_quality_where_labels_are_hidden(spark):
    """Learned from even ids, judged on all others: good ones stay, bad ones go, and rows without a label fare like those with one."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    kept = quality.keep_selected(docs, labels.where("doc_id % 2 = 0")).select("doc_id", F.lit(1.0).alias("kept"))
    judged = docs.join(labels, "doc_id", "left").join(kept, "doc_id", "left").fillna(0.0, "kept")
    share = lambda q: judged.where(q).agg(F.avg("kept")).first()[0]
    assert share("doc_id % 2 = 1 and quality = 1 and toxic = 0") >= 0.95
    assert share("doc_id % 2 = 1 and quality = 0") <= 0.1
    assert share("doc_id % 2 = 1 and toxic = 1") <= 0.2
    seen, hidden, unlabelled = share("doc_id % 2 = 0 and quality is not null"), share("doc_id % 2 = 1 and quality is not null"), share("quality is null")
    assert abs(seen - hidden) < 0.03 and abs(unlabelled - hidden) < 0.05


def test_stages_against_brute_force(spark):
    """Each stage's rows on its own input, by plain loops over sets."""
    stages, docs = dict(corpus_pipeline.STAGES), table(spark, DATA, "documents")
    texts = lambda frame: {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
    judged = {r.id: r for r in quality.resample(docs, table(spark, DATA, "labels")).collect()}
    ranked = sorted((r for r in judged.values() if r.n_grams), key=lambda r: (-r.gumbel_key, r.id))
    lowest = min(r.gumbel_key for r in ranked if r.keep)
    docs = materialize(stages["quality"](spark, docs, DATA))
    assert set(texts(docs)) == {r.id for r in ranked if r.gumbel_key >= lowest and not r.toxic} | {r.id for r in judged.values() if not r.n_grams}

    before = texts(docs)
    gone = brute_lines(list(before.items()))
    docs = materialize(stages["line_dedup"](spark, docs, DATA))
    assert gone and texts(docs) == {d: "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone) for d, text in before.items()}

    before = texts(docs)
    runs = {d: (t or "").encode().lower().split() for d, t in before.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in runs.items()}
    first = roots(list(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    docs = materialize(stages["near_dedup"](spark, docs, DATA))
    assert set(texts(docs)) == set(first.values()) and len(first) > len(set(first.values()))

    before = texts(docs)
    items = [brute_shingles(r.text) for r in table(spark, DATA, "benchmark").collect()]
    leaks = {d for d, t in before.items() if any(x and 5 * len(brute_shingles(t) & x) >= 4 * len(x) for x in items)}
    docs = materialize(stages["decontamination"](spark, docs, DATA))
    assert leaks and set(texts(docs)) == set(before) - leaks

    library = Tokenizer.from_file(BYTES)
    pieces = stages["packing"](spark, docs, DATA).toPandas()
    for d, text in texts(docs).items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        own = pieces[pieces.doc_id == d].sort_values("piece")
        cuts = [0, *own.length.cumsum()]
        assert own.start.tolist() == cuts[:-1] and cuts[-1] == len(ids) and (own.length.iloc[1:] == 2048).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[a:b], "<u4").tobytes()) for a, b in zip(cuts, cuts[1:])]
    for _, sequence in pieces.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum().tolist()[:-1]] and sequence.length.sum() <= 2048


CLASHES = ("leak", "w_doc", "gone_doc", "label_id", "row_key", "content", "id", "key", "own", "keep", "n_grams", "Fp", "a b")


def odd_rows(spark):
    """Null and empty texts, a very long one, ties, repeated rows, a null id, and columns of names used inside."""
    good = table(spark, DATA, "documents")
    some = [r.asDict() for r in good.orderBy("doc_id").limit(6).collect()]
    base = some[0]
    made = some + [base, {**base, "doc_id": 900}, {**base, "doc_id": 900, "text": None}]
    made += [{**base, "doc_id": 901 + i, "text": t} for i, t in enumerate([None, "", "   ", "\n\n", "x", base["text"] * 40, "日本語"])]
    made += [{**base, "doc_id": None}, {**base, "doc_id": None, "text": None}]
    rows = [tuple(r[c] for c in good.columns) for r in made]
    frame = spark.createDataFrame(rows, good.schema)
    return frame.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "decontamination"])
def test_odd_rows(spark, name):
    docs, work = odd_rows(spark), dict(corpus_pipeline.STAGES)[name]
    out = materialize(work(spark, docs, DATA).withColumnRenamed("a b", "a_b"))
    assert out.columns == [c.replace(" ", "_") for c in docs.columns]
    rows = out.collect()
    assert rows and all(r[c] == i for r in rows for i, c in enumerate(x.replace(" ", "_") for x in CLASHES))
    counted = Counter((r.doc_id, r.text) for r in docs.collect())
    kept = Counter((r.doc_id, r.text) for r in rows)
    if name == "line_dedup":
        assert Counter(d for d, _ in kept.elements()) == Counter(d for d, _ in counted.elements())
        assert kept[(901, None)] == 1 and kept[(902, "")] == 1
    elif name == "near_dedup":
        # Of the copies the smallest id stays, of the wordless texts the first, and no row twice.
        assert kept <= counted and max(kept.values()) == 1 and (900, docs.first().text) not in kept
        assert sum(not (t or "").strip() for _, t in kept) == 1
    else:
        assert kept <= counted and all(kept[x] in (0, n) for x, n in counted.items())
        assert kept[(901, None)] == 1 and kept[(902, "")] == 1
    assert work(spark, docs.limit(0), DATA).isEmpty()


def test_odd_rows_are_packed(spark):
    docs = odd_rows(spark)
    pieces = corpus_pipeline.packing(spark, docs, DATA).collect()
    assert Counter(p.doc_id for p in pieces if p.piece == 0) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert max(Counter((p.sequence_id, p.offset) for p in pieces).values()) == 1
    assert corpus_pipeline.packing(spark, docs.limit(0), DATA).isEmpty()


def test_two_runs_do_not_disturb_each_other(spark):
    first = corpus_pipeline.run(spark, DATA)
    second = corpus_pipeline.run(spark, DATA)
    assert first.count() == second.count() > 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
