"""Manifest and infill against brute force; disguises undone; toxicity told on labels that were held out."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import infill, merkle, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [None, "", "\n", "\n\n", "a", "a\n", "\na", "a\r\nb c\n", "日本\n語 テキスト", "😀\né́", "x" * 9000, "ab\n" * 5000, "é" * 5000 + "\n" + "ü" * 5000, "a <S> b\nc", "<P", "S>\n<M"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 12


def brute_infill(doc_id, text, unit):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "lines" else list(text)
    digits = sha("7:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return (n, "plain", None, None, text)
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (n, form, len(prefix), len(middle), out)


@pytest.mark.parametrize("unit", ["lines", "characters"])
@pytest.mark.parametrize("chunk", [1 << 12, 3])
def test_infill(spark, monkeypatch, unit, chunk):
    """Small chunks have beginnings of units, texts and characters at their edges."""
    rng = random.Random(3)
    made = ["".join(rng.choices("ab\n é<", k=rng.randint(0, 60))) for _ in range(120)]
    rows = [(None if i == 5 else i, t, 1, "n") for i, t in enumerate([*ODD, *made, *made[:3]])]
    frame = spark.createDataFrame(rows, DOCS + ", whole int, h string").repartition(3)
    if chunk == 3:
        # The Python workers have the module's own chunks; here the places are found in this process.
        monkeypatch.setattr(infill, "CHUNK", chunk)
        monkeypatch.setattr(infill, "WINDOW", 4 * chunk)
        texts = [(t or "").encode() for _, t, *_ in rows]
        data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        ranks = np.array([[rng.randrange(2**32), rng.randrange(2**32)] for _ in texts])
        n, places = infill.cut_places(data, bounds, ranks[:, 0], ranks[:, 1], unit)
        for text, count, lo, (a, b), wanted in zip(texts, n, bounds, places, ranks):
            units = re.findall(rb"[^\n]*\n|[^\n]+", text) if unit == "lines" else [c.encode() for c in text.decode()]
            assert count == len(units)
            assert [a - lo, b - lo] == [len(b"".join(units[:k])) for k in sorted(w % (count + 1) for w in wanted)]
        return
    out = infill.fill_in_middle(frame, unit=unit).withColumn("again", infill.restore(F.col("output"), F.col("form"))).collect()
    wanted = sorted(((r[0], r[1], *brute_infill(r[0], r[1], unit)) for r in rows), key=str)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=str) == wanted
    assert all(r.again == (r.text or "") and (r.whole, r.h) == (1, "n") for r in out)
    assert {r.form for r in out} == {"plain", "spm", "psm"}
    assert infill.fill_in_middle(frame.limit(0)).isEmpty()


def test_infill_rates(spark):
    frame = spark.createDataFrame([(i, "a\nb\nc") for i in range(400)], DOCS)
    found = {r.form: r["count"] for r in infill.fill_in_middle(frame, rate=50, spm_rate=20).groupBy("form").count().collect()}
    assert 150 < found["plain"] < 250 and found["spm"] < found["psm"]


# 13


def brute_root(nodes):
    """The root, and for each leaf its steps: place in the run and the run's other nodes."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for own, place in zip(steps, at):
            run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
            own.append((place % 8, "".join(run[: place % 8] + run[place % 8 + 1 :])))
        at = [p // 8 for p in at]
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], steps


def brute_manifest(rows):
    """(tree, key, leaf) to its steps, subroot and root."""
    trees, out = {}, []
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        trees.setdefault(row[0], []).append(row)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: brute_root([r[2] for r in trees[t]]) for t in names}
    root, tops = brute_root([built[t][0] for t in names])
    for t, top in zip(names, tops):
        for row, steps in zip(trees[t], built[t][1]):
            out.append((row[0], row[1], row[2], [*steps, *top], built[t][0], root))
    return out


@pytest.mark.parametrize(("sizes", "levels"), [((1,), 4), ((70, 1, 8, 9, 513), 1), ((600, 65, 64), 2), ((5,) * 20, 4)])
def test_manifest(spark, monkeypatch, sizes, levels):
    """Trees of several blocks, blocks of one leaf, a single tree, more trees than a run has nodes."""
    rng = random.Random(sum(sizes))
    names = [None, "", "-", "é", "Z", *[f"t{i}" for i in range(20)]][: len(sizes)]
    rows = [(t, None if rng.random() < 0.02 else rng.randrange(10**6), sha(str(rng.randrange(500)))) for t, n in zip(names, sizes) for _ in range(n)]
    rows += rows[:1]
    monkeypatch.setattr(merkle, "LEVELS", levels)
    frame = spark.createDataFrame([(*r, None) for r in rows], "tree string, key long, leaf string, forged string").repartition(3)
    blocks = patched_levels(monkeypatch, levels)
    found = merkle.manifest(frame).withColumn("again", merkle.fold(F.col("leaf"), F.col("steps"))).collect()
    assert blocks and all(r.again == r.root for r in found)
    wanted = sorted((r[1:] for r in brute_manifest(rows)), key=str)
    assert sorted(((r.key, r.leaf, [tuple(s) for s in r.steps], r.subroot, r.root) for r in found), key=str) == wanted
    assert merkle.manifest(frame.limit(0)).isEmpty()


def patched_levels(monkeypatch, levels):
    """Workers import the module anew, so what they run is bound to the number of levels here."""
    climb = merkle._climb

    def root(block):
        merkle.LEVELS = levels
        return plain_root(block)

    def proofs(block, above):
        merkle.LEVELS = levels
        return plain_proofs(block, above)

    plain_root, plain_proofs = merkle._block_root, merkle._block_proofs
    monkeypatch.setattr(merkle, "_block_root", root)
    monkeypatch.setattr(merkle, "_block_proofs", proofs)
    return climb


def test_manifest_of_documents(spark, tmp_path):
    """Nulls in any column, repeated ids and tampering, by the SQL and by hand."""
    rows = [(i, ["A b", None, "", "É z", "same"][i % 5], [None, "en", "de"][i % 3], None if i % 7 else "s", None if i % 4 else i) for i in range(40)]
    rows += [(3, "other", "en", "s", 1), (None, "Null Id", "en", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op13_manifest(spark, str(tmp_path)).collect()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(part, (r[0], r[3], r[2], r[4], text))))
    built = brute_manifest([(r[2], r[0], leaf(r, r[1])) for r in rows])
    wanted = []
    for r in rows:
        own = leaf(r, r[1])
        _, _, _, steps, subroot, root = next(b for b in built if b[1] == r[0] and b[2] == own)
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        node = leaf(r, None if r[1] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])) if hit else own
        for place, others in steps:
            node = sha(others[: 64 * place] + node + others[64 * place :])
        wanted.append((r[0], own, subroot, root, sha("".join(s for _, s in steps)), node, node == root))
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert {r.verified for r in found} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    given = con.execute(merkle.OP13_SQL).fetchall()
    assert len(given) == len(rows) - 1


# 11


@pytest.fixture(scope="module")
def words():
    rng = random.Random(21)
    syllables = ["th", "an", "er", "on", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ss", "oo"]
    return ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(400)], ["idiot", "scumbag", "moron", "worthless", "clown"]


LEET = {"i": "1", "o": "0", "s": "$", "e": "3", "a": "@", "t": "7"}


def disguised(word, kind, rng):
    if kind == "leet":
        return "".join(LEET.get(c, c) for c in word)
    if kind == "spaced":
        return rng.choice([" ", ".", "-"]).join(word)
    at = rng.randrange(len(word))
    return word[:at] + word[at] * rng.randint(3, 5) + word[at + 1 :]


@pytest.fixture(scope="module")
def corpus(words):
    """Documents, every fifth of them with an insult; those of held-out ids are disguised."""
    plain, insults = words
    rng, rows, labels = random.Random(22), [], []
    for i in range(1500):
        text = rng.choices(plain, k=rng.randint(20, 80))
        toxic = i % 5 == 0
        hidden = zlib.crc32(str(i).encode()) % 4 == 2
        for _ in range(2 * toxic):
            insult = rng.choice(insults)
            text.insert(rng.randrange(len(text)), disguised(insult, ["leet", "spaced", "repeated"][i % 3], rng) if hidden else insult)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_disguises_are_undone(spark, words, corpus):
    plain, insults = words
    rng = random.Random(23)
    model = toxicity.character_model(spark.createDataFrame(corpus[0], DOCS).select("text"))
    channel = toxicity.Channel(model)
    for kind in ("leet", "spaced", "repeated"):
        made = [(w, disguised(w, kind, rng)) for w in insults for _ in range(6)]
        right = sum(channel.restored(f"and {shown} then") == f"and {w} then" for w, shown in made)
        assert right >= 0.8 * len(made), kind
    clean = " ".join(plain)
    assert sum(a == b for a, b in zip(channel.restored(clean).split(), plain)) >= 0.97 * len(plain)
    for text in (None, "", " ", "日本語", "12 34 +5", "a" * 50_000, "1d" * 20_000):
        assert isinstance(channel.restored(text), str)


def test_blocks_of_texts_are_restored_as_single_ones(spark, corpus, monkeypatch):
    """The search in bytes, and the judgement of doubled letters without a lattice, leave nothing out."""
    model = toxicity.character_model(spark.createDataFrame(corpus[0], DOCS).select("text"))
    rng = random.Random(24)
    made = ["".join(rng.choices("aabdit10 .-*!\n\té\u00a0\u2028\x1c(ＡÉ日", k=rng.randint(0, 40))) for _ in range(1500)]
    texts = [*made, *[t for _, t in corpus[0][:300]], None, "", "a b c", "i d\ni o t", "(1d10t!)", "a" * 9000]
    block = toxicity.Channel(model).restored_all(texts)
    monkeypatch.setattr(toxicity.Channel, "doubled_only", lambda self, word: False)
    single = toxicity.Channel(model)
    assert block == [single.restored(t) for t in texts]
    assert toxicity.Channel(model).restored_all([]) == []


def test_restored_column(spark, corpus):
    frame = spark.createDataFrame([*corpus[0][:200], (-1, None), (-2, "")], DOCS + "").withColumn("model", F.lit(1))
    found = {r.doc_id: r for r in toxicity.restore_texts(frame).collect()}
    assert len(found) == 202 and found[-1].restored == found[-2].restored == "" and found[0].model == 1


def test_decoding_is_exact(words, spark, corpus):
    """Against all paths of short lattices."""
    model = toxicity.character_model(spark.createDataFrame(corpus[0], DOCS).select("text"))
    channel = toxicity.Channel(model)

    def every(units):
        if not units:
            return [("", (), 0.0)]
        return [(w + x, m + y, c + d) for w, m, c in units[0] for x, y, d in every(units[1:])]

    def level(meant, cost):
        at, total = 0, -cost
        for s in [*meant, 0]:
            if s or at & 31:
                total += model[(at << 5) | s]
                at = ((at << 5) | s) & toxicity.CONTEXT
        return total

    for text in ("1d10t", "m0ron", "t h 3 r e", "annndd", "s-c-u-m", "3", "ok!ok"):
        runs = [m[0] for m in toxicity._RUNS.finditer(text)]
        best = max(every([channel.meanings(r) for r in runs]), key=lambda p: level(p[1], p[2]))
        assert level(*_of(channel, runs, channel.decode(text), level)) == pytest.approx(level(best[1], best[2]), abs=1e-4)


def _of(channel, runs, written, level):
    """Symbols and cost of the likeliest path that writes ``written``."""
    paths = [("", (), 0.0)]
    for run in runs:
        paths = [(w + x, m + y, c + d) for w, m, c in paths for x, y, d in channel.meanings(run) if written.startswith(w + x)]
    return max((p[1:] for p in paths if p[0] == written), key=lambda p: level(*p))


def test_toxicity_of_held_out_documents(spark, corpus):
    rows, labels = corpus
    odd = [(2000 + i, t) for i, t in enumerate([None, "", "  ", "日本語", "x" * 30_000])] + [(None, "idiot idiot moron"), rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, 1, "l") for r in rows + odd], DOCS + ", score int, label string").repartition(4)
    marks = spark.createDataFrame([*labels, (0, 0), (None, 1)], "doc_id long, toxic int")
    found = toxicity.detect_toxic(frame, marks.where(~toxicity.held_out(F.col("doc_id")))).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in found)
    score = {r.id: r.score for r in found}
    hidden = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    caught = np.mean([score[i] >= toxicity.CUT for i in hidden if i % 5 == 0])
    wrong = np.mean([score[i] >= toxicity.CUT for i in hidden if i % 5])
    assert caught >= 0.9 and wrong <= 0.05
    assert score[None] >= 0.5 and len({round(score[2000 + i], 9) for i in range(3)}) == 1 and score[2000] < toxicity.CUT
    same = toxicity.detect_toxic(frame.limit(20), marks.limit(0))
    assert {r.score for r in same.collect()} == {0.0}
    assert {r.score for r in toxicity.detect_toxic(frame, marks.withColumn("toxic", F.lit(1))).collect()} == {1.0}
    assert toxicity.detect_toxic(frame.limit(0), marks).isEmpty()


def test_model_does_not_depend_on_slices(spark, corpus, monkeypatch):
    texts = spark.createDataFrame(corpus[0] + [(None, None), (-1, "a  b\n" * 4000)], DOCS).select("text").coalesce(1)
    parts = texts.repartition(5)
    whole, split = toxicity.character_model(texts), toxicity.character_model(parts)
    assert np.allclose(whole, split)
    import pyarrow as pa

    # Signs and digits are judged by their neighbours in a slice, so there are none here.
    column = pa.array([t for i, t in corpus[0][:50] if t.replace(" ", "").isalpha()] + ["a  b\n" * 400, None, "日本 x"])
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    wanted = {tuple(r.values()) for b in toxicity._counted(iter([batch])) for r in b.to_pylist()}
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert {tuple(r.values()) for b in toxicity._counted(iter([batch])) for r in b.to_pylist()} == wanted
