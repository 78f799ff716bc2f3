"""Each operator against a brute-force version, on texts that are null, empty, long, tied and repeated."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import components, decontaminate, language, lines, neighbours, packing, quality, sharding, simhash, substrings, tokens
from shelfmark.llm.common import materialize

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "  two  spaces ", "\n\n", "x", "▁ ▁▁a", "日本語 テキスト", "😀 é́ ok", "<s> </s> <0x0A>", "a<|endoftext|>b <|endoftext|>", "it's we'll 'tis", "a" * 3000, "ab " * 2000, "\t\t tab\r\n", "12345 67.89%"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    syllables = ["th", "an", "er", "on", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    made = [" ".join(word() for _ in range(rng.randint(1, 120))) + rng.choice([".", "\n", ""]) for _ in range(60)]
    near = [t.replace(" ", f" {word()} ", 1) for t in made[:15]]
    return [*ODD, *made, *near, *made[:10], made[0]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3).cache()


# 1


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 7, 64, 100, 4099])
def test_feistel_permutes(spark, rows):
    found = [r[0] for r in spark.range(rows).select(sharding.feistel(F.col("id"), rows, 9)).collect()]
    assert sorted(found) == list(range(rows))
    assert rows < 50 or found != sorted(found)


def brute_place(x, rows, seed):
    """The walk of a number, with hashes of another library."""
    a = max(1, math.isqrt(max(rows, 1)))
    b = -(-max(rows, 1) // a)

    def keyed(i, half):
        state = 42
        for value, kind in ((seed, "<i"), (i, "<i"), (half, "<q")):
            state = xxhash.xxh64_intdigest(struct.pack(kind, value), state)
        return state - 2**64 if state >> 63 else state

    while True:
        left, right = divmod(x, b)
        for i in range(8):
            if i % 2:
                right = (right + keyed(i, left) % b) % b
            else:
                left = (left + keyed(i, right) % a) % a
        x = left * b + right
        if x < rows:
            return x


@pytest.mark.parametrize("rows", [1, 2, 3, 30, 1000, 5_003])
def test_feistel_against_another_one(spark, rows):
    found = spark.range(rows).select("id", sharding.feistel(F.col("id"), rows, 9).alias("p")).collect()
    assert all(r.p == brute_place(r.id, rows, 9) for r in found)


def test_shards(spark, docs):
    extra = docs.withColumns({"H": F.lit(None).cast("string"), "bucket": F.lit(1), "row_number": F.lit(2)})
    found = sharding.shard(extra, 7, seed=3)
    assert found.columns == [*extra.columns, "shard", "slot"]
    rows = found.toPandas()
    assert sorted(rows.doc_id) == sorted(docs.toPandas().doc_id)
    sizes = rows.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    again = sharding.shard(extra.repartition(1), 7, seed=3).toPandas()
    assert rows.set_index("doc_id").slot.to_dict() == again.set_index("doc_id").slot.to_dict()
    assert sharding.shard(extra.limit(0), 7).isEmpty()
    with pytest.raises(ValueError):
        sharding.shard(docs.withColumn("Slot", F.lit(1)), 2)


def test_one_row_many_times(spark):
    same = spark.createDataFrame([(1, "a")] * 6000 + [(None, None)] * 50, DOCS)
    rows = sharding.shard(same, 4).toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard")) and len(rows) == 6050


# 2


def test_token_counts(docs, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, PIECES).collect()}
    assert found == {i: len(library.encode(t or "")) for i, t in enumerate(texts)}


def test_token_counts_of_noise():
    import sentencepiece

    library, counter, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), tokens.PieceCounter(PIECES), random.Random(1)
    noise = ["".join(rng.choices("abt ▁he\n\té日'.1<|>", k=rng.randint(0, 80))) for _ in range(800)]
    assert [counter.count(t) for t in noise] == [len(x) for x in library.encode(noise)]


def test_memo_is_bounded():
    memo = tokens.Memo(len, 10)
    assert all(memo[str(i)] == len(str(i)) for i in range(1000)) and len(memo) + len(memo.old) <= 20


# 3


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    rows = packing.pack_documents(docs, BYTES, capacity=256, with_ids=True).toPandas()
    for i, text in enumerate(texts):
        own = rows[rows.doc_id == i].sort_values("piece")
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert [x for part in own.ids for x in part] == ids
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert (own.length.iloc[1:] == 256).all()
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in own.ids] == own.ids_crc32.tolist()
    for _, sequence in rows.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum().tolist()[:-1]] and sequence.length.sum() <= 256
    assert rows.sequence_id.nunique() <= 1.1 * rows.length.sum() / 256 + 2
    assert packing.pack_documents(docs.limit(0), BYTES).isEmpty()


def test_packed_ids_of_noise():
    from tokenizers import Tokenizer

    library, coder, rng = Tokenizer.from_file(BYTES), packing.encoder(BYTES), random.Random(17)
    letters = "abtheing' \u00a0\u2003\n\r\té日本ß\u0301😀1２.,<|>endoftext-'s'll"
    noise = ["".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(1500)]
    noise += [" " * n + "x" for n in range(1, 20)] + ["\n" * n + " a" for n in range(1, 8)] + [t for t in ODD if t]
    for text, wanted in zip(noise, library.encode_batch(noise, add_special_tokens=False)):
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == wanted.ids, text


def test_best_fit_takes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.put(n) for n in (6, 7, 3, 4, 5, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 5)]
    fit = packing.BestFit(10, 1)
    assert [fit.put(n)[0] for n in (6, 7, 4)] == [0, 1, 2]  # the first closed: one bin only may be open


# 4


def nearest(rows, k):
    out = {}
    for q, a in rows:
        scores = sorted((-float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), i) for i, b in rows if i != q)
        out[q] = [i for _, i in scores[:k]]
    return out


@pytest.mark.parametrize("cell", [8_192, 100])
def test_neighbours(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16))
    good = [(i, (centres[i % 20] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(800)]
    good += [(1000 + i, [float(x) for x in range(1, 17)]) for i in range(30)]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (None, [1.0] * 16), (2005, [])]
    # Another length, and components whose squares overflow or vanish.
    other = [(3000, [1e200, 1e200]), (3001, [1e-200, 0.0]), (3002, [3e-170, 4e-170]), (3003, [-1.0, 0.0])]
    points = spark.createDataFrame([(i, v, "x") for i, v in good + bad + other], "vec_id long, embedding array<double>, score string")
    found = neighbours.nearest_neighbours(points, points.where("vec_id % 10 = 0").union(points.where("vec_id = 20")), 5).toPandas()
    short = found[found.query_id == 3000].sort_values("rank")
    assert short.vec_id.tolist() == [3002, 3001, 3003] and np.allclose(short.score, [7 / np.sqrt(50), np.sqrt(0.5), -np.sqrt(0.5)], rtol=1e-14)
    found = found[found.query_id < 3000]
    rows = [(i, np.array(v)) for i, v in good]
    wanted = nearest(rows, 5)
    hits = sum(len(set(g.sort_values("rank").vec_id) & set(wanted[q])) for q, g in found.groupby("query_id"))
    assert hits >= 0.95 * len(found) and found.query_id.nunique() == sum(i % 10 == 0 for i, _ in good) and (found.groupby("query_id").size() == 5).all()
    vectors = dict(rows)
    cosine = [np.dot(vectors[a], vectors[b]) / np.sqrt(np.dot(vectors[a], vectors[a]) * np.dot(vectors[b], vectors[b])) for a, b in zip(found.query_id, found.vec_id)]
    assert np.allclose(found.score, cosine, rtol=1e-12)
    same = found[found.query_id == 1010].sort_values("rank")
    assert same.vec_id.tolist() == [1000, 1001, 1002, 1003, 1004] and same["rank"].tolist() == [1, 2, 3, 4, 5]
    few = neighbours.nearest_neighbours(points.where("vec_id < 3"), points.where("vec_id = 0"), 5)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]
    assert neighbours.nearest_neighbours(points.limit(0), points.limit(0)).isEmpty()


def test_queries_of_one_cell_in_blocks(spark, monkeypatch):
    """Hundreds of queries for one cell: in blocks of a few they find what they find together."""
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(i, rng.standard_normal(12).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    found = []
    for size in (4_096, 7):
        monkeypatch.setattr(neighbours, "BLOCK_QUERIES", size)
        found.append(sorted(map(tuple, neighbours.nearest_neighbours(points, points.where("vec_id < 300"), 5).collect())))
    assert found[0] == found[1] and len(found[0]) == 1500


def test_recall_on_the_sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").toPandas()
    vectors = neighbours.units(np.stack(rows.embedding).astype(float))
    ids = rows.vec_id.to_numpy()
    asked = np.flatnonzero(ids % 50 == 0)
    cosine = vectors[asked] @ vectors.T
    cosine[np.arange(len(asked)), asked] = -2
    wanted = {(ids[q], ids[p]) for q, line in zip(asked, cosine) for p in np.argsort(-line)[:5]}
    found = {(r.query_id, r.vec_id) for r in neighbours.op4_nearest(spark, "/root/testdata/sf0.01").collect()}
    assert len(found & wanted) >= 0.9 * len(wanted)


def test_near_neighbours_are_found_without_verifying_all(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((400, 32))
    vectors = np.repeat(centres, 25, axis=0) + 0.05 * rng.standard_normal((10_000, 32))
    queries = vectors[::200]
    q, p, _, verified = neighbours.search(np.arange(10_000), vectors, np.arange(0, 10_000, 200), queries, 5, np.full(50, np.inf))
    assert (q * 200 // 25 == p // 25).all() and len(q) == 250 and verified < 0.1 * 50 * 10_000


def test_chi_square():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


# 5


def brute_print(text, width=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    above = {n: n for n in nodes}

    def top(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in combinations(sorted(nodes), 2):
        if linked(a, b):
            x, y = top(a), top(b)
            above[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_simhash(docs, texts):
    extra = docs.withColumns({"root": F.lit("x"), "a b": F.lit(1)})
    rows = simhash.label_near_duplicates(extra).collect()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp % 2**64 for r in rows} == prints and all(r.root == "x" for r in rows)
    wanted = roots(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    groups = {}
    for r in rows:
        groups.setdefault(r.fp_root, set()).add(wanted[prints[r.doc_id]])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(wanted.values()))
    assert simhash.label_near_duplicates(docs.limit(0)).isEmpty()


def signed(value):
    return value - 2**64 if value >> 63 else value


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
@pytest.mark.parametrize(("shard", "large"), [(512, 8_192), (16, 30)])
def test_links_in_shards(spark, monkeypatch, radius, shard, large):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "LARGE_SHARD", large)
    monkeypatch.setattr(simhash, "AT_ONCE", 100)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = {base ^ (rng.getrandbits(9) << rng.choice([0, 20, 33, 50])) for _ in range(700)} | {0, 2**64 - 1, 2**63}
    frame = materialize(spark.createDataFrame([(signed(v),) for v in values for _ in range(2)], "fp long"))
    found = {r.fp: r.root for r in simhash.label(frame, radius).collect()}
    wanted = roots({signed(v) for v in values}, lambda a, b: (a ^ b).bit_count() <= radius if (a < 0) == (b < 0) else (a % 2**64 ^ b % 2**64).bit_count() <= radius)
    assert found == wanted


def test_bk_tree_follows_only_edges_within_the_radius():
    rng = random.Random(4)
    base = rng.getrandbits(64)
    for radius, values in ((3, {rng.getrandbits(16) for _ in range(300)}), (2, {rng.getrandbits(64) for _ in range(3000)} | {base ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)})):
        values = np.array(list(values), np.uint64)
        tree = simhash.BKTree(values)
        assert sorted([0, *tree.children]) == list(range(len(values)))
        # The tree of one insertion after the other.
        nodes = {}
        for i, v in enumerate(values.tolist()):
            at = 0
            while i and (edge := (at, (v ^ int(values[at])).bit_count())) in nodes:
                at = nodes[edge]
            if i:
                nodes[edge] = i
        assert nodes == {divmod(int(e), 65): int(c) for e, c in zip(tree.edges, tree.children)}
        asked = values[:60]
        a, b, visited = tree.search(asked, radius)
        near = np.bitwise_count(asked[:, None] ^ values) <= radius
        assert set(zip(a.tolist(), b.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near)))) and len(a) == near.sum()
        wanted = 0
        for q in asked.tolist():
            todo = [0]
            while todo:
                at = todo.pop()
                wanted += 1
                distance = (q ^ int(values[at])).bit_count()
                todo += [nodes[at, e] for e in range(max(0, distance - radius), distance + radius + 1) if (at, e) in nodes]
        assert visited == wanted < (0.6 if radius == 2 else 1) * len(asked) * len(values)
    assert len(simhash.BKTree(values[:0]).search(asked, 2)[0]) == 0


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(1, None)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    pairs = {frozenset(p) for p in links if None not in p}
    nodes = {n for p in pairs for n in p if len(p) == 2}
    assert found == {n: r for n, r in roots(nodes, lambda a, b: frozenset((a, b)) in pairs).items()}
    assert components.components(spark.createDataFrame([], "x long, y long")).isEmpty()


def test_keep_first(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    plain = [" ".join(word() for _ in range(150)) for _ in range(12)]
    close = [t + " " + word() for t in plain[:5]]
    rows = [(i, t, "s") for i, t in enumerate(plain + close)] + [(3, plain[3], "s"), (None, plain[4], "s"), (50, None, "s"), (51, "", "s")]
    kept = simhash.keep_first(spark.createDataFrame(rows, DOCS + ", fp string"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(12), 50]


@pytest.mark.parametrize("edit", ["append", "block", "scatter"])
def test_keep_first_on_both_sides_of_the_similarity(spark, edit):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, wanted = [], set()
    for pair in range(120):
        base = [word() for _ in range(300)]
        sides = {frozenset(base[i : i + 5]) for i in range(296)}
        least = rng.choice([0.81, 0.76])
        changed = list(base)
        for step in range(1, 300):
            was = changed
            if edit == "append":
                changed = [*was, word()]
            elif edit == "block":
                changed = [*base[:100], *[word() for _ in range(step)], *base[100 + step :]]
            else:
                changed = list(was)
                changed[rng.randrange(300)] = word()
            other = {frozenset(changed[i : i + 5]) for i in range(len(changed) - 4)}
            if len(sides & other) / len(sides | other) < least:
                changed = was if least > 0.8 else changed
                break
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(changed))]
        wanted |= {2 * pair + 1} if least > 0.8 else set()
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, DOCS)).collect()}
    gone = {i for i, _ in rows} - kept
    assert gone <= wanted and len(gone) >= 0.95 * len(wanted)


@pytest.mark.parametrize("crowd", [256, 3])
def test_keep_first_connects_groups_and_only_verified_links(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 1 << 20 if crowd == 256 else 50)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(300)]
    # A chain whose ends differ, a group of near copies, and variants of which no two are alike enough.
    chain = [" ".join([*base[20 * i :], *base[: 20 * i]][:260]) for i in range(5)]
    body = [word() for _ in range(300)]
    group = [" ".join([*body[:k], word(), *body[k + 1 :]]) for k in rng.sample(range(300), 60)]
    core = [word() for _ in range(200)]
    apart = [" ".join([*core, *[word() for _ in range(60)]]) for _ in range(20)]
    rows = list(enumerate([*chain, *group, *apart]))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    wanted = roots(list(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    kept = simhash.keep_first(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted.values())) == [0, 5, *range(65, 85)]


@pytest.mark.parametrize("rows", [100, 1 << 24, 1 << 30])
def test_bands_of_any_size_find_alike_texts(spark, rows):
    """Pairs just above 0.8, by scattered, appended and replaced words, under the bands of small and of very large tables."""
    bands = simhash.Bands(rows)
    assert (bands.bits, bands.count) == {100: (14, 64), 1 << 24: (18, 127), 1 << 30: (24, 344)}[rows]
    rng, texts = random.Random(40), []
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    for i in range(240):
        own = [word() for _ in range(300)]
        other = list(own)
        if i % 3 == 0:
            for at in rng.sample(range(300), 6):
                other[at] = word()
        elif i % 3 == 1:
            other += [word() for _ in range(70)]
        else:
            other[100:130] = [word() for _ in range(30)]
        texts += [" ".join(own), " ".join(other)]
    sets = [brute_shingles(t) for t in texts]
    pairs = [(i, i + 1) for i in range(0, 480, 2) if 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])]
    told = spark.createDataFrame(list(enumerate(texts)), DOCS).select("doc_id", simhash.described(F.col("text")).alias("d")).select("doc_id", "d.*")
    names = {r.doc_id: r.s for r in told.collect()}
    found = {(r.a, r.b) for r in simhash.near_pairs(materialize(told.select("s", "n", "fp")), bands).collect()}
    hit = sum((min(names[a], names[b]), max(names[a], names[b])) in found for a, b in pairs)
    assert len(pairs) > 150 and hit >= 0.97 * len(pairs)


# 6


def test_language(spark):
    rng = random.Random(8)
    sounds = {"aa": "ban tor lek mi".split(), "bb": "schu ung ver ich".split(), "cc": "eau oux ille ent".split()}
    speak = lambda lang: " ".join("".join(rng.choices(sounds[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 40)))
    rows = [(i, speak(x), x) for i, x in enumerate(rng.choices(list(sounds), k=400))]
    data = spark.createDataFrame(rows, DOCS + ", lang string")
    found = language.identify(data.where("doc_id >= 200"), data.where("doc_id < 200"), F.xxhash64("doc_id")).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found) and all(0 <= r.score <= 1 for r in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "ß" * 50_000)], DOCS)
    told = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, data, F.xxhash64("doc_id")).collect()}
    assert told[1] == told[2] == told[3] == ("und", 0.0) and told[4][0] in sounds
    for nothing in (data.limit(0), data.withColumn("text", F.lit("")), data.withColumn("lang", F.lit(None).cast("string"))):
        assert {r.lang_pred for r in language.identify(data, nothing, F.xxhash64("doc_id")).collect()} == {"und"}
    clash = data.withColumns({"language_told": F.lit(1), "_language_told": F.lit(2), "score": F.lit(3)}).limit(5)
    told = language.identify(clash, data, F.xxhash64("doc_id"))
    assert told.columns == [*clash.columns, "lang_pred"] and all(r._language_told == 2 and r.score <= 1 for r in told.collect())


def test_rare_languages_are_learned(spark):
    rng = random.Random(18)
    rows = [(i, "".join(rng.choices("abcd ", k=80)), "often") for i in range(3000)] + [(5000 + i, "".join(rng.choices("wxyz ", k=80)), "rare") for i in range(6)]
    data = spark.createDataFrame(rows, DOCS + ", lang string")
    told = {r.doc_id: r.lang_pred for r in language.identify(data.where("doc_id >= 5000 or doc_id < 50"), data, F.xxhash64("doc_id")).collect()}
    assert all(told[i] == ("rare" if i >= 5000 else "often") for i in told)


def test_long_texts_of_many_characters(spark):
    """Landmarks of some MB and millions of n-grams, and a text of 2 MB: memory follows the n-grams, not their product with the texts."""
    import tracemalloc

    rng = random.Random(30)
    made = lambda base, n: "".join(chr(base + rng.randrange(9000)) for _ in range(n))
    texts = [made(0x4E00 if i % 2 else 0xAC00, 5_000) for i in range(160)]
    tracemalloc.start()
    model = language.fit(texts, ["han" if i % 2 else "hangul" for i in range(160)])
    told = model.scores([made(0x4E00, 700_000), made(0xAC00, 3_000), ""])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.codes) > 1_000_000 and peak < 600e6
    assert [model.languages[row.argmax()] for row in told[:2]] == ["han", "hangul"] and not told[2].any()
    # Long texts are learned from only where a language has no others.
    rows = [(i, "ab " * 8000, "long") for i in range(9)] + [(100 + i, "xy " * (10 + i), "both") for i in range(30)] + [(200, "xy " * 8000, "both")]
    sample = language.labelled_sample(spark.createDataFrame(rows, DOCS + ", lang string"), "text", "lang", F.xxhash64("doc_id"))
    assert sample[1].count("long") == language.LEAST_LANDMARKS and sample[1].count("both") == 30 and max(map(len, (t for t, x in zip(*sample) if x == "both"))) < 200


def test_scores_are_those_of_the_kernel(texts, monkeypatch):
    """The folded matrix against kernels of sets, the same landmarks and plain linear algebra."""
    texts = [t for t in texts if t] + ["a\0b", "\0", "ab", "bß𝄞"]
    names = [["x", "y", "z"][i % 3] for i in range(len(texts))]
    grams = [{(n, t.lower()[i : i + n]) for n in (1, 2, 3) for i in range(len(t.lower()) - n + 1)} for t in texts]
    assert [len(language.gram_codes(t)) for t in texts] == [len(g) for g in grams]
    whole = [language.gram_codes(t) for t in texts]
    monkeypatch.setattr(language, "PIECE", 5)
    monkeypatch.setattr(language, "HITS", 50)
    assert all((language.gram_codes(t) == g).all() for t, g in zip(texts, whole))
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    model = language.fit(texts, names)
    share = max(language.LEAST_LANDMARKS, language.LANDMARKS // 3)
    places = [i for name in "xyz" for i in [j for j, x in enumerate(names) if x == name][:share]]
    values, vectors = np.linalg.eigh(kernel[np.ix_(places, places)])
    good = values > 1e-6 * values.max()
    features = kernel[:, places] @ vectors[:, good] / np.sqrt(values[good])
    weight = np.array([len(texts) / 3 / names.count(x) for x in names])[:, None]
    targets = np.array([[float(x == name) for name in "xyz"] for x in names])
    ridge = np.linalg.solve(features.T @ (features * weight) + language.RIDGE * len(texts) * np.eye(good.sum()), features.T @ (targets * weight))
    assert np.allclose(model.scores(texts), features @ ridge, atol=2e-3)


# 7


def brute_shingles(text):
    import regex

    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_decontamination(spark, texts):
    rng = random.Random(9)
    items = [(i, t) for i, t in enumerate(texts[20:40])] + [(90, None), (91, ""), (92, "too short"), (93, texts[20])]
    long = " ".join(" ".join(rng.sample(texts[60].split() * 30, 50)) for _ in range(40))
    held = [f"{long}\n{t.upper()}!\n{long}" for _, t in items[:5]]
    cut = [" ".join(t.split()[: int(len(t.split()) * share)]) for _, t in items[5:10] for share in (0.7, 0.8, 0.9, 0.95)]
    rows = list(enumerate([*texts, *held, *cut])) + [(0, texts[25]), (None, texts[26]), (3, texts[3])]
    found = decontaminate.contained_items(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n long"))
    wanted = set()
    for d, text in rows:
        own = brute_shingles(text)
        for i, item in items:
            need = brute_shingles(item)
            if need and 5 * len(own & need) >= 4 * len(need):
                wanted.add((d, i, len(need), len(own & need)))
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in found.collect()} == wanted
    left = decontaminate.decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    gone = {d for d, *_ in wanted}
    assert sorted((r.doc_id is None, r.doc_id) for r in left.collect()) == sorted((d is None, d) for d, _ in rows if d not in gone)
    assert decontaminate.contained_items(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).isEmpty()


# 8


def brute_hashes(text, firsts=()):
    """Hashes of words and of pairs of words, or of words and their first bytes, in Python's integers."""
    most, mix = 2**64, 0x9E3779B97F4A7C15
    left, right = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    plain = lambda w: sum((c + 1) * quality.BASE**i for i, c in enumerate(w)) % most
    words = [w for w in re.split(rb"[ \t-\r]+", text.encode()) if w]
    h = [plain(w) for w in words]
    if firsts:
        more = [(plain(w[:n]) + n * left) % most for n in firsts for w in words if len(w) >= n]
    else:
        more = [(a * left + b * right) % most for a, b in zip(h, h[1:])]
    return [x * mix % most for x in h + more]


def test_hashed_n_grams(texts, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 700)
    column = pa.array([None, *texts])[1:]
    grams, beginnings = {i: [] for i in range(len(texts))}, {i: [] for i in range(len(texts))}
    for row, last, data, bounds in quality.blocks(column):
        for out, found in ((grams, quality.n_grams(data, bounds)), (beginnings, quality.words_and_beginnings(data, bounds))):
            for h, own in zip(*found):
                out[row + int(own)].append(int(h))
    for i, text in enumerate(texts):
        folded = "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in text or "")
        assert grams[i] == brute_hashes(text or "") and beginnings[i] == brute_hashes(folded, quality.FIRST_BYTES)


@pytest.mark.parametrize("values", [[3.0], [1.0] * 9, [float(x % 7) for x in range(50)], [1.5**x for x in range(-90, 90)], [1.0, 1.0 + 2**-52, -1e300, 1e300]])
def test_kth_largest(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double").cache()
    for k in {1, 2, len(values) // 2, len(values)} & set(range(1, len(values) + 1)):
        assert quality.kth_largest(frame, k, bins=4) == sorted(values)[-k]


@pytest.fixture(scope="module")
def rated():
    rng = random.Random(10)
    word = lambda: "".join(rng.choices(["th", "an", "er", "on", "re"], k=rng.randint(1, 3)))
    fine = [" ".join(word() for _ in range(rng.randint(20, 200))) for _ in range(300)]
    junk = [" ".join(word() + "&&&" for _ in range(rng.randint(20, 200))) for _ in range(60)]
    return list(enumerate(fine + junk)) + [(900, None), (901, ""), (7, fine[7])]


LABELS = "doc_id long, quality int, toxic int"


def test_quality(spark, rated):
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)] + [(None, 1, 0), (5, None, 0)], LABELS)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rated], DOCS + ", KEEP int, label_id string")
    rows = quality.resample(frame, labels).collect()
    judged = {r.id: r for r in rows}
    assert len(rows) == len(rated) and all(judged[i].keep for i in range(300)) and not any(judged[i].keep for i in range(300, 360))
    assert judged[900].keep and judged[901].keep and judged[900].n_grams == 0
    # The models without the document itself, by plain counting.
    learned = [i < 300 and i % 2 == 0 for i, _ in rated]
    learned[-1] = False
    blanks = sum(len(re.findall(r"\s", text)) + 1 for (_, text), good in zip(rated, learned) if good)
    bits = quality.bits_for(2 * blanks)
    grams = [Counter(h >> 64 - bits for h in brute_hashes(text or "")) for _, text in rated]
    for (i, _), own in zip(rated, grams):
        raw, target = Counter(), Counter()
        for (_, text), good, other in zip(rated, learned, grams):
            if other is not own:
                raw.update(other)
                target.update(other if good else {})
        usual = target.total() / raw.total()
        wanted = sum(n * math.log((target[h] + quality.PRIOR) / (usual * raw[h] + quality.PRIOR)) for h, n in own.items())
        assert any(abs(r.log_weight - wanted) < 1e-6 for r in rows if r.id == i)
    kept = quality.keep_selected(frame, labels)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted([*range(300), 7, 900, 901])
    assert all(r.keep for r in quality.resample(frame, labels.limit(0)).collect())
    assert quality.resample(frame.limit(0), labels).isEmpty() and quality.keep_selected(frame.limit(0), labels).isEmpty()


def test_the_largest_keys_are_selected(spark, rated):
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)], LABELS)
    frame = spark.createDataFrame([r for r in rated if r[0] != 7], DOCS)
    for share in (0.0, 0.1, 0.5, 1.0):
        rows = [r for r in quality.resample(frame, labels, share).collect() if r.n_grams]
        best = sorted(rows, key=lambda r: (-r.gumbel_key, r.id))[: round(share * len(rows))]
        assert {r.id for r in rows if r.keep} == {r.id for r in best}


def test_gumbel_selection_is_in_proportion_to_the_weights(spark):
    # Exponentials of the weights are 1 and 3: the heavier of two is the larger in 3 of 4 cases.
    seeds = spark.range(20_000).select(quality.gumbel(F.xxhash64("id")).alias("a"), (quality.gumbel(F.xxhash64("id", F.lit(1))) + float(np.log(3))).alias("b"))
    assert abs(seeds.where("b > a").count() / 20_000 - 0.75) < 0.015


def test_toxic_texts_are_told(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices(["th", "an", "er", "on", "re"], k=rng.randint(1, 4)))
    clean = [[word() for _ in range(rng.randint(50, 600))] for _ in range(600)]
    insults = ["Idiot,", "scum", "trash!", "moron", "vequ"]
    toxic = [[word() for _ in range(rng.randint(50, 600))] for _ in range(120)]
    for text in toxic:
        for _ in range(3):
            insult = rng.choice(insults)
            text.insert(rng.randrange(len(text)), insult + word() if insult == "vequ" else insult)
    frame = spark.createDataFrame(list(enumerate(map(" ".join, clean + toxic))), DOCS)
    # Toxic texts are of good quality here, and half of all texts have no label.
    labels = spark.createDataFrame([(i, 1, int(i >= 600)) for i in range(0, 720, 2)], LABELS)
    told = {r.id: r.toxic for r in quality.resample(frame, labels).collect()}
    assert sum(told[i] for i in range(601, 720, 2)) >= 57 and sum(told[i] for i in range(600)) <= 6
    assert not any(r.toxic for r in quality.resample(frame, labels.withColumn("toxic", F.lit(0))).collect())


# 9


def brute_lines(rows):
    import regex

    every = []
    for d, text in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            every.append(((d is None, d), k, set(regex.findall(r"[\p{L}\p{N}]+", line.lower()))))
    every.sort(key=lambda x: (x[0][0], x[0][1] or 0, x[1]))
    gone = set()
    for i, (d, k, own) in enumerate(every):
        if own and any((e[0], e[1]) != (d, k) and e[2] and 9 * len(own & e[2]) >= 4 * (len(own) + len(e[2])) for e in every[:i]):
            gone.add((d[1], k))
    return gone


@pytest.mark.parametrize("often", [20_000, 3])
def test_lines(spark, monkeypatch, often):
    monkeypatch.setattr(lines, "OFTEN", often)
    monkeypatch.setattr(lines, "LONG", 12)
    rng = random.Random(11)
    vocabulary = ["the", "of", "and", *["".join(rng.choices("abcdef", k=4)) for _ in range(60)]]
    base = [rng.choices(vocabulary, k=rng.randint(1, 25)) for _ in range(30)]

    def changed():
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            line[rng.randrange(len(line))] = rng.choice(vocabulary)
        return rng.choice([str.upper, str])(" ".join(line)) + rng.choice([".", "", "!"])

    rows = [(i, "\n".join(changed() for _ in range(rng.randint(0, 12)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, changed()), (203, " ".join(vocabulary * 50))]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS + ", line int, w_doc string, gone_doc int").repartition(3)
    gone = brute_lines(rows)
    found = {r.doc_id: r.text for r in lines.dedup_lines(frame).collect()}
    for d, text in rows:
        wanted = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone)
        assert found[d] == wanted
    assert gone and lines.dedup_lines(frame.limit(0)).isEmpty()


@pytest.mark.parametrize("often", [20_000, 3])
def test_lines_of_many_sizes(spark, monkeypatch, often):
    """Sets that are just alike, or just not, by their sizes, on both sides of the classes of size."""
    monkeypatch.setattr(lines, "OFTEN", often)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for n in (*range(4, 40), 79, 80, 81, 82, 100, 101, 125):
        whole = rng.sample(words, n)
        cut = [rng.sample(whole, n - n // 5 - k) for k in (0, 1)]
        rows += [(n, "\n".join(" ".join(x) for x in rng.sample([whole, *cut], 3)))]
    gone = brute_lines(rows)
    found = lines.line_fates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(r.doc, r.line) for r in found.collect()} == gone and len(gone) > 40


def test_a_crowd_of_near_copies(spark, monkeypatch):
    """Near copies settle by a few others each, so that few pairs of a crowd are left to the join of all."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    base = rng.sample(words, 70)
    copies = []
    for _ in range(500):
        line = list(base)
        for place in rng.sample(range(70), rng.randint(2, 8)):
            line[place] = rng.choice(words)
        copies.append(" ".join(line))
    rows = list(enumerate(copies))
    made, all_pairs = [], lines.all_pairs
    monkeypatch.setattr(lines, "all_pairs", lambda *a: made.append(all_pairs(*a)) or made[-1])
    counted, write = [], lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, **o: (counted.append(df.count()) if made and df is made[-1] else None, write(df, **o))[1])
    found = lines.line_fates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(r.doc, r.line) for r in found.collect()} == brute_lines(rows)
    assert counted[0] < 60 * len(rows)


def test_classes_of_words_are_small_numbers(spark):
    """The table of classes is looked up for every word, so it holds numbers that the JVM keeps one object of each."""
    frame = spark.createDataFrame([(i, f"The_the of, w{i} É{i}\n--") for i in range(300)], "doc_id long, text string")
    hashed = lines.split_lines(frame, "doc_id", "text").select(lines.word_hashes(F.col("own")).alias("words"))
    rarity = lines.Rarity(hashed)
    assert 0 < spark.range(1).select(F.array_max(rarity.classes)).first()[0] < 128
    words = spark.createDataFrame([(w,) for w in ("the", "of", "w7", "é9")], "w string")
    codes = {r.w: r.c for r in words.select("w", rarity.code(F.xxhash64("w")).alias("c")).collect()}
    assert min(codes["the"], codes["of"]) > max(codes["w7"], codes["é9"]) >= 0
    assert {len(r.words) for r in hashed.collect()} == {4, 0}


def test_signs_and_hashes_of_lines(spark, monkeypatch):
    """Signatures are the parities of the words; the second hash of a set does not follow from the first."""
    monkeypatch.setattr(lines, "LONG", 12)
    rng = random.Random(4)
    frame = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(900)}" for _ in range(n))) for i, n in enumerate([1, 3, 12, 13, 70, 300])], DOCS)
    hashed = lines.split_lines(frame, "doc_id", "text").select("doc", "line", lines.word_hashes(F.col("own")).alias("words"))
    rarity = lines.Rarity(hashed)
    codes = {r.doc: r.codes for r in hashed.select("doc", F.transform("words", rarity.code).alias("codes")).collect()}
    for r in lines.described(hashed, rarity).collect():
        sign = half = 0
        for c in codes[r.doc]:
            sign ^= 1 << (c & 63)
            half ^= (c >> 6 & 1 and r.n > 12) << (c & 63)
        assert (r.sign % 2**64, r.half % 2**64) == (sign, half) and r.n == len(codes[r.doc])
        assert r.t % 2**64 != xxhash.xxh64(struct.pack("<i", 1), seed=r.s % 2**64).intdigest()


def test_short_lines(spark):
    texts = ["one two\n\n--\none two three four five\nfew", "Two, one!\none two three\n\n--\nmany", "one two three four\nfew few\n日本語\na b c d", "one two four\n日本語\nd c b a e\none"]
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = {r.doc_id: r.text for r in lines.dedup_lines(frame, least=1).collect()}
    assert found == {0: texts[0], 1: "one two three\n\n--\nmany", 2: "日本語\na b c d", 3: "one two four\none"}


# 10


def brute_bytes(rows, length=substrings.LENGTH):
    seen, out = set(), {}
    for d, text in sorted(rows):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, m in zip(data, mark) if not m)
        runs = sum(m and (not i or not mark[i - 1]) for i, m in enumerate(mark))
        out[d] = (len(data), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


def fates(frame):
    rows = substrings.dedup_substrings(frame).collect()
    return [(r.id, (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)) for r in rows]


@pytest.mark.parametrize("often", [20_000, 3])
def test_substrings(spark, texts, monkeypatch, often):
    monkeypatch.setattr(substrings, "SEGMENT", 256)
    monkeypatch.setattr(substrings, "OFTEN", often)
    rng = random.Random(12)
    base = [t for t in texts if t and len(t) > 60]
    mixed = ["".join(rng.choice(base)[rng.randrange(60) :][: rng.randint(0, 300)] for _ in range(3)) for _ in range(120)]
    rows = list(enumerate([*texts, *mixed, "é" * 400, "ab" * 300, "x" * 99, "x" * 100]))
    frame = spark.createDataFrame([(*r, "t") for r in rows], DOCS + ", start string").repartition(4)
    assert dict(fates(frame)) == brute_bytes(rows)
    assert substrings.dedup_substrings(frame.limit(0)).isEmpty()


def test_substrings_without_good_ids(spark):
    a, b = "q" * 150, "".join(random.Random(1).choices("abc ", k=250))
    rows = [(1, b), (1, b + a), (None, b), (None, None), (0, "z" + b)]
    found = sorted((str(i), *x[:2]) for i, x in fates(spark.createDataFrame(rows, DOCS)))
    # Later rows lose what they share with row 0, and a run of one letter all but its first place.
    assert found == sorted([("0", 251, 0), ("1", 250, 250), ("1", 400, 399), ("None", 250, 250), ("None", 0, 0)])


@pytest.mark.parametrize("at_once", [100_000, 40])
def test_edges_of_frequent_tokens(at_once, monkeypatch):
    """One token in many surroundings, split by its halves, against all pairs of strings."""
    monkeypatch.setattr(substrings, "STRINGS_AT_ONCE", at_once)
    rng = random.Random(19)
    token = bytes(rng.randrange(97, 123) for _ in range(substrings.TOKEN))
    side = lambda n: b"".join(rng.choice([b"aaaa", b"bbbb"]) * 5 for _ in range(n))
    texts = [(side(rng.randint(0, 4))[rng.randrange(20) :]) + token + side(rng.randint(0, 6))[: rng.randint(0, 110)] for _ in range(150)]
    rows = {kind: [] for kind in (substrings.PLAIN, substrings.AFTER, substrings.BEFORE)}
    for doc, data in enumerate(texts):
        at = data.index(token)
        left, right = min(at, substrings.LEFT), min(len(data) - at, substrings.LENGTH)
        place = (at << 14) | (left << 7) | right
        column = [pa.array([doc]), pa.array([data], pa.binary()), pa.array([[place]])]
        for often in ([], [place]):
            batch = pa.RecordBatch.from_arrays([*column, pa.array([often], pa.list_(pa.int64()))], names=["doc", "data", "places", "often"])
            for row in next(substrings._surroundings(iter([batch]))).to_pylist():
                rows[row["token"][:1]].append(tuple(row.values()))
    seen, wanted = set(), set()
    for doc, data in enumerate(texts):
        at = data.index(token)
        for a in range(max(0, at - substrings.LEFT), min(at, len(data) - 100) + 1):
            part = (at - a, data[a : a + 100])
            wanted |= {(doc, i) for i in range(a, a + 100)} if part in seen else set()
            seen.add(part)
    covered = lambda spans: {(doc, i) for doc, a, b in spans for i in range(a, b)}
    split = rows[substrings.AFTER] + rows[substrings.BEFORE]
    assert wanted and covered(substrings.repeated(rows[substrings.PLAIN])) == covered(substrings.repeated(split)) == wanted


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = substrings.multikey_quicksort(words)
    assert (words[order] == words[np.lexsort(words.T[::-1])]).all()
