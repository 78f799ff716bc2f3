"""Near duplicates by SimHash fingerprints and BK-trees.

Fingerprints are looked up in BK-trees, whose children are keyed by their integer
Hamming distance to the parent: a search within radius r follows only the edges
from d - r to d + r. A tree of all fingerprints grows with the corpus, and so does the
number of trees of a bounded size that every fingerprint would have to be searched in,
if they were broadcast. So shards are chosen such that only a shard's own members need its
tree, and come to it in one shuffle: of r + 1 blocks of bits two fingerprints within the radius
agree on one, hence on its leading bits, of which there are as many as make shards of
about ``SHARD`` fingerprints. Large shards are split by the whole block and then, in
the same way, by blocks of the remaining bits.

``keep_first`` takes fingerprints for candidates only and verifies five-word shingles.
At its radius a tree's edges would rule out nothing, so shards are compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enter, fresh, materialize, release, table
from .components import components

SEED = 42
BLOCK = 32_768
#: Fingerprints of a shard (about); shards with more than so many are split.
SHARD, LARGE_SHARD = 512, 8_192
#: Searches that go through a tree together.
AT_ONCE = 4_096


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of each run of ``width`` words, repeats included; fewer words: of them all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])]


def fingerprint(hashes: list[int], words: int = 1) -> bytes:
    """``64 * words`` bits, big-endian; a bit is 1 if it is set in over half the hashes.

    The first word counts the hashes' own bits, each further one those of the hashes
    multiplied by another odd number and folded.
    """
    total = np.zeros((words, 64), np.int64)
    for i in range(0, len(hashes), BLOCK):
        own = np.array(hashes[i : i + BLOCK], np.uint64)
        for k in range(words):
            mixed = own
            if k:
                mixed = own * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(32)
            bits = np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            total[k] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(total * 2 > len(hashes), axis=1).tobytes()


def simhash(text: Column, width: int = 3) -> Column:
    """The fingerprint of each whole text as a signed long; null, empty or wordless: zero."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        found = (fingerprint(shingle_hashes(t.as_py(), width)) for t in texts)
        return pa.array([int.from_bytes(x, "big", signed=True) for x in found], pa.int64())

    return prints(text)


class BKTree:
    """A tree of distinct 64-bit integers; the children of a node are keyed by their Hamming distance to it.

    Values are inserted in their order, a level of the tree at once: of the values that
    came to a node and have one distance to it the first becomes the child.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        edges, children = [], []
        left, node = np.arange(1, len(values)), np.zeros(max(len(values) - 1, 0), np.int64)
        while len(left):
            edge = node * 65 + np.bitwise_count(values[left] ^ values[node])
            found, first, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(found)
            children.append(left[first])
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, node = left[rest], left[first][which[rest]]
        edges, children = np.concatenate([*edges, np.empty(0, np.int64)]), np.concatenate([*children, np.empty(0, np.int64)])
        order = np.argsort(edges)
        #: Node times 65 plus distance, sorted, and the child there.
        self.edges, self.children = edges[order], children[order]

    def search(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places (of ``values``, of the tree's) of all pairs within ``radius``, and how many nodes were visited."""
        found, visited = [(np.empty(0, np.int64),) * 2], 0
        asking = np.arange(len(values)) if len(self.values) else np.empty(0, np.int64)
        node = np.zeros(len(asking), np.int64)
        while len(asking):
            visited += len(asking)
            distance = np.bitwise_count(values[asking] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            found.append((asking[near], node[near]))
            # The edges from distance - radius to distance + radius stand together.
            low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), "right")
            count = high - low
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            asking, node = np.repeat(asking, count), self.children[np.repeat(low, count) + within]
        return *(np.concatenate(x) for x in zip(*found)), visited


def shard_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the same fingerprints as all pairs within ``radius`` do, as places."""
    tree, above, out = BKTree(values), list(range(len(values))), []

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    for at in range(0, len(values), AT_ONCE):
        asking, found, _ = tree.search(values[at : at + AT_ONCE], radius)
        later = found > asking + at
        for i, j in zip((asking[later] + at).tolist(), found[later].tolist()):
            if (a := top(i)) != (b := top(j)):
                above[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _linked(radius: int):
    """Over rows sorted by shard: the links of one shard after the other."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        shard = None

        def flush() -> pa.RecordBatch:
            values = np.unique(np.concatenate(held)).view(np.uint64)
            pairs = np.array(shard_links(values, radius), np.int64).reshape(-1, 2)
            ends = values.view(np.int64)[pairs]
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                if keys[a] != shard and held:
                    if sum(map(len, held)) > 1:
                        yield flush()
                    held = []
                shard = keys[a]
                held.append(values[a:b])
        if sum(map(len, held)) > 1:
            yield flush()

    return links


def _mask(bits: range) -> int:
    """The signed 64-bit integer with these bits set; bit 0 is the highest."""
    value = sum(1 << 63 - b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _parts(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` cut into ``n`` blocks of about one size."""
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def shard_masks(radius: int, leading: int) -> list[list[int]]:
    """For each level the masks of its shards' fixed bits; shard i of a level is split into those from i * (its share) on.

    Level 0: the leading bits of a block; 1: the block; 2 and 3: a block of the remaining bits as well.
    """
    n, every = radius + 1, list(range(64))
    blocks = [(own, [b for b in every if b not in own]) for own in _parts(every, n)]
    levels = [[own[:leading] for own, _ in blocks], [own for own, _ in blocks]]
    for _ in range(2):
        blocks = [([*own, *part], [b for b in rest if b not in part]) for own, rest in blocks for part in _parts(rest, n)]
        levels.append([own for own, _ in blocks])
    return [[_mask(own) for own in level] for level in levels]


def _keyed(rows: DataFrame, level: list[int], first: Column, share: int) -> DataFrame:
    """``path``, ``fp`` and ``key``: a row for each of the shards from ``first`` on."""
    masks = F.array(*[F.lit(m).cast("long") for m in level])
    paths = rows.select("fp", F.explode(F.sequence(first, first + share - 1)).alias("path"))
    return paths.select("path", "fp", F.xxhash64(F.lit(len(level)), "path", F.col("fp").bitwiseAND(F.get(masks, F.col("path")))).alias("key"))


def links_within(prints: DataFrame, radius: int) -> DataFrame:
    """Links between distinct fingerprints (written longs, column ``fp``) within ``radius``.

    They connect exactly what all such pairs connect. Two that share no key never meet;
    two of one key that only shares its hash are told apart by their distance. With a
    radius of 2 a shard holds at most 2**19 fingerprints after the last split.
    """
    n = radius + 1
    leading = max(0, min(64 // n, (prints.count() // SHARD).bit_length()))
    masks = shard_masks(radius, leading)
    rows, small = _keyed(prints, masks[0], F.lit(0), n), []
    for level in (1, 2, 3):
        large = materialize(rows.groupBy("key").count().where(F.col("count") > LARGE_SHARD).select("key"))
        if large.isEmpty():
            break
        small.append(rows.join(large, "key", "left_anti"))
        share = 1 if level == 1 else n
        rows = materialize(_keyed(rows.join(large, "key", "left_semi"), masks[level], F.col("path") * share, share))
    every = reduce(DataFrame.unionByName, small, rows)
    dealt = every.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_linked(radius), "a long, b long").distinct()


def label(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``fp``, ``root``: for every distinct long ``fp`` of ``prints`` the smallest one it is connected with; written.

    Equal fingerprints are reduced to one before any search, so a group of copies
    costs no more than one text.
    """
    own = materialize(prints.select("fp").distinct())
    found = components(links_within(own, radius))
    return materialize(own.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")))


def label_near_duplicates(df: DataFrame, text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """Add ``fp`` and ``fp_root`` (longs) to ``df``: see ``simhash`` and ``label``.

    Texts of one fingerprint are connected, and fingerprints within ``radius`` bits
    are, see ``links_within``. Null, empty and wordless texts have fingerprint zero
    and are connected like others. Repeated rows stay; an empty table gives an empty
    table. ``df`` must not have columns of the names ``fp`` or ``fp_root``; all others
    keep their values.
    """
    if clash := {"fp", "fp_root"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    rows = materialize(df.withColumn("fp", simhash(F.col(f"`{text}`"), width)))
    found = label(rows, radius).select(F.col("fp").alias("known_fp"), F.col("root").alias("fp_root"))
    joined = rows.alias("l").join(found.alias("r"), F.col("l.fp") == F.col("r.known_fp"))
    return joined.select(*[F.col(f"l.`{c}`") for c in rows.columns], F.col("r.fp_root"))


#: Near duplicates share NEED / OF of their distinct five-word shingles, or more.
NEED, OF = 4, 5
#: Words of the fingerprints that choose shards, and of those that choose pairs to verify.
WIDE_WORDS, WIDEST_WORDS = 4, 16
#: The share of bits that differ at a similarity of 0.8, wherever the edits are; four standard deviations more are searched.
DIFFERENT, DEVIATIONS = 0.1515, 4
#: Of sets with fewer shingles the bits scatter more: a quarter of them may differ.
FEW = 64
#: Bits of a band at least. Of more than 2**20 fingerprints bands have more bits, so that a shard holds some 64
#: of unlike texts at any size; and there are as many bands as leave out this share of pairs of similarity 0.8 only.
BAND_BITS, UNLIKE_BITS, MISSED = 14, 6, 0.0012


class Bands:
    """Chosen bits of a fingerprint; pairs are compared that agree on all bits of a band."""

    def __init__(self, rows: int):
        self.bits = max(BAND_BITS, math.ceil(math.log2(max(rows, 1))) - UNLIKE_BITS)
        self.count = math.ceil(math.log(MISSED) / math.log(1 - (1 - DIFFERENT) ** self.bits))
        self.picked = np.argsort(np.random.default_rng(SEED).random((self.count, 64 * WIDE_WORDS)), axis=1)[:, : self.bits]
        masks = np.zeros((self.count, 64 * WIDE_WORDS), np.uint8)
        np.put_along_axis(masks, self.picked, 1, axis=1)
        self.masks = np.packbits(masks, axis=1).view(np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the five-word shingles, sorted; see ``shingle_hashes``."""
    return np.unique(np.array(shingle_hashes(text, 5), np.uint64))


def described(text: Column) -> Column:
    """Struct of ``s`` (hash of the shingle set), ``n`` (its size) and ``fp`` (its fingerprint)."""

    @F.arrow_udf("s long, n int, fp binary")
    def run(texts: pa.Array) -> pa.Array:
        enter("simhash")
        sets = [shingle_set(t.as_py()) for t in texts]
        names = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
        prints = pa.array([fingerprint(x, WIDE_WORDS) for x in sets], pa.binary())
        return pa.StructArray.from_arrays([pa.array(names), pa.array([len(x) for x in sets], pa.int32()), prints], ["s", "n", "fp"])

    return run(text)


def unfolded(text: Column) -> Column:
    """Struct of ``own`` (the shingle set) and ``widest`` (a fingerprint of 1,024 bits that begins with ``fp``)."""

    @F.arrow_udf("own array<long>, widest binary")
    def run(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py()) for t in texts]
        own = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([own, pa.array([fingerprint(x, WIDEST_WORDS) for x in sets], pa.binary())], ["own", "widest"])

    return run(text)


def _print_words(column: pa.Array) -> np.ndarray:
    """A row of 64-bit words for each of the fingerprints, which are of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _banded(bands: Bands):
    """A row for each fingerprint and band: ``key`` is the band and its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bands.bits)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                bits = np.unpackbits(_print_words(batch.column("fp")).view(np.uint8), axis=1, count=64 * WIDE_WORDS)
                keys = np.stack([(k << bands.bits) + bits[:, own] @ powers for k, own in enumerate(bands.picked)], axis=1)
                each = pa.array(np.repeat(np.arange(batch.num_rows), bands.count))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[c.take(each) for c in batch.columns]], names=["key", *batch.schema.names])

    return run


def near(prints: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the fingerprints at places ``a`` and ``b`` differ as little as those of alike sets."""
    bits = 64 * prints.shape[1]
    radius = DIFFERENT * bits + DEVIATIONS * (DIFFERENT * (1 - DIFFERENT) * bits) ** 0.5
    radius = np.where(np.minimum(sizes[a], sizes[b]) < FEW, bits / 4, radius)
    return np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64) <= radius


def first_shared(keys: np.ndarray, prints: np.ndarray, a: np.ndarray, b: np.ndarray, bands: Bands) -> np.ndarray:
    """Whether the band of ``keys`` is the first on which the fingerprints at ``a`` and ``b`` agree."""
    differ, band = prints[a, :WIDE_WORDS] ^ prints[b, :WIDE_WORDS], keys[a] >> bands.bits
    first = np.full(len(a), bands.count)
    for k in range(bands.count - 1, -1, -1):
        first[~(differ & bands.masks[k]).any(axis=1)] = k
    return first == band


#: Shards with more members than this are searched by leaders first.
CROWD = 256
#: Pairs that are compared at once.
PAIRS_AT_ONCE = 1 << 20


def alike_sizes(sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(sizes[a], sizes[b]) * OF >= np.maximum(sizes[a], sizes[b]) * NEED


def led(sizes: np.ndarray, prints: np.ndarray, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a leader and those of the shard's places that are near to it and to no leader before.

    A leader that is near only to places of others is paired with the first of these, so that
    every place with a partner in the shard is in a pair. A group of near copies costs one
    comparison for each member and leader.
    """
    every, free, out = np.arange(low, high), np.ones(high - low, bool), []
    while free.any():
        lead = every[free.argmax()]
        to = every[every != lead]
        to = to[alike_sizes(sizes, np.full(len(to), lead), to)]
        to = to[near(prints, sizes, np.full(len(to), lead), to)]
        own = to[free[to - low]]
        partner = own if len(own) else to[:1]
        out.append((np.full(len(partner), lead), partner))
        free[own - low] = False
        free[lead - low] = False
    return out


def near_in_shards(keys: np.ndarray, sizes: np.ndarray, prints: np.ndarray, group: np.ndarray | None, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of one key that are ``near`` and whose sizes allow the similarity.

    With ``group``, all pairs of different groups, each in one of the shards they share;
    rows are sorted by key and group then, and pairs within a group are never looked at.
    Without, each place that has such a partner with one at least; rows are sorted by key,
    and all small shards are compared at once, place i with i + 1, then i + 2 and so on.
    """
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    shard = np.searchsorted(keys, keys, "right")
    if group is not None:
        begins = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])]) if len(keys) else np.empty(0, int)
        after = np.repeat(np.r_[begins[1:], len(keys)], np.diff(np.r_[begins, len(keys)])) if len(keys) else np.empty(0, int)
        count = shard - after
        total = np.cumsum(count)
        for at in range(0, int(total[-1]) if len(total) else 0, PAIRS_AT_ONCE):
            pair = np.arange(at, min(at + PAIRS_AT_ONCE, total[-1]))
            a = np.searchsorted(total, pair, "right")
            b = after[a] + pair - (total[a] - count[a])
            fits = alike_sizes(sizes, a, b)
            a, b = a[fits], b[fits]
            close = near(prints, sizes, a, b)
            a, b = a[close], b[close]
            if len(a):
                new = first_shared(keys, prints, a, b, bands)
                left.append(a[new])
                right.append(b[new])
        return np.concatenate(left), np.concatenate(right)
    first = np.searchsorted(keys, keys)
    crowd = shard - first > CROWD
    for low in np.unique(first[crowd]):
        for a, b in led(sizes, prints, int(low), int(shard[low])):
            left.append(a)
            right.append(b)
    at, lag = np.flatnonzero(~crowd), 1
    below, above = np.zeros(len(keys), bool), np.full(len(keys), -1)
    while True:
        at = at[at + lag < shard[at]]
        if not len(at):
            break
        a, b = at, at + lag
        fits = alike_sizes(sizes, a, b)
        a, b = a[fits], b[fits]
        close = near(prints, sizes, a, b)
        a, b = a[close], b[close]
        above[b] = a  # the last that is written is the first in the shard
        new = ~below[a]
        below[a] = True
        left.append(a[new])
        right.append(b[new])
        lag += 1
    found = np.flatnonzero(above >= 0)
    return np.concatenate([*left, above[found]]), np.concatenate([*right, found])


def _near(grouped: bool, bands: Bands):
    """Over rows sorted by key: the pairs of ``near_in_shards``, by ``s``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            key, s, n = (rows.column(c).to_numpy() for c in ("key", "s", "n"))
            group = rows.column("root").to_numpy() if grouped else None
            a, b = near_in_shards(key, n.astype(np.int64), _print_words(rows.column("fp")), group, bands)
            both = np.unique(np.stack([np.minimum(s[a], s[b]), np.maximum(s[a], s[b])], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last shard may go on
            if rows + cut > 50_000 and (cut or batch.column("key")[0] != held[-1].column("key")[-1]):
                yield pairs([*held, batch.slice(0, cut)])
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield pairs(held)

    return run


def near_pairs(nodes: DataFrame, bands: Bands) -> DataFrame:
    """Candidates ``a`` < ``b`` among ``nodes`` (``s``, ``n``, ``fp``; ``root``: see ``near_in_shards``)."""
    keyed = nodes.mapInArrow(_banded(bands), "key long, " + ", ".join(f"{c} {t}" for c, t in nodes.dtypes))
    order = ["key", "root", "s"] if "root" in nodes.columns else ["key", "s"]
    dealt = keyed.repartition("key").sortWithinPartitions(*order)
    found = dealt.mapInArrow(_near("root" in nodes.columns, bands), "a long, b long")
    return found if "root" in nodes.columns else found.distinct()


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets (``s``, ``own``) have a Jaccard similarity of NEED / OF or more."""
    left, right = sets.toDF("l_s", "l_own"), sets.toDF("r_s", "r_own")
    joined = pairs.join(left, F.col("a") == F.col("l_s")).join(right, F.col("b") == F.col("r_s"))
    common = F.size(F.array_intersect("l_own", "r_own"))
    return joined.where(common * OF >= (F.size("l_own") + F.size("r_own") - common) * NEED).select("a", "b")


def verified_links(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between shingle sets ``s`` that connect what all verified candidates connect.

    ``prints``: ``id``, ``key``, ``s``, ``n``, ``fp``; ``texts``: ``id``, ``key``, ``text``. First
    each set is compared with its first and next candidate of each shard, which
    connects most of a large group; then those that have a candidate are compared
    with all candidates that they are not yet connected with.
    """
    nodes = materialize(prints.groupBy("s").agg(F.min(F.struct("id", "key", "n", "fp")).alias("at")).select("s", "at.*"))
    bands = Bands(nodes.count())
    tried = materialize(near_pairs(nodes.select("s", "n", "fp"), bands))
    release(prints.sparkSession)
    involved = tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()
    some = materialize(nodes.join(involved, F.col("s") == F.col("node"), "left_semi"))
    wanted = some.select("s", F.col("id").alias("w_id"), F.col("key").alias("w_key"))
    own = texts.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")))
    own = own.dropDuplicates(["s"]).select("s", unfolded(F.col("text")).alias("u")).select("s", "u.own", "u.widest")
    described_ = materialize(own)
    sets = described_.select("s", "own")
    links = materialize(alike(tried, sets))
    known = materialize(components(links))
    rest = described_.join(known, F.col("s") == F.col("node"), "left").select("s", F.size("own").alias("n"), F.col("widest").alias("fp"), F.coalesce("root", "s").alias("root"))
    more = materialize(near_pairs(rest, bands))
    release(prints.sparkSession)
    return links.union(alike(more.join(tried, ["a", "b"], "left_anti"), sets))


def keep_first(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id.

    Near duplicates have five-word shingle sets of a Jaccard similarity of 0.8 or more
    (a text of up to five words is one shingle), and a group is what such pairs connect.
    Candidates agree on one of 64 bands of 14 bits (of more rows, more and longer bands: see
    ``Bands``) of a 256-bit fingerprint and differ in no more bits than alike sets do (see ``near``; of 3,000 made pairs right at 0.8, 99.4 %
    were found); each link is verified with the sets themselves. A null id counts as
    larger than any; among equal ids the row with the smaller hash of its values stays,
    and of wholly equal rows one stays. Null, empty and wordless texts are copies of each
    other. Any further columns are kept.
    """
    key, row = fresh(df, "row_key", "row_id")
    keyed = df.withColumn(key, F.xxhash64(*df.columns))
    texts = keyed.select(F.col(id_).alias("id"), F.col(key).alias("key"), F.col(text).alias("text"))
    prints = materialize(texts.withColumn("d", described(F.col("text"))).select("id", "key", "d.*"))
    found = components(verified_links(prints, texts))
    order = F.struct(F.col("id").isNull().alias("missing"), "id", "key")
    first = prints.join(found, F.col("s") == F.col("node"), "left").groupBy(F.coalesce("root", "s")).agg(F.min(order).alias("first"))
    first = first.select(F.col("first.id").alias(row), F.col("first.key").alias("first_key"))
    kept = keyed.join(first, F.col(id_).eqNullSafe(F.col(row)) & (F.col(key) == F.col("first_key")), "left_semi")
    if not prints.groupBy("id", "key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_, key])
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the smallest doc_id each is connected with."""
    docs = table(spark, sf_dir, "documents")
    rows = materialize(docs.select("doc_id", simhash(F.col("text")).alias("fp")))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # Components are told by fingerprint first, so a group of copies is one row in every shuffle but the last join.
    known = materialize(label(rows).join(least, "fp"))
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
    told = materialize(known.join(roots, "root").select(F.col("fp").alias("known_fp"), "component_id"))
    return rows.join(told, F.col("fp") == F.col("known_fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
