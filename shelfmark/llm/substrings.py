"""Removal of repeated byte strings through a sampled suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier.
Not every suffix is sorted. Each string of that length names one of its own suffixes,
the one whose first ``TOKEN`` bytes hash lowest, so equal strings name suffixes with
the same leading token, at the same distance from their starts. Only these suffixes
(one in some 35) are kept, each with 96 bits of hashes of all bytes that strings through
its leading token can reach, its surroundings (the bytes themselves would be seven
times the input):

* Suffixes with equal surroundings: all strings through the token are equal, so
  all but the first suffix lose them whole. Each task compares the bytes of its own and
  sends on one of them only.
* A token with only one kind of surroundings needs nothing more.
* The rest, which stand at the edges of repeats, fetch their surroundings. Sampled
  splitters range-partition them by leading token; a bucket leaves out suffixes that
  agree with no other beyond the token, sorts the strings of the rest by multikey
  quicksort, eight bytes at a time, and compares neighbours. All suffixes of one
  leading token lie in one bucket, so no run crosses a boundary. A token that stands at more
  than ``OFTEN`` edges is split by the bytes beside it: a string through it has at least
  half of its other bytes before or after it, so equal ones agree on that half, too.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release, table

LENGTH = 100
TOKEN = 32
#: Leading tokens in one string, and how far a string reaches to the left of one.
TOKENS = LENGTH - TOKEN + 1
LEFT = LENGTH - TOKEN
SEGMENT = 1 << 21
STRINGS_AT_ONCE = 100_000
SUFFIXES_AT_ONCE = 60_000
PLACES_AT_ONCE = 10_000
SMALL = 512
#: A token at more edges than this is split by the ``HALF`` bytes before or after it.
OFTEN = 1_000
HALF = LEFT // 2
BASE = 0x100000001B3


def token_hashes(data: np.ndarray) -> np.ndarray:
    """A well-mixed hash of the ``TOKEN`` bytes from each position on."""
    h, n, power = data.astype(np.uint64) + np.uint64(1), 1, BASE
    while n < TOKEN:
        h = h[:-n] * np.uint64(power) + h[n:]
        power = power * power % 2**64
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def sliding(h: np.ndarray, width: int, choose) -> np.ndarray:
    """``choose`` (minimum or maximum) over each run of ``width``."""
    n = 1
    while 2 * n <= width:
        h = choose(h[:-n], h[n:])
        n *= 2
    return choose(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


def named_suffixes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and token hashes of the suffixes that the strings of ``data`` name."""
    found, hashes = [], []
    for at in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        # The strings that start in this segment.
        h = token_hashes(np.frombuffer(data[at : at + SEGMENT + LENGTH - 1], np.uint8))
        least = sliding(h, TOKENS, np.minimum)
        # A position is named if it is the least of a run: the largest least of its runs is its own.
        edge = np.zeros(TOKENS - 1, np.uint64)
        reach = sliding(np.concatenate([edge, least, edge]), TOKENS, np.maximum)
        own = np.flatnonzero(reach == h)
        found.append(own + at)
        hashes.append(h[own])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    positions, first = np.unique(np.concatenate(found), return_index=True)
    return positions, np.concatenate(hashes)[first]


def spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals, as maximal runs."""
    out: list[list[int]] = []
    for i in np.argsort(starts, kind="stable"):
        if out and starts[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(ends[i]))
        else:
            out.append([int(starts[i]), int(ends[i])])
    return [tuple(x) for x in out]


def _merged(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Rows (doc, start, end) of the union of the intervals of each document."""
    order = np.argsort(docs, kind="stable")
    docs, starts, ends = docs[order], starts[order], ends[order]
    for i, j in zip(*_runs(docs)):
        for a, b in spans(starts[i:j], ends[i:j]):
            yield int(docs[i]), a, b


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal rows."""
    if not len(columns[0]):
        return np.empty(0, int), np.empty(0, int)
    change = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    starts = np.concatenate([[0], np.flatnonzero(change) + 1])
    return starts, np.append(starts[1:], len(columns[0]))


SUFFIX_ROW = "h long, c long, d int, doc long, start long, end long"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes with their surroundings; without hashes: spans that are known to go.

    For suffixes, ``start`` is the position times 2**14, plus 2**7 times the bytes to
    the left, plus the bytes to the right. Of equal surroundings among some 100,000
    suffixes only the first goes on.
    """
    parts: list[tuple] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = value.as_py() or b""
            at, h = named_suffixes(data)
            if len(at):
                left, right = np.minimum(at, LEFT), np.minimum(len(data) - at, LENGTH)
                c = b"".join([xxhash.xxh3_128_digest(data[p - x : p + y], x) for p, x, y in zip(at.tolist(), left.tolist(), right.tolist())])
                c = np.frombuffer(c, np.int64).reshape(-1, 2)
                parts.append((h, c[:, 0], c[:, 1].astype(np.int32), np.full(len(at), doc, np.int64), at, left, right, np.full(len(at), len(texts))))
                texts.append(data)
                held += len(at)
            if held >= SUFFIXES_AT_ONCE:
                yield _reduced(parts, texts)
                parts, texts, held = [], [], 0
    if parts:
        yield _reduced(parts, texts)


def _reduced(parts: list[tuple], texts: list[bytes]) -> pa.RecordBatch:
    h, c, d, doc, at, left, right, text = map(np.concatenate, zip(*parts))
    order = np.lexsort((at, doc, d, c, h))
    h, c, d, doc, at, left, right, text = (x[order] for x in (h, c, d, doc, at, left, right, text))
    first = np.zeros(len(h), bool)
    first[_runs(h, c, d)[0]] = True
    own = lambda i: texts[text[i]][at[i] - left[i] : at[i] + right[i]]
    for i in np.flatnonzero(~first):
        # Hashes that agree though the bytes differ would be a wonder; then the suffix goes on by itself.
        first[i] = own(i) != own(i - 1)
    packed = (at << 14) | (left << 7) | right
    gone = np.array(list(_merged(doc[~first], (at - left)[~first], (at + right)[~first])), np.int64).reshape(-1, 3)
    none, sent = np.zeros(len(gone), np.int64), int(first.sum())
    is_span = np.arange(sent + len(gone)) >= sent
    columns = [
        pa.array(np.concatenate([h[first].view(np.int64), none]), mask=is_span),
        pa.array(np.concatenate([c[first], none]), mask=is_span),
        pa.array(np.concatenate([d[first], none]).astype(np.int32), mask=is_span),
        pa.array(np.concatenate([doc[first], gone[:, 0]])),
        pa.array(np.concatenate([packed[first], gone[:, 1]])),
        pa.array(np.concatenate([np.zeros(sent, np.int64), gone[:, 2]]), mask=~is_span),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["h", "c", "d", "doc", "start", "end"])


PLAIN, AFTER, BEFORE = b"\0", b"\1", b"\2"


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc, data, places, often): the surroundings of each place, by token or, for frequent ones, by token and half.

    They go out in blocks, however many places a text has.
    """
    types = (pa.binary(), pa.int64(), pa.int64(), pa.binary())

    def sent(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=["token", "doc", "place", "around"])

    for batch in batches:
        out: list[tuple] = []
        for doc, data, places, often in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            data, often = data.as_py(), set(often.as_py())
            for place in places.as_py():
                at, left, right = place >> 14, place >> 7 & 127, place & 127
                around = data[at - left : at + right]
                if place not in often:
                    out.append((PLAIN + data[at : at + TOKEN], doc, place, around))
                else:
                    if right >= TOKEN + HALF:
                        out.append((AFTER + data[at : at + TOKEN + HALF], doc, place, around))
                    if left >= HALF:
                        out.append((BEFORE + data[at - HALF : at + TOKEN], doc, place, around))
                if len(out) >= PLACES_AT_ONCE:
                    yield sent(out)
                    out = []
        yield sent(out)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order that sorts the rows of ``words`` (unsigned, one key a column).

    Three-way partition by the key at a depth; the equal part goes on to the next key.
    """
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == words.shape[1]:
            continue
        part = order[low:high]
        if high - low <= SMALL:
            order[low:high] = part[np.lexsort(words[part, depth:].T[::-1])]
            continue
        key = words[part, depth]
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]
        less, more = key < pivot, key > pivot
        a, b = int(less.sum()), int(more.sum())
        order[low:high] = np.concatenate([part[less], part[~(less | more)], part[more]])
        todo += [(low, low + a, depth), (low + a, high - b, depth + 1), (high - b, high, depth)]
    return order


def repeated(members: list[tuple[bytes, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """Spans (doc, start, end) of strings through one token that are equal to an earlier one.

    ``members``: key (see ``_surroundings``), doc, place and surroundings. Equal strings have the token that
    names their suffix at the same distance, so strings are compared with those of
    the same key and distance only. Of very many members, those of one distance are sorted at a time.
    """
    places = np.array([m[2] for m in members], np.int64)
    docs = np.array([m[1] for m in members], np.int64)
    at, left, right = places >> 14, places >> 7 & 127, places & 127
    names = {t: i for i, t in enumerate(dict.fromkeys(m[0] for m in members))}
    group = np.array([names[m[0]] for m in members], np.uint64)
    kind = np.array([m[0][0] for m in members], np.uint8)
    around = np.zeros((len(members), LEFT + LENGTH), np.uint8)
    for row, member, x in zip(around, members, left.tolist()):
        row[LEFT - x : LEFT - x + len(member[3])] = np.frombuffer(member[3], np.uint8)
    out: list[tuple[int, int, int]] = []
    words, doc, start = [], [], []
    for begin in range(TOKENS):
        # Strings that begin up to HALF before the token reach HALF after it at least; the others stand in BEFORE.
        late = begin >= LEFT - HALF
        own = np.flatnonzero((begin >= LEFT - left) & (begin + LENGTH <= LEFT + right) & (kind != (BEFORE[0] if late else AFTER[0])))
        padded = np.zeros((len(own), 104), np.uint8)
        padded[:, :LENGTH] = around[own, begin : begin + LENGTH]
        key = (group[own] << np.uint64(7)) | np.uint64(begin)
        words.append(np.column_stack([key, padded.view(">u8").astype(np.uint64)]))
        doc.append(docs[own])
        start.append(at[own] - LEFT + begin)
        if begin == TOKENS - 1 or len(own) > STRINGS_AT_ONCE // 4:
            out += _later(*map(np.concatenate, (words, doc, start)))
            words, doc, start = [], [], []
    return out


def _later(words: np.ndarray, doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of the strings that are equal to one that starts earlier."""
    order = multikey_quicksort(words)
    words, doc, start = words[order], doc[order], start[order]
    begins, _ = _runs(*words.T)
    run = np.zeros(len(doc), np.int64)
    run[begins[1:]] = 1
    run = np.cumsum(run)
    ranked = np.lexsort((start, doc, run))
    gone = np.ones(len(doc), bool)
    gone[ranked[_runs(run[ranked])[0]]] = False
    return list(_merged(doc[gone], start[gone], start[gone] + LENGTH))


def plausible(key: bytes, members: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """Of suffixes with one key, those that may share a whole string with another.

    A string has at least half of its other bytes before the token or at least half
    after it, so two that share one agree on that half next to the token, too.
    """
    if len(members) < 2:
        return []
    if key[:1] != PLAIN:
        return members
    halves = []
    for _, place, around in members:
        left, right = place >> 7 & 127, place & 127
        before = around[left - HALF : left] if left >= HALF else None
        after = around[left + TOKEN : left + TOKEN + HALF] if right >= TOKEN + HALF else None
        halves.append((before, after))
    befores, afters = (Counter(x) for x in zip(*halves))
    return [m for m, (b, a) in zip(members, halves) if (b is not None and befores[b] > 1) or (a is not None and afters[a] > 1)]


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's rows, sorted by token: the spans that go, for as many whole tokens at once as fit."""
    members: list[tuple[bytes, int, int, bytes]] = []
    same: list[tuple[int, int, bytes]] = []
    token = None

    def flush() -> pa.RecordBatch:
        columns = list(zip(*repeated(members))) or [(), (), ()]
        members.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc", "start", "end"])

    for batch in batches:
        for key, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if key != token:
                members += [(token, *m) for m in plausible(token, same)]
                same.clear()
                if len(members) * TOKENS >= STRINGS_AT_ONCE:
                    yield flush()
            token = key
            same.append(tuple(row))
    members += [(token, *m) for m in plausible(token, same)]
    if members:
        yield flush()


def _fate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, runs, digests, rest = [], [], [], [], []
        for data, gone in zip(batch.column(1), batch.column(2)):
            data, gone = data.as_py() or b"", gone.as_py() or []
            bounds = spans(np.array([g["start"] for g in gone]), np.array([g["end"] for g in gone]))
            kept, at = [], 0
            for a, b in bounds:
                kept.append(data[at:a])
                at = b
            left = b"".join([*kept, data[at:]])
            sizes.append(len(data))
            removed.append(len(data) - len(left))
            runs.append([{"start": a, "end": b} for a, b in bounds])
            digests.append(hashlib.sha256(left).hexdigest())
            rest.append(left)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, span), pa.array(digests, pa.string()), pa.array(rest, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def numbered(df: DataFrame, id_: str, text: str) -> DataFrame:
    """``id``, ``doc`` (a long that orders the rows) and ``data`` (the text's UTF-8 bytes).

    Where ids are longs without nulls or repeats they are the order themselves. Else
    rows are numbered by id, nulls last, then by a hash of the text, and rows that
    agree in both share a number.
    """
    source = df.select(F.col(id_).cast("long").alias("id"), F.xxhash64(text).alias("content"), F.encode(text, "UTF-8").alias("data"))
    if source.where("id is null").isEmpty() and source.groupBy("id").count().where("count > 1").isEmpty():
        return source.select("id", F.col("id").alias("doc"), "data")
    keys = source.select("id", "content").distinct()
    keys = keys.repartitionByRange(F.asc_nulls_last("id"), "content").sortWithinPartitions(F.asc_nulls_last("id"), "content")
    keys = materialize(keys.withColumn("doc", F.monotonically_increasing_id()).toDF("i", "x", "doc"))
    return source.join(keys, F.col("id").eqNullSafe(F.col("i")) & (F.col("content") == F.col("x"))).select("id", "doc", "data")


def removed_spans(rows: DataFrame) -> DataFrame:
    """``doc``, ``start``, ``end``: spans that together cover the bytes that go, written."""
    known, kept = _settled(rows)
    release(rows.sparkSession)
    at, left, right = "shiftright(start, 14)", "(shiftright(start, 7) & 127)", "(start & 127)"
    whole = kept.where("n > 1").selectExpr("doc", f"{at} - {left} as start", f"{at} + {right} as end")
    place = F.collect_list("start").alias("places"), F.collect_list(F.when(F.col("often"), F.col("start"))).alias("often_places")
    places = kept.where("n = 1").groupBy(F.col("doc").alias("p_doc")).agg(*place)
    joined = rows.join(places, F.col("doc") == F.col("p_doc")).select("doc", "data", "places", "often_places")
    around = joined.mapInArrow(_surroundings, "token binary, doc long, place long, around binary")
    buckets = around.repartitionByRange("token").sortWithinPartitions("token")
    repeats = buckets.mapInArrow(_bucket, "doc long, start long, end long")
    found = materialize(known.union(whole).union(repeats))
    discard(known.written_path, kept.written_path)
    return found


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans that go for sure; and suffixes (``n`` > 1: wholly repeated; 1: with others of their token)."""
    suffixes = materialize(rows.select("doc", "data").mapInArrow(_suffixes, SUFFIX_ROW))
    known = materialize(suffixes.where("h is null").select("doc", "start", "end"))
    # Dealt by token once, for both windows.
    ranked = suffixes.where("h is not null").repartition("h").selectExpr("h", "doc", "start", "row_number() over (partition by h, c, d order by doc, start) as n")
    kinds = ranked.withColumn("kinds", F.expr("count_if(n = 1) over (partition by h)"))
    kept = materialize(kinds.where("n > 1 or kinds > 1").select("doc", "start", "n", (F.col("kinds") > OFTEN).alias("often")))
    discard(suffixes.written_path)
    return known, kept


def dedup_substrings(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``spans``, ``kept_sha256`` and ``kept`` (bytes) of each row.

    Rows are taken in the order of their ids; see ``numbered`` for nulls and repeats.
    Matches do not cross rows, and are judged on the input. Null and empty texts have
    no bytes; texts of fewer than 100 bytes lose nothing. Of wholly repeated rows,
    which have one number, both lose what an earlier row or place has, and neither
    what the other has. ``spans`` are the maximal removed runs.
    """
    rows = numbered(df, id_, text)
    found = removed_spans(rows)
    release(df.sparkSession)
    each = found.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("gone")).withColumnRenamed("doc", "g_doc")
    joined = rows.join(each, F.col("doc") == F.col("g_doc"), "left").select("id", "data", "gone")
    return joined.mapInArrow(_fate, "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    """What each document loses to 100-byte strings that start earlier in the corpus."""
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
