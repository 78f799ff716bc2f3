"""Quality selection by importance resampling with hashed n-grams.

Two generative models of hashed word unigrams and bigrams are counted: one of the
target (documents labelled good) and one of the raw corpus. A document's log
importance weight is the sum of log(target / raw) over its n-grams, under models
that have not counted the document itself, so that a labelled document is judged as an
unlabelled one is. The number of buckets follows the target's n-grams, so that a bucket's
counts tell something about n-grams of other documents. Standard Gumbel noise is added, and the k documents with the largest sums are a sample without
replacement in proportion to the weights.

A sum hardly sees a few toxic words in a long text. So toxicity has a ratio of its own,
of the shares of toxic and of clean labelled documents that contain a word or the first
bytes of one, and a text is judged by its most toxic ones alone.

Texts are read twice: once for all counts, once for all scores. Words are hashed in
blocks of bytes, so memory does not grow with a task's texts.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, enter, materialize, table, worker_cache
from .decontaminate import bounded

#: About so many n-grams of the target fall to a bucket; the buckets are 2**8 to 2**19.
TO_A_BUCKET, LEAST_BITS, MOST_BITS = 70, 8, 19
#: Buckets of the toxic ratios.
TOXIC_BITS = 22
#: Words count for toxicity whole and by so many first bytes.
FIRST_BYTES = (4, 5, 6)
#: The driver gets the toxic ratios of what so many toxic documents share.
TOXIC_LEAST = 3
#: A text's toxicity is the sum of so many of its largest ratios.
STRONGEST = 3
#: At most so many labelled documents are learned from, and so many of them for toxicity.
LABELLED_ROWS, TOXIC_ROWS = 100_000, 20_000
#: Thresholds may reject at most this share of the documents labelled clean or good.
CLEAN_LOST = 0.005
#: What a bucket has in the target, and what it would have if the target were like the raw corpus, are smoothed by so many
#: n-grams, so a bucket that no other document has met says nothing.
PRIOR = 20
#: Texts are hashed in blocks of about so many bytes.
CHUNK = 1 << 19
BASE, INVERSE = 0x100000001B3, pow(0x100000001B3, -1, 2**64)
MIX, LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2**64, ``n`` at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        _powers[:] = []
        for base in (BASE, INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


#: Bytes without case; ASCII bytes that are no letters become blanks.
FOLDED = np.array([i + 32 if 65 <= i < 91 else i if i >= 128 or 97 <= i < 123 else 32 for i in range(256)], np.uint8)


def hash_words(data: np.ndarray, bounds: np.ndarray, firsts: tuple[int, ...] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
    """A 64-bit hash of each word (run of bytes other than ASCII white space), and the place of its text.

    ``bounds``: where the texts in ``data`` begin, and where the last one ends. For each of
    ``firsts`` follow the hashes of the first so many bytes, and places, of all words that have them.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begin, end = ~space, ~space
    begin[1:] &= space[:-1]
    end[:-1] &= space[1:]
    full = bounds[1:] > bounds[:-1]
    at, last = bounds[:-1][full], bounds[1:][full] - 1
    begin[at] = ~space[at]
    end[last] = ~space[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds)))
    out = [((sums[ends] - sums[starts]) * inverse[starts], own)]
    for n in firsts:
        long = ends - starts >= n
        some = starts[long]
        out.append(((sums[some + n] - sums[some]) * inverse[some] + np.uint64(n * int(LEFT) % 2**64), own[long]))
    return out


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts: first and last row, the bytes, and where the texts begin and end in them."""
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def n_grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every unigram and then of every bigram of the texts, in order, and the place of the text."""
    ((hashes, own),) = hash_words(data, bounds)
    same = own[:-1] == own[1:]
    pairs = (hashes[:-1] * LEFT + hashes[1:] * RIGHT)[same]
    return np.concatenate([hashes, pairs]) * MIX, np.concatenate([own, own[:-1][same]])


def words_and_beginnings(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word without case and of its ``FIRST_BYTES``, and the place of the text."""
    found = hash_words(FOLDED[data], bounds, FIRST_BYTES)
    return np.concatenate([h for h, _ in found]) * MIX, np.concatenate([own for _, own in found])


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


RAW, TARGET, CLEAN, TOXIC = range(4)
_made = threading.local()
worker_cache("quality", lambda: _made.__dict__.clear())


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, bucket, n): occurrences for raw and target, documents for clean and toxic.

    Bucket -1 has the number of documents. Columns: text, good, toxic (null: not learned from).
    """
    enter("quality")
    sums = [np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), np.zeros(1 << TOXIC_BITS, np.int32), np.zeros(1 << TOXIC_BITS, np.int32)]
    documents = np.zeros(4, np.int64)
    for batch in batches:
        good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        toxic = np.array([-1 if t is None else int(t) for t in batch.column(2).to_pylist()])
        documents += [len(good), good.sum(), (toxic == 0).sum(), (toxic == 1).sum()]
        for row, last, data, bounds in blocks(batch.column(0)):
            hashes, own = n_grams(data, bounds)
            found, chosen = buckets(hashes, bits), good[row:last][own]
            sums[RAW] += np.bincount(found, minlength=1 << bits)
            if chosen.any():
                sums[TARGET] += np.bincount(found[chosen], minlength=1 << bits)
            told = toxic[row:last]
            if (told >= 0).any():
                hashes, own = words_and_beginnings(data, bounds)
                for kind, label in ((CLEAN, 0), (TOXIC, 1)):
                    some = told[own] == label
                    each = np.unique((own[some] << TOXIC_BITS) | buckets(hashes[some], TOXIC_BITS))
                    np.add.at(sums[kind], each & ((1 << TOXIC_BITS) - 1), 1)
    for kind, counts in enumerate(sums):
        at = np.flatnonzero(counts)
        n = np.r_[documents[kind], counts[at]].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(np.r_[-1, at]), pa.array(n)], names=["kind", "bucket", "n"])


def bits_for(n: int) -> int:
    """The bits of a bucket's number for a target of about ``n`` n-grams."""
    return min(max(round(math.log2(max(n, 1) / TO_A_BUCKET)), LEAST_BITS), MOST_BITS)


class Model:
    """What the labelled documents and the corpus say: the counts of each bucket, and the toxic ratios."""

    def __init__(self, df: DataFrame):
        """``df``: text, good, toxic, as for ``_counted``; every document counts for raw.

        Each task sends its sums, so what is moved grows with the tasks and the buckets,
        and the driver gets one row for each bucket.
        """
        # White space tells about how many words there are; each gives a word and a pair.
        blank = F.octet_length("text") - F.octet_length(F.translate("text", " \t\n\x0b\x0c\r", ""))
        bits = bits_for(2 * (df.where("good").agg(F.sum(blank + 1)).first()[0] or 0))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _counted(batches, bits)

        self.bits = bits
        counts = materialize(df.mapInArrow(counted, "kind int, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")))
        self.raw, self.target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for part, kind in ((self.raw, RAW), (self.target, TARGET)):
            got = counts.where((F.col("kind") == kind) & (F.col("bucket") >= 0)).select("bucket", "n").toArrow()
            part[got["bucket"].to_numpy()] = got["n"].to_numpy()
        self.sums = int(self.raw.sum()), int(self.target.sum())
        documents = {r.kind: r.n for r in counts.where("bucket < 0").collect()}
        bad = counts.where((F.col("kind") == TOXIC) & (F.col("bucket") >= 0) & (F.col("n") >= TOXIC_LEAST)).select("bucket", F.col("n").alias("t"))
        also = counts.where(F.col("kind") == CLEAN).select("bucket", F.col("n").alias("c"))
        both = bad.join(also, "bucket", "left").select("bucket", (F.col("t") + 0.5).alias("t"), (F.coalesce("c", F.lit(0)) + 0.5).alias("c")).toArrow()
        both = np.column_stack([column.to_numpy().astype(float) for column in both.columns])
        self.told, self.levels = np.empty(0, np.int64), np.empty(0, np.float32)
        if len(both):
            t, c = both[:, 1], both[:, 2]
            # Less one standard error; below zero it says nothing.
            level = np.log(t / (documents[TOXIC] + 1)) - np.log(c / (documents[CLEAN] + 1)) - np.sqrt(1 / t + 1 / c)
            self.told, self.levels = both[level > 0, 0].astype(np.int64), level[level > 0].astype(np.float32)
        discard(counts.written_path)

    def weights(self, found: np.ndarray, own: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Log importance weights of texts: ``found`` are buckets of n-grams, ``own`` their texts' numbers, ``good`` tells which texts the target has counted.

        A text's own n-grams are taken out of both models first.
        """
        raw, target = self.sums
        if not target:
            return np.zeros(len(good))
        each, n = np.unique((own << self.bits) | found, return_counts=True)
        own, found = each >> self.bits, each & ((1 << self.bits) - 1)
        size = np.bincount(own, n, len(good))
        seen, learned = self.target[found] - n * good[own], target - size * good
        usual = (learned / np.maximum(raw - size, 1))[own] * (self.raw[found] - n)
        return np.bincount(own, n * np.log((seen + PRIOR) / (usual + PRIOR)), len(good))

    @property
    def toxic(self) -> np.ndarray:
        """The ratio of every bucket, made where it is used: what is sent holds only those that tell something."""
        table = getattr(_made, "table", None)
        if table is None or _made.of is not self:
            table = np.zeros(1 << TOXIC_BITS, np.float32)
            table[self.told] = self.levels
            _made.of, _made.table = self, table
        return table

    def scored(self, column: pa.Array, good: np.ndarray) -> list[np.ndarray]:
        """The number of n-grams, log weight and toxicity of each whole text; null and empty: 0. ``good``: which the target has counted."""
        sizes, weights, toxicity = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column))
        toxic = self.toxic if len(self.told) else None
        for row, last, data, bounds in blocks(column):
            hashes, own = n_grams(data, bounds)
            sizes[row:last] = np.bincount(own, minlength=last - row)
            weights[row:last] = self.weights(buckets(hashes, self.bits), own, good[row:last])
            if toxic is None:
                continue
            hashes, own = words_and_beginnings(data, bounds)
            found = buckets(hashes, TOXIC_BITS)
            told = toxic[found] > 0
            each = np.unique((own[told] << TOXIC_BITS) | found[told])
            own, level = each >> TOXIC_BITS, toxic[each & ((1 << TOXIC_BITS) - 1)]
            order = np.lexsort((-level, own))
            own, level = own[order], level[order]
            strong = np.arange(len(own)) - np.searchsorted(own, own) < STRONGEST
            toxicity[row:last] = np.bincount(own[strong], level[strong], minlength=last - row)
        return [sizes, weights, toxicity]


def gumbel(seed: Column) -> Column:
    """Standard Gumbel noise that depends on ``seed`` (a hash) alone."""
    uniform = (F.shiftrightunsigned(seed, 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(values: DataFrame, k: int, bins: int = 4096) -> float:
    """The ``k``-th largest (from 1) of the doubles in the only column of a written table, exactly.

    A histogram of equal ranges tells in which range it lies; that range is divided
    again until it holds one value. The driver gets ``bins`` rows each time.
    """
    v = F.col(values.columns[0])
    while True:
        low, high = values.agg(F.min(v), F.max(v)).first()
        width = (high - low) / bins
        if low == high or low + width == low:
            break
        place = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        for at, n in sorted(map(tuple, values.groupBy(place).count().collect()), reverse=True):
            if k <= n:
                break
            k -= n
        values = values.where(place == at)
    if low == high:
        return low
    # The range is as narrow as doubles are: few different values are left.
    for value, n in sorted(map(tuple, values.groupBy(v).count().collect()), reverse=True):
        if k <= n:
            return value
        k -= n


def threshold(bad: np.ndarray, level: np.ndarray) -> float | None:
    """The level above which ``bad`` ones are best told from others, few of which may be above it; None without both kinds."""
    good, worse = np.sort(level[~bad]), np.sort(level[bad])
    if not len(good) or not len(worse):
        return None
    cuts = np.unique(level)
    lost = 1 - np.searchsorted(good, cuts, "right") / len(good)
    caught = 1 - np.searchsorted(worse, cuts, "right") / len(worse)
    best = int(np.where(lost <= CLEAN_LOST, caught - lost, -1).argmax())
    return float(cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2


def resample(df: DataFrame, labels: DataFrame, share: float | None = None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The judgement of every row of ``df``: ``id``, ``content`` (a hash of the text),
    ``n_grams``, ``log_weight``, ``gumbel_key``, ``toxic`` and ``keep``.

    ``labels`` has ``doc_id``, ``quality`` (1: good) and ``toxic`` (1: toxic); an id with several
    labels takes the worst. At most ``LABELLED_ROWS`` labelled ids are learned from, those with
    the smallest hashes; counts of the raw corpus cover all rows. ``keep`` is true for the k
    rows with the largest Gumbel keys, ties to smaller ids (null: the largest), if they are not
    toxic. k is ``share`` of the rows with words; by default it is how many rows there are
    like the target: as many as have a weight on the good side of the value that best
    separates the weights of good and bad labels. No weight holds the document's own counts. Toxicity is learned from one half of at
    most ``TOXIC_ROWS`` labelled ids, the other half sets its threshold. Either threshold may
    leave ``CLEAN_LOST`` of the good or clean ones on the wrong side.

    Null, empty and wordless texts carry no evidence and are kept. So are all rows where,
    without ``share``, nothing is labelled good, or all is; nothing is toxic without both kinds of that
    label. Repeated rows are judged alike. An empty table stays empty. Further columns
    of ``df`` are left out, whatever they are called.
    """
    found = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"), F.max(F.col("toxic") != 0).alias("bad"))
    few = found.orderBy(F.xxhash64("label_id"), "label_id").limit(LABELLED_ROWS)
    few = bounded(few.withColumn("bad", F.when(F.row_number().over(Window.orderBy(F.xxhash64("label_id"), "label_id")) <= TOXIC_ROWS, F.col("bad"))))
    docs = df.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{text}`").alias("text"))
    learned = F.xxhash64(F.lit(9), F.col("id")) >= 0
    known = docs.join(few, F.col("id") == F.col("label_id"), "left").withColumns({"good": F.coalesce(F.col("quality") == 1, F.lit(False)), "bad": F.when(learned, F.col("bad"))})
    model = Model(known.select("text", "good", "bad"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            good = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            columns = [batch.column(0), batch.column(1), *map(pa.array, model.scored(batch.column(2), good))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "content", "n_grams", "log_weight", "toxicity"])

    kind = dict(docs.dtypes)["id"]
    rows = known.select("id", F.xxhash64("text").alias("content"), "text", "good").mapInArrow(scored, f"id {kind}, content long, n_grams long, log_weight double, toxicity double")
    rows = materialize(rows.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.xxhash64(F.lit(8), "id", "content"))))
    # One row for each labelled id, so their number is bounded.
    own = rows.where("n_grams > 0").groupBy("id").agg(F.min("log_weight").alias("weight"), F.max("toxicity").alias("toxicity"))
    judged = own.join(few, F.col("id") == F.col("label_id")).select("weight", "toxicity", "quality", "bad", (~learned).alias("held")).toPandas()
    held, rated = judged[judged["held"] & judged["bad"].notna()], judged[judged["quality"].notna()]
    most = threshold(held["bad"].to_numpy(bool), held["toxicity"].to_numpy())
    toxic = F.lit(False) if most is None else F.col("toxicity") > most
    some = rows.where("n_grams > 0")
    n = k = some.count()
    if share is not None:
        k = round(n * share)
    elif (least := threshold((rated["quality"] != 1).to_numpy(bool), -rated["weight"].to_numpy())) is not None:
        k = some.where(F.col("log_weight") >= -least).count()
    keep = F.lit(True)
    if n and k < n:
        keep = F.lit(False)
        if k:
            least = kth_largest(some.select("gumbel_key"), k)
            above = some.where(F.col("gumbel_key") > least).count()
            # Noise depends on the id and the text, so the ids that tie are few.
            tied = some.where(F.col("gumbel_key") == least).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
            before = F.coalesce(F.sum("n").over(Window.orderBy(F.asc_nulls_last("id")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            gone = tied.withColumn("before", before).where(F.col("before") >= k - above).select(F.col("id").alias("late"))
            late = gone.orderBy(F.asc_nulls_last("late")).limit(1).collect()
            keep = F.col("gumbel_key") >= least
            if late:
                early = F.col("id").isNotNull() if late[0][0] is None else F.coalesce(F.col("id") < F.lit(late[0][0]), F.lit(False))
                keep = (F.col("gumbel_key") > least) | ((F.col("gumbel_key") == least) & early)
    keep = (keep | (F.col("n_grams") == 0)) & ~F.col("toxic")
    return rows.withColumn("toxic", toxic).select("id", "content", "n_grams", "log_weight", "gumbel_key", "toxic", keep.alias("keep"))


def keep_selected(df: DataFrame, labels: DataFrame, share: float | None = None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``resample`` keeps, with all their columns."""
    judged = resample(df, labels, share, id_, text)
    gone = bounded(judged.where("not keep").select(F.col("id").alias("gone_id"), F.col("content").alias("gone_content")).distinct())
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("content"))
    left = own.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("content") == F.col("gone_content")), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """The importance weight, key and fate of every document; toxic ones are not kept."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    judged = resample(docs, labels)
    return judged.select(F.col("id").alias("doc_id"), "n_grams", F.round("log_weight", 6).alias("log_weight"), F.round("gumbel_key", 6).alias("gumbel_key"), "toxic", "keep")
