"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (a blended spectrum of
n = 1, 2, 3) that both contain, divided by the root of the product of their own
numbers. A Nystrom map on landmark texts approximates it, and ridge regression in
that space fits one score for each language. As the kernel is linear in n-gram
presence, landmarks, map and weights fold into one matrix, with a row for every n-gram
of the landmarks: no other n-gram can be shared with one. A batch of texts is scored
by one product of its sparse presence matrix with it; each text's own number counts all its n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, table

SIZES = (1, 2, 3)
#: About so many labelled rows are fitted, dealt evenly to the languages, but at least so many of each.
FIT_ROWS, LEAST_ROWS = 2_000, 20
#: So many of them are landmarks, dealt evenly as well, but at least so many of each language.
LANDMARKS, LEAST_LANDMARKS = 300, 5
RIDGE = 1e-3
#: Texts of more bytes are not learned from, where a language has others.
LONGEST = 16 * 1024
#: Texts of a batch, n-grams that are looked up at once, and characters of a text that are taken at once.
BATCH, HITS, PIECE = 128, 200_000, 1 << 20
UNKNOWN = "und"


def _codes(points: np.ndarray) -> np.ndarray:
    codes, out = points, []
    for n in SIZES:
        if n > 1:
            codes = (codes[:-1] << 21) | points[n - 1 :]
        if not len(codes):
            break
        # Codes of different n differ but for 3-grams of an unassigned character and NULs.
        out.append(codes + (n << 61) if n < 3 else codes)
    codes = np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)
    return codes[np.r_[True, codes[1:] != codes[:-1]]] if len(codes) else codes


def gram_codes(text: str) -> np.ndarray:
    """Distinct codes of the n-grams of ``text`` in lower case, sorted; 21 bits a character.

    A long text is taken in pieces that overlap, so memory follows its different n-grams.
    """
    low, found = text.lower(), None
    for at in range(0, max(len(low), 1), PIECE):
        piece = low[at : at + PIECE + SIZES[-1] - 1]
        codes = _codes(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
        found = codes if found is None else np.union1d(found, codes)
    return found


def hits(codes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of the sorted ``codes`` a text has that has ``own``: the columns of its row of the presence matrix."""
    if not len(own) or not len(codes):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    return at[codes[at] == own]


def product(rows: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """The presence matrix, given by the columns of each row, times ``matrix``: in batches of rows with about ``HITS`` ones."""
    out, start = np.zeros((len(rows), matrix.shape[1])), 0
    while start < len(rows):
        stop, n = start + 1, len(rows[start])
        while stop < len(rows) and n + len(rows[stop]) <= HITS:
            n += len(rows[stop])
            stop += 1
        if n > HITS:
            for at in range(0, n, HITS):
                out[start] += matrix[rows[start][at : at + HITS]].sum(0, dtype=float)
        elif n:
            sizes = np.array([len(r) for r in rows[start:stop]])
            full = np.flatnonzero(sizes)
            out[start + full] = np.add.reduceat(matrix[np.concatenate(rows[start:stop])], (np.cumsum(sizes) - sizes)[full], axis=0, dtype=float)
        start = stop
    return out


def per_root(n: np.ndarray | list[int]) -> np.ndarray:
    """One by the root of the number of a text's n-grams; 0 for none."""
    return np.array([1 / np.sqrt(x) if x else 0.0 for x in n])


@dataclass
class Model:
    """``weights``: a row for each code of ``codes`` (sorted), a column for each language."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Ridge scores of each text for each language."""
        blocks = []
        for i in range(0, len(texts), BATCH):
            sizes, rows = [], []
            for text in texts[i : i + BATCH]:
                own = gram_codes(text)
                sizes.append(len(own))
                rows.append(hits(self.codes, own))
            blocks.append(product(rows, self.weights) * per_root(sizes)[:, None])
        return np.concatenate(blocks) if blocks else np.empty((0, len(self.languages)))


def fit(texts: list[str], languages: list[str]) -> Model | None:
    """Kernel ridge regression on landmarks; None if no text has an n-gram.

    The presence of n-grams in landmarks is kept as a list of landmarks for each n-gram, so
    memory follows the landmarks' n-grams and not their product with the landmarks.
    """
    names = sorted(set(languages))
    grams = [gram_codes(t) for t in texts]
    share = max(LEAST_LANDMARKS, -(-LANDMARKS // max(1, len(names))))
    places = [i for name in names for i in [j for j, x in enumerate(languages) if x == name and len(grams[j])][:share]]
    if not places:
        return None
    every = np.concatenate([grams[i] for i in places])
    order = np.argsort(every, kind="stable")
    owners = np.repeat(np.arange(len(places)), [len(grams[i]) for i in places])[order]
    codes, first = np.unique(every[order], return_index=True)
    lists = np.append(first, len(every))

    def shared(own: np.ndarray) -> np.ndarray:
        """How many n-grams each landmark has in common with a text."""
        at = hits(codes, own)
        sizes = lists[at + 1] - lists[at]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.bincount(owners[np.repeat(lists[at], sizes) + within], minlength=len(places))

    roots = per_root([len(grams[i]) for i in places])
    kernel = np.array([shared(g) for g in grams]) * per_root([len(g) for g in grams])[:, None] * roots
    values, vectors = np.linalg.eigh(kernel[places])
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ whiten
    targets = np.array([[float(x == name) for name in names] for x in languages])
    # Every language weighs the same, however many rows it has.
    weight = 1 / np.array([languages.count(x) for x in languages], float)[:, None]
    weight *= len(languages) / weight.sum()
    gram = features.T @ (features * weight) + RIDGE * len(texts) * np.eye(features.shape[1])
    ridge = np.linalg.solve(gram, features.T @ (targets * weight))
    of_landmarks = ((whiten @ ridge) * roots[:, None]).astype(np.float32)
    weights = np.empty((len(codes), len(names)), np.float32)
    for at in range(0, len(codes), HITS):
        last = min(at + HITS, len(codes))
        weights[at:last] = np.add.reduceat(of_landmarks[owners[lists[at] : lists[last]]], lists[at:last] - lists[at], axis=0)
    return Model(names, codes, weights)


def labelled_sample(df: DataFrame, text: str, language: str, key: Column, rows: int = FIT_ROWS) -> tuple[list[str], list[str]]:
    """About ``rows`` whole labelled texts, as many of each language, those with the smallest ``key`` (a 64-bit hash).

    Texts of more than ``LONGEST`` bytes are not learned from, but for a few of a language that has no
    others. Languages are counted first, so that only the part of the keys' range that should
    hold a few more than wanted is sorted and sent to the driver.
    """
    usable = df.select(F.col(f"`{text}`").alias("t"), F.col(f"`{language}`").alias("l"), F.shiftrightunsigned(key, 1).alias("k")).where("t is not null and l is not null")
    usable = usable.withColumn("short", F.octet_length("t") <= LONGEST)
    counts = {r.l: (r.n, r.short) for r in usable.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("short")).collect()}
    share = max(LEAST_ROWS, -(-rows // max(1, len(counts))))
    some, most = F.lit(False), F.lit(share)
    for name, (n, short) in counts.items():
        wanted, there = (share, short) if short else (LEAST_LANDMARKS, n)
        below = min(2**63 - 1, int(1.2 * max(wanted, LEAST_ROWS) / there * 2**63))
        some |= (F.col("l") == name) & (F.col("k") <= below) & (F.col("short") if short else F.lit(True))
        most = most if short else F.when(F.col("l") == name, LEAST_LANDMARKS).otherwise(most)
    nth = F.row_number().over(Window.partitionBy("l").orderBy("k", F.xxhash64("t"), "t"))
    got = usable.where(some).withColumn("n", nth).where(F.col("n") <= most).orderBy("k", "l", F.xxhash64("t")).collect()
    return [r.t for r in got], [r.l for r in got]


def predict(text: Column, model: Model | None) -> Column:
    """Struct of ``lang_pred`` and ``score`` (0 to 1) for each whole text.

    ``und`` with score 0 for null texts, texts without a letter, and without a model.
    """

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        told, sure = [UNKNOWN] * len(values), [0.0] * len(values)
        usable = [i for i, t in enumerate(values) if model and t and any(map(str.isalpha, t))]
        if usable:
            scores = model.scores([values[i] for i in usable])
            best = scores.argmax(axis=1)
            for i, b, row in zip(usable, best, scores):
                told[i], sure[i] = model.languages[b], float(min(max(row[b], 0.0), 1.0))
        return pa.StructArray.from_arrays([pa.array(told, pa.string()), pa.array(sure, pa.float64())], ["lang_pred", "score"])

    return run(text)


def identify(df: DataFrame, train: DataFrame, key: Column, text: str = "text", language: str = "lang") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``df``, by a model fitted on ``train``.

    The model learns from about ``FIT_ROWS`` labelled rows of ``train``, chosen by ``key`` and
    dealt evenly to the languages, none longer than ``LONGEST`` bytes where a language has others; every row of ``df`` is predicted from the whole of its
    text alone. Equal texts get equal predictions; a tie goes to the language that sorts
    first. Null texts, texts without a letter, and all texts if nothing or only empty texts
    can be learned from, are ``und`` with score 0. Columns of the two added names are
    replaced; all others stay, whatever they are called.
    """
    model = fit(*labelled_sample(train, text, language, key))
    (told,) = fresh(df, "language_told")
    predicted = df.withColumn(told, predict(F.col(f"`{text}`"), model))
    return predicted.withColumns({"lang_pred": F.col(f"{told}.lang_pred"), "score": F.col(f"{told}.score")}).drop(told)


def op6_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document; one in five, by its id, is never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    learned = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return identify(docs.select("doc_id", "text", held.alias("held_out")), learned, F.xxhash64("doc_id")).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
