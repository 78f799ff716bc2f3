"""Toxicity of texts whose words may be disguised, by a noisy channel.

What a writer meant is found by decoding: every stretch that may be disguised becomes a lattice
in which a look-alike sign may stand for letters, a separator for nothing and a run of one
letter for fewer of them, at a cost each. Viterbi's algorithm finds the path that is most likely
under a model of sequences of four characters, counted over all texts, and that cost.
Restored texts are then scored by the words and beginnings of words that toxic ones share.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, enter, materialize, table, worker_cache
from .decontaminate import bounded
from .quality import blocks, buckets, words_and_beginnings
from .tokens import Memo

#: Look-alike signs and the letters that they may stand for. Fixed values, as commonly used.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou",
}
#: What may stand between the letters of one word, blanks apart.
SEPARATORS = "-._~^'`·•/\\,:;=*#|+\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: What the channel's changes cost, in nats: a look-alike, a separator, one letter doubled, or said more than twice;
#: and what a sign that looks like a letter costs as itself.
LOOKALIKE, SPACING, DOUBLED, REPEATED, ODD = 2.5, 1.0, 5.5, 1.0, 2.5

#: Symbols of the model: no letter or digit, a to z, any other letter, a digit, the edge of a text.
BITS = 5
NONE, OTHER, DIGIT, SIGN, EDGE = 0, 27, 28, 29, 31
ORDER = 4
CELLS = 1 << (BITS * ORDER)
CONTEXT = (1 << (BITS * (ORDER - 1))) - 1
LAST = (1 << BITS) - 1
#: A context counts as if seen so many times more, as the shorter context has it.
PRIOR = 4.0
#: Characters that are counted in one go.
CHUNK = 1 << 20

#: Labelled ids that are learned from, at most: those with the smallest hashes.
LABELLED_ROWS = 50_000
TOXIC_BITS = 22
#: A word counts as evidence from so many toxic documents on, and so many of a text's strongest words count.
TOXIC_LEAST, STRONGEST = 3, 3
#: From this score on a text is called toxic.
CUT = 0.3
#: What a Python worker remembers: words restored, and runs of one character.
WORDS_KEPT, RUNS_KEPT = 300_000, 20_000


def symbol(character: str) -> int:
    base = unicodedata.normalize("NFD", character.lower())[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    return EDGE if base == "\0" else OTHER if base.isalpha() else DIGIT if base.isdigit() else NONE


def _kind(point: int) -> int:
    character = chr(point)
    found = symbol(character)
    return SIGN if found == NONE and not character.isspace() else found


#: The symbols of Latin characters; signs have one of their own here.
LATIN = np.array([_kind(i) for i in range(0x250)], np.int64)


def symbols(text: str) -> np.ndarray:
    """The symbol of each character, ``EDGE`` for what may be a disguise: digits beside letters, and signs between them."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = LATIN[np.minimum(points, len(LATIN) - 1)]
    beyond = points >= len(LATIN)
    if beyond.any():
        some, at = np.unique(points[beyond], return_inverse=True)
        out[beyond] = np.array([_kind(p) for p in some])[at]
    # The last and the next place that is no sign.
    places, sign = np.arange(len(out)), out == SIGN
    last = np.maximum.accumulate(np.where(sign, 0, places))
    following = np.minimum.accumulate(np.where(sign, len(out) - 1, places)[::-1])[::-1]
    letter = (out > NONE) & (out <= OTHER)
    between = sign & letter[last] & letter[following]
    near = np.zeros(len(out), bool)
    near[1:] |= letter[:-1]
    near[:-1] |= letter[1:]
    out[sign] = NONE
    out[between | ((out == DIGIT) & near)] = EDGE
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, n): how often four symbols follow each other in texts, runs of signs and blanks being one; nothing that may be a disguise counts."""
    sums, carry = np.zeros(CELLS, np.int64), np.zeros(0, np.int64)

    def add(text: str) -> None:
        nonlocal carry
        found = np.concatenate([carry, symbols(text)])
        keep = found != NONE
        keep[1:] |= found[:-1] != NONE
        keep[:1] = True
        found = found[keep]
        carry = found[1 - ORDER :]
        cells, edge = np.zeros(max(len(found) - ORDER + 1, 0), np.int64), np.zeros(max(len(found) - ORDER + 1, 0), bool)
        for k in range(ORDER):
            part = found[k : k + len(cells)]
            cells = (cells << BITS) | part
            edge |= part == EDGE
        nonlocal sums
        sums += np.bincount(cells[~edge], minlength=CELLS)

    # Before and after each text an edge stands.
    held, size = [" \0 "], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            # A long text is taken in slices; what one slice ends with precedes the next.
            for at in range(0, len(text or ""), CHUNK):
                held.append(text[at : at + CHUNK])
                size += len(held[-1])
                if size >= CHUNK:
                    add("".join(held))
                    held, size = [], 0
            held.append(" \0 ")
    add("".join(held))
    found = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["cell", "n"])


def character_model(texts: DataFrame) -> array:
    """Log probability of each symbol after each three, from the only column of ``texts``.

    A task sends a sum for each sequence that it has met; the driver gets at most 2**20 rows.
    """
    counted = texts.mapInArrow(_counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS)
    counts[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    size = 1 << BITS
    likely = np.full(size, 1 / size)
    for order in range(1, ORDER + 1):
        # Sequences of the last ``order`` symbols, by context and symbol.
        seen = counts.reshape(-1, size**order).sum(0).reshape(-1, size)
        shorter = likely.reshape(-1, size) if order > 1 else likely.reshape(1, size)
        shorter = np.tile(shorter, (len(seen) // len(shorter), 1))
        likely = (seen + PRIOR * shorter) / (seen.sum(1, keepdims=True) + PRIOR)
    return array("f", np.log(likely).ravel().astype(np.float32).tobytes())


Unit = list[tuple[str, tuple[int, ...], float]]
_LETTER = re.compile(r"[A-Za-z]")
_LOOKALIKE = re.compile(f"[{re.escape(''.join(LOOKALIKES))}]")
_RUN = re.compile(r"([^\W\d_])\1", re.IGNORECASE)
_SPLIT = re.compile(rf"[^\W_][{re.escape(SEPARATORS)}]+[^\W_]")
_WHITE = re.compile(r"(\s+)")
#: At least three single characters with blanks between them.
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t ]+){2,}\S(?!\S)")
_ODD_WHITE = re.compile(r"[^\S \t\n\x0b\x0c\r]")
_RUNS = re.compile(r"(.)\1*", re.IGNORECASE | re.DOTALL)
#: What stands before and after words without being part of them.
_AROUND = ".,;:?!\"'()[]{}<>…»«“”„"


class Channel:
    """Restores disguised words under a character model."""

    def __init__(self, model: array):
        self.model = model
        self.words = Memo(self.restored_word, WORDS_KEPT)
        self.runs = Memo(self.meanings, RUNS_KEPT)
        self.signs = Memo(symbol, RUNS_KEPT)

    def meanings(self, run: str) -> Unit:
        """What a run of one character may stand for: what is written then, its symbols, and the cost."""
        sign, size = run[0].lower(), len(run)
        own = symbol(sign)
        unit = [(run, (own,) * size if own != NONE else (NONE,), ODD if own == NONE and sign in LOOKALIKES else 0.0)]
        if 1 <= own <= 26 and size > 1:
            unit.append((run[:1], (own,), DOUBLED if size == 2 else REPEATED))
            if size > 2:
                unit.append((run[:2], (own, own), REPEATED))
        for letter in LOOKALIKES.get(sign, ""):
            for times in range(1, min(size, 2) + 1):
                unit.append((letter * times, (symbol(letter),) * times, LOOKALIKE + (REPEATED if size > times else 0.0)))
        if own == NONE and (sign.isspace() or sign in SEPARATORS):
            unit.append(("", (), SPACING))
        return unit

    def decode(self, text: str) -> str:
        """The most likely reading of ``text``, exactly; of equally likely ones, that which changes least at the end."""
        model, states = self.model, {0: (0.0, None)}
        for run in _RUNS.finditer(text):
            unit = self.runs[run[0]]
            after: dict[int, tuple] = {}
            for context, (score, before) in states.items():
                for written, meant, cost in unit:
                    level, at = score - cost, context
                    for s in meant:
                        if s or at & LAST:
                            at = (at << BITS) | s
                            level += model[at]
                            at &= CONTEXT
                    if at not in after or level > after[at][0]:
                        after[at] = (level, (before, written))
            states = after
        best = max(states, key=lambda c: states[c][0] + (model[c << BITS] if c & LAST else 0.0))
        parts, path = [], states[best][1]
        while path:
            path, written = path
            parts.append(written)
        return "".join(reversed(parts))

    def doubled_only(self, word: str) -> bool:
        """Whether ``word``, in which only doubled letters are suspicious, is surely meant as it is.

        Doubles that stand four symbols apart change no common terms of the model, so each is judged by
        what the path without its second letter would gain; closer ones are left to ``decode``.
        """
        model, last = self.model, -ORDER
        own = [NONE] * (ORDER - 1) + [self.signs[c] for c in word] + [NONE]
        if NONE in own[ORDER - 1 : -1]:
            return False
        for i in range(ORDER, len(own) - 1):
            if own[i] != own[i - 1] or not NONE < own[i] < OTHER:
                continue
            if i - last < ORDER or own[i + 1] == own[i]:
                return False
            last, gain = i, -DOUBLED
            before = (own[i - 3] << (2 * BITS)) | (own[i - 2] << BITS) | own[i - 1]
            at = before
            for s in own[i : i + ORDER]:
                at = ((at & CONTEXT) << BITS) | s
                gain -= model[at]
            at = before
            for s in own[i + 1 : i + ORDER]:
                at = ((at & CONTEXT) << BITS) | s
                gain += model[at]
            if gain > 0:
                return False
        return True

    def restored_word(self, word: str) -> str:
        """``word``, a text without blanks, with disguises undone; other white space may be in it."""
        if not _LETTER.search(word):
            return word
        if _WHITE.search(word):
            return "".join(self.restored_word(part) for part in _WHITE.split(word))
        core = word.strip(_AROUND)
        if not _LETTER.search(core):
            return word
        if not (_LOOKALIKE.search(core) or _SPLIT.search(core)) and (not _RUN.search(core) or self.doubled_only(core)):
            return word
        at = word.index(core)
        return word[:at] + self.decode(core) + word[at + len(core) :]

    def spaced(self, found: re.Match) -> str:
        return self.decode(found[0]) if _LETTER.search(found[0]) else found[0]

    def restored(self, text: str | None) -> str:
        """The whole text as it was meant; null: empty."""
        return self.whole(composed(text))

    def whole(self, text: str) -> str:
        return " ".join(map(self.words.__getitem__, _SPACED.sub(self.spaced, text).split(" ")))

    def restored_all(self, texts: list[str | None]) -> list[str]:
        """``restored`` of each text; only words that may be suspicious are looked at one by one."""
        texts = [composed(t) for t in texts]
        raw = "\n".join([*texts, ""]).encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        begin, end, suspicious, spaced = suspects(data)
        bounds = np.cumsum([0, *(len(t) + 1 if t.isascii() else len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts)])
        out = list(texts)
        slow = {i for i, t in enumerate(texts) if _ODD_WHITE.search(t)} | set((np.searchsorted(bounds, begin[spaced], "right") - 1).tolist())
        for i in slow:
            out[i] = self.whole(texts[i])
        changes: dict[int, list[tuple[int, int, bytes]]] = {}
        own = np.searchsorted(bounds, begin[suspicious], "right") - 1
        for i, lo, hi in zip(own.tolist(), begin[suspicious].tolist(), end[suspicious].tolist()):
            word = raw[lo:hi].decode("utf-8", "surrogatepass")
            meant = self.words[word]
            if meant != word:
                changes.setdefault(i, []).append((lo, hi, meant.encode("utf-8", "surrogatepass")))
        for i, found in changes.items():
            if i not in slow:
                parts, at = [], int(bounds[i])
                for lo, hi, meant in found:
                    parts += [raw[at:lo], meant]
                    at = hi
                out[i] = b"".join([*parts, raw[at : int(bounds[i + 1]) - 1]]).decode("utf-8", "surrogatepass")
        return out


def composed(text: str | None) -> str:
    """``text`` with wide letters as usual ones and marks on their letters; null: empty."""
    return text or "" if not text or text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


_AROUND_BYTES = np.isin(np.arange(256), np.frombuffer(_AROUND.encode("ascii", "ignore"), np.uint8))


def suspects(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where words (runs of bytes but ASCII white space) begin and end, which of them may hold a
    disguise, and which are the third single character in a row, with only blanks between.

    Digits, signs other than punctuation around words, doubled letters and what bytes don't tell are suspicious.
    ``data`` ends with white space.
    """
    white = (data == 32) | ((data >= 9) & (data <= 13))
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    plain = (low >= 97) & (low <= 122)
    high = data >= 128
    sign = ~(white | plain | high)
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    flag = sign & (~_AROUND_BYTES[data] | ~(before | after))
    flag[1:] |= plain[1:] & (low[1:] == low[:-1])
    flag |= (data == 0xC2) | (data >= 0xE0)
    flag[1:] |= (data[1:] >= 0xC0) & high[:-1]
    begin, end = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
    if not len(begin):
        none = np.zeros(0, bool)
        return begin, end, none, none
    suspicious = np.add.reduceat(flag, begin, dtype=np.int64) > 0
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    lines = np.concatenate([[0], np.cumsum(white & (data != 32) & (data != 9))])
    single = characters[end] - characters[begin] == 1
    joined = np.zeros(len(begin), bool)
    joined[1:] = single[1:] & single[:-1] & (lines[begin[1:]] == lines[end[:-1]])
    third = np.zeros(len(begin), bool)
    third[2:] = joined[2:] & joined[1:-1]
    return begin, end, suspicious, third


_channels: dict[int, Channel] = {}
worker_cache("toxicity", _channels.clear)


def channel(model: array) -> Channel:
    """One channel for each model in a Python worker."""
    key = hash(model.tobytes())
    if key not in _channels:
        _channels.clear()
        _channels[key] = Channel(model)
    return _channels[key]


def portions(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts in lists of about ``CHUNK`` bytes, or of one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + CHUNK, "right")))
        yield column.slice(row, last - row).to_pylist()
        row = last


def restore_texts(df: DataFrame, text: str = "text", name: str = "restored", model: array | None = None) -> DataFrame:
    """``df`` with ``name``: the text as it was meant (null and empty: empty). Without ``model`` one is counted over all of ``df``."""
    model = model or character_model(df.select(text))

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        enter("toxicity")
        out = []
        for some in portions(texts):
            out += channel(model).restored_all(some)
        return pa.array(out, pa.string())

    return df.withColumn(name, run(F.col(f"`{text}`")))


CLEAN, TOXIC = 0, 1


def _words(column: pa.Array, model: array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of texts, first and last row, the buckets of the words and beginnings of words of restored texts, and the row in the block."""
    row = 0
    for some in portions(column):
        texts = pa.array(channel(model).restored_all(some), pa.string())
        for first, last, data, bounds in blocks(texts):
            hashes, own = words_and_beginnings(data, bounds)
            yield row + first, row + last, buckets(hashes, TOXIC_BITS), own
        row += len(some)


class Evidence:
    """How much more often toxic documents have a word (bucket) than clean ones, as a log ratio less one standard error; only what speaks for toxicity."""

    def __init__(self, counts: np.ndarray, clean: int, toxic: int):
        """``counts``: rows of bucket, clean documents, toxic documents."""
        some = counts[counts[:, 2] >= TOXIC_LEAST]
        c, t = some[:, 1] + 0.5, some[:, 2] + 0.5
        level = np.log(t / (toxic + 1)) - np.log(c / (clean + 1)) - np.sqrt(1 / t + 1 / c)
        self.buckets, self.levels = some[level > 0, 0].astype(np.int64), level[level > 0].astype(np.float32)
        order = np.argsort(self.buckets)
        self.buckets, self.levels = self.buckets[order], self.levels[order]

    def strongest(self, found: np.ndarray, own: np.ndarray, rows: int) -> np.ndarray:
        """The ``STRONGEST`` largest levels of each row's different words, largest first, 0 where there are fewer."""
        out = np.zeros((rows, STRONGEST), np.float32)
        if not len(self.buckets) or not len(found):
            return out
        at = np.minimum(np.searchsorted(self.buckets, found), len(self.buckets) - 1)
        hit = self.buckets[at] == found
        each = np.unique(own[hit] * len(self.buckets) + at[hit])
        own, level = each // len(self.buckets), self.levels[each % len(self.buckets)]
        order = np.lexsort((-level, own))
        own, level = own[order], level[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        out[own[rank < STRONGEST], rank[rank < STRONGEST]] = level[rank < STRONGEST]
        return out


def evidence(learned: DataFrame, model: array) -> list[Evidence]:
    """Of the documents ``learned`` (text, fold 0 or 1, toxic), without fold 0, without fold 1, and of all.

    A word or beginning of a word counts once for each document. Tasks send a sum for each
    word they met and only what several toxic documents share reaches the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        sums, documents = np.zeros((4, 1 << TOXIC_BITS), np.int32), np.zeros(4, np.int64)
        for batch in batches:
            kinds = batch.column(1).to_numpy() * 2 + batch.column(2).to_numpy()
            documents += np.bincount(kinds, minlength=4)
            for row, last, found, own in _words(batch.column(0), model):
                each = np.unique((own << TOXIC_BITS) | found)
                kind = kinds[row:last][each >> TOXIC_BITS]
                for k in range(4):
                    np.add.at(sums[k], each[kind == k] & ((1 << TOXIC_BITS) - 1), 1)
        at = np.flatnonzero(sums.any(0))
        columns = [np.r_[-1, at], *[np.r_[documents[k], sums[k, at]].astype(np.int64) for k in range(4)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "c0", "t0", "c1", "t1"])

    rows = learned.mapInArrow(counted, "bucket long, c0 long, t0 long, c1 long, t1 long")
    counts = materialize(rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")]))
    shared = counts.where((F.col("t0") + F.col("t1") >= TOXIC_LEAST) & (F.col("bucket") >= 0)).toArrow()
    few = np.column_stack([c.to_numpy().astype(float) for c in shared.columns])
    totals = counts.where("bucket < 0").first()
    discard(counts.written_path)
    totals = np.array(totals[1:] if totals else [0] * 4)
    part = lambda c, t: np.column_stack([few[:, 0], few[:, c].sum(1), few[:, t].sum(1)])
    pick = [([3], [4]), ([1], [2]), ([1, 3], [2, 4])]
    return [Evidence(part(c, t), totals[np.array(c) - 1].sum(), totals[np.array(t) - 1].sum()) for c, t in pick]


def logistic(levels: np.ndarray, toxic: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the constant first, by Newton's method with a small penalty."""
    x = np.column_stack([np.ones(len(levels)), levels]).astype(float)
    weights, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 1e-2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (toxic - p) - penalty @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def detect_toxic(df: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``score`` (0 to 1) and the ``levels`` of its strongest evidence for every row of ``df``.

    ``labels``: ``doc_id`` and ``toxic`` (1: toxic; null: not labelled); an id with several takes the
    worst, and a null id none. The character model counts all texts. Words are learned from the
    ``LABELLED_ROWS`` labelled ids with the smallest hashes, in two folds by id: a document of one
    is judged by the words of the other, so that no label speaks for itself, and the weights of
    the score are fitted to these judgements. All others are judged by the words of both.

    Texts are judged whole. Null, empty and wordless texts have no evidence and the score of such documents.
    Where labels are all alike or none, every score is their share of toxic ones (none: 0).
    Repeated rows are judged alike; an empty table stays empty; further columns are left out.
    """
    rows = df.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{text}`").alias("text"))
    model = character_model(rows.select("text"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("label"))
    few = bounded(known.orderBy(F.xxhash64("label_id"), "label_id").limit(LABELLED_ROWS))
    fold = F.pmod(F.xxhash64(F.lit(11), "label_id"), F.lit(2)).cast("int")
    rows = rows.join(few.select("label_id", "label", fold.alias("fold")), F.col("id") == F.col("label_id"), "left")
    sources = evidence(rows.where("label is not null").select("text", "fold", "label"), model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for batch in batches:
            which = batch.column(2).fill_null(2).to_numpy()
            levels = np.zeros((len(which), STRONGEST), np.float32)
            for row, last, found, own in _words(batch.column(3), model):
                for k, source in enumerate(sources):
                    some = which[row:last] == k
                    if some.any():
                        mine = some[own]
                        levels[row:last] += source.strongest(found[mine], own[mine], last - row)
            shown = pa.ListArray.from_arrays(pa.array(np.arange(0, levels.size + 1, STRONGEST, dtype=np.int32)), pa.array(levels.ravel().astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), shown], names=["id", "label", "levels"])

    kind = dict(rows.dtypes)["id"]
    out = materialize(rows.select("id", "label", "fold", "text").mapInArrow(judged, f"id {kind}, label int, levels array<double>"))
    # One row for each labelled id, so their number is bounded.
    fit = out.where("label is not null").groupBy("id").agg(F.max("label").alias("label"), F.max("levels").alias("levels")).toPandas()
    toxic = fit["label"].to_numpy(float)
    if 0 < toxic.sum() < len(toxic):
        first, *weights = logistic(np.array(fit["levels"].tolist()), toxic)
        total = F.lit(float(first))
        for k, weight in enumerate(weights):
            total += F.get("levels", F.lit(k)) * float(weight)
        score = 1 / (1 + F.exp(-total))
    else:
        score = F.lit(float(toxic.mean()) if len(toxic) else 0.0)
    return out.select("id", score.alias("score"), "levels")


def held_out(id_: Column) -> Column:
    """Whether labels of this id are kept from learning: the CRC-32 of its decimal digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = detect_toxic(docs, labels.where(~held_out(F.col("doc_id"))))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
