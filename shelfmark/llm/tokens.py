"""Token counts by byte-pair merging, without token ids.

Symbols of a text stand in a linked list; a heap holds the adjacent pairs that are
pieces, lowest rank (highest score) first, ties to the left. Popping and merging
until none is left gives the library's segmentation, so the count is the number
of initial symbols less the number of merges.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enter, table, worker_cache

SPACE = "▁"
WORDS_KEPT = 400_000
PARTS_KEPT = 300_000
LONGEST_KEPT = 64


class Memo(dict):
    """A dict that computes what is missing and holds at most ``2 * most`` entries.

    When ``most`` are new, the ones before them go; entries in use come back first.
    """

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceCounter:
    """Counts a byte-pair sentencepiece model's tokens of a text.

    Supports models with the identity normaliser, a dummy prefix and byte fallback.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal, trainer = model.normalizer_spec, model.trainer_spec
        plain = not normal.precompiled_charsmap and normal.add_dummy_prefix and not normal.remove_extra_whitespaces and normal.escape_whitespaces
        types = {p.type for p in model.pieces}
        if trainer.model_type != 2 or not trainer.byte_fallback or not plain or types - {1, 2, 3, 6}:
            raise ValueError(f"{path}: not a byte-pair model with identity normaliser, dummy prefix and byte fallback")
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
        #: Characters that stand side by side in some piece; no merge crosses any other two.
        self.beside = {a + b for p in self.rank for a, b in zip(p, p[1:])}
        self.words = Memo(lambda word: self.segment(SPACE + word), WORDS_KEPT)
        self.parts = Memo(self.merged, PARTS_KEPT)
        self.runs = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, part: str) -> int:
        """Tokens of ``part``: initial symbols minus merges."""
        rank, size = self.rank, len(part)
        symbols = list(part)
        # A character that is no piece stands for its UTF-8 bytes; it is in no longer piece either.
        count = sum(1 if c in rank else len(c.encode("utf-8", "surrogatepass")) for c in symbols)
        if size == 1:
            return count
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        heap = []
        for i in range(size - 1):
            if (r := rank.get(part[i : i + 2])) is not None:
                heap.append((r, i, i + 1, 2))
        heapq.heapify(heap)
        while heap:
            _, left, right, length = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != length:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            count -= 1
            after[left] = nxt = after[right]
            if nxt >= 0:
                before[nxt] = left
                pair = symbols[left] + symbols[nxt]
                if (r := rank.get(pair)) is not None:
                    heapq.heappush(heap, (r, left, nxt, len(pair)))
            if (prev := before[left]) >= 0:
                pair = symbols[prev] + symbols[left]
                if (r := rank.get(pair)) is not None:
                    heapq.heappush(heap, (r, prev, left, len(pair)))
        return count

    def segment(self, text: str) -> int:
        """Tokens of escaped ``text``, in parts that no merge can join."""
        total, start, beside = 0, 0, self.beside
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in beside:
                total += self.parts[text[start:i]]
                start = i
        return total + self.parts[text[start:]]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text:
            return sum(map(self.words.__getitem__, text.split(" ")))
        # No piece has a space after another character, so runs that begin with spaces stand alone.
        total = 0
        for run in self.runs.findall(SPACE + text.replace(" ", SPACE)):
            single = run[0] == SPACE and len(run) > 1 and run[1] != SPACE
            total += self.words[run[1:]] if single else self.segment(run)
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


worker_cache("tokens", counter.cache_clear)


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of ``text`` (null and empty: 0) under the model at ``path``."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        enter("tokens")
        return pa.array(list(map(counter(path).count, texts.to_pylist())), pa.int64())

    return count(text)


def count_tokens(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Add ``name``: the token count of each whole text; nothing is cut or padded.

    Null and empty texts count 0. Every row is counted by itself, so ties, repeated
    rows and empty tables need nothing. A column called ``name`` is replaced.
    """
    return df.withColumn(name, token_count(F.col(text), path))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document under piece_bpe_32k.model."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
