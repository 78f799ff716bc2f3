"""Fingerprints of texts and images, and their similarity."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import written

BITS = 64
#: 3-grams whose digests are kept while a batch of texts is read.
GRAMS_KEPT = 400_000


class GramDigests(dict):
    """The first 8 bytes of the SHA-256 of each 3-gram, computed when it is first met."""

    def __missing__(self, gram: str) -> bytes:
        if len(self) >= GRAMS_KEPT:
            self.clear()
        self[gram] = found = hashlib.sha256(gram.encode()).digest()[:8]
        return found


def text_fingerprint(text: str, digests_of: dict[str, bytes] | None = None) -> int:
    """64 votes of the SHA-256 of character 3-grams over letters and digits; ties set the bit."""
    digests_of = GramDigests() if digests_of is None else digests_of
    plain = "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())
    grams = [plain[i : i + 3] for i in range(len(plain) - 2)] or [plain]
    known: dict[str, int] = {}
    for gram in grams:
        known[gram] = known.get(gram, 0) + 1
    digests = np.frombuffer(b"".join(map(digests_of.__getitem__, known)), np.uint8).reshape(-1, 8)
    bits = np.unpackbits(digests, axis=1, bitorder="little").astype(np.int64)
    weights = (2 * bits - 1).T @ np.fromiter(known.values(), np.int64)
    return int(np.packbits(weights >= 0, bitorder="little").view("<i8")[0])


def text_simhash(text: Column) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        digests = GramDigests()
        return pd.Series([None if t is None else text_fingerprint(t, digests) for t in texts], dtype="Int64")

    # So marked, filters on the hash are not pushed below it, where they would compute it again.
    return run.asNondeterministic()(text)


def image_dhash(samples: Column) -> Column:
    """Of 8 rows of 9 grey values: bit 8 r + c is set if a value exceeds the one to its right."""
    out = F.lit(0).cast("long")
    for row in range(8):
        for column in range(8):
            at = 9 * row + column
            bit = 1 << (8 * row + column)
            signed = bit - 2**64 if bit >= 2**63 else bit
            out = out.bitwiseOR(F.when(F.get(samples, F.lit(at)) > F.get(samples, F.lit(at + 1)), F.lit(signed).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def similarity(left: Column, right: Column) -> Column:
    return (1 - F.bit_count(left.bitwiseXOR(right)) / BITS).cast("double")


def bit_votes(hashes: DataFrame, key: str, value: str, bits: int = BITS) -> DataFrame:
    """``key`` and ``hash``: each bit is the majority of its group's values; ties set it."""
    vote = lambda b: F.sum(F.when(F.shiftright(value, b).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1))
    votes = hashes.groupBy(key).agg(*[vote(b).alias(f"b{b}") for b in range(bits)])
    out = F.lit(0).cast("long")
    for b in range(bits):
        signed = (1 << b) - (1 << 64) * (b == 63)
        out = out.bitwiseOR(F.when(F.col(f"b{b}") >= 0, F.lit(signed).cast("long")).otherwise(F.lit(0).cast("long")))
    return votes.select(key, out.alias("hash"))


def similar_pairs(prints: DataFrame, distance: int = 3) -> DataFrame:
    """``left_id``, ``right_id``, ``similarity``: links that leave out no class of equal hashes.

    The smallest id stands for its class: it is linked with each member (similarity 1), and with
    those of the classes within ``distance`` bits. Of distance + 2 blocks two such hashes
    agree on two at least, so they meet under a pair of blocks. Hashes are computed once, and written.
    """
    prints = written(prints)
    classes = prints.where("hash is not null").groupBy("hash").agg(F.min("id").alias("rep"))
    blocks = distance + 2
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    part = lambda i: F.shiftrightunsigned("hash", cuts[i]).bitwiseAND(F.lit((1 << cuts[i + 1] - cuts[i]) - 1))
    keys = F.array(*[F.struct(F.lit(blocks * i + j).alias("n"), part(i).alias("a"), part(j).alias("b")) for i in range(blocks) for j in range(i + 1, blocks)])
    keyed = classes.select("rep", "hash", F.explode(keys).alias("key")).repartition("key")
    other = keyed.select(F.col("key").alias("other_key"), F.col("rep").alias("right_id"), F.col("hash").alias("right_hash"))
    met = keyed.join(other, (F.col("key") == F.col("other_key")) & (F.col("rep") < F.col("right_id")) & (F.bit_count(F.col("hash").bitwiseXOR(F.col("right_hash"))) <= distance))
    near = met.select(F.col("rep").alias("left_id"), "right_id", similarity(F.col("hash"), F.col("right_hash")).alias("similarity")).distinct()
    members = prints.join(classes.withColumnRenamed("hash", "known"), F.col("hash") == F.col("known")).where(F.col("id") != F.col("rep"))
    return near.union(members.select("rep", "id", F.lit(1.0)))
