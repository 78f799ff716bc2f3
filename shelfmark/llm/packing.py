"""Packing documents into sequences by bounded-space online best-fit."""

from __future__ import annotations

import array
import re
import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, materialize, table, worker_cache
from .tokens import Memo

CHUNKS_KEPT = 600_000
OPEN_BINS = 1024
SEQUENCES_A_GROUP = 4096
#: Up to here all libraries agree on what letters and digits are.
LATIN_END = "ɐ"


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level byte-pair tokenizer as bytes and ids.

    None unless merges stand in the order of the ids of what they make: only then
    is merging by lowest id the same as merging by the list.
    """
    import json

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary[a + b] for a, b in merges]
    # Bytes that print stand for themselves, the others for the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    tokens = {t: i for t, i in vocabulary.items() if all(c in back for c in t)}
    ranks = {bytes(back[c] for c in t): i for t, i in tokens.items()}
    single = max((i for t, i in ranks.items() if len(t) == 1), default=-1)
    return ranks if made == sorted(made) and (not made or single < made[0]) and len(ranks) == len(made) + 256 else None


class ChunkEncoder:
    """Token ids, as little-endian unsigned 32-bit bytes, of a byte-level tokenizer.

    The tokenizer never joins what stands before a space and a visible character
    with what follows, so texts are cut there and the cuts' ids are remembered. New
    cuts are merged by tiktoken, from the ranks in the tokenizer's own file, which
    gives the same ids several times as fast. Cuts that may hold a special token or
    letters beyond the Latin blocks go to the tokenizer, as does everything if its
    merges are not in the order of their ids.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = re.compile(r" (?=\S)")
        ranks = byte_ranks(path)
        self.merge = ranks and tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.spaced = Memo(lambda chunk: self.chunk(" " + chunk), CHUNKS_KEPT)

    def chunk(self, text: str) -> bytes:
        if not text:
            return b""
        if self.merge and max(text) < LATIN_END and not any(s in text for s in self.special):
            ids = array.array("I", self.merge(text))
        else:
            ids = array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def ids(self, text: str | None) -> bytes:
        first, *rest = self.cut.split(text or "")
        return self.chunk(first) + b"".join(map(self.spaced.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


worker_cache("packing", encoder.cache_clear)


def cut_documents(df: DataFrame, path: str, capacity: int = 2048, end: int = 0, text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: its token ids and ``end``, in at most ``capacity`` tokens.

    Only longer documents are cut; then the first piece takes the remainder, and all
    others are full. Returns every column of ``df`` but ``text``, with ``piece`` (int
    from 0), ``start``, ``length``, ``ids_crc32`` (long) and, on demand, ``ids``. Null
    and empty texts give one piece that holds ``end`` alone.
    """
    others = [c for c in df.columns if c != text]
    if clash := {"piece", "start", "length", "ids_crc32", "ids"} & {c.lower() for c in others}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)
    closing = end.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing")
        coder = encoder(path)
        for batch in batches:
            rows, out = [], [[], [], [], [], []]
            for i, value in enumerate(batch.column(text)):
                ids = coder.ids(value.as_py()) + closing
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                for k, stop in enumerate(range(first, total + 1, capacity)):
                    start = max(0, stop - capacity) if k else 0
                    rows.append(i)
                    part = ids[4 * start : 4 * stop]
                    for column, x in zip(out, (k, start, stop - start, zlib.crc32(part), part)):
                        column.append(x)
            taken = pa.array(rows, pa.int64())
            columns = [batch.column(c).take(taken) for c in others]
            columns += [pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                columns.append(pa.array([memoryview(x).cast("i").tolist() for x in out[4]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return df.select(*[F.col(f"`{c}`") for c in others], F.col(text)).mapInArrow(pieces, ", ".join(x for x in (kept, fields) if x))


class BestFit:
    """Online best-fit into bins of ``capacity`` with at most ``most`` of them open.

    Bit ``f`` of ``free`` is set if an open bin has ``f`` places left. An item goes to
    the fullest bin that takes it: the lowest set bit from its size on. When too
    many bins are open, the fullest closes: the lowest set bit of all.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free, self.open, self.bins, self.made = 0, 0, {}, 0

    def put(self, size: int) -> tuple[int, int]:
        """The bin and the place in it for an item of ``size``."""
        fitting = self.free >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            bin_ = self.take(left)
        else:
            left, bin_ = self.capacity, self.made
            self.made += 1
        if rest := left - size:
            if self.open == self.most:
                self.take((self.free & -self.free).bit_length() - 1)
            self.bins.setdefault(rest, []).append(bin_)
            self.free |= 1 << rest
            self.open += 1
        return bin_, self.capacity - left

    def take(self, left: int) -> int:
        same = self.bins[left]
        bin_ = same.pop()
        if not same:
            del self.bins[left]
            self.free ^= 1 << left
        self.open -= 1
        return bin_


def pack(df: DataFrame, capacity: int = 2048, length: str = "length", bins: int = OPEN_BINS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (longs): a place for each row of ``length`` units.

    Rows are dealt out evenly to as many groups as keep about 4096 full sequences
    each, and packed group by group as they come, in memory that is bounded by the
    number of open bins; only the bins open at a group's end stay less than full.
    Lengths must be from 1 to ``capacity``; an empty table gives an empty table.
    """
    if clash := {"sequence_id", "offset"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    written = materialize(df)
    total = written.agg(F.sum(length)).first()[0] or 0
    groups = max(1, total // (capacity * SEQUENCES_A_GROUP))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, fit = TaskContext.get().partitionId() << 40, BestFit(capacity, bins)
        for batch in batches:
            placed = [fit.put(n) for n in batch.column(length).to_pylist()]
            sequences = pa.array([base + b for b, _ in placed], pa.int64())
            offsets = pa.array([o for _, o in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sequences, offsets], names=[*batch.schema.names, "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return written.repartition(groups).mapInArrow(place, f"{kept}, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Cut the documents of ``df`` and pack the pieces; see ``cut_documents`` and ``pack``."""
    return pack(cut_documents(df, path, capacity, with_ids=with_ids), capacity)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens of byte_bpe_50k.json."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
