"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors of length one are projected to a few dimensions by a Gaussian (2-stable)
matrix and indexed by kd-trees. A query takes points in the order of their projected
distance and verifies them with the original vectors. For a point at distance d,
(projected distance / d)^2 is chi-square distributed; the search ends when a point as
near as the k-th best would, with probability ``CONFIDENCE``, already have come.

A tree over a sample of the projections deals all points to its cells, one task each.
A query is searched in its own cell first, which bounds its k-th distance, and then
goes only to the cells that the stopping test does not rule out. How many these are
depends on the data: few if neighbours are much nearer than the rest, nearly all if
vectors are spread evenly in many dimensions. A task therefore answers its queries
together, with one product of matrices for each leaf of its own tree and wave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

DIMENSIONS = 8
CONFIDENCE = 0.97
#: Points of a leaf, rows of a cell (about), and rows of the sample that cells are made from.
LEAF, CELL_ROWS, SAMPLE_ROWS = 64, 8_192, 262_144
#: Queries of a cell that one task searches, about.
BLOCK_QUERIES = 4_096
#: So many sampled rows stand for a cell at least.
SAMPLED_A_CELL = 16
SEED = 7


def chi_square_quantile(p: float, k: int) -> float:
    """The value that a chi-square variable of even ``k`` degrees exceeds with probability 1 - p."""
    low, high = 0.0, 1.0
    above = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    while above(high) > 1 - p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > 1 - p else (low, mid)
    return high


def kd_split(points: np.ndarray, most: int, leaves: int | None = None) -> Iterator[tuple]:
    """Median splits along the widest dimension, from the root on: (node, axis, cut) or (node, part).

    Node i has the children 2 i + 1 and 2 i + 2. A part of up to ``most`` points, or of
    equal ones, or at the depth that gives ``leaves``, is a leaf.
    """
    depth = math.inf if leaves is None else math.ceil(math.log2(max(leaves, 1)))
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, part = todo.pop()
        own = points[part]
        spread = own.max(axis=0) - own.min(axis=0) if len(part) else np.zeros(1)
        if len(part) <= most or not spread.max() > 0 or (node + 1).bit_length() > depth:
            yield node, part
            continue
        axis = int(spread.argmax())
        values = np.sort(own[:, axis])
        cut = values[len(values) // 2]
        if cut == values[0]:
            cut = values[np.searchsorted(values, cut, "right")]
        below = own[:, axis] < cut
        yield node, axis, cut
        todo += [(2 * node + 1, part[below]), (2 * node + 2, part[~below])]


class Cells:
    """A kd-tree whose leaves share out the whole space."""

    def __init__(self, sample: np.ndarray, cells: int):
        found = list(kd_split(sample, SAMPLED_A_CELL, cells)) if len(sample) else [(0, sample)]
        self.splits = {x[0]: x[1:] for x in found if len(x) == 3}
        self.numbers = {x[0]: i for i, x in enumerate(x for x in found if len(x) == 2)}
        self.low, self.high = (np.full((len(self.numbers), DIMENSIONS), s * np.inf) for s in (-1, 1))
        todo = [(0, np.full(DIMENSIONS, -np.inf), np.full(DIMENSIONS, np.inf))]
        while todo:
            node, low, high = todo.pop()
            if node in self.numbers:
                self.low[self.numbers[node]], self.high[self.numbers[node]] = low, high
                continue
            axis, cut = self.splits[node]
            left, right = high.copy(), low.copy()
            left[axis] = right[axis] = cut
            todo += [(2 * node + 1, low, left), (2 * node + 2, right, high)]

    def of(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while todo:
            node, part = todo.pop()
            if node in self.numbers:
                out[part] = self.numbers[node]
            elif len(part):
                axis, cut = self.splits[node]
                below = points[part, axis] < cut
                todo += [(2 * node + 1, part[below]), (2 * node + 2, part[~below])]
        return out


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes, a row for each point."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[:, d] - points[:, d, None], points[:, d, None] - high[:, d]), 0)
        out += gap * gap
    return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that no square overflows or vanishes; cosines stay as they are."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    return np.ldexp(vectors, -exponent[:, None])


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def projected(vectors: np.ndarray) -> np.ndarray:
    """Stable projections of scaled vectors, taken to length one."""
    return units(vectors) @ np.random.default_rng(SEED).standard_normal((vectors.shape[1], DIMENSIONS))


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, worst: np.ndarray):
    """For each query its ``k`` nearest found: places of the queries and the points, and cosines.

    ``worst``: squared distances (of unit vectors) beyond which a query needs no points; infinite if unknown.
    Returns also how many points were verified.
    """
    limit, worst = chi_square_quantile(CONFIDENCE, DIMENSIONS), worst.copy()
    places = projected(vectors)
    leaves = [x[1] for x in kd_split(places, LEAF) if len(x) == 2]
    low, high = (np.array([f(places[part], axis=0) for part in leaves]) for f in (np.min, np.max))
    own, asked = units(vectors), units(queries)
    bounds = box_distances(projected(queries), low, high)
    order = np.argsort(bounds, axis=1, kind="stable")
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    first, size, verified = 0, 1, 0
    while first < len(leaves):
        # A wave: the next leaves of each query that the test lets it see, leaf by leaf.
        wave = order[:, first : first + size]
        open_ = np.take_along_axis(bounds, wave, axis=1) <= limit * worst[:, None]
        if not open_.any():
            break
        asking, at = np.nonzero(open_)
        leaf = wave[asking, at]
        by_leaf = np.argsort(leaf, kind="stable")
        asking, leaf = asking[by_leaf], leaf[by_leaf]
        new = [held]
        starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(leaf)]):
            part, who = leaves[leaf[a]], asking[a:b]
            cosine = asked[who] @ own[part].T
            verified += cosine.size
            i, j = np.nonzero((2 - 2 * cosine <= worst[who, None] + 1e-9) & (ids[part] != query_ids[who, None]))
            new.append([who[i], part[j], cosine[i, j]])
        q, p, s = map(np.concatenate, zip(*new))
        # Of each query all that may be among its k best stay.
        ranked = np.lexsort((-s, q))
        q, p, s = q[ranked], p[ranked], s[ranked]
        begin = np.searchsorted(q, np.arange(len(queries)))
        kth = begin + k - 1
        full = (kth < len(q)) & (q[np.minimum(kth, len(q) - 1)] == np.arange(len(queries))) if len(q) else np.zeros(len(queries), bool)
        worst[full] = np.minimum(worst[full], np.maximum(0, 2 - 2 * s[kth[full]]))
        near = 2 - 2 * s <= worst[q] + 1e-9
        held = [q[near], p[near], s[near]]
        first, size = first + size, 2 * size
    q, p, _ = held
    # Row by row, so equal vectors get equal scores wherever they stand.
    norms, query_norms = (np.sqrt((x * x).sum(axis=1)) for x in (vectors, queries))
    s = (vectors[p] * queries[q]).sum(axis=1) / (norms[p] * query_norms[q])
    ranked = np.lexsort((ids[p], -s, q))
    q, p, s = q[ranked], p[ranked], s[ranked]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], p[best], s[best], verified


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column, all of one length, scaled."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return scaled(flat.reshape(len(column), -1)) if len(column) else np.empty((0, 1))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    lengths = batch.column("dims").to_numpy()
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


ROW = "vec_id long, embedding array<double>, dims int, cell int"


def _dealt(trees: dict[int, Cells]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            for n, rows in _by_length(batch):
                if n in trees:
                    cells[rows] = trees[n].of(projected(_matrix(batch.column("embedding").take(pa.array(rows)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    return run


def _routed(trees: dict[int, Cells]):
    """Queries (``worst``: squared distance of the k-th best so far): a row for each further cell to search."""
    limit = chi_square_quantile(CONFIDENCE, DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                home, worst = batch.column("cell").to_numpy(), batch.column("worst").to_numpy()
                for n, rows in _by_length(batch):
                    if n not in trees:
                        continue
                    vectors = batch.column("embedding").take(pa.array(rows))
                    bounds = box_distances(projected(_matrix(vectors)), trees[n].low, trees[n].high)
                    bounds[np.arange(len(rows)), home[rows]] = np.inf
                    i, cell = np.nonzero((bounds <= limit * worst[rows, None]) & (bounds < np.inf))
                    taken = batch.take(pa.array(rows[i]))
                    names = [x for x in batch.schema.names if x != "cell"]
                    yield pa.RecordBatch.from_arrays([*[taken.column(x) for x in names], pa.array(cell.astype(np.int32))], names=[*names, "cell"])

    return run


def searched(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: the k nearest that each query finds in the cell it is sent to.

    The queries of a cell are dealt to blocks of about ``BLOCK_QUERIES`` by a hash, and the cell's vectors are
    sent to each of its blocks, so that no task holds all queries of a crowded cell.
    """
    dealt = queries.groupBy("dims", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("blocks"))
    blocks = materialize(dealt)
    queries = queries.join(blocks, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).drop("blocks")
    points = points.join(blocks, ["dims", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def found(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(others):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own = own.sort_values("vec_id", kind="stable")
        ids, query_ids = own["vec_id"].to_numpy(), others["vec_id"].to_numpy()
        vectors, asked = (scaled(np.stack(x["embedding"]).astype(float)) for x in (own, others))
        q, p, s, _ = search(ids, vectors, query_ids, asked, k, others["worst"].to_numpy(float))
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[p], "score": s})

    return points.groupBy("dims", "cell", "block").cogroup(queries.groupBy("dims", "cell", "block")).applyInPandas(found, "query_id long, vec_id long, score double")


def nearest_neighbours(points: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (int from 1), ``vec_id``, ``score``: the k nearest found by cosine.

    Both tables have ``vec_id`` (long) and ``embedding`` (array of float or double);
    further columns are left out. Vectors that are null, empty, zero or not finite take no
    part, nor do rows without an id; a query is not its own neighbour, and meets vectors
    of its own length only. Query rows that repeat an id count once, with the vector whose
    hash is smallest. Ties go to the smaller id. Fewer than k candidates give all of them; empty tables give none.

    Of equal vectors only the k + 1 rows with the smallest ids can be among anyone's k
    nearest, so the others are set aside before the index is built: an exact reduction
    that keeps a common vector from filling a cell. Cells are made from at most
    ``SAMPLE_ROWS`` projections, those of the rows with the smallest hashes; every row is indexed.
    """
    vector = F.col("embedding").cast("array<double>")

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
        return rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).withColumn("dims", F.size("embedding"))

    rank = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    same = rank([F.xxhash64("embedding"), "embedding"], "vec_id")
    kept = materialize(clean(points).withColumn("n", same).where(F.col("n") <= k + 1).drop("n"))
    once = rank(["vec_id"], F.xxhash64("embedding"), "embedding")
    asked = clean(queries).withColumn("n", once).where("n = 1").drop("n")
    trees = {}
    sizes = dict(map(tuple, kept.groupBy("dims").count().collect()))
    for n, rows in sizes.items():
        if rows > CELL_ROWS:
            few = kept.where(F.col("dims") == n).orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE_ROWS).select("embedding")
            sample = few.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays(list(map(pa.array, projected(_matrix(b.column(0))).T)), names=[f"p{i}" for i in range(DIMENSIONS)]) for b in batches), ", ".join(f"p{i} double" for i in range(DIMENSIONS)))
            trees[n] = Cells(sample.toPandas().to_numpy(), -(-rows // CELL_ROWS))
    kept_in, asked_in = (materialize(x.mapInArrow(_dealt(trees), ROW)) for x in (kept, asked))
    discard(kept.written_path)
    near = materialize(searched(kept_in, asked_in.withColumn("worst", F.lit(float("inf"))), k))
    best = near
    if trees:
        told = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        worst = F.when(F.col("n") >= k, F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))).otherwise(float("inf"))
        bound = asked_in.join(told, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "embedding", "dims", "cell", worst.alias("worst"))
        best = near.union(searched(kept_in, bound.mapInArrow(_routed(trees), "vec_id long, embedding array<double>, dims int, worst double, cell int"), k))
    ranked = best.withColumn("rank", rank(["query_id"], F.desc("score"), "vec_id"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
