"""Nearest neighbours by a forest of sorted hash strings.

Distinct vectors are dealt into blocks. In each block every tree draws a long string of hash bits for
a vector (on which side of a random hyperplane it lies; the hyperplane passes the block's median, so
that each bit halves the block and closeness is Euclidean, not angular) and keeps the strings sorted.
A query descends every tree by binary search to the entries that share the longest prefix with its own
string, then ascends all trees at once, one bit at a time, until the entries that it met are several times
the block. Every meeting counts: an entry is worth the bits that it shares with the query, added up over
the trees, and those worth most, a tenth of the block, are the candidates. They are ranked by exact distance
in double precision.

Nearly isotropic vectors, of which the nearest are not much nearer than others, are the hard case: 192 trees
then find more than 0.95 of the ten nearest among a tenth of the block, where taking whole levels of 48
trees needed three quarters of it.

Equal vectors are one entry that carries its least ids, so that copies never fill a bucket. A block's
forest is built once, by the task that then reads the queries as a stream; a query meets every block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trees, bits of a hash string, vectors of a block.
TREES, BITS, BLOCK = 192, 12, 8_192
#: Candidates as a share of a block, and for each wanted neighbour at least; meetings for each entry of the block at which a query stops to ascend.
SHARE, SPREAD, MEETINGS = 0.1, 20, 16
NEIGHBOURS, QUERY_DIVISOR = 10, 100
SEED = 20_240_229
_FOUND = "query_id long, vec_id long, score double"


class PrefixForest:
    """The trees of one block of vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        n, dim = vectors.shape
        self.planes = np.random.default_rng(seed).standard_normal((dim, trees * bits)).astype(np.float32)
        self.centre, self.scale = vectors.mean(0), np.abs(vectors).max() or 1.0
        sides = self._project(vectors)
        self.medians = np.median(sides, axis=0)
        codes = self._codes(sides)
        self.order = np.argsort(codes, axis=1, kind="stable")
        # the trees side by side in one sorted array: the tree's number comes before the hash string
        self.sorted = (np.take_along_axis(codes, self.order, 1) + (np.arange(trees)[:, None] << bits)).ravel()
        self.order = self.order.ravel()

    def _project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale).astype(np.float32) @ self.planes

    def _codes(self, sides: np.ndarray) -> np.ndarray:
        """A hash string for each tree and vector, as a number whose high bits come first."""
        bit = (sides > self.medians).reshape(len(sides), self.trees, self.bits)
        return (bit.astype(np.int64) << np.arange(self.bits - 1, -1, -1, dtype=np.int64)).sum(2).T

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query the ``enough`` entries that share most with it, and those that share as much as the last."""
        n = len(self.vectors)
        codes = self._codes(self._project(queries)) + (np.arange(self.trees)[:, None] << self.bits)
        for code in codes.T:
            shares, met = np.zeros(n), 0
            for depth in range(self.bits, -1, -1):
                first = code >> (self.bits - depth) << (self.bits - depth)
                low, high = np.searchsorted(self.sorted, first), np.searchsorted(self.sorted, first + (1 << (self.bits - depth)))
                counts = high - low
                met = int(counts.sum())
                at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(met)
                shares += np.bincount(self.order[at], minlength=n)
                if met >= MEETINGS * n:
                    break
            yield np.flatnonzero(shares >= np.partition(shares, n - enough)[n - enough]) if enough < n else np.arange(n)

    def nearest(self, queries: np.ndarray, k: int, share: float = SHARE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (entries, distances), nearest first: k entries and those as far as the k-th."""
        enough = min(len(self.vectors), max(int(np.ceil(share * len(self.vectors))), SPREAD * k))
        for q, found in zip(queries, self.candidates(queries, enough), strict=True):
            d = np.sqrt(((self.vectors[found] - q) ** 2).sum(1))
            if len(d) > k:
                keep = d <= np.partition(d, k - 1)[k - 1]
                found, d = found[keep], d[keep]
            order = np.argsort(d, kind="stable")
            yield found[order], d[order]


def usable(vector: str) -> Column:
    """Vectors that take part: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _search(k: int):
    """Over rows (dim, block, role, id, ids, vector) that are sorted so: a block's points (role 0), then its queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, vectors, ids, forest = None, [], [], None
        for batch in batches:
            dim, block, role = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(dim)], strict=True):
                if last == first:
                    continue
                if (dim[first], block[first]) != key:
                    key, vectors, ids, forest = (dim[first], block[first]), [], [], None
                own = batch.column(5).slice(first, last - first).flatten().to_numpy().reshape(last - first, -1)
                if role[first] == 0:
                    vectors.append(own)
                    ids += batch.column(4).slice(first, last - first).to_pylist()
                    continue
                if not vectors:
                    continue
                forest = forest or PrefixForest(np.concatenate(vectors))
                out: list[tuple] = []
                for query, (found, d) in zip(batch.column(3).slice(first, last - first).to_pylist(), forest.nearest(own, k + 1), strict=True):
                    out += [(query, v, s) for s, v in sorted((s, v) for e, s in zip(found.tolist(), d.tolist(), strict=True) for v in ids[e] if v != query)[:k]]
                if out:
                    yield pa.RecordBatch.from_pydict({c: pa.array(x, t) for c, x, t in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return run


def nearest_neighbours(embeddings: DataFrame, k: int = NEIGHBOURS, divisor: int = QUERY_DIVISOR, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``divisor``.

    Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part,
    nor do null ids; vectors of another length are never candidates; a row that repeats its id and vector
    counts once; an id with two vectors is a query and a candidate with each; ties go to the smaller
    vec_id; a query without any candidate has no row; an empty table gives no rows; other columns are ignored.
    """
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable("vector"))
    # the least ids of equal vectors; Spark keeps k + 1 of a vector before it shuffles, so a very common one is no hot key
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    blocks = max(1, -(-rows.count() // block))
    points = distinct.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("long").alias("block"), F.lit(0).alias("role"), F.col("ids")[0].alias("id"), "ids", "vector")
    wanted = rows.where(F.col("vec_id") % divisor == 0).distinct()
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    queries = wanted.select(F.size("vector").alias("dim"), every, F.lit(1).alias("role"), F.col("vec_id").alias("id"), F.array().cast("array<bigint>").alias("ids"), "vector")
    dealt = points.unionByName(queries).repartition("dim", "block").sortWithinPartitions("dim", "block", "role", "id", "vector")
    once = dealt.mapInArrow(_search(k), _FOUND).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
