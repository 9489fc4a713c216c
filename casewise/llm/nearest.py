"""Nearest neighbours by inner product: vantage-point trees per shard."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewise.llm.common import Scratch, table

NEIGHBOURS = 20
#: Vectors of a shard and queries of a block; a task searches one shard for one block.
SHARD_VECTORS, BLOCK_QUERIES = 8192, 4096
LEAF_VECTORS = 256
#: Margins in the distances of the pruning rule, and candidates kept beyond k, that cover rounding.
SLACK, SPARE = 1e-6, 11


class VantagePointTree:
    """A tree of balls over the rows of ``x``; :meth:`search` finds the largest inner products.

    Each row gets one more coordinate that brings all rows to the same length, so that the nearest row in
    Euclidean distance is the one with the largest inner product. A node keeps a row as its vantage
    point and the median distance of its other rows; the halves below are inside or outside of that ball.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF_VECTORS):
        self.x = x
        norms = np.einsum("ij,ij->i", x, x)
        self.top = float(norms.max(initial=0.0))
        self.extra = np.sqrt(np.maximum(self.top - norms, 0.0))
        self.root = self._build(np.arange(len(x)), leaf)

    def _build(self, rows: np.ndarray, leaf: int):
        if len(rows) <= leaf:
            return rows
        vantage = rows[len(rows) // 2]
        products = self.x[rows] @ self.x[vantage] + self.extra[rows] * self.extra[vantage]
        distance = np.sqrt(np.maximum(2 * self.top - 2 * products, 0.0))
        radius = float(np.median(distance))
        inside = distance <= radius
        if inside.all():  # all at one distance: nothing to tell apart
            return rows
        return vantage, radius, self._build(rows[inside], leaf), self._build(rows[~inside], leaf)

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Indices (by falling product, ties by index; -1 where there are fewer) and products of the k best rows.

        A ball is skipped when the triangle inequality puts all of it farther than ``1 / factor`` of the
        distance of the k-th best found so far. Factor 1 is exact; a larger one skips more.
        """
        self.queries, self.k, self.factor = queries, k, factor
        self.lengths = np.einsum("ij,ij->i", queries, queries)
        self.scores = np.full((len(queries), k), -np.inf)
        self.index = np.full((len(queries), k), -1)
        self._visit(self.root, np.arange(len(queries)))
        return self.index, self.scores

    def _reach(self, which: np.ndarray) -> np.ndarray:
        worst = self.scores[which, -1]
        return np.sqrt(np.maximum(self.lengths[which] + self.top - 2 * worst, 0.0)) / self.factor + SLACK

    def _visit(self, node, which: np.ndarray) -> None:
        if not len(which):
            return
        if isinstance(node, np.ndarray):
            self._scan(node, which)
            return
        vantage, radius, inner, outer = node
        products = self.queries[which] @ self.x[vantage]
        distance = np.sqrt(np.maximum(self.lengths[which] + self.top - 2 * products, 0.0))
        inside = distance <= radius
        self._visit(inner, which[inside])
        self._visit(outer, which[~inside])
        gap = np.abs(distance - radius)
        near = gap <= self._reach(which)
        self._visit(outer, which[inside & near])
        self._visit(inner, which[~inside & near])

    def _scan(self, rows: np.ndarray, which: np.ndarray) -> None:
        products = self.queries[which] @ self.x[rows].T
        better = products.max(axis=1) >= self.scores[which, -1]
        which, products = which[better], products[better]
        scores = np.concatenate([self.scores[which], products], axis=1)
        index = np.concatenate([self.index[which], np.broadcast_to(rows, products.shape)], axis=1)
        order = np.lexsort((index, -scores), axis=1)[:, : self.k]
        self.scores[which] = np.take_along_axis(scores, order, axis=1)
        self.index[which] = np.take_along_axis(index, order, axis=1)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).astype(np.float64)


def _search(k: int, factor: float):
    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        if not shard.num_rows or not block.num_rows:
            return empty
        x, ids = _matrix(shard["vector"], shard.num_rows), shard["vec_id"].to_numpy()
        q, own, key = _matrix(block["vector"], block.num_rows), block["vec_id"].to_numpy(), block["query_key"].to_numpy()
        # Equal vectors are one row of the tree, in order of their smallest id.
        order = np.lexsort((ids, *x.T[::-1]))
        x, ids = x[order], ids[order]
        new = np.append(True, (x[1:] != x[:-1]).any(axis=1))
        first = np.flatnonzero(new)
        past = np.append(first[1:], len(ids))
        by_id = np.argsort(ids[first], kind="stable")
        first, past = first[by_id], past[by_id]
        index, _ = VantagePointTree(x[first]).search(q, min(k + 1 + SPARE, len(first)), factor)
        asked, rows = np.nonzero(index >= 0)
        tree = index[asked, rows]
        # Of equal vectors no more than k + 1 smallest ids can be among a query's k others.
        take = np.minimum(past - first, k + 1)[tree]
        asked, start = np.repeat(asked, take), np.repeat(first[tree], take)
        at = start + np.arange(len(start)) - np.repeat(np.cumsum(take) - take, take)
        keep = ids[at] != own[asked]
        asked, at = asked[keep], at[keep]
        score = np.zeros(len(at))
        for component in range(x.shape[1]):  # in order, so that equal vectors get equal scores
            score += q[asked, component] * x[at, component]
        order = np.lexsort((ids[at], -score, asked))
        asked, at, score = asked[order], at[order], score[order]
        rank = np.arange(len(asked)) - np.searchsorted(asked, asked)
        best = rank < k
        asked, at, score = asked[best], at[best], score[best]
        return pa.table({"query_id": own[asked], "query_key": key[asked], "vec_id": ids[at], "score": score})

    return search


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, one of them not 0."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    factor: float = 1.0,
    shard_vectors: int = SHARD_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` nearest rows of ``vectors``.

    Both have vec_id and embedding; rows of the query's own id are left out. Nearness is the inner product
    in double precision, ties go to the smaller id. Every vector is in one shard by hash, every query in
    one block; a block meets each shard once, in a task of bounded size that grows the shard's tree
    (a three-hundredth of the search at full size) and searches it. At most ``k`` rows per query leave a shard. ``factor`` 1
    is exact.

    Null ids, and vectors that :func:`usable` refuses, take no part. Repeated rows of ``vectors`` count
    once, and so do those of ``queries``. Vectors of other lengths than the query's are not compared. With
    fewer than ``k`` candidates all are returned; no rows give no rows. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")

    def clean(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
        return scratch.save(rows.dropDuplicates(["vec_id", "vector"]), name)

    x, q = clean(vectors, "vectors"), clean(queries, "queries")
    shards = max(1, math.ceil(x.count() / shard_vectors))
    blocks = max(1, math.ceil(q.count() / block_queries))
    dealt = F.xxhash64("vec_id", "vector")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("vector").alias("size")
    left = x.select(size, F.pmod(dealt, F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), "vec_id", "vector")
    right = q.select(size, every(shards).alias("shard"), F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"), "vec_id", "vector", dealt.alias("query_key"))
    cell = ["size", "shard", "block"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        _search(k, factor), "query_id long, query_key long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


OP5_SQL = """
WITH vectors AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0
),
pairs AS (
    SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_dot_product(q.v, x.v) AS score
    FROM vectors q JOIN vectors x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""
