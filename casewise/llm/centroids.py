"""Centroid clustering over a vector approximation file: small cells first, full vectors only where they must decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import Scratch, table

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256.0, "2"
#: Bits of a cell, and how many standard deviations about the mean the cells of a dimension cover; outside, the
#: outermost cell counts, and the cell error says how far off it is.
CELL_BITS, CELL_SPAN = 6, 3.5
#: Whole numbers up to this size keep every squared distance of 64 dimensions inside 63 bits.
LARGEST = 1 << 27
#: Relative margin for rounding in the intervals.
SLACK = 1e-9


class Cells:
    """The cells of each dimension: a vector becomes one byte per dimension and the length of its error.

    The error is the distance between the vector and the middle of its cells, so that the vector's distance to any
    centroid lies in an interval about the distance of that middle.
    """

    def __init__(self, low: np.ndarray, width: np.ndarray, bits: int = CELL_BITS):
        self.low, self.width, self.last = low, width, (1 << bits) - 1
        #: Middle of each cell, looked up by dimension and cell.
        self.middle = low[:, None] + (np.arange(self.last + 1) + 0.5) * width[:, None]

    @classmethod
    def of(cls, mean: np.ndarray, deviation: np.ndarray, bits: int = CELL_BITS) -> "Cells":
        reach = CELL_SPAN * np.maximum(deviation, 0.5)
        return cls(mean - reach, 2 * reach / (1 << bits), bits)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = np.clip(np.floor((x - self.low) / self.width), 0, self.last).astype(np.uint8)
        error = np.sqrt(((x - self.middles(cells)) ** 2).sum(axis=1)) * (1 + SLACK)
        return cells, error

    def middles(self, cells: np.ndarray) -> np.ndarray:
        return self.middle[np.arange(cells.shape[1]), cells]


class Assigner:
    """Nearest centroid of vectors known by their cells, with ties to the smaller number."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.cells, self.centroids = cells, centroids
        c = centroids.astype(np.float64)
        self.lengths = (c * c).sum(axis=1)
        self.apart = np.sqrt(np.maximum(self.lengths[:, None] + self.lengths - 2 * c @ c.T, 0.0)) * (1 + SLACK)
        self.c = c

    def candidates(self, cells: np.ndarray, error: np.ndarray) -> np.ndarray:
        """For each vector the centroids whose distance interval overlaps that of the nearest one.

        The squared distances to two centroids differ by what their middles' do, give or take twice the error times
        the distance of the two centroids; this interval of the difference is narrower than both single ones.
        """
        middle = self.cells.middles(cells)
        square = (middle * middle).sum(axis=1)
        distance = square[:, None] - 2 * middle @ self.c.T + self.lengths
        near = distance.argmin(axis=1)
        gap = distance - distance[np.arange(len(near)), near][:, None]
        reach = 2 * error[:, None] * self.apart[near]
        return gap <= reach + SLACK * (square[:, None] + self.lengths) * 8 + 1e-6

    def decide(self, cells: np.ndarray, error: np.ndarray) -> np.ndarray:
        """The nearest centroid where the intervals tell it, else -1."""
        candidates = self.candidates(cells, error)
        return np.where(candidates.sum(axis=1) == 1, candidates.argmax(axis=1), -1).astype(np.int32)

    def exact(self, cells: np.ndarray, error: np.ndarray, fetch) -> np.ndarray:
        """The nearest centroid; ``fetch`` gives the whole vectors of some rows, and is asked only for undecided ones."""
        candidates = self.candidates(cells, error)
        nearest = candidates.argmax(axis=1).astype(np.int32)
        open_rows = np.flatnonzero(candidates.sum(axis=1) > 1)
        if len(open_rows):
            x = fetch(open_rows)
            row, centroid = np.nonzero(candidates[open_rows])
            distance = square_distance(x[row], self.centroids[centroid])
            order = np.lexsort((centroid, distance, row))
            first = np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))
            nearest[open_rows] = centroid[order][first]
        return nearest


def square_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows."""
    difference = x.astype(np.int64) - y
    return np.einsum("ij,ij->i", difference, difference)


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    """Whole-number vectors from a binary column of little-endian 32-bit numbers."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<i4").reshape(-1, dimensions).astype(np.int64)


def _cells(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, dimensions)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.array([r.tobytes() for r in rows], pa.binary()) if len(rows) else pa.array([], pa.binary(width)).cast(pa.binary())


class _Sums:
    """Sums of the vectors that enter clusters less those that leave them: what a task adds to the next centroids."""

    def __init__(self, k: int, dimensions: int):
        self.count, self.total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)

    def add(self, clusters: np.ndarray, x: np.ndarray, sign: int = 1) -> None:
        np.add.at(self.count, clusters, sign)
        np.add.at(self.total, clusters, sign * x)

    def batch(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.total.any(axis=1) | (self.count != 0))
        none = pa.nulls(len(used))
        return pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.float64()), pa.array(used, pa.int32()),
             pa.array(self.count[used]), pa.array(list(self.total[used]), pa.list_(pa.int64()))],
            _STATE_NAMES,
        )


#: One row per vector (no sums), and per task and cluster one with sums (no key).
_STATE = "key long, cells binary, error double, cluster int, count long, sums array<long>"
_STATE_NAMES = ["key", "cells", "error", "cluster", "count", "sums"]


def _state(keys: pa.Array, cells: np.ndarray, error: np.ndarray, cluster: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(cluster))
    return pa.RecordBatch.from_arrays(
        [keys, _binary(cells), pa.array(error), pa.array(cluster, pa.int32()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))],
        _STATE_NAMES,
    )


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector is kept: the right length, no component null or not finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & ~bad, F.lit(False))


def _whole(scale: float, dimensions: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            flat = piece.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(scale * flat)
            if (np.abs(x) > LARGEST).any():
                raise ValueError(f"a component times {scale} is beyond {LARGEST}: its squared distances don't fit 64 bits")
            yield pa.RecordBatch.from_arrays(
                [piece.column("vec_id"), piece.column("key"), _binary(x.reshape(-1, dimensions).astype("<i4"))], ["vec_id", "key", "x"]
            )

    return whole


def _moments(dimensions: int):
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dimensions), np.zeros(dimensions)
        for piece in _pieces(batches):
            x = _vectors(piece.column("x"), dimensions).astype(np.float64)
            n, total, square = n + len(x), total + x.sum(axis=0), square + (x * x).sum(axis=0)
        columns = [pa.array(np.arange(dimensions), pa.int32()), pa.array(np.full(dimensions, n), pa.int64()), pa.array(total), pa.array(square)]
        yield pa.RecordBatch.from_arrays(columns, ["d", "n", "total", "square"])

    return moments


def _first_round(assigner: Assigner, k: int, dimensions: int):
    """Cells of all vectors, their first cluster, and the sums of the clusters."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(k, dimensions)
        for piece in _pieces(batches):
            x = _vectors(piece.column("x"), dimensions)
            cells, error = assigner.cells.encode(x)
            cluster = assigner.exact(cells, error, lambda rows: x[rows])
            sums.add(cluster, x)
            yield _state(piece.column("key"), cells, error, cluster)
        yield sums.batch()

    return first


def _by_cells(assigner: Assigner, dimensions: int):
    """The cluster that the cells alone tell, -1 where full vectors must decide; the cluster before it stays beside."""

    def by_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            told = assigner.decide(_cells(piece.column("cells"), dimensions), piece.column("error").to_numpy())
            columns = [piece.column(c) for c in ("key", "cells", "error", "cluster")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(told, pa.int32())], ["key", "cells", "error", "cluster", "told"])

    return by_cells


def _by_vectors(assigner: Assigner, k: int, dimensions: int):
    """Undecided and moved vectors, fetched: their cluster, and what they change in the clusters' sums."""

    def by_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(k, dimensions)
        for piece in _pieces(batches):
            x, cells = _vectors(piece.column("x"), dimensions), _cells(piece.column("cells"), dimensions)
            error, old = piece.column("error").to_numpy(), piece.column("cluster").to_numpy()
            cluster = assigner.exact(cells, error, lambda rows: x[rows])
            moved = cluster != old
            sums.add(old[moved], x[moved], -1)
            sums.add(cluster[moved], x[moved])
            yield _state(piece.column("key"), cells, error, cluster)
        yield sums.batch()

    return by_vectors


def _last_round(assigner: Assigner, dimensions: int):
    """Every vector with its final cluster and squared distance; the cells are made anew from the vectors that come by."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            x = _vectors(piece.column("x"), dimensions)
            cluster = assigner.exact(*assigner.cells.encode(x), lambda rows: x[rows])
            distance = square_distance(x, assigner.centroids[cluster])
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return last


def _add_sums(state: DataFrame, count: np.ndarray, total: list[list[int]]) -> None:
    """Add the tasks' sums to ``count`` and ``total`` in place: one row per cluster comes to the driver."""
    dimensions = range(len(total[0]))
    sums = state.where(F.col("key").isNull()).groupBy("cluster")
    for row in sums.agg(F.sum("count").alias("count"), *[F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in dimensions]).collect():
        cluster = row["cluster"]
        count[cluster] += row["count"]
        total[cluster] = [old + row[f"s{d}"] for d, old in enumerate(total[cluster])]


def cluster_vectors(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: float = SCALE,
    seed: str = SEED,
    bits: int = CELL_BITS,
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, final centroids) of exact whole-number k-means.

    ``vectors`` has vec_id and embedding; kept are those with ``dimensions`` components, all finite, as whole numbers
    floor(scale * x). The first centroids are the ``k`` vectors whose hex sha256 of ``seed:vec_id`` is smallest. Each
    round assigns every vector to its nearest centroid (ties: smaller number) and moves every non-empty centroid to the
    floor of its vectors' mean; then vectors are assigned once more.

    The approximation file holds a cell of ``bits`` bits per dimension and the length of the cell error; a round
    reads it alone, decides what the distance intervals decide, and fetches, by a join on the row's key, only vectors whose
    intervals overlap or whose cluster changed: sums of clusters are kept and changed by those. The first round, which
    writes the file, and the last, which needs all distances, pass over the vectors without a join. The driver
    holds ``k`` centroids and their sums.

    Repeated rows are vectors of their own, a null vec_id too (its hash sorts last). With fewer than ``k`` kept
    vectors there are as many centroids; with none, no rows. A component beyond 2**27 after scaling is an error,
    because its distances do not fit a long. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    numbers = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding")).where(usable(F.col("embedding"), dimensions))
    kept = kept.withColumn("key", F.monotonically_increasing_id())
    full = scratch.save(kept.mapInArrow(_whole(scale, dimensions), "vec_id long, key long, x binary"), "vectors")

    chosen = full.select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("hash"))
    start = chosen.orderBy(F.asc_nulls_last("hash"), "x").limit(k).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dimensions), np.int64)
    centroids = np.stack([np.frombuffer(row["x"], "<i4").astype(np.int64) for row in start])
    k = len(centroids)

    moments = full.mapInArrow(_moments(dimensions), "d int, n long, total double, square double")
    moments = moments.groupBy("d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("square").alias("square")).orderBy("d").collect()
    n, total, square = (np.array([row[c] for row in moments], np.float64) for c in ("n", "total", "square"))
    cells = Cells.of(total / n, np.sqrt(np.maximum(square / n - (total / n) ** 2, 0.0)), bits)

    counts, totals = np.zeros(k, np.int64), [[0] * dimensions for _ in range(k)]
    state, written = None, []
    for number in range(rounds):
        assigner = Assigner(cells, centroids)
        if state is None:
            fetched = scratch.save(full.mapInArrow(_first_round(assigner, k, dimensions), _STATE), "round")
            after, made = fetched.where(F.col("key").isNotNull()), [fetched]
        else:
            told = state.select("key", "cells", "error", "cluster").mapInArrow(
                _by_cells(assigner, dimensions), "key long, cells binary, error double, cluster int, told int"
            )
            told = scratch.save(told, "told")
            stays = F.col("told") == F.col("cluster")
            wanted = told.where(~stays).drop("told").join(full.select("key", "x"), "key")
            fetched = scratch.save(wanted.mapInArrow(_by_vectors(assigner, k, dimensions), _STATE), "fetched")
            names = ["key", "cells", "error", "cluster"]
            after = told.where(stays).select(*names).union(fetched.where(F.col("key").isNotNull()).select(*names))
            made = [told, fetched]
        _add_sums(fetched, counts, totals)
        moved = [[t // int(counts[c]) for t in totals[c]] if counts[c] else centroids[c] for c in range(k)]
        centroids = np.array(moved, np.int64)
        for old in written:  # nothing reads the state before last any more
            scratch.drop(old)
        state, written = after, made
    for old in written:
        scratch.drop(old)
    found = full.mapInArrow(_last_round(Assigner(cells, centroids), dimensions), "vec_id long, cluster int, distance long")
    return found, centroids


def op12_va_file_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` in 40 clusters, with the clusters' inertia and final centroids."""
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    scratch = Scratch(spark, "clusters")
    found = scratch.save(found, "found")
    sums = {row["cluster"]: int(row["sum"]) for row in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()}
    whole = sum(sums.values())
    rows = [(c, sums[c], whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(sums)]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row per centroid
    return found.join(clusters, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql() -> str:
    """K-means written out round by round."""
    assign = """
a{r} AS MATERIALIZED (
    SELECT key, vec_id, v, min(struct_pack(distance, cluster)) AS best FROM (
        SELECT x.key, x.vec_id, x.v, c.cluster,
            list_sum(list_transform(list_zip(x.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
        FROM kept x CROSS JOIN c{r} c
    ) GROUP BY key, vec_id, v
)"""
    move = """
m{r} AS (
    SELECT cluster, list(mean ORDER BY d) AS c FROM (
        SELECT best.cluster AS cluster, d, sum(v[d])::HUGEINT AS s, count(*)::HUGEINT AS n,
            ((s - ((s % n) + n) % n) // n)::BIGINT AS mean
        FROM a{r} CROSS JOIN range(1, 65) t(d) GROUP BY best.cluster, d
    ) GROUP BY cluster
),
c{s} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))"""
    parts = [
        """
kept AS MATERIALIZED (
    SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
),
c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INT AS cluster, v AS c
    FROM (SELECT v, sha256('2:' || vec_id::VARCHAR) AS h FROM kept) ORDER BY h NULLS LAST, v LIMIT 40
)"""
    ]
    for r in range(ROUNDS):
        parts += [assign.format(r=r), move.format(r=r, s=r + 1)]
    parts.append(assign.format(r=ROUNDS))
    return f"""WITH {",".join(parts)}
SELECT a.vec_id, a.best.cluster AS cluster, a.best.distance AS distance,
    sum(a.best.distance) OVER (PARTITION BY a.best.cluster)::BIGINT AS cluster_inertia,
    sum(a.best.distance) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.best.cluster"""


OP12_SQL = _op12_sql()
