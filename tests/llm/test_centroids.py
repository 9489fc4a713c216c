import hashlib

import numpy as np
import pytest

from casewise.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, key string, cluster string, x int"


def plain_k_means(rows, k=C.CENTROIDS, rounds=C.ROUNDS):
    """Whole-number k-means over (vec_id, vector) by all distances."""
    x = [[int(np.floor(256 * float(np.float32(v)))) for v in vector] for _, vector in rows]
    order = sorted(range(len(rows)), key=lambda at: (rows[at][0] is None, hashlib.sha256(f"2:{rows[at][0]}".encode()).hexdigest(), x[at]))
    centroids = [x[at] for at in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), at) for at, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for v in x:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(d) // len(g) for d in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    return [(rows[at][0], *nearest(v)[::-1]) for at, v in enumerate(x)], centroids


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "k", "c", 1) for i, v in rows], SCHEMA)


def clusters(df, **settings):
    found, centroids = C.cluster_vectors(df, **settings)
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in found.collect()), centroids.tolist()


def expected(rows, **settings):
    found, centroids = plain_k_means(rows, **settings)
    return sorted((i is None, i or 0, c, d) for i, c, d in found), centroids


@pytest.mark.parametrize("bits", [2, 6])
def test_equals_all_distances(spark, bits):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(9, 64)) * 0.3
    rows = [(at, (middle[at % 9] + rng.normal(size=64) * 0.15).astype(np.float32).tolist()) for at in range(260)]
    assert clusters(frame(spark, rows), k=11, bits=bits) == expected(rows, k=11)


def test_ties_copies_outliers_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(at, rng.integers(-2, 3, 64).astype(float).tolist()) for at in range(40)]
    rows += [(100 + at, [0.5] * 64) for at in range(60)] + [(7, rows[7][1]), (7, rows[8][1]), (None, [1.0] * 64)]
    rows += [(300, [900.0] + [0.0] * 63), (301, [-0.001] * 64)]
    refused = [(400, None), (401, [1.0] * 63), (402, [1.0] * 63 + [None]), (403, [float("nan")] * 64), (404, [float("inf")] + [0.0] * 63), (405, [])]
    assert clusters(frame(spark, rows + refused), k=12) == expected(rows, k=12)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.1] * 64), (2, [0.1] * 64), (3, [-0.7] * 64)]
    assert clusters(frame(spark, rows)) == expected(rows)
    assert clusters(frame(spark, [])) == ([], [])
    assert clusters(frame(spark, [(1, None)])) == ([], [])


def test_components_too_large_are_told(spark):
    with pytest.raises(Exception, match="don't fit 64 bits"):
        clusters(frame(spark, [(1, [1e30] * 64)]))


def test_cells_decide_most_vectors_without_fetching_them():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-200, 200, (8, 64))
    x = centroids[rng.integers(0, 8, 3000)] + rng.integers(-30, 30, (3000, 64))
    cells = C.Cells.of(x.mean(axis=0), x.std(axis=0))
    assigner, (codes, error), asked = C.Assigner(cells, centroids), cells.encode(x), []
    nearest = assigner.exact(codes, error, lambda rows: asked.extend(rows) or x[rows])
    true = ((x[:, None] - centroids) ** 2).sum(axis=2)
    assert (nearest == true.argmin(axis=1)).all()
    assert len(asked) < 100
    told = assigner.decide(codes, error)
    assert (told[told >= 0] == true.argmin(axis=1)[told >= 0]).all() and (told >= 0).sum() == 3000 - len(asked)


def test_query_equals_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(6)
    rows = [(at, rng.normal(size=64).tolist()) for at in range(150)] + [(200, None), (201, [1.0])]
    frame(spark, rows).select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in C.op12_va_file_clusters(spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        assert got == sorted(db.execute("SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM (" + C.OP12_SQL + ")").fetchall())
