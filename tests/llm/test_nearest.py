import numpy as np
import pytest

from casewise.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, score double"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, 2.0) for i, v in vectors], SCHEMA)


def plain(vectors, queries, k):
    out = []
    for i, q in queries:
        scored = []
        for j, x in vectors:
            if j != i and len(x) == len(q):
                total = 0.0
                for a, b in zip(q, x):
                    total += float(np.float32(a)) * float(np.float32(b))
                scored.append((-total, j))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shards", [8192, 40])
def test_exact_against_brute_force(spark, shards):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * rng.uniform(0.1, 4, size=(300, 1))
    x[50:120] = x[50]  # ties
    x[200:220] = np.round(x[200:220])
    vectors = [(i, v.tolist()) for i, v in enumerate(x) if v.any()]
    df = frame(spark, vectors)
    got = N.nearest(df, df.where("vec_id % 20 = 0"), 7, shard_vectors=shards, block_queries=6 if shards == 40 else 4096)
    assert sorted(map(tuple, got.collect())) == plain(vectors, [v for v in vectors if v[0] % 20 == 0], 7)


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1, 0]), (1, None), (2, [0, 0]), (3, [None, 1]), (4, [float("nan"), 1]), (5, [float("inf"), 1]), (6, [1, 2, 3]), (7, [2, 1]), (7, [2, 1]), (None, [1, 1]), (20, [])]
    df = frame(spark, rows)
    assert [tuple(r) for r in N.nearest(df, df).orderBy("query_id").collect()] == [(0, 1, 7, 2.0), (7, 1, 0, 2.0)]
    assert N.nearest(frame(spark, []), frame(spark, [])).collect() == []


def test_tree_prunes_and_factor_trades_recall():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 6)) * 5
    x = (centres[rng.integers(20, size=4000)] + rng.normal(size=(4000, 6)) * 0.2).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(x[:100] @ x.T), axis=1, kind="stable")[:, :10]
    scanned = []
    for factor in (1.0, 4.0):
        tree = N.VantagePointTree(x, 64)
        scan, seen = tree._scan, []
        tree._scan = lambda rows, which: (seen.append(len(rows) * len(which)), scan(rows, which))  # noqa: B023
        got, _ = tree.search(x[:100], 10, factor)
        recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, want)])
        assert recall == 1 if factor == 1 else recall > 0.5
        scanned.append(sum(seen))
    assert scanned[1] <= scanned[0] < 100 * 4000
