import math
from hashlib import sha256

import numpy as np
import pytest
from compare import compare, connect
from pyspark.sql import types as T

from colonnade.llm import centroids

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.StringType()),
                        T.StructField("name", T.StringType()), T.StructField("v", T.StringType())])


def brute(rows, k=8, rounds=10, dims=64):
    used = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(used, key=lambda r: (sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        hits = [near(v)[1] for _, v in used]
        for n in range(len(centers)):
            own = [v for (_, v), h in zip(used, hits) if h == n]
            if own:
                centers[n] = [sum(x) // len(own) for x in zip(*own)]
    hits = [near(v) for _, v in used]
    sums = [sum(d for d, h in hits if h == n) for n in range(len(centers))]
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, h, d, sums[h], sum(sums), names[h]) for (i, _), (d, h) in zip(used, hits)), key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "c", "n", "v") for i, v in rows], VECTORS)
    return sorted((tuple(r) for r in centroids.summary(*centroids.cluster(df, **more)).collect()), key=str)


def test_equals_brute_force(spark):
    r = np.random.default_rng(3)
    middle = r.normal(0, 0.3, (5, 64))
    rows = [(i, (middle[i % 5] + r.normal(0, 0.1, 64)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(10)]  # ties
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (1, None), (2, []), (3, [1.0] * 63), (4, [0.5] * 63 + [None]),
             (5, [float("nan")] * 64), (6, [float("-inf")] * 64), (8, [0.0] * 64), (9, [0.0] * 64)]
    assert found(spark, rows) == brute(rows)


def test_few_equal_and_large(spark):
    r = np.random.default_rng(4)
    assert found(spark, []) == [] and found(spark, [(1, None), (2, [1.0])]) == []
    same = [(i, [0.25] * 64) for i in range(20)]
    assert found(spark, same) == brute(same) and {x[1] for x in found(spark, same)} == {0}
    few = [(i, r.normal(0, 1, 64).astype(np.float32).tolist()) for i in range(3)]
    assert found(spark, few) == brute(few)
    large = [(i, (r.normal(0, 1, 64) * 10.0 ** (i % 5)).astype(np.float32).tolist()) for i in range(40)]
    assert found(spark, large) == brute(large)
    with pytest.raises(Exception, match="(?i)overflow|too large|out of"):
        found(spark, [(0, [1e20] * 64), (1, [-1e20] * 64)], k=1, rounds=0)


@pytest.mark.parametrize("kind", [np.int64, object])
def test_search_is_exact_and_prunes(kind):
    r = np.random.default_rng(5)
    centers = [[int(x) for x in r.normal(m, 3 + 10 * abs(m % 3), 16)] for m in r.integers(-300, 300, 200)]
    search = centroids.Centroids(centers)
    x = np.array(centers)[r.integers(0, 200, 500)] + r.integers(-4, 5, (500, 16))
    number, distance, computed = centroids.nearest(x.astype(kind), search)
    every = ((x[:, None, :] - np.array(centers)[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance.astype(np.int64) == every.min(axis=1)).all()
    assert computed < 500 * 200 / 10  # most centroids are ruled out by their mean and deviation


def test_sql(spark, data):
    assert compare(spark, connect(data), "op13_centroid_search", data) is None
