import math

import numpy as np
from pyspark.sql import types as T

from colonnade.llm import topk

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.StringType()),
                        T.StructField("block", T.StringType())])


def brute(rows, every, k):
    used = [(i, np.array([math.floor(256 * float(np.float32(x))) for x in v], dtype=object)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(used):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(used) if m != n)
            out += [(q, rank + 1, i, int(-s)) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, size=16, **more):
    df = spark.createDataFrame([(i, v, "r", "b") for i, v in rows], VECTORS)
    return sorted(tuple(r) for r in topk.search(topk.build(topk.quantized(df), size), **more).collect())


def test_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), r.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(0, 900, 3)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(50, rows[7][1]), (50, rows[7][1]), (1, None), (2, [1.0, None]), (4, [float("nan")] * 8), (100, [float("inf")] * 8), (None, [1.0] * 8), (5, []), (7, [0.5, -0.5])]
    want = brute(rows, 50, 5)
    assert found(spark, rows) == want
    assert found(spark, rows, chunk=4, shard=3) == want


def test_clustered_blocks_are_pruned():
    r = np.random.default_rng(5)
    center = r.normal(0, 300, (20, 16))
    blocks = []
    for n in range(20):
        m = (center[n] + r.normal(0, 5, (50, 16))).astype(np.int64)
        row = type("R", (), {"block": n, "vec_ids": list(range(n * 50, n * 50 + 50)), "dims": 16, "vectors": m.tobytes(), "most": m.max(0), "least": m.min(0)})
        blocks.append(topk.Block(row))
    seen = []
    plain = topk._product
    topk._product = lambda a, b: seen.append(b.shape) or plain(a, b)
    try:
        asked = [(0, 0, 0)]
        got = topk.best_of(asked, blocks[0].vectors[:1], blocks, 5)
    finally:
        topk._product = plain
    every = sorted((-int(blocks[0].vectors[0] @ v), int(i)) for b in blocks for i, v in zip(b.ids, b.vectors) if i)[:5]
    assert [(-g[4], g[3]) for g in got] == every and sum(s == (50, 16) for s in seen) < 10


def test_large_values_and_few_rows(spark):
    rows = [(0, [3e6, -1.0]), (1, [2e6, 2.0]), (2, [-3e6, 0.0])]
    assert found(spark, rows) == brute(rows, 50, 5)
    assert found(spark, [(3, [1.0])]) == [] and found(spark, [(0, [1.0])]) == [] and found(spark, []) == []
