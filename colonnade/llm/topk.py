"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.llm.registry import query, table
from colonnade.session import stage

SCALE = 256
INDEX = "block long, vec_ids array<long>, dims int, vectors binary, most array<long>, least array<long>"


def quantized(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and terms: floor(256 x) of every component as a long. Rows whose vector is null or has a null or non-finite component,
    or whose id is null, are left out; an empty vector stays and scores 0."""
    x = F.col(f"`{vector}`")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), x.alias("v"), bad.alias("bad")).where("vec_id IS NOT NULL AND v IS NOT NULL AND NOT bad")
    return rows.select("vec_id", F.transform("v", lambda v: F.floor(v.cast("double") * SCALE)).alias("terms"))


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of any lengths as one matrix, short ones filled with 0."""
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def build(terms: DataFrame, size: int = 1024) -> DataFrame:
    """Index of quantized vectors: one row per block of at most `size` neighbours in the order of vec_id, with its forward index
    (ids and vectors) and the largest and smallest value of every term. Rows are dealt by ranges of ids, so that blocks are document ranges,
    and cut where they stand; a task holds one block."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows, made = [], [], 0

        def block() -> pd.DataFrame:
            from pyspark import TaskContext

            m = _matrix(rows)
            most, least = (m.max(axis=0), m.min(axis=0)) if m.shape[1] else (m[0], m[0])
            number = (TaskContext.get().partitionId() << 32) + made
            return pd.DataFrame([(number, list(ids), m.shape[1], m.tobytes(), most, least)], columns=[c.split()[0] for c in INDEX.split(", ")])
        for b in batches:
            for i, t in zip(b["vec_id"], b["terms"]):
                ids.append(int(i))
                rows.append(np.asarray(t, np.int64))
                if len(ids) == size:
                    yield block()
                    ids, rows, made = [], [], made + 1
        if ids:
            yield block()
    return stage(terms.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInPandas(run, INDEX), "blocks")


class Block:
    """One block of the index, in memory."""

    def __init__(self, row):
        self.number, self.ids = int(row.block), np.asarray(row.vec_ids, np.int64)
        self.vectors = np.frombuffer(row.vectors, np.int64).reshape(len(self.ids), int(row.dims))
        self.most, self.least = np.asarray(row.most, np.int64), np.asarray(row.least, np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a and b: in floats where all sums stay below 2**53, else in integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * width < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best_of(asked: list[tuple[int, int, int]], queries: np.ndarray, blocks: list[Block], k: int) -> list[tuple[int, int, int, int, int]]:
    """(query block, query place, query id, vec_id, score) of the k best rows of the blocks for each query, ties to the smaller id.

    Per query the blocks are visited in the order of their bound, the sum over terms of the largest product that the block
    allows; when a bound is below the k-th score so far, so are all later ones. A query leaves out its own row."""
    wide = max([queries.shape[1], *(len(b.most) for b in blocks)])
    fill = lambda m: np.pad(m, ((0, 0), (0, wide - m.shape[1])))
    q = fill(queries)
    most, least = fill(_matrix([b.most for b in blocks])), fill(_matrix([b.least for b in blocks]))
    # a positive query term is largest with the block's largest value, a negative one with its smallest
    bound = _product(np.maximum(q, 0), most) + _product(np.minimum(q, 0), least)
    order = np.argsort(-bound, axis=1, kind="stable")
    kept: list[list[tuple[int, int]]] = [[] for _ in asked]  # (-score, id), best first
    waiting = np.arange(len(asked))
    for turn in range(len(blocks)):
        floor = np.array([-kept[i][-1][0] if len(kept[i]) == k else np.iinfo(np.int64).min for i in waiting])
        waiting = waiting[bound[waiting, order[waiting, turn]] >= floor]  # ties of the k-th score may still have smaller ids
        if not len(waiting):
            break
        for b in np.unique(order[waiting, turn]).tolist():
            block, now = blocks[b], waiting[order[waiting, turn] == b]
            scores = _product(q[now], block.vectors)
            for i, row in zip(now.tolist(), scores):
                number, place, _ = asked[i]
                own = place if number == block.number else -1
                least_kept = -kept[i][-1][0] if len(kept[i]) == k else np.iinfo(np.int64).min
                take = np.flatnonzero(row >= max(least_kept, np.partition(row, -k - 1)[-k - 1] if len(row) > k + 1 else least_kept))
                kept[i] = sorted(kept[i] + [(-int(row[j]), int(block.ids[j])) for j in take.tolist() if j != own])[:k]
    return [(*asked[i], vec, -negative) for i in range(len(asked)) for negative, vec in kept[i]]


def search(index: DataFrame, every: int = 50, k: int = 5, chunk: int = 512, shard: int = 32) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every query: the rows of the index whose vec_id is divisible by `every`.

    Queries are packed into chunks of about `chunk` rows and blocks into shards of `shard` blocks. Each chunk is scored
    against each shard in a task of its own, which holds one of each; the k best of every shard are merged by query. Repeated rows
    are rows of their own: each is a query and a candidate, but not its own. No queries or no rows give no rows."""
    blocks = index.agg(F.count(F.lit(1)), F.sum(F.size(F.filter("vec_ids", lambda v: v % every == 0)))).first()  # two numbers
    if not blocks[1]:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, chunks = -(-blocks[0] // shard), -(-blocks[1] // chunk)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                block = Block(row)
                at = np.flatnonzero(block.ids % every == 0)
                if len(at):
                    yield pd.DataFrame([(block.number, at, block.ids[at], int(row.dims), block.vectors[at].tobytes())],
                                       columns=["block", "places", "ids", "dims", "vectors"])

    def spread(column: str, parts: int) -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")
    asked = index.select("block", "vec_ids", "dims", "vectors", "most", "least").mapInPandas(
        cut, "block long, places array<long>, ids array<long>, dims int, vectors binary")
    # every chunk of the stated queries meets every shard of the rows
    left = asked.withColumn("chunk", spread("block", chunks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = index.withColumn("shard", spread("block", shards)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def score(queries: pd.DataFrame, shard_rows: pd.DataFrame) -> pd.DataFrame:
        names, rows = [], []
        for r in queries.itertuples():
            names += [(int(r.block), int(p), int(i)) for p, i in zip(r.places, r.ids)]
            rows += list(np.frombuffer(r.vectors, np.int64).reshape(len(r.ids), int(r.dims)))
        found = best_of(names, _matrix(rows), [Block(r) for r in shard_rows.itertuples()], k) if len(names) and len(shard_rows) else []
        return pd.DataFrame(found, columns=["block", "place", "query_id", "vec_id", "score"], dtype="int64")
    found = left.groupBy("chunk", "shard").cogroup(right.groupBy("chunk", "shard")).applyInPandas(
        score, "block long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "place", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op4_block_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
    FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored) WHERE rank <= 5""")
def op4_block_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best rows for every 50th vector."""
    return search(build(quantized(table(spark, folder, "embeddings"))))
