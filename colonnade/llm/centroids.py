"""Centroid clustering in whole numbers; nearest centroids by equal-average equal-variance search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.registry import query, table
from colonnade.session import stage


def integers(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of a matrix: longs where no step of the search can leave 2**62, Python integers otherwise."""
    scaled = np.floor(rows.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() * scaled.shape[1] <= 2**29:
        return scaled.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(scaled)


class Centroids:
    """Centroids in the order of their component sums (their means times the number of components)."""

    def __init__(self, rows: list[list[int]]):
        self.rows, self.dims = rows, len(rows[0])
        small = max(abs(x) for r in rows for x in r) * self.dims <= 2**29
        matrix = np.array(rows, np.int64 if small else object)
        self.number = np.argsort(np.array([sum(r) for r in rows], object), kind="stable").astype(np.int64)
        self.matrix = matrix[self.number]
        self.sums, self.spread = measures(self.matrix)


def measures(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and the whole part of the deviation, both times the number of components."""
    sums = x.sum(axis=1)
    spread = x.shape[1] * (x * x).sum(axis=1) - sums * sums
    return sums, np.sqrt(spread.astype(np.float64)).astype(np.int64) if x.dtype != object else np.frompyfunc(math.isqrt, 1, 1)(spread)


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller number), its squared distance, and how many distances were computed.

    With n components, n * distance is at least the square of the difference of the sums plus that of the deviations. Each vector
    walks outward from its own sum through the sorted centroids, the nearer side first, and stops when the first square alone is
    too large, as it only grows; centroids that both squares rule out are skipped. Deviations are whole parts of roots, so two are
    taken off their difference: nothing is ruled out wrongly. All else is in whole numbers."""
    if x.dtype != centroids.matrix.dtype:
        x = x.astype(object)
    matrix = centroids.matrix.astype(x.dtype)
    sums, spread = measures(x)
    c_sums, c_spread = centroids.sums.astype(x.dtype), centroids.spread.astype(x.dtype)
    n, k, none = centroids.dims, len(matrix), 1 << 62 if x.dtype != object else 1 << 2200
    limit = np.full(len(x), none, x.dtype)  # n times the best distance so far
    found, high = np.zeros(len(x), np.int64), np.searchsorted(c_sums, sums)
    low, open_, computed = high - 1, np.arange(len(x)), 0
    while len(open_):
        lo, hi = low[open_], high[open_]
        left = np.where(lo >= 0, sums[open_] - c_sums[np.maximum(lo, 0)], none)
        right = np.where(hi < k, c_sums[np.minimum(hi, k - 1)] - sums[open_], none)
        down = left <= right
        gap, at = np.where(down, left, right), np.where(down, lo, hi)
        going = gap < none
        going[going] = gap[going] * gap[going] <= limit[open_[going]]
        open_, at, gap, down = open_[going], at[going], gap[going], down[going]
        low[open_[down]] -= 1
        high[open_[~down]] += 1
        apart = np.maximum(np.abs(spread[open_] - c_spread[at]) - 2, 0)
        asked = np.flatnonzero(gap * gap + apart * apart <= limit[open_])
        rows, at = open_[asked], at[asked]
        away = x[rows] - matrix[at]
        distance, number, computed = n * (away * away).sum(axis=1), centroids.number[at], computed + len(rows)
        better = (distance < limit[rows]) | ((distance == limit[rows]) & (number < found[rows]))
        limit[rows[better]], found[rows[better]] = distance[better], number[better]
    return found, limit // n, computed


def usable(vectors: DataFrame, dimensions: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v of the rows whose vector has exactly `dimensions` components, none of them null, NaN or infinite."""
    x = F.col(f"`{vector}`")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.where((F.size(x) == dimensions) & ~bad).select(F.col(f"`{key}`").cast("long").alias("vec_id"), x.alias("v"))


def starts(kept: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; rows with equal ids by their components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select("v", name.alias("name")).orderBy("name", "v").limit(k).collect()  # k rows
    return [[math.floor(float(x) * scale) for x in r["v"]] for r in rows]


def _matrix(vectors: pd.Series, scale: int) -> np.ndarray:
    return integers(np.stack(vectors.to_numpy()), scale)


def moved(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The floor of the mean, by component, of the vectors nearest to each centroid; a centroid without vectors stays.

    A task sends one sum per centroid and component, Spark adds them up, and the driver gets as many numbers as the centroids have."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, count, total = Centroids(centroids), {}, {}
        for b in batches:
            if len(b):
                x = _matrix(b["v"], scale)
                number = nearest(x, search)[0]
                for c in np.unique(number).tolist():
                    own = x[number == c]
                    count[c] = count.get(c, 0) + len(own)
                    total[c] = total.get(c, 0) + own.sum(axis=0).astype(object)
        yield pd.DataFrame([(c, i, count[c], Decimal(int(t))) for c in count for i, t in enumerate(total[c])], columns=["cluster", "place", "n", "total"])
    parts = kept.select("v").mapInPandas(run, "cluster int, place int, n long, total decimal(38,0)")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["cluster"]][r["place"]] = int(r["total"]) // r["n"]
    return out


def assigned(kept: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """vec_id, cluster and distance (squared) of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Centroids(centroids)
        for b in batches:
            if len(b):
                number, distance, _ = nearest(_matrix(b["v"], scale), search)
                yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64").array, "cluster": number.astype(np.int32), "distance": distance})
    return kept.mapInPandas(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dimensions: int = 64, seed: str = "3",
            key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster and squared distance of every usable row; the final centroids) after `rounds` rounds of nearest centroids and means.

    Vectors are taken as floor(scale * x). Rows of other lengths, and those with null, NaN or infinite components, take no part; rows without id do,
    and equal rows count as often as they are. Fewer usable rows than k make fewer centroids, none give no rows. Further columns are
    ignored. Vectors never leave their tasks: per round the k centroids go out and k sums come back. Scaled components of 2**62 and
    more, and distances beyond a long, raise an error."""
    kept = stage(usable(vectors, dimensions, key, vector), "vectors")
    centroids = starts(kept, k, seed, scale)
    if not centroids:
        return kept.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    for _ in range(rounds):
        centroids = moved(kept, centroids, scale)
    return stage(assigned(kept, centroids, scale), "assigned"), centroids


def summary(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds each cluster's sum of distances, the sum over all, and a digest of the final centroid; one small row per centroid is joined."""
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, s, sum(sums.values()), sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    names = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(names), "cluster").select("vec_id", *[c for c in rows.columns if c not in ("vec_id", "cluster", "distance")],
                                                           "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, scale: int = 1024, dimensions: int = 64, seed: str = "3") -> str:
    """The same in SQL, one pair of tables per round."""
    away = "list_sum(list_transform(range(1, len(v.q) + 1), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"

    def near(centroids: str) -> str:
        return f"SELECT v.vec_id, v.q, v.h, min({{'distance': {away}::BIGINT, 'cluster': c.cluster}}) AS hit FROM v, {centroids} c GROUP BY v.vec_id, v.q, v.h"
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q, sha256('{seed}:' || vec_id) AS h FROM embeddings
    WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS cluster, q FROM v ORDER BY h LIMIT {k})"]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near(f'c{r}')})")
        parts.append(f"""s{r} AS (SELECT hit.cluster AS cluster, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dimensions + 1}) t(i) GROUP BY hit.cluster, i)""")
        parts.append(f"""m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{r} GROUP BY cluster)""")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    parts.append(f"a AS MATERIALIZED ({near(f'c{rounds}')})")
    return f"""WITH {', '.join(parts)}
SELECT a.vec_id, hit.cluster AS cluster, hit.distance AS distance, (sum(hit.distance) OVER (PARTITION BY hit.cluster))::BIGINT AS cluster_inertia,
    (sum(hit.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a JOIN c{rounds} c ON c.cluster = hit.cluster"""


@query("op13_centroid_search", _sql())
def op13_centroid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Eight clusters of all vectors of 64 components."""
    return summary(*cluster(table(spark, folder, "embeddings")))
