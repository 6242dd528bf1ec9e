"""Exact selection by rank without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.session import stage

# Groups up to this many rows are ranked in one task; larger ones are narrowed first.
RANK_GROUP_LIMIT = 1_000_000
SPLITS = 64


def values_at_ranks(rows: DataFrame, wanted: dict[str, list[int]], limit: int | None = None) -> dict[tuple[str, int], float]:
    """Value at each 0-based rank, from rows (key, x, n) with weight n.

    Each round cuts the range that holds a wanted rank into equally filled pieces and keeps the one that
    holds it, so the candidates shrink by ``SPLITS`` per round until a bounded group remains. The driver
    only sees the bounds: a few numbers per key and rank.
    """
    limit = limit or RANK_GROUP_LIMIT
    rows = stage(rows.groupBy("key", "x").agg(F.sum("n").alias("n")), "ranks")  # distinct values, so that every round narrows; read by all rounds
    spark = rows.sparkSession
    # open range per (key, rank): values in (low, high], `before` = weight at or below low
    ranges = {(k, r): (float("-inf"), float("inf"), 0) for k, ranks in wanted.items() for r in ranks}
    found: dict[tuple[str, int], float] = {}
    while ranges:
        cells = sorted({(k, low, high, before) for (k, _), (low, high, before) in ranges.items()})
        bounds = spark.createDataFrame(
            [(i, *c) for i, c in enumerate(cells)], "cell int, key string, low double, high double, before bigint")
        inside = rows.join(F.broadcast(bounds), "key").filter(
            ((F.col("x") > F.col("low")) | (F.col("low") == float("-inf"))) & (F.col("x") <= F.col("high")))
        sizes = {r["cell"]: r["size"] for r in inside.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).collect()}
        small = [i for i in range(len(cells)) if sizes[i] <= limit]
        large = [i for i in range(len(cells)) if sizes[i] > limit]
        index = {c: i for i, c in enumerate(cells)}
        nxt = {}
        if small:
            targets = spark.createDataFrame(
                [(index[k, *rng], r) for (k, r), rng in ranges.items() if index[k, *rng] in small], "cell int, rank bigint")
            running = inside.filter(F.col("cell").isin(small)).withColumn(
                "upto", F.col("before") + F.sum("n").over(Window.partitionBy("cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
            hits = running.join(F.broadcast(targets), "cell").filter(
                (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
            for r in hits.select("key", "rank", "x").collect():
                found[r["key"], r["rank"]] = r["x"]
        if large:
            grid = F.array(*[F.lit((i + 1) / SPLITS) for i in range(SPLITS - 1)])
            found_cuts = {r["cell"]: r["cuts"] for r in inside.filter(F.col("cell").isin(large)).groupBy("cell").agg(
                F.percentile_approx("x", grid, F.lit(1000)).alias("cuts")).collect()}
            cuts = spark.createDataFrame(list(found_cuts.items()), "cell int, cuts array<double>")
            pieces = inside.join(F.broadcast(cuts), "cell").withColumn("piece", F.expr("size(filter(cuts, c -> c < x))"))
            weights: dict[int, dict[int, int]] = {}
            for r in pieces.groupBy("cell", "piece").agg(F.sum("n").alias("n")).collect():
                weights.setdefault(r["cell"], {})[r["piece"]] = r["n"]
            for (k, r), (low, high, before) in ranges.items():
                cell = index[k, low, high, before]
                if cell not in large:
                    continue
                edges = [low, *found_cuts[cell], high]
                for piece in sorted(weights[cell]):
                    if before + weights[cell][piece] > r:
                        nxt[k, r] = (edges[piece], edges[piece + 1], before)
                        break
                    before += weights[cell][piece]
        ranges = nxt
    return found
