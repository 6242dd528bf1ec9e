"""Embedding of column texts and similar pairs across tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.session import stage

DIMENSIONS = 256
# Vectors per block: a comparison task holds two blocks.
BLOCK = 2000
# Most vectors by whose distances blocks are told apart, the rows they are picked from (at least 64 for each), and rings of distances around each.
PIVOTS, PIVOT_SAMPLE, RINGS = 64, 4096, 64
THRESHOLD = 0.85


def hashed_vectors(df: DataFrame, keys: list[str], text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Default embedder: counts of hashed character trigrams, scaled to length one; empty for empty texts."""
    lower = F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" "))
    grams = df.select(*keys, F.explode(F.regexp_extract_all(lower, F.lit("(?s)(?=(...))"), 1)).alias("gram"))
    counts = grams.groupBy(
        *keys, F.pmod(F.xxhash64("gram"), F.lit(dimensions)).cast("int").alias("slot")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    # at most `dimensions` entries per text
    maps = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"),
                                     F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)),
                      lambda i: (F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)) / F.col("len")).cast("float"))
    return df.join(maps.select(*keys, vec.alias("vec")), keys, "left").withColumn("vec", F.coalesce("vec", F.array().cast("array<float>")))


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float] | None]]) -> DataFrame:
    """Adds ``vec`` from a user's batch embedder; texts it fails on get an empty vector."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                vectors = embedder(batch[text].tolist())
            except Exception:  # noqa: BLE001 - a failed batch is retried text by text
                vectors = []
                for value in batch[text]:
                    try:
                        vectors.append(embedder([value])[0])
                    except Exception:  # noqa: BLE001
                        vectors.append([])
            yield batch.assign(vec=[list(v) if v is not None else [] for v in vectors])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", vec array<float>"
    return df.mapInPandas(run, schema)


def _unit(vecs: DataFrame) -> DataFrame:
    """(table, column, vec) scaled to length one; vectors that are null, empty or zero, or hold a null, are left out."""
    @F.pandas_udf("array<double>")
    def scaled(vec: pd.Series) -> pd.Series:
        out = []
        for v in vec:
            x = np.asarray([] if v is None else v, dtype=float)
            length = np.sqrt(x @ x)
            out.append(x / length if length > 0 and np.isfinite(length) else None)
        return pd.Series(out, dtype=object)
    return vecs.select(F.col("table").cast("string").alias("table"), F.col("column").cast("string").alias("column"), scaled("vec").alias("vec")).filter("vec IS NOT NULL")


def _pivots(unit: DataFrame, number: int) -> np.ndarray:
    """Up to ``number`` vectors far from each other, out of the `PIVOT_SAMPLE` rows of smallest hash. Only the pruning depends on the choice."""
    rows = unit.orderBy(F.xxhash64("table", "column"), "table", "column").limit(PIVOT_SAMPLE).select("vec").collect()
    vectors = np.array([r["vec"] for r in rows], dtype=float)
    if not len(vectors):
        return vectors
    chosen, nearest = [0], 2 - 2 * vectors @ vectors[0]
    while len(chosen) < min(number, len(vectors) // 64) and nearest.max() > 1e-9:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, 2 - 2 * vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _blocks(unit: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """Adds ``away``, the distances to all pivots, and ``block``: the nearest pivot, a ring of distances around it, and a part of the ring by hash where
    it has more than ``block`` vectors."""
    @F.pandas_udf("array<double>")
    def away(vec: pd.Series) -> pd.Series:
        there = vec.notna().tolist()  # Spark may ask before it drops the rows without a vector
        known = iter(np.sqrt(np.maximum(2 - 2 * np.stack(vec[there].tolist()) @ pivots.T, 0.0)) if any(there) else ())
        return pd.Series([next(known) if t else None for t in there], dtype=object)
    near = F.array_position("away", F.array_min("away")).cast("int")
    placed = unit.withColumn("away", away("vec")).withColumn("cell", near).withColumn("own", F.array_min("away"))
    cuts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.percentile_approx(
        "own", F.array(*[F.lit((i + 1) / RINGS) for i in range(RINGS - 1)]), F.lit(1_000)).alias("cuts"))
    step = F.ceil(F.lit(RINGS) / F.greatest(F.lit(1), F.least(F.lit(RINGS), F.ceil(F.col("members") / block))))
    ring = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("own"))) / step).cast("int")
    ringed = placed.join(F.broadcast(cuts), "cell").withColumn("ring", ring).drop("cuts", "members", "own")  # a row per pivot
    sizes = ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("members"))
    part = F.pmod(F.xxhash64("table", "column"), F.ceil(F.col("members") / block))
    return ringed.join(F.broadcast(sizes), ["cell", "ring"]).select(  # at most `RINGS` rows per pivot
        "table", "column", "vec", "away", F.concat_ws(".", "cell", "ring", part).alias("block"))


def block_pairs(placed: DataFrame, pivots: int, threshold: float) -> DataFrame:
    """(a, b) with a <= b: pairs of blocks that can hold vectors with a cosine of ``threshold``, by the bounds of all pivots.

    Vectors that close are at most `reach` apart, so their distances to any pivot differ by no more. Blocks meet as rows with a common key: the squares
    that their distances to the first two pivots cover, one side widened by the reach; the bounds of the other pivots then rule pairs out."""
    reach = math.sqrt(max(2 - 2 * threshold, 0.0)) + 1e-6
    width = max(reach, 0.05)
    spans = placed.select("block", F.posexplode("away").alias("at", "d")).groupBy("block", "at").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    in_order = F.sort_array(F.collect_list(F.struct("at", "lo", "hi")))  # one entry per pivot
    bounds = spans.groupBy("block").agg(in_order.alias("s")).select("block", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))

    def keyed(side: str, wider: float) -> DataFrame:
        rows = bounds.select(F.col("block").alias(side), F.col("lo").alias(f"lo_{side}"), F.col("hi").alias(f"hi_{side}"))
        for i in range(min(2, pivots)):
            first, last = [F.floor((F.col(f"{end}_{side}")[i] + sign * wider) / width) for end, sign in (("lo", -1), ("hi", 1))]
            rows = rows.withColumn(f"k{i}", F.explode(F.sequence(first, last)))
        return rows
    keys = [f"k{i}" for i in range(min(2, pivots))]
    gaps = F.zip_with("lo_b", "hi_a", lambda lo, hi: lo - hi), F.zip_with("lo_a", "hi_b", lambda lo, hi: lo - hi)
    met = keyed("a", reach).join(keyed("b", 0.0), keys).filter(F.col("a") <= F.col("b"))
    return met.filter((F.array_max(gaps[0]) <= reach) & (F.array_max(gaps[1]) <= reach)).select("a", "b").distinct()


def similar_columns(vecs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """All pairs (table_a < table_b) of vectors with cosine at or above ``threshold``; exact.

    Input columns: table, column, vec (of one length). Vectors are put into blocks of bounded size around pivot vectors; only blocks whose distances to
    all pivots allow a pair meet, and each such pair of blocks is one bounded matrix product. Vectors that are null, empty or zero take no part.
    """
    unit = _unit(vecs)
    points = _pivots(unit, pivots)
    if not len(points):
        return vecs.sparkSession.createDataFrame([], "table_a string, column_a string, table_b string, column_b string, similarity double")
    placed = stage(_blocks(unit, points, block), "placed_vectors")
    tasks = block_pairs(placed, len(points), threshold).withColumn("task", F.concat_ws("-", "a", "b"))
    sides = tasks.select("task", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(
        tasks.filter("a < b").select("task", F.col("b").alias("block"), F.lit(1).alias("side")))
    work = placed.select("table", "column", "vec", "block").join(sides, "block").select("task", "side", "table", "column", "vec")
    return work.groupBy("task").applyInPandas(
        lambda pdf: _block_pairs(pdf, threshold), "table_a string, column_a string, table_b string, column_b string, similarity double")


def _block_pairs(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Pairs of one block pair; a block against itself comes as side 0 only."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    same = right.empty
    if same:
        right = left
    sims = np.stack(left["vec"].to_numpy()) @ np.stack(right["vec"].to_numpy()).T
    rows, cols = np.nonzero(sims >= threshold)
    lt, rt = left["table"].to_numpy()[rows], right["table"].to_numpy()[cols]
    lc, rc = left["column"].to_numpy()[rows], right["column"].to_numpy()[cols]
    keep = (lt < rt) if same else (lt != rt)
    swap = keep & (lt > rt)
    out = pd.DataFrame({"table_a": np.where(swap, rt, lt), "column_a": np.where(swap, rc, lc), "table_b": np.where(swap, lt, rt),
                        "column_b": np.where(swap, lc, rc), "similarity": sims[rows, cols]})
    return out[keep]


def with_context(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Attaches both sides' text (table, column, text) to each pair."""
    a = texts.select(F.col("table").alias("table_a"), F.col("column").alias("column_a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("table").alias("table_b"), F.col("column").alias("column_b"), F.col("text").alias("text_b"))
    return pairs.join(a, ["table_a", "column_a"]).join(b, ["table_b", "column_b"])


def pairs_per_table(pairs: DataFrame) -> DataFrame:
    """Lists each pair under both of its tables."""
    return pairs.select(F.explode(F.array("table_a", "table_b")).alias("table"), *pairs.columns)
