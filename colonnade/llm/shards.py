"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.llm.common import bucket_of, buckets_for, rank_within, uniform31
from colonnade.llm.registry import query, table
from colonnade.session import stage


def interleave(docs: DataFrame, shards: int = 24, seed: int = 17, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Adds `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard) to all rows of `docs`.

    Rows are shuffled by a seeded hash within each source and ranked there; the rank, less a random phase of its source
    between 0 and 1, over the source's row count is the row's fractional rank. In the order of fractional ranks every stretch holds
    each source in its overall proportion, so the order is cut into shards whose row counts differ by one at most. A
    shard's count of a source differs from the source's share of it by two rows, and by that share of the rows by which random phases move
    a cut (about half the square root of the number of sources).

    No source is gathered in one task: ranks and global positions are numbered inside ranges of about sqrt(rows) rows
    and shifted by the summed counts of the ranges before. A null source is a source of its own; null keys and repeated
    rows are ordinary rows (equal rows are interchangeable); an empty table gives an empty result. Columns of docs named
    shard or slot are replaced, all others are kept whatever their name."""
    others = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = stage(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        F.to_json(F.struct(F.col(f"`{source}`").alias("s"))).alias("stratum"),  # null and text apart
        uniform31(F.lit(seed), F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in others]).alias("shuffled"),
        F.xxhash64(*[F.col(f"`{c}`") for c in others]).alias("content")), "interleave")
    total = rows.count()
    ranked = rank_within(rows, "stratum", "shuffled", ["content"], total)
    phase = uniform31(F.lit(seed + 1), F.col("stratum")) / F.lit(float(2**31))
    spread = ranked.withColumn("fraction", (F.col("rank") - phase) / F.col("group_rows"))
    placed = spread.withColumn("position31", F.least(F.floor(F.col("fraction") * F.lit(float(2**31))), F.lit(2**31 - 1)))
    placed = stage(placed.select("row", "stratum", "shuffled", "content", "fraction", bucket_of("position31", buckets_for(total)).alias("stretch")),
                   "interleave")
    # one row per stretch, about sqrt(rows) of them
    before = placed.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).select(
        "stretch", (F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inside = Window.partitionBy("stretch").orderBy("fraction", "stratum", "shuffled", "content")
    at = placed.join(before, "stretch").select("row", (F.row_number().over(inside) - 1 + F.col("before")).alias("at"))
    small, more = divmod(total, shards)  # the first `more` shards take one row more
    edge = more * (small + 1)
    first = F.col("at") < edge
    rest = F.col("at") - edge
    return at.select(
        "row.*",
        F.when(first, F.floor(F.col("at") / (small + 1))).otherwise(more + F.floor(rest / max(1, small))).cast("int").alias("shard"),
        F.when(first, F.col("at") % (small + 1)).otherwise(rest % max(1, small)).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, order: str = "slot") -> None:
    """Writes a sharded table as one folder per shard, each file in slot order."""
    sharded.repartition("shard", F.floor(F.col(order) / 1_000_000)).sortWithinPartitions("shard", order).write.partitionBy("shard").parquet(path)


@query("op8_stratified_interleaving")
def op8_stratified_interleaving(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of all documents under the law `rows`. DuckDB has no crc32, so there is no SQL."""
    text = F.col("text").cast("binary")
    docs = table(spark, folder, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"))
    out = interleave(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
