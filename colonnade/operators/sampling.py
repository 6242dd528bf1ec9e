"""Row samples by position and repeatable random samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from colonnade.operators import stats
from colonnade.session import stage


def _at_rank(df: DataFrame, order_by: str, rank: int) -> Row:
    """``key`` that stands at a 0-based rank of an orderable column (NULL first) and ``upto``, the number of rows up to its last. Distinct keys are
    dealt by ranges and each range sums up by itself; one row per range is summed across."""
    counts = df.groupBy(F.col(order_by).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    ranged = stage(counts.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "rank_counts")
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("size"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    before = sizes.select("part", (F.sum("size").over(order) - F.col("size")).alias("before"))
    inside = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.sum("n").over(inside))  # one row per range
    return found.filter((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)).select("key", "upto").first()


def head_mid_tail(df: DataFrame, order_by: str, n: int = 10) -> DataFrame:
    """First, middle and last rows by a key of any orderable type, at most ``n`` distinct rows. Rows of equal keys
    are interchangeable.

    Head and tail are top-k; the middle starts at the key of the wanted rank, found without sorting the
    table in one task. All pieces hold at most ``n`` rows.
    """
    total = df.count()
    if total <= n:
        return df
    third = max(1, n // 3)
    first, last, middle = third, third, n - 2 * third
    if middle <= 0:
        first, last, middle = (n + 1) // 2, n // 2, 0
    key, tie = F.col(order_by), F.xxhash64(*[stats.quoted(c) for c in df.columns])
    parts = [df.orderBy(F.asc(order_by), tie).limit(first), df.orderBy(F.desc(order_by), tie.desc()).limit(last)]
    if middle > 0:
        start = max(0, total // 2 - middle // 2)
        at = _at_rank(df, order_by, start)
        own = min(middle, at["upto"] - start)
        value = F.lit(at["key"]).cast(df.schema[order_by].dataType)
        near = df.filter(key.eqNullSafe(value)).orderBy(tie).limit(first + own + last)
        parts.append(near.exceptAll(parts[0].unionByName(parts[1])).limit(own))  # rows of a key that reaches into head or tail come once
        if own < middle:
            parts.append(df.filter(key.isNotNull() if at["key"] is None else key > value).orderBy(F.asc(order_by), tie).limit(middle - own))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct().orderBy(F.asc(order_by), tie).limit(n)


def head_json(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    """First rows as one JSON text each."""
    return df.orderBy(order_by).limit(n).select(F.to_json(F.struct(*df.columns)).alias("record"))
