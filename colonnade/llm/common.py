"""Helpers of the training-data operators."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kept_by_worker(name: str, make: Callable[[], Any]) -> Any:
    """A value that a Python worker makes once and keeps for its later tasks, until one asks for another: workers live as long as the session,
    and what all its operators keep would add up. Functions travel by value, so their own module's globals start anew in every task;
    the interpreter's do not."""
    kept = vars(sys).setdefault("_colonnade_kept", {})
    if name not in kept:
        kept.clear()
        kept[name] = make()
    return kept[name]


def keep_nothing() -> None:
    """Frees what `kept_by_worker` keeps, for tasks that need the memory themselves."""
    vars(sys).get("_colonnade_kept", {}).clear()


def uniform31(*parts: Column) -> Column:
    """A long in [0, 2**31), spread evenly over distinct values of `parts`."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 33)


def bucket_of(hashed: str, buckets: int) -> Column:
    """Number of the equal range of [0, 2**31) that holds `hashed`, out of `buckets`."""
    return F.shiftright(F.col(hashed) * F.lit(buckets), 31)


def buckets_for(total: int) -> int:
    """About the square root of a count: as many ranges as each then has rows."""
    return max(1, math.isqrt(max(0, total - 1)) + 1)


def rank_within(rows: DataFrame, group: str, hashed: str, ties: list[str], total: int) -> DataFrame:
    """Adds `rank` (from 1, by `hashed`, then `ties`) and `group_rows` within each value of `group`, never null.

    A group of any size is cut into ranges of `hashed` with about sqrt(total) rows each: the ranges are counted (with
    partial sums before the shuffle), their counts summed up to offsets, and rows numbered inside their range only."""
    cut = rows.withColumn("__range", bucket_of(hashed, buckets_for(total)))
    counts = cut.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(group)
    offsets = counts.select(
        group, "__range", F.sum("__n").over(over).alias("group_rows"),
        (F.sum("__n").over(over.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    inside = Window.partitionBy(group, "__range").orderBy(hashed, *ties)
    return (cut.join(offsets, [group, "__range"]).withColumn("rank", F.row_number().over(inside) + F.col("__before"))
            .drop("__range", "__before"))
