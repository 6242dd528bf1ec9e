"""Value frequencies and what is read off them: cardinality, modes, distribution, quantiles.

``value_freq`` is one shuffle keyed by (column, value). The shuffle is pre-aggregated on the map side,
so a value that fills a third of a table costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.operators import stats
from colonnade.operators.ranks import values_at_ranks
from colonnade.session import stage

MODE_LIMIT = 5
# Above this many distinct values a quantile is found by narrowing ranges instead of ranking the column in one task.
QUANTILE_GROUP_LIMIT = 1_000_000
QUANTILES = (0.25, 0.5, 0.75)


def num_text(value: Column) -> Column:
    """Number as its shortest exact decimal text (one rule for every text output): plain digits, or the exponent form where
    18 places before and after the point don't hold it."""
    shortest = value.cast("double").cast("string")
    plain = shortest.try_cast(T.DecimalType(38, 18))
    exact = plain.cast("double") == value.cast("double")
    return F.when(exact, F.regexp_replace(plain.cast("string"), r"\.?0+$", "")).otherwise(shortest)


# value of column {c} in its slot, per type class
_SLOT = {
    "integral": ("i", "cast({c} AS bigint)"),
    "fractional": ("d", "cast({c} AS double)"),
    "temporal": ("i", "unix_micros(cast({c} AS timestamp))"),
    "interval": ("i", "cast(cast(cast({c} AS interval second) AS decimal(18, 6)) * 1000000 AS bigint)"),
    "array": ("s", "md5(to_json({c}))"),
    "string": ("s", "cast({c} AS string)"),
    "boolean": ("s", "cast({c} AS string)"),
    "digest": ("s", "CASE WHEN length({c}) > 32 THEN md5({c}) ELSE {c} END"),
}


# Up to this many columns each get their own branch (a scan of that one column); wider tables share branches.
BRANCHES = 64


def _label(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _branch(df: DataFrame, unit: str, columns: list[tuple[str, str, str]]) -> DataFrame:
    """Counts the values of a few (label, cell, kind) columns that share a slot, in one scan."""
    slot = _SLOT[columns[0][2]][0]
    types = {"i": "bigint", "d": "double", "s": "string"}
    if len(columns) == 1:
        label, cell, kind = columns[0]
        counts = df.selectExpr(_SLOT[kind][1].replace("{c}", cell) + " AS v").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        name = f"{_label(label)} AS column_name"
    else:
        rows = [f"struct({_label(label)} AS column_name, {_SLOT[kind][1].replace('{c}', cell)} AS v)" for label, cell, kind in columns]
        counts = df.selectExpr(f"inline(array({', '.join(rows)}))").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
        name = "column_name"
    return counts.selectExpr(name, f"'{unit}' AS unit", *[
        (f"v AS {k}" if k == slot else f"cast(NULL AS {t}) AS {k}") for k, t in types.items()], "n")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def value_freq(df: DataFrame, columns: list[str] | None = None, list_columns: list[str] = (),
               with_missing: bool = False, with_sizes: bool = False) -> DataFrame:
    """(column_name, unit, i, d, s, n): how often each value occurs; exactly one of i, d, s is set.

    Integral and temporal values use ``i`` (epoch microseconds), fractions ``d``, the rest ``s``.
    Each column is its own narrow scan and aggregate, so a columnar source is read once in total.
    ``list_columns`` are counted twice: their cells (long ones as digests) and their tokens. ``with_missing``
    keeps one row per column with all three NULL; ``with_sizes`` adds the units 'length' (text length) and 'size'
    (tokens per cell) for text and list columns.
    """
    df = stats.drop_nan(df)
    names = list(columns or df.columns)
    kinds, types = stats.kinds_of(df), {f.name: f.dataType for f in df.schema.fields}
    slots: dict[str, list[tuple[str, str, str]]] = {}
    for name in names:
        kind = "digest" if name in list_columns and kinds[name] == "string" else kinds[name]
        slots.setdefault(_SLOT[kind][0], []).append((name, "`" + name.replace("`", "``") + "`", kind))
    width = -(-len(names) // BRANCHES)
    parts = [_branch(df, "cell", group[k:k + width]) for group in slots.values() for k in range(0, len(group), width)]
    for name in names:
        if name in list_columns:
            if kinds[name] == "array":
                element, cells = stats.column_kind(types[name].elementType), df.select(F.explode(stats.quoted(name)).alias("t"))
            else:
                element, cells = "string", stats.spread(df.select(stats.quoted(name))).select(F.explode(stats.tokens(name)).alias("t"))
            parts.append(_branch(cells.filter("t IS NOT NULL"), "token", [(name, "t", element)]))
        sizes = {}
        if with_sizes and kinds[name] == "string":
            sizes["length"] = F.length(stats.quoted(name))
        if with_sizes and name in list_columns:
            sizes["size"] = F.size(stats.quoted(name) if kinds[name] == "array" else stats.tokens(name))
        for unit, size in sizes.items():
            cells = df.filter(stats.quoted(name).isNotNull()).select(size.alias("t"))
            parts.append(_branch(cells, unit, [(name, "t", "integral")]))
    out = _union(parts)
    return out if with_missing else out.filter(PRESENT)


PRESENT = "(i IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL)"


def freq_facts(freq: DataFrame) -> DataFrame:
    """Per (column, unit): everything that follows from the frequencies with bounded state.

    Patterns and number parsing run once per distinct value, not once per row.
    """
    x = f"coalesce(d, cast(i AS double), {stats.NUMBER_SQL.replace('{c}', 's')})"
    rows = freq.selectExpr("*", f"{x} AS x", f"CASE WHEN {PRESENT} THEN n END AS m")
    return rows.groupBy("column_name", "unit").agg(*[F.expr(e) for e in (
        "sum(n) AS total", "coalesce(sum(m), 0) AS nonnull", "count(m) AS distinct_n", "max(m) AS top_n",
        "min(x) AS num_min", "max(x) AS num_max", "sum(x * n) / sum(CASE WHEN x IS NOT NULL THEN n END) AS num_avg",
        "sum(CASE WHEN x IS NOT NULL THEN n ELSE 0 END) AS n_number", "sum(CASE WHEN x % 1 = 0 THEN n ELSE 0 END) AS n_whole",
        f"sum(CASE WHEN {stats.ENCODED_DATE.replace('{c}', 'i')} THEN n ELSE 0 END) AS n_encoded_date",
        "min(i) AS i_min", "max(i) AS i_max",
        f"sum(CASE WHEN {stats.BOOLEAN_SQL.replace('{c}', 's')} THEN n ELSE 0 END) AS n_boolean",
        f"sum(CASE WHEN {stats.DATE_SQL.replace('{c}', 's')} IS NOT NULL THEN n ELSE 0 END) AS n_date",
        f"sum(CASE WHEN {stats.TIME_SQL.replace('{c}', 's')} IS NOT NULL THEN n ELSE 0 END) AS n_time",
        f"sum(CASE WHEN i IS NOT NULL OR d IS NOT NULL OR s RLIKE r'{stats.NUMERIC_TOKEN}' THEN n ELSE 0 END) AS n_numeric",
        "sum(CASE WHEN i IS NOT NULL OR s RLIKE '^[0-9]+$' THEN n ELSE 0 END) AS n_digits",
        "min(s) AS text_min", "max(s) AS text_max",
    )])


def value_text(kind: Column) -> Column:
    """Readable form of a frequency row's value, given the column's type class."""
    return F.coalesce(
        F.when(kind == "temporal", stats.iso_text(F.timestamp_micros("i"))).otherwise(F.col("i").cast("string")),
        num_text(F.col("d")), F.col("s"))


def number_of() -> Column:
    """The row's value as a number, NULL for texts."""
    return F.coalesce(F.col("d"), F.col("i").cast("double"))


def freq_summary(freq: DataFrame) -> DataFrame:
    """Per (column, unit): distinct values, counted values, largest count."""
    return freq.groupBy("column_name", "unit").agg(
        F.count(F.lit(1)).alias("distinct_n"), F.sum("n").alias("counted"), F.max("n").alias("top_n"))


def top_values(freq: DataFrame, limit: int = MODE_LIMIT) -> DataFrame:
    """First ``limit`` values per (column, unit) by count descending, then value ascending.

    The rank filter is applied on each map task before the shuffle, so no task sees a whole column.
    """
    order = Window.partitionBy("column_name", "unit").orderBy(F.desc("n"), "i", "d", "s")
    return freq.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def first_values(freq: DataFrame, limit: int = MODE_LIMIT) -> DataFrame:
    """First ``limit`` distinct values per (column, unit) in ascending order."""
    order = Window.partitionBy("column_name", "unit").orderBy("i", "d", "s")
    return freq.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def mode_values(freq: DataFrame, kinds: Column, limit: int = MODE_LIMIT) -> DataFrame:
    """Per (column, unit): values tied for the largest count, ascending, at most ``limit``."""
    top = top_values(freq, limit).withColumn("value", value_text(kinds))
    picked = top.groupBy("column_name", "unit").agg(
        F.max("n").alias("top_n"), F.sort_array(F.collect_list(F.struct("rank", "n", "value"))).alias("rows"))
    return picked.select("column_name", "unit", F.expr("transform(filter(rows, r -> r.n = top_n), r -> r.value)").alias("mode_values"))


def distribution(summary: DataFrame) -> DataFrame:
    """Adds top_value_frequency and uniformity; 0 and 0 for constant or empty columns, no unique_count there."""
    several = F.col("distinct_n") > 1
    share = F.col("top_n") / F.col("counted")
    return summary.withColumns({
        "top_value_frequency": F.when(several, share).otherwise(F.lit(0.0)),
        "uniformity": F.when(several, 1 - share).otherwise(F.lit(0.0)),
        "unique_count": F.when(several, F.col("distinct_n")),
    })


def quantiles(rows: DataFrame, large: list[str] = (), probs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Exact quantiles with linear interpolation per column, from (column_name, x, n) rows with distinct values.

    Columns with a bounded number of distinct values are ranked by a running weight; those named in
    ``large`` are resolved by rank narrowing, which never holds a whole column in one task.
    """
    # x is distinct but for integers beyond 2**53, which share doubles: there, equal x are one value
    far = F.abs("x") >= 2.0**53
    rows = rows.filter(~far).unionByName(rows.filter(far).groupBy("column_name", "x").agg(F.sum("n").alias("n")))
    small = rows.filter(~F.col("column_name").isin(list(large))) if large else rows
    totals = small.groupBy("column_name").agg((F.sum("n") - 1).alias("last"))  # one row per column
    order = Window.partitionBy("column_name").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = small.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(totals), "column_name")
    at = "max(CASE WHEN upto - n <= {r} AND {r} < upto THEN x END)"
    cuts = []
    for p in probs:
        low = at.replace("{r}", f"floor({p}D * last)")
        high = at.replace("{r}", f"ceil({p}D * last)")
        cuts.append(f"{low} + ({high} - {low}) * max({p}D * last - floor({p}D * last))")
    out = ranked.groupBy("column_name").agg(F.expr(f"array({', '.join(cuts)})").alias("q"))
    if large:
        out = out.unionByName(_large_quantiles(rows, list(large), probs))
    return out


def _large_quantiles(freq: DataFrame, large: list[str], probs: tuple[float, ...]) -> DataFrame:
    rows = freq.filter(F.col("column_name").isin(large))
    totals = {r["column_name"]: r["n"] for r in rows.groupBy("column_name").agg(F.sum("n").alias("n")).collect()}
    wanted = {name: sorted({k for p in probs for k in _ends(total, p)}) for name, total in totals.items()}
    found = values_at_ranks(rows.select(F.col("column_name").alias("key"), "x", "n"), wanted)
    out = []
    for name, total in totals.items():
        values = []
        for p in probs:
            low, high = _ends(total, p)
            part = p * (total - 1) - low
            values.append(found[name, low] + (found[name, high] - found[name, low]) * part)
        out.append((name, values))
    return freq.sparkSession.createDataFrame(out, "column_name string, q array<double>")


def _ends(total: int, p: float) -> tuple[int, int]:
    low = int(p * (total - 1))
    return low, min(low + 1, total - 1)


def exact_quantiles(rows: DataFrame, probs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Quantiles of (column_name, x, n) rows of unknown size: counts the distinct values first."""
    rows = stage(rows, "quantile_rows")
    sizes = rows.groupBy("column_name").count().filter(F.col("count") > QUANTILE_GROUP_LIMIT).collect()
    return quantiles(rows, [r["column_name"] for r in sizes], probs)


def moments(rows: DataFrame, means: dict[str, float]) -> DataFrame:
    """Bias-corrected skewness, excess kurtosis and standard deviation per column around known means, from (column_name, x, n) rows with distinct values.

    NULL below three (four) values, 0 for a constant column.
    """
    if not means:
        return rows.selectExpr("column_name", "cast(NULL AS double) AS skew", "cast(NULL AS double) AS kurt",
                               "cast(NULL AS double) AS std").limit(0)
    known = rows.sparkSession.createDataFrame(list(means.items()), "column_name string, mu double")
    sums = rows.join(F.broadcast(known), "column_name").groupBy("column_name").agg(*[F.expr(e) for e in CENTRAL])  # one row per column
    return sums.selectExpr("column_name", *SHAPE)


CENTRAL = ["cast(sum(n) AS double) AS c", *[f"sum(n * pow(x - mu, {k})) / sum(n) AS m{k}" for k in (2, 3, 4)]]
SHAPE = [
    "CASE WHEN c >= 3 THEN coalesce(m3 / nullif(pow(m2, 1.5), 0D), 0D) * sqrt(c * (c - 1)) / (c - 2) END AS skew",
    """CASE WHEN c >= 4 THEN coalesce((c - 1) / ((c - 2) * (c - 3))
       * ((c + 1) * (m4 / nullif(m2 * m2, 0D) - 3) + 6), 0D) END AS kurt""",
    "CASE WHEN c > 1 THEN sqrt(m2 * c / (c - 1)) END AS std"]


def summary(rows: DataFrame, means: dict[str, float], large: list[str] = (), probs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(column_name, q, skew, kurt, std) from (column_name, x, n) rows: quantiles and moments around the known means in one aggregate.

    The exact percentile keeps the distinct values of a column in its task, so columns in ``large``, which have more
    than a bounded number, get theirs by rank narrowing."""
    known = rows.sparkSession.createDataFrame([(k, v) for k, v in means.items()], "column_name string, mu double")
    named = rows.join(F.broadcast(known), "column_name", "left")  # one row per column
    cuts = F.array(*[F.lit(p) for p in probs])
    kept = F.when(~F.col("column_name").isin(list(large)), F.col("x")) if large else F.col("x")
    sums = named.groupBy("column_name").agg(F.percentile(kept, cuts, F.col("n")).alias("q"), *[F.expr(e) for e in CENTRAL])
    out = sums.selectExpr("column_name", "q", *SHAPE)
    if large:
        narrow = _large_quantiles(rows, list(large), probs).withColumnRenamed("q", "_q")
        out = out.join(F.broadcast(narrow), "column_name", "left").withColumn("q", F.coalesce("_q", "q")).drop("_q")  # one row per column
    return out
