"""Full column profile: one row per column, assembled from the single-pass facts and value frequencies."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.operators import freq as fq
from colonnade.operators import stats
from colonnade.session import stage, stage_counts

# Fixed values of the reference rules.
EFFECTIVE_CATEGORICAL_SHARE = 0.05
NO_SAMPLES_ABOVE = 10_000
FEW_SAMPLES_ABOVE = 1_000
MANY_MODES_BELOW = 100

# Share of values that look like a given kind of identifier.
VALUE_PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    "phone": r"^\+?[0-9][0-9() .-]{6,18}[0-9]$",
    "credit_card": r"^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}$",
    "numeric_id": r"^[0-9]+$",
}


def text_facts(df: DataFrame, columns: list[str], order_by: str | None = None) -> dict[str, dict]:
    """Cell, token and length statistics of the text columns; one row per column reaches the driver."""
    texts = [c for c in columns if stats.kinds_of(df)[c] == "string"]
    if not texts:
        return {}
    return {r["column_name"]: r.asDict() for r in stats.per_column(df, texts, stats.TEXT, order_by).collect()}


def list_columns(df: DataFrame, columns: list[str], texts: dict[str, dict], detect_lists: bool = True) -> list[str]:
    """Columns whose cells hold several values: over 1 % of cells with a delimiter, or three in a 500-cell
    sample with several tokens."""
    kinds, out = stats.kinds_of(df), []
    for name in columns:
        f = texts.get(name)
        if kinds[name] == "array":
            out.append(name)
        elif detect_lists and f and f["nonnull"]:
            share = f["n_multi"] / f["nonnull"]
            if f["n_delimited"] / f["nonnull"] > 0.01 or share * min(500, f["nonnull"]) >= 3:
                out.append(name)
    return out


def profile(df: DataFrame, columns: list[str] | None = None, order_by: str | None = None,
            detect_lists: bool = True, original: dict[str, str] | None = None, ranked: bool = True) -> DataFrame:
    """One row per column with type, counts, cardinality, distribution, modes, samples, range and quantiles.

    One scan for the value frequencies, one over the text columns before it to find multi-value columns; all
    the rest works on the staged frequency table. ``original`` maps new column names to the names in ``df``
    (profile under an inferred header). ``order_by`` names the column that marks the first row. Without ``ranked`` quantiles, moments, the
    distribution's shape and the lengths and sizes of cells stay empty: nothing is narrowed by rank, for callers that read none of them.
    """
    if original:
        df = df.select(*[stats.quoted(original.get(c, c)).alias(c) for c in original])
    df = stats.drop_nan(df)
    names = list(columns or df.columns)
    texts = text_facts(df, names, order_by)
    lists = list_columns(df, names, texts, detect_lists)
    freq = stage_counts(fq.value_freq(df, names, lists, with_missing=True, with_sizes=ranked), "value_freq", [df])
    facts = merge_facts(df, names, freq, texts, lists)
    source = {c: (original or {}).get(c, c) for c in names}
    out = finish(assemble(df, facts, freq, lists, ranked))
    mapping = F.create_map(*[F.lit(v) for kv in source.items() for v in kv])
    return out.withColumn("original_column", mapping[F.col("column_name")])


# Fields of the profile that follow from counts alone.
COUNTED = ["column_name", "data_type", "kind", "is_list", "total_rows", "total_count", "missing_percentage", "cardinality", "uniqueness_ratio", "cardinality_type",
           "is_effectively_categorical", "min_value", "max_value", "avg_value", "temporal_min", "temporal_max"]


def column_facts(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """The `COUNTED` fields of `profile`, one row per column: nothing is ranked and no frequency table is written."""
    df = stats.drop_nan(df)
    texts = text_facts(df, df.columns, order_by)
    lists = list_columns(df, df.columns, texts)
    facts = merge_facts(df, df.columns, fq.value_freq(df, None, lists, with_missing=True), texts, lists)
    ranked = {c: F.lit(None).cast("double") for c in ("q1", "median", "q3", "skew", "kurt", "len_median", "len_std")}
    ranked |= {c: F.lit(None).cast("array<string>") for c in ("mode_values", "samples")}
    return finish(fact_rows(df, facts).withColumns(ranked)).select(*COUNTED)


FACTS = [
    ("column_name", "string"), ("kind", "string"), ("is_list", "boolean"), ("total_rows", "bigint"), ("nonnull", "bigint"),
    ("cell_distinct", "bigint"), ("counted", "bigint"), ("distinct_n", "bigint"), ("top_n", "bigint"), ("n_number", "bigint"),
    ("n_number_whole", "bigint"), ("n_whole", "bigint"), ("n_encoded_date", "bigint"), ("n_boolean", "bigint"),
    ("n_date", "bigint"), ("n_time", "bigint"), ("tokens", "bigint"), ("tokens_min", "bigint"), ("tokens_max", "bigint"),
    ("tokens_numeric", "bigint"), ("tokens_digits", "bigint"), ("num_min", "double"), ("num_max", "double"),
    ("num_avg", "double"), ("i_min", "bigint"), ("i_max", "bigint"), ("text_min", "string"), ("text_max", "string"),
    ("len_min", "bigint"), ("len_max", "bigint"), ("len_mean", "double"),
    ("first_cell", "string"),
]


def merge_facts(df: DataFrame, names: list[str], freq: DataFrame, texts: dict[str, dict], lists: list[str]) -> list[dict]:
    """Facts of every column as one small record each (bounded by the number of columns)."""
    kinds = stats.kinds_of(df)
    counted = {(r["column_name"], r["unit"]): r.asDict() for r in fq.freq_facts(freq).collect()}
    out = []
    for name in names:
        cell, text = counted.get((name, "cell"), {}), texts.get(name, {})
        unit = counted.get((name, "token"), {}) if name in lists else cell
        f = {"column_name": name, "kind": kinds[name], "is_list": name in lists, "total_rows": cell.get("total") or 0,
             "nonnull": cell.get("nonnull") or 0, "cell_distinct": cell.get("distinct_n") or 0,
             "counted": unit.get("nonnull") or 0, "distinct_n": unit.get("distinct_n") or 0, "top_n": unit.get("top_n"),
             "n_number_whole": cell.get("n_whole"), "tokens": unit.get("nonnull") if name in lists else None,
             "tokens_numeric": unit.get("n_numeric"), "tokens_digits": unit.get("n_digits")}
        f |= {k: cell.get(k) for k in ("n_number", "n_whole", "n_encoded_date", "n_boolean", "n_date", "n_time", "num_min", "num_max",
                                       "num_avg", "i_min", "i_max", "text_min", "text_max")}
        lengths, sizes = counted.get((name, "length"), {}), counted.get((name, "size"), {})
        f |= {"first_cell": text.get("first_cell"), "tokens_min": sizes.get("i_min"), "tokens_max": sizes.get("i_max"),
              "len_min": lengths.get("i_min"), "len_max": lengths.get("i_max"), "len_mean": lengths.get("num_avg")}
        if name in lists and kinds[name] == "string":  # list cells enter the frequencies as digests
            f |= {"n_number": None, "num_min": None, "num_max": None, "num_avg": None}
            if f["tokens"] and (f["tokens_numeric"] or 0) > 0.9 * f["tokens"]:
                f |= stats.per_column(df, [name], {"n_number": "count({v})", "num_min": "min({v})", "num_max": "max({v})",
                                                   "num_avg": "avg({v})"}).first().asDict()
        out.append(f)
    return out


def number_columns(facts: list[dict]) -> tuple[list[str], list[str]]:
    """Columns whose cells need quantiles: numeric ones, and text ones that are mostly numbers."""
    numeric = [f["column_name"] for f in facts if f["nonnull"] and f["kind"] in ("integral", "fractional")]
    texts = [f["column_name"] for f in facts if f["nonnull"] and f["kind"] == "string" and f["n_number"] and (
        (f["tokens_numeric"] or 0) > 0.9 * (f["tokens"] or 0) if f["is_list"] else f["n_number"] >= 0.9 * f["nonnull"])]
    return numeric, texts


def fact_rows(df: DataFrame, facts: list[dict]) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(f[k] for k, _ in FACTS) for f in facts], ", ".join(f"{n} {t}" for n, t in FACTS))


def assemble(df: DataFrame, facts: list[dict], freq: DataFrame, lists: list[str], ranked: bool = True) -> DataFrame:
    """Joins the per-column pieces; every piece has one row per column, so the joins are tiny."""
    base = fact_rows(freq, facts)
    kinds = F.create_map(*[F.lit(v) for f in facts for v in (f["column_name"], f["kind"])])[F.col("column_name")]
    present = freq.filter(fq.PRESENT)
    counted = present.filter(F.col("unit") == (
        F.when(F.col("column_name").isin(lists), "token").otherwise("cell") if lists else F.lit("cell")))
    # the largest count of each column is known: only values that reach it need ranking
    tops = F.create_map(*[F.lit(v) for f in facts for v in (f["column_name"], f["top_n"] or 0)])[F.col("column_name")]
    pieces = [fq.mode_values(counted.filter(F.col("n") == tops), kinds).select("column_name", "mode_values")]
    texts = [f["column_name"] for f in facts if f["is_list"] or (f["kind"] == "string" and f["cell_distinct"] <= FEW_SAMPLES_ABOVE)]
    if texts:
        pieces.append(sample_values(counted.filter(F.col("column_name").isin(texts)), kinds, lists))
    numeric, numeric_texts = number_columns(facts) if ranked else ([], [])
    large = [f["column_name"] for f in facts if f["cell_distinct"] > fq.QUANTILE_GROUP_LIMIT]
    means = {f["column_name"]: f["num_avg"] for f in facts if f["column_name"] in numeric}
    if numeric or numeric_texts:
        rows = numeric_freq(present, df, numeric, numeric_texts, lists)
        pieces.append(fq.summary(rows, means, [c for c in large if c in numeric + numeric_texts]).selectExpr(
            "column_name", "q[0] AS q1", "q[1] AS median", "q[2] AS q3", "skew", "kurt"))
    lengths = present.filter(F.col("unit") == "length").selectExpr("column_name", "cast(i AS double) AS x", "n")
    length_means = {f["column_name"]: f["len_mean"] for f in facts if f["len_mean"] is not None}
    if length_means:
        pieces.append(fq.summary(lengths, length_means).selectExpr("column_name", "q[1] AS len_median", "std AS len_std"))
    fields = {"mode_values": "array<string>", "samples": "array<string>", "q1": "double", "median": "double", "q3": "double",
              "skew": "double", "kurt": "double", "len_median": "double", "len_std": "double"}
    rows = None
    for piece in pieces:
        full = piece.selectExpr("column_name", *[(c if c in piece.columns else f"cast(NULL AS {t}) AS {c}") for c, t in fields.items()])
        rows = full if rows is None else rows.unionByName(full)
    merged = rows.groupBy("column_name").agg(*[F.first(c, ignorenulls=True).alias(c) for c in fields])
    return base.join(F.broadcast(merged), "column_name", "left")  # one row per column


def numeric_freq(freq: DataFrame, df: DataFrame, numeric: list[str], texts: list[str], lists: list[str]) -> DataFrame:
    """(column_name, x, n) with distinct x per column, for quantiles and moments."""
    rows = freq.filter(F.col("column_name").isin(numeric) & (F.col("unit") == "cell")).select(
        "column_name", fq.number_of().alias("x"), "n")
    for name in texts:
        if name in lists:
            part = df.select(stats.parse_number(stats.quoted(name)).alias("x"), F.lit(1).alias("n"))
        else:
            part = freq.filter(F.col("column_name") == name).select(stats.parse_number(F.col("s")).alias("x"), "n")
        part = part.filter(F.col("x").isNotNull()).groupBy("x").agg(F.sum("n").alias("n"))
        rows = rows.unionByName(part.select(F.lit(name).alias("column_name"), "x", "n"))
    return rows


def sample_values(freq: DataFrame, kinds: Column, random: list[str] = (), limit: int = 5, seed: int = 42) -> DataFrame:
    """A few distinct values per column: the ``limit`` smallest, or for the columns in ``random`` those with
    the smallest hashes (a repeatable random sample)."""
    key = F.when(F.col("column_name").isin(list(random)), F.xxhash64(F.lit(seed), "i", "d", "s")) if random else F.lit(None).cast("bigint")
    order = Window.partitionBy("column_name").orderBy("h", "i", "d", "s")
    top = freq.withColumn("h", key).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return top.groupBy("column_name").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", fq.value_text(kinds).alias("v")))), lambda r: r["v"]).alias("samples"))


def shape_text(skew: Column, kurt: Column) -> Column:
    """Distribution descriptor of a numeric column."""
    side = F.when(skew > 1, "skewed right").when(skew < -1, "skewed left").otherwise("symmetric")
    tails = F.when(kurt > 3, "heavy tails").when(kurt < 3, "light tails")
    return F.concat_ws(", ", side, tails)


def finish(m: DataFrame) -> DataFrame:
    """Derived fields of the profile, from the merged per-column pieces."""
    m = m.withColumn("raw_type", stats.detected_type()).selectExpr(
        "*",
        """CASE raw_type WHEN 'list_string' THEN 'string'
           WHEN 'list_numeric' THEN if(tokens_digits = tokens, 'integer', 'float') ELSE raw_type END AS data_type""",
        "if(is_list, coalesce(tokens, 0), total_rows) AS total_count",
        "coalesce((total_rows - nonnull) / nullif(total_rows, 0), 0D) AS missing_percentage",
        "cell_distinct AS cardinality", "coalesce(cell_distinct / nullif(total_rows, 0), 0D) AS uniqueness_ratio",
        "coalesce(mode_values, cast(array() AS array<string>)) AS modes")
    m = m.withColumns({
        "cardinality_type": stats.cardinality_type(F.col("uniqueness_ratio")),
        "list_delimiter": F.when(F.col("is_list"), stats.list_delimiter(F.coalesce("first_cell", F.lit("")))),
        "start": F.when(F.col("kind") == "temporal", stats.iso_text(F.timestamp_micros("i_min"))),
        "end": F.when(F.col("kind") == "temporal", stats.iso_text(F.timestamp_micros("i_max"))),
        "shape": F.when(F.col("kind").isin("integral", "fractional"), shape_text(F.col("skew"), F.col("kurt"))).otherwise(""),
    }).selectExpr(
        "*", "data_type IN ('integer', 'float') AS numeric", "data_type IN ('date', 'datetime') AS temporal",
        "data_type = 'string' AS is_text", "data_type IN ('categorical', 'boolean') AS few",
        "distinct_n > 1 AS several", f"slice(modes, 1, if(cardinality < {MANY_MODES_BELOW}, 5, 3)) AS some_modes",
        "coalesce(start, cast(i_min AS string), text_min) AS first_time", "coalesce(end, cast(i_max AS string), text_max) AS last_time")
    return m.selectExpr(
        "column_name", "data_type", "kind", "is_list", "total_rows", "total_count", "missing_percentage", "cardinality",
        "uniqueness_ratio", "cardinality_type",
        f"coalesce(numeric AND cardinality / nullif(total_count, 0) <= {EFFECTIVE_CATEGORICAL_SHARE}D, false) AS is_effectively_categorical",
        "if(several, top_n / counted, 0D) AS top_value_frequency", "if(several, 1 - top_n / counted, 0D) AS uniformity",
        "CASE WHEN several THEN distinct_n END AS unique_count", "modes AS mode_values",
        f"""coalesce(CASE WHEN numeric AND cardinality > {NO_SAMPLES_ABOVE} THEN NULL
            WHEN numeric OR few THEN some_modes WHEN temporal THEN slice(modes, 1, 3)
            WHEN is_text AND is_list THEN samples WHEN is_text AND cardinality > {NO_SAMPLES_ABOVE} THEN NULL
            WHEN is_text AND cardinality > {FEW_SAMPLES_ABOVE} THEN slice(modes, 1, 3) WHEN is_text THEN samples
            ELSE slice(modes, 1, 3) END, cast(array() AS array<string>)) AS sampled_values""",
        f"""CASE WHEN numeric THEN shape
            WHEN temporal THEN concat('start: ', coalesce(first_time, ''), ', end: ', coalesce(last_time, ''))
            WHEN is_text AND is_list THEN concat('list column with delimiter \\'', list_delimiter, '\\', cardinality ', cardinality)
            WHEN is_text AND cardinality > {FEW_SAMPLES_ABOVE} THEN concat(cardinality, ' unique, text format')
            WHEN is_text THEN concat(cardinality, ' unique, sample values')
            ELSE concat(cardinality, ' unique') END AS contextual_description""",
        *[f"CASE WHEN numeric THEN {src} END AS {name}" for src, name in (
            ("num_min", "min_value"), ("num_max", "max_value"), ("num_avg", "avg_value"), ("q1", "q1"), ("median", "median"),
            ("q3", "q3"), ("skew", "skew"), ("kurt", "kurt"))],
        "CASE WHEN temporal THEN first_time END AS temporal_min", "CASE WHEN temporal THEN last_time END AS temporal_max",
        """CASE WHEN is_text THEN struct(coalesce(cast(len_min AS double), 0D) AS min, coalesce(cast(len_max AS double), 0D) AS max,
            coalesce(len_mean, 0D) AS mean, coalesce(len_median, 0D) AS median, coalesce(len_std, 0D) AS std) END AS value_lengths""",
        """CASE WHEN is_list THEN struct(list_delimiter AS delimiter, coalesce(tokens_min, 0) AS tokens_min,
            coalesce(tokens_max, 0) AS tokens_max, coalesce(tokens / nullif(nonnull, 0), 0D) AS tokens_avg) END AS list""",
    )


def pattern_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column, the share of non-missing cells that match each value pattern; one pass."""
    kinds = stats.kinds_of(df)
    names = [c for c in (columns or df.columns) if kinds[c] in ("string", "integral")]
    outs, structs = [], []
    for j, name in enumerate(names):
        text = stats.quoted(name).cast("string")
        for key, shape in VALUE_PATTERNS.items():
            hit = F.avg(F.when(text.isNotNull(), text.rlike(shape).cast("double")))
            outs.append(F.coalesce(hit, F.lit(0.0)).alias(f"a{j}_{key}"))
        structs.append(F.struct(F.lit(name).alias("column_name"), *[F.col(f"a{j}_{k}").alias(f"{k}_ratio") for k in VALUE_PATTERNS]))
    return df.agg(*outs).select(F.inline(F.array(*structs)))


def profile_catalog(tables: dict[str, DataFrame], dataset: str, order_by: dict[str, str] | None = None,
                    at_once: int = 4, counted_only: bool = False) -> DataFrame:
    """Profiles of many tables as one table keyed by (dataset, table). At most ``at_once`` tables are worked on together, each until its profile
    is written. ``counted_only`` leaves out all that needs ranking, see `column_facts`."""
    def one(item: tuple[str, DataFrame]) -> DataFrame:
        name, df = item
        by = (order_by or {}).get(name)
        part = column_facts(df, by) if counted_only else stage(profile(df, order_by=by), "profile")
        return part.select(F.lit(dataset).alias("dataset"), F.lit(name).alias("table"), "*")
    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(one, tables.items()))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_precomputed(prof: DataFrame) -> DataFrame:
    """Extra fields of the stored profile: inferred type and distinct count next to the base statistics."""
    return prof.withColumns({"inferred_type": F.col("data_type"), "distinct_count": F.col("cardinality")})


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_row_count"))


def interval_profile(df: DataFrame, column: str) -> DataFrame:
    """Minimum, maximum and mean of a duration column in seconds."""
    seconds = f"cast(`{column}` AS interval second)"
    number = f"cast({seconds} AS decimal(38, 6))"
    return df.selectExpr(f"cast(min({number}) AS bigint) AS min_seconds", f"cast(max({number}) AS bigint) AS max_seconds",
                         f"cast(avg({number}) AS double) AS avg_seconds")


COMPACT = ["data_type", "uniqueness_ratio", "cardinality", "missing_percentage", "min_value", "max_value"]


def compact(prof: DataFrame) -> DataFrame:
    """The six statistics used as merge evidence."""
    return prof.select(*[c for c in ("dataset", "table", "column_name") if c in prof.columns], *COMPACT)


def scalars(prof: DataFrame) -> DataFrame:
    """Profile without its nested fields: what travels with a property list."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return prof.select(*[f.name for f in prof.schema.fields if not isinstance(f.dataType, nested)])


def samples_only(prof: DataFrame) -> DataFrame:
    """Profile without analytics: names and samples."""
    return prof.select(*[c for c in ("dataset", "table", "column_name", "sampled_values") if c in prof.columns])
