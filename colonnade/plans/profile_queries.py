"""Column profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.operators import freq as fq
from colonnade.operators import profile as pf
from colonnade.operators import stats
from colonnade.plans import oracle
from colonnade.plans.registry import Tables, query

SCALARS = [
    "column_name", "data_type", "total_count", "missing_percentage", "cardinality", "uniqueness_ratio", "cardinality_type",
    "top_value_frequency", "uniformity", "mode_count", "min_value", "max_value", "avg_value", "q1", "median", "q3",
]


def flat(prof: DataFrame) -> DataFrame:
    """Profile with scalars only, rounded the same way as the SQL side."""
    six = ["missing_percentage", "uniqueness_ratio", "top_value_frequency", "uniformity"]
    four = ["min_value", "max_value", "avg_value", "q1", "median", "q3", "skew", "kurt"]
    return prof.selectExpr(
        "column_name", "data_type", "total_count", "total_rows", "is_list", "cardinality", "cardinality_type",
        "is_effectively_categorical", "cast(size(mode_values) AS bigint) AS mode_count",
        "array_join(mode_values, ', ') AS modes", "array_join(sampled_values, ', ') AS samples", "contextual_description",
        "temporal_min", "temporal_max", *[f"round({c}, 6) AS {c}" for c in six], *[f"round({c}, 4) AS {c}" for c in four],
        "value_lengths.min AS len_min", "value_lengths.max AS len_max", "round(value_lengths.mean, 4) AS len_mean",
        "value_lengths.median AS len_median", "round(value_lengths.std, 4) AS len_std",
        "cast(list.tokens_min AS double) AS tokens_min", "cast(list.tokens_max AS double) AS tokens_max",
        "round(list.tokens_avg, 4) AS tokens_avg", "list.delimiter AS delimiter")


def profile_query(name: str, table: str, columns: list[str]) -> None:
    @query(name, f"SELECT {', '.join(columns)} FROM ({oracle.profile_sql(table)})")
    def run(t: Tables) -> DataFrame:
        return flat(pf.profile(getattr(t, table))).select(*columns)


for _table in ("lineitem", "orders", "customer", "events", "documents"):
    profile_query(f"profile_{_table}", _table, SCALARS + ["modes", "temporal_min", "temporal_max"])


# ---- counts and missing values ----------------------------------------------------------------------

LABELLED = "(SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def labelled(t: Tables) -> DataFrame:
    """Documents with their labels where there are any: the columns of the right side have missing cells."""
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")


def per_column_sql(table: str, columns: list[str], body: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {body.replace('{c}', c)} FROM {table}" for c in columns)


LINE = list(oracle.COLUMNS["lineitem"])
LABELLED_COLUMNS = ["doc_id", "lang", "source", "quality", "toxic"]


@query("profile_counts", per_column_sql("lineitem", LINE, "count(*) AS total_count, count({c}) AS nonnull_count"))
def profile_counts(t: Tables) -> DataFrame:
    return stats.per_column(t.lineitem, LINE, {"total_count": "count(1)", "nonnull_count": "count({c})"})


@query("profile_missing", per_column_sql(LABELLED, LABELLED_COLUMNS, "round(avg(({c} IS NULL)::INT), 6) AS missing_percentage"))
def profile_missing(t: Tables) -> DataFrame:
    return stats.per_column(labelled(t), LABELLED_COLUMNS, {
        "missing_percentage": "round(coalesce(avg(cast({c} IS NULL AS double)), 0D), 6)"})


@query("columns_with_nulls", "SELECT * FROM (" + per_column_sql(
    LABELLED, LABELLED_COLUMNS, "count(*) FILTER ({c} IS NULL) AS missing_cells") + ") WHERE missing_cells > 0")
def columns_with_nulls(t: Tables) -> DataFrame:
    return stats.per_column(labelled(t), LABELLED_COLUMNS, {"missing_cells": "count_if({c} IS NULL)"}).filter("missing_cells > 0")


@query("missing_total", f"""SELECT CAST(sum(m) AS BIGINT) AS missing_cells, count(*) AS column_count, count(*) = 1 AS single_column
    FROM ({per_column_sql(LABELLED, LABELLED_COLUMNS, 'count(*) FILTER ({c} IS NULL) AS m')})""")
def missing_total(t: Tables) -> DataFrame:
    cells = stats.per_column(labelled(t), LABELLED_COLUMNS, {"m": "count_if({c} IS NULL)"})
    return cells.agg(F.sum("m").alias("missing_cells"), F.count("*").alias("column_count"), (F.count("*") == 1).alias("single_column"))


@query("missing_nan", """SELECT count(*) FILTER (event_id % 7 <> 0) AS present, count(*) FILTER (event_id % 7 = 0) AS missing, min(value) FILTER (event_id % 7 <> 0) AS least,
    max(value) FILTER (event_id % 7 <> 0) AS most FROM events WHERE value IS NOT NULL""")
def missing_nan(t: Tables) -> DataFrame:
    """NaN counts as missing."""
    rows = stats.drop_nan(t.events.filter("value IS NOT NULL").select(F.expr("if(event_id % 7 = 0, double('NaN'), value)").alias("value")))
    return rows.agg(F.count("value").alias("present"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("duplicate_rows", """WITH x AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_quantity > 40)
    SELECT (SELECT count(*) FROM x) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x)) AS duplicate_row_count""")
def duplicate_rows(t: Tables) -> DataFrame:
    """Whole rows, some of which stand twice."""
    return pf.duplicate_row_count(t.lineitem.unionByName(t.lineitem.filter("l_quantity > 40")))


# ---- cardinality, distribution, modes ---------------------------------------------------------------

def facts_columns(table: str, body: str) -> str:
    return f"SELECT column_name, {body} FROM ({oracle.facts_sql(table)})"


def line_summary(t: Tables) -> DataFrame:
    df = t.lineitem
    return fq.freq_summary(fq.value_freq(df)).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("total_rows"))))


@query("profile_cardinality", per_column_sql("lineitem", LINE, "count(DISTINCT {c}) AS cardinality"))
def profile_cardinality(t: Tables) -> DataFrame:
    return line_summary(t).selectExpr("column_name", "distinct_n AS cardinality")


@query("profile_uniqueness", per_column_sql("lineitem", LINE, "round(count(DISTINCT {c}) / count(*), 6) AS uniqueness_ratio"))
def profile_uniqueness(t: Tables) -> DataFrame:
    return line_summary(t).selectExpr("column_name", "round(distinct_n / total_rows, 6) AS uniqueness_ratio")


@query("cardinality_type", f"""SELECT column_name, CASE WHEN r < 0.05 THEN 'low' WHEN r < 0.5 THEN 'medium' ELSE 'high' END
    AS cardinality_type FROM ({per_column_sql('lineitem', LINE, 'count(DISTINCT {c}) / count(*) AS r')})""")
def cardinality_type(t: Tables) -> DataFrame:
    return line_summary(t).select("column_name", stats.cardinality_type(F.expr("distinct_n / total_rows")).alias("cardinality_type"))


@query("profile_distribution", facts_columns("lineitem", """CASE WHEN distinct_n > 1 THEN round(top_n / counted, 6) ELSE 0.0 END
    AS top_value_frequency, CASE WHEN distinct_n > 1 THEN round(1 - top_n / counted, 6) ELSE 0.0 END AS uniformity,
    CASE WHEN distinct_n > 1 THEN distinct_n END AS unique_count"""))
def profile_distribution(t: Tables) -> DataFrame:
    return fq.distribution(fq.freq_summary(fq.value_freq(t.lineitem))).selectExpr(
        "column_name", "round(top_value_frequency, 6) AS top_value_frequency", "round(uniformity, 6) AS uniformity", "unique_count")


def kind_map(df: DataFrame):
    return F.create_map(*[F.lit(v) for kv in stats.kinds_of(df).items() for v in kv])[F.col("column_name")]


@query("profile_modes", facts_columns("lineitem", "modes, mode_count"))
def profile_modes(t: Tables) -> DataFrame:
    return fq.mode_values(fq.value_freq(t.lineitem), kind_map(t.lineitem)).selectExpr(
        "column_name", "array_join(mode_values, ', ') AS modes", "cast(size(mode_values) AS bigint) AS mode_count")


LISTS = {"part": ["p_name"], "documents": ["text"], "events": ["props"]}
TOKEN_COLUMNS = [(t, c) for t, cs in LISTS.items() for c in cs]


def over_tables(t: Tables, fn) -> DataFrame:
    out = None
    for table in LISTS:
        part = fn(getattr(t, table), table)
        out = part if out is None else out.unionByName(part)
    return out


def token_facts_sql(body: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, column_name, {body} FROM ({oracle.facts_sql(t, {c: 'list'})})" for t, c in TOKEN_COLUMNS)


@query("token_modes", token_facts_sql("modes, round(top_n / counted, 6) AS top_value_frequency, distinct_n AS unique_count"))
def token_modes(t: Tables) -> DataFrame:
    def run(df: DataFrame, table: str) -> DataFrame:
        freq = fq.value_freq(df, LISTS[table], LISTS[table]).filter("unit = 'token'")
        dist = fq.distribution(fq.freq_summary(freq))
        return fq.mode_values(freq, F.lit("string")).join(dist, "column_name").selectExpr(
            f"'{table}' AS table_name", "column_name", "array_join(mode_values, ', ') AS modes",
            "round(top_value_frequency, 6) AS top_value_frequency", "unique_count")
    return over_tables(t, run)


@query("profile_tokens", token_facts_sql(
    "total_count, tokens_min, tokens_max, round(tokens_avg, 4) AS tokens_avg"))
def profile_tokens(t: Tables) -> DataFrame:
    def run(df: DataFrame, table: str) -> DataFrame:
        return stats.per_column(df, LISTS[table], {
            "total_count": "sum(size({k}))", "tokens_min": "cast(min(size({k})) AS double)",
            "tokens_max": "cast(max(size({k})) AS double)", "tokens_avg": "round(avg(size({k})), 4)"}).selectExpr(
            f"'{table}' AS table_name", "*")
    return over_tables(t, run)


KEYS = {"part": "p_partkey", "documents": "doc_id", "events": "event_id"}


@query("list_delimiter", " UNION ALL ".join(f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
    CASE WHEN contains(s, ',') THEN ',' WHEN contains(s, ';') THEN ';' WHEN contains(s, '|') THEN '|' WHEN contains(s, ' ') THEN ' '
    ELSE ',' END AS delimiter FROM (SELECT arg_min({c}, {KEYS[t]}) AS s FROM {t})""" for t, c in TOKEN_COLUMNS))
def list_delimiter(t: Tables) -> DataFrame:
    def run(df: DataFrame, table: str) -> DataFrame:
        first = stats.per_column(df, LISTS[table], {"cell": "{first}"}, order_by=KEYS[table])
        return first.select(F.lit(table).alias("table_name"), "column_name", stats.list_delimiter(F.col("cell")).alias("delimiter"))
    return over_tables(t, run)


# ---- types ------------------------------------------------------------------------------------------

TYPED = ["region", "nation", "customer", "supplier", "part", "orders", "events", "labels", "conversations"]


@query("profile_types", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, data_type FROM ({oracle.facts_sql(t)})" for t in TYPED))
def profile_types(t: Tables) -> DataFrame:
    return pf.profile_catalog({n: getattr(t, n) for n in TYPED}, "demo").selectExpr(
        "`table` AS table_name", "column_name", "data_type")


@query("type_encoded_date", """SELECT column_name, round(share, 6) AS share, CASE WHEN share > 0.8 THEN 'date' ELSE 'integer' END AS data_type FROM (
    SELECT 'day' AS column_name, avg((try_strptime(CAST(day AS VARCHAR), '%Y%m%d') IS NOT NULL)::INT) AS share
      FROM (SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS day FROM orders)
    UNION ALL SELECT 'o_custkey', avg((o_custkey BETWEEN 10000101 AND 99991231)::INT) FROM orders)""")
def type_encoded_date(t: Tables) -> DataFrame:
    df = t.orders.selectExpr("cast(date_format(o_orderdate, 'yyyyMMdd') AS int) AS day", "o_custkey")
    return stats.per_column(df, df.columns, {"share": f"avg(cast({stats.ENCODED_DATE} AS double))"}).selectExpr(
        "column_name", "round(share, 6) AS share", "if(share > 0.8, 'date', 'integer') AS data_type")


FRACTIONS = [c for c, k in oracle.COLUMNS["lineitem"].items() if k == "fractional"]


@query("type_whole_float", f"""SELECT column_name, round(share, 6) AS share, CASE WHEN share > 0.95 THEN 'integer' ELSE 'float' END AS data_type
    FROM ({per_column_sql('lineitem', FRACTIONS, 'avg(({c} % 1 = 0)::INT) AS share')})""")
def type_whole_float(t: Tables) -> DataFrame:
    return stats.per_column(t.lineitem, FRACTIONS, {"share": "avg(cast({v} % 1 = 0 AS double))"}).selectExpr(
        "column_name", "round(share, 6) AS share", "if(share > 0.95, 'integer', 'float') AS data_type")


TEXTS = {"part": ["p_name", "p_brand", "p_type"], "documents": ["text", "lang", "source"], "pages": ["url", "html"]}


@query("type_multivalue", " UNION ALL ".join(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (d) AS delimited,
    count(*) FILTER (m) AS multi, avg(d::INT) > 0.01 OR avg(m::INT) * least(500, count(*)) >= 3 AS is_list FROM (
      SELECT regexp_matches({c}, '[,;| ]') AS d, len({oracle.tokens(c)}) > 1 AS m FROM {t})""" for t, cs in TEXTS.items() for c in cs))
def type_multivalue(t: Tables) -> DataFrame:
    out = None
    for table, columns in TEXTS.items():
        facts = stats.per_column(getattr(t, table), columns, stats.TEXT).withColumn("kind", F.lit("string"))
        part = facts.select(F.lit(table).alias("table_name"), "column_name", F.col("n_delimited").alias("delimited"),
                            F.col("n_multi").alias("multi"), stats.is_list().alias("is_list"))
        out = part if out is None else out.unionByName(part)
    return out


NUMERIC_STRINGS = """(SELECT CAST(l_linenumber AS VARCHAR) AS line, CAST(CAST(l_discount AS DECIMAL(10,2)) AS VARCHAR) AS discount,
    CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(l_partkey AS VARCHAR) END AS mixed, l_returnflag AS flag FROM lineitem)"""
STRING_COLUMNS = ["line", "discount", "mixed", "flag"]


@query("type_numeric_strings", "SELECT column_name, round(coverage, 6) AS coverage, all_whole, CASE WHEN coverage < 0.9 THEN NULL "
       "WHEN all_whole THEN 'integer' ELSE 'float' END AS data_type FROM (" + per_column_sql(
        NUMERIC_STRINGS, STRING_COLUMNS, "count(TRY_CAST({c} AS DOUBLE)) / count(*) AS coverage, "
        "coalesce(bool_and(TRY_CAST({c} AS DOUBLE) % 1 = 0), true) AS all_whole") + ")")
def type_numeric_strings(t: Tables) -> DataFrame:
    df = t.lineitem.selectExpr(
        "cast(l_linenumber AS string) AS line", "cast(cast(l_discount AS decimal(10,2)) AS string) AS discount",
        "CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE cast(l_partkey AS string) END AS mixed", "l_returnflag AS flag")
    return stats.per_column(df, df.columns, {
        "coverage": "count({v}) / count({c})", "all_whole": "coalesce(bool_and({v} % 1 = 0), true)"}).selectExpr(
        "column_name", "round(coverage, 6) AS coverage", "all_whole",
        "CASE WHEN coverage < 0.9 THEN NULL WHEN all_whole THEN 'integer' ELSE 'float' END AS data_type")


@query("type_boolean_strings", per_column_sql("""(SELECT CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS returned,
    CAST(l_quantity > 25 AS VARCHAR) AS bulky, l_linestatus AS status FROM lineitem)""", ["returned", "bulky", "status"],
    "bool_and(lower({c}) IN ('true','false','yes','no','y','n','1','0','t','f')) AS is_boolean"))
def type_boolean_strings(t: Tables) -> DataFrame:
    df = t.lineitem.selectExpr("if(l_returnflag = 'R', 'Yes', 'No') AS returned", "cast(l_quantity > 25 AS string) AS bulky",
                               "l_linestatus AS status")
    return stats.per_column(df, df.columns, {"is_boolean": f"bool_and({stats.BOOLEAN_SQL})"})


CUSTOMER_TEXT = ["c_name", "c_mktsegment"]


@query("type_categorical", per_column_sql("customer", CUSTOMER_TEXT, """count(DISTINCT {c}) AS cardinality,
    count(DISTINCT {c}) / count({c}) < 0.1 AND count(DISTINCT {c}) < 20 AS is_categorical"""))
def type_categorical(t: Tables) -> DataFrame:
    return fq.freq_summary(fq.value_freq(t.customer, CUSTOMER_TEXT)).selectExpr(
        "column_name", "distinct_n AS cardinality", "distinct_n / counted < 0.1 AND distinct_n < 20 AS is_categorical")


DAY_FORMATS = {"iso": ("yyyy-MM-dd", "%Y-%m-%d"), "slash": ("d/M/yyyy", "%-d/%-m/%Y"), "us": ("MM/dd/yyyy", "%m/%d/%Y"),
               "dash": ("dd-MM-yyyy", "%d-%m-%Y"), "stamp": ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S")}


@query("type_dates", per_column_sql(
    "(SELECT " + ", ".join(f"strftime(o_orderdate, '{d}') AS {c}" for c, (_, d) in DAY_FORMATS.items()) + " FROM orders)",
    list(DAY_FORMATS), """round(avg((regexp_matches({c}, '^[0-9/-]+$') AND coalesce(try_strptime({c}, ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y',
    '%Y/%m/%d', '%d-%m-%Y', '%m-%d-%Y'])) IS NOT NULL)::INT), 6) AS date_share, avg((regexp_matches({c}, '^[0-9/-]+$'))::INT) > 0.8 AS is_date"""))
def type_dates(t: Tables) -> DataFrame:
    df = t.orders.selectExpr(*[f"date_format(o_orderdate, \"{s}\") AS {c}" for c, (s, _) in DAY_FORMATS.items()])
    return stats.per_column(df, df.columns, {"share": f"avg(cast({stats.DATE_SQL} IS NOT NULL AS double))"}).selectExpr(
        "column_name", "round(share, 6) AS date_share", "share > 0.8 AS is_date")


# ---- numbers, times, lengths ------------------------------------------------------------------------

NUMBERS = [c for c, k in oracle.COLUMNS["lineitem"].items() if k in ("integral", "fractional")]


def number_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return fq.value_freq(df, columns).select("column_name", fq.number_of().alias("x"), "n")


@query("profile_numeric", per_column_sql("lineitem", NUMBERS, """CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value,
    round(avg({c}), 4) AS avg_value"""))
def profile_numeric(t: Tables) -> DataFrame:
    return stats.per_column(t.lineitem, NUMBERS, {
        "min_value": "min({v})", "max_value": "max({v})", "avg_value": "round(avg({v}), 4)"})


@query("profile_quantiles", per_column_sql("lineitem", NUMBERS, """round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1,
    round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3"""))
def profile_quantiles(t: Tables) -> DataFrame:
    return fq.exact_quantiles(number_rows(t.lineitem, NUMBERS)).selectExpr(
        "column_name", "round(q[0], 4) AS q1", "round(q[1], 4) AS median", "round(q[2], 4) AS q3")


def side(column: str) -> str:
    return f"CASE WHEN {column} > 1 THEN 'skewed right' WHEN {column} < -1 THEN 'skewed left' ELSE 'symmetric' END"


@query("profile_skew", f"SELECT *, {side('skew')} AS descriptor FROM (" + per_column_sql(
    "lineitem", NUMBERS, "round(skewness({c}), 4) AS skew") + ")")
def profile_skew(t: Tables) -> DataFrame:
    return stats.per_column(t.lineitem, NUMBERS, {"skew": f"round({stats.SKEW}, 4)"}).selectExpr("*", f"{side('skew')} AS descriptor")


@query("profile_kurtosis", "SELECT *, CASE WHEN kurt > 3 THEN 'heavy tails' WHEN kurt < 3 THEN 'light tails' END AS descriptor FROM ("
       + per_column_sql("lineitem", NUMBERS, "round(kurtosis({c}), 4) AS kurt") + ")")
def profile_kurtosis(t: Tables) -> DataFrame:
    return stats.per_column(t.lineitem, NUMBERS, {"kurt": f"round({stats.KURTOSIS}, 4)"}).selectExpr(
        "*", "CASE WHEN kurt > 3 THEN 'heavy tails' WHEN kurt < 3 THEN 'light tails' END AS descriptor")


TIMES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


@query("profile_temporal", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, {oracle.time_text(f'min({c})')} AS start_value,
    {oracle.time_text(f'max({c})')} AS end_value FROM {t}""" for t, c in TIMES.items()))
def profile_temporal(t: Tables) -> DataFrame:
    out = None
    for table, c in TIMES.items():
        part = stats.per_column(getattr(t, table), [c], {"lo": "min({c})", "hi": "max({c})"}).select(
            "column_name", stats.iso_text(F.col("lo")).alias("start_value"), stats.iso_text(F.col("hi")).alias("end_value"))
        out = part if out is None else out.unionByName(part)
    return out


DOC_TEXT = ["text", "lang", "source"]


@query("profile_lengths", per_column_sql("documents", DOC_TEXT, """CAST(min(length({c})) AS BIGINT) AS len_min, CAST(max(length({c})) AS BIGINT) AS len_max,
    round(avg(length({c})), 4) AS len_mean, quantile_cont(length({c})::DOUBLE, 0.5) AS len_median, round(stddev_samp(length({c})), 4) AS len_std"""))
def profile_lengths(t: Tables) -> DataFrame:
    return stats.per_column(t.documents, DOC_TEXT, stats.LENGTHS).selectExpr(
        "column_name", "len_min", "len_max", "round(len_mean, 4) AS len_mean", "len_median", "round(len_std, 4) AS len_std")


@query("profile_interval", """SELECT CAST(min(s) AS BIGINT) AS min_seconds, CAST(max(s) AS BIGINT) AS max_seconds, round(avg(s), 4) AS avg_seconds
    FROM (SELECT epoch(l_shipdate) - epoch(o_orderdate) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def profile_interval(t: Tables) -> DataFrame:
    delay = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("l_shipdate - o_orderdate AS delay")
    return pf.interval_profile(delay, "delay").selectExpr("min_seconds", "max_seconds", "round(avg_seconds, 4) AS avg_seconds")


# ---- flags, samples, text of the profile ------------------------------------------------------------

@query("effectively_categorical", per_column_sql("lineitem", NUMBERS, "count(DISTINCT {c}) / count(*) <= 0.05 AS is_effectively_categorical"))
def effectively_categorical(t: Tables) -> DataFrame:
    prof = pf.profile(t.lineitem, NUMBERS)
    return prof.select("column_name", "is_effectively_categorical")


def samples_sql(table: str) -> str:
    """Sample policy over the facts; the text columns of these tables have few distinct values or over a thousand."""
    first = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, string_agg(v, ', ' ORDER BY v) AS firsts FROM (SELECT DISTINCT {c} AS v FROM {table} ORDER BY v LIMIT 5)"
        for c, k in oracle.COLUMNS[table].items() if k == "string")
    three = "array_to_string(string_split(modes, ', ')[1:3], ', ')"
    return f"""SELECT column_name, CASE
        WHEN data_type IN ('integer', 'float') AND cardinality > 10000 THEN ''
        WHEN data_type IN ('integer', 'float', 'categorical', 'boolean') THEN CASE WHEN cardinality < 100 THEN modes ELSE {three} END
        WHEN data_type IN ('date', 'datetime') THEN {three} WHEN cardinality > 10000 THEN ''
        WHEN cardinality > 1000 THEN {three} ELSE firsts END AS samples
      FROM ({oracle.facts_sql(table, {c: k for c, k in oracle.COLUMNS[table].items() if k != 'list'})}) LEFT JOIN ({first}) USING (column_name)"""


@query("profile_samples", " UNION ALL ".join(f"SELECT '{t}' AS table_name, * FROM ({samples_sql(t)})" for t in ("lineitem", "customer", "part")))
def profile_samples(t: Tables) -> DataFrame:
    out = None
    for table in ("lineitem", "customer", "part"):
        columns = [c for c, k in oracle.COLUMNS[table].items() if k != "list"]
        part = flat(pf.profile(getattr(t, table), columns, ranked=False)).selectExpr(f"'{table}' AS table_name", "column_name", "samples")
        out = part if out is None else out.unionByName(part)
    return out


DESCRIBED = f"""CASE WHEN data_type IN ('integer', 'float') THEN concat_ws(', ', {side('skew')},
      CASE WHEN kurt > 3 THEN 'heavy tails' WHEN kurt < 3 THEN 'light tails' END)
    WHEN data_type IN ('date', 'datetime') THEN concat('start: ', temporal_min, ', end: ', temporal_max)
    WHEN data_type = 'string' AND is_list THEN concat('list column with delimiter ''', delimiter, ''', cardinality ', cardinality)
    WHEN data_type = 'string' AND cardinality > 1000 THEN concat(cardinality, ' unique, text format')
    WHEN data_type = 'string' THEN concat(cardinality, ' unique, sample values') ELSE concat(cardinality, ' unique') END"""


@query("profile_description", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, {DESCRIBED} AS contextual_description FROM ({oracle.facts_sql(t)})" for t in ("orders", "part")))
def profile_description(t: Tables) -> DataFrame:
    return pf.profile_catalog({"orders": t.orders, "part": t.part}, "demo").selectExpr(
        "`table` AS table_name", "column_name", "contextual_description")


@query("profile_renamed", f"""SELECT column_name, original_column, data_type, cardinality FROM (
    SELECT column_name AS original_column, data_type, cardinality FROM ({oracle.facts_sql('customer')}))
    JOIN (VALUES ('customer_id', 'c_custkey'), ('full_name', 'c_name'), ('balance', 'c_acctbal')) AS m(column_name, original_column) USING (original_column)""")
def profile_renamed(t: Tables) -> DataFrame:
    names = {"customer_id": "c_custkey", "full_name": "c_name", "balance": "c_acctbal"}
    return pf.profile(t.customer, original=names).select("column_name", "original_column", "data_type", "cardinality")


@query("profile_compact", f"""SELECT column_name, data_type, uniqueness_ratio, cardinality, missing_percentage, min_value, max_value
    FROM ({oracle.profile_sql('supplier')})""")
def profile_compact(t: Tables) -> DataFrame:
    return pf.compact(pf.profile(t.supplier)).withColumns({
        "uniqueness_ratio": F.round("uniqueness_ratio", 6), "missing_percentage": F.round("missing_percentage", 6),
        "min_value": F.round("min_value", 4), "max_value": F.round("max_value", 4)})


@query("profile_samples_only", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, * FROM ({samples_sql(t)})" for t in ("customer", "supplier")))
def profile_samples_only(t: Tables) -> DataFrame:
    prof = pf.profile_catalog({"customer": t.customer, "supplier": t.supplier}, "demo")
    return pf.samples_only(prof).selectExpr("`table` AS table_name", "column_name", "array_join(sampled_values, ', ') AS samples")


@query("profile_catalog", " UNION ALL ".join(
    f"""SELECT 'demo' AS dataset, '{t}' AS table_name, column_name, data_type AS inferred_type, cardinality AS distinct_count, total_count,
    uniqueness_ratio FROM ({oracle.profile_sql(t)})""" for t in oracle.COLUMNS))
def profile_catalog(t: Tables) -> DataFrame:
    prof = pf.profile_catalog({n: getattr(t, n) for n in oracle.COLUMNS}, "demo")
    return pf.with_precomputed(prof).selectExpr(
        "dataset", "`table` AS table_name", "column_name", "inferred_type", "distinct_count", "total_count",
        "round(uniqueness_ratio, 6) AS uniqueness_ratio")


PATTERNED = {"pages": ["page_id", "url"], "customer": ["c_custkey", "c_name"], "documents": ["lang", "text"]}
SHAPES = {"email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$", "phone": r"^\+?[0-9][0-9() .-]{6,18}[0-9]$",
          "credit_card": r"^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}$", "numeric_id": "^[0-9]+$"}


@query("value_patterns", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, " + ", ".join(
        f"round(avg(regexp_matches(CAST({c} AS VARCHAR), '{s}')::INT), 6) AS {k}_ratio" for k, s in SHAPES.items()) + f" FROM {t}"
    for t, cs in PATTERNED.items() for c in cs))
def value_patterns(t: Tables) -> DataFrame:
    out = None
    for table, columns in PATTERNED.items():
        part = pf.pattern_ratios(getattr(t, table), columns).selectExpr(
            f"'{table}' AS table_name", "column_name", *[f"round({k}_ratio, 6) AS {k}_ratio" for k in SHAPES])
        out = part if out is None else out.unionByName(part)
    return out
