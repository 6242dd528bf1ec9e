"""Single-pass column statistics.

Every statistic here has bounded state per column, so one scan with map-side aggregation yields one
row per column no matter how many rows the table has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Delimiter characters of multi-value cells, the boolean words and the date formats.
DELIMITERS = [",", ";", "|", " "]
DELIMITER_CLASS = "[ ,;|]"
TOKEN_SPLIT = "[ ,;|]+"
BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n", "1", "0", "t", "f"]
DATE_FORMATS = [
    ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-yyyy"),
]
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
NUMERIC_TOKEN = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"

# Columns per aggregate: wider aggregates outgrow what the JVM compiles, and each batch scans only its own columns.
BATCH = 6

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def column_kind(data_type: T.DataType) -> str:
    """Spark type class that decides which statistics apply."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, _INTEGRAL):
        return "integral"
    if isinstance(data_type, _FRACTIONAL):
        return "fractional"
    if isinstance(data_type, _TEMPORAL):
        return "temporal"
    if isinstance(data_type, T.DayTimeIntervalType):
        return "interval"
    if isinstance(data_type, T.ArrayType):
        return "array"
    return "string"


def kinds_of(df: DataFrame) -> dict[str, str]:
    return {f.name: column_kind(f.dataType) for f in df.schema.fields}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def drop_nan(df: DataFrame) -> DataFrame:
    """NaN counts as missing: turn it into NULL once, at the entrance."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats}) if floats else df


TOKENS_SQL = f"CASE WHEN btrim({{c}}, ' ,;|') = '' THEN array() ELSE split(btrim({{c}}, ' ,;|'), '{TOKEN_SPLIT}') END"


def tokens(cell: str) -> Column:
    """Non-empty tokens of the multi-value cell in column ``cell``: ends are stripped first, so none is empty."""
    return F.expr(TOKENS_SQL.replace("{c}", f"`{cell}`"))


def parse_number(cell: Column) -> Column:
    """Number in a string cell, NULL when it is none."""
    return F.when(cell.rlike(NUMBER), F.trim(cell).try_cast("double"))


def parse_date(cell: Column) -> Column:
    """First of the six date formats that fits, unpadded parts allowed."""
    return F.coalesce(*[F.when(cell.rlike(shape), F.try_to_timestamp(cell, F.lit(fmt))) for shape, fmt in DATE_FORMATS])


def is_encoded_date(number: Column) -> Column:
    """Integer that reads as YYYYMMDD."""
    return number.between(10000101, 99991231) & F.try_to_timestamp(number.cast("string"), F.lit("yyyyMMdd")).isNotNull()


def is_whole(number: Column) -> Column:
    return (number % 1) == 0


def iso_text(value: Column) -> Column:
    """Timestamp or date as text, the time part and the fraction of a second only where there is one."""
    stamp = value.cast("timestamp")
    return F.when(
        stamp == F.date_trunc("day", stamp), F.date_format(stamp, "yyyy-MM-dd")
    ).when(stamp == F.date_trunc("second", stamp), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# Statistics per type class as SQL aggregates over {c} (the cell), {v} (its number), {k} (its tokens).
SKEW = """CASE WHEN count({v}) >= 3 THEN coalesce(skewness({v}), 0D)
    * sqrt(count({v}) * (count({v}) - 1D)) / (count({v}) - 2D) END"""
KURTOSIS = """CASE WHEN count({v}) >= 4 THEN coalesce((count({v}) - 1D) / ((count({v}) - 2D) * (count({v}) - 3D))
    * ((count({v}) + 1D) * kurtosis({v}) + 6), 0D) END"""
# integers that read as YYYYMMDD, by the calendar's rules: a parser raises and catches an error for every key in that range that is no date
LEAP = "(({c} div 10000) % 4 = 0 AND (({c} div 10000) % 100 <> 0 OR ({c} div 10000) % 400 = 0))"
MONTH_DAYS = f"CASE WHEN {{c}} div 100 % 100 = 2 THEN if({LEAP}, 29, 28) WHEN {{c}} div 100 % 100 IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
ENCODED_DATE = f"{{c}} BETWEEN 10000101 AND 99991231 AND {{c}} div 100 % 100 BETWEEN 1 AND 12 AND {{c}} % 100 BETWEEN 1 AND {MONTH_DAYS}"
NUMBER_SQL = f"CASE WHEN {{c}} RLIKE r'{NUMBER}' THEN try_cast(trim({{c}}) AS double) END"
DATE_SQL = "coalesce(" + ", ".join(
    f"CASE WHEN {{c}} RLIKE r'{shape}' THEN try_to_timestamp({{c}}, '{fmt}') END" for shape, fmt in DATE_FORMATS) + ")"
BOOLEAN_SQL = "lower({c}) IN (" + ", ".join(f"'{w}'" for w in BOOLEAN_WORDS) + ")"
TIME_SQL = ("coalesce(" + DATE_SQL + ", CASE WHEN {c} RLIKE '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T]' THEN "
            "coalesce(try_to_timestamp({c}, 'yyyy-M-d HH:mm:ss'), try_to_timestamp({c}, \"yyyy-M-d'T'HH:mm:ss\")) END)")

DELIMITER_SQL = "CASE " + " ".join(f"WHEN contains({{c}}, '{d}') THEN '{d}'" for d in DELIMITERS) + " ELSE ',' END"

COUNTS = {"total_rows": "count(1)", "nonnull": "count({c})"}
TEXT = {
    **COUNTS, "n_delimited": f"count_if({{c}} RLIKE '{DELIMITER_CLASS}')",
    "n_multi": "count_if({c} RLIKE '[^ ,;|][ ,;|]+[^ ,;|]')", "first_cell": "{first}",
}


# the median's state is one entry per distinct length, not per value
LENGTHS = {"len_min": "cast(min({n}) AS bigint)", "len_max": "cast(max({n}) AS bigint)", "len_mean": "avg({n})",
           "len_median": "percentile({n}, 0.5)", "len_std": "stddev_samp({n})"}


def fill(template: str, j: int) -> str:
    """Template for the j-th column of a batch."""
    for part in "cvnk":
        template = template.replace("{" + part + "}", f"{part}{j}")
    return template


def per_column(df: DataFrame, columns: list[str], exprs: dict[str, str], order_by: str | None = None) -> DataFrame:
    """One row per column: evaluates SQL aggregate templates for every column in one scan per batch.

    Templates see ``{c}`` (cell), ``{v}`` (its number), ``{n}`` (its length) and ``{k}`` (its tokens).
    """
    kinds, used = kinds_of(df), "".join(exprs.values())
    parts = []
    for start in range(0, len(columns), BATCH):
        batch = columns[start:start + BATCH]
        cells, more, aggs, rows = [], [], [], []
        for j, name in enumerate(batch):
            cell, text = "`" + name.replace("`", "``") + "`", kinds[name] in ("string", "boolean")
            cells.append(f"cast({cell} AS string) AS c{j}" if text else f"{cell} AS c{j}")
            if "{v}" in used:
                more.append(fill(NUMBER_SQL if text else "cast({c} AS double)", j) + f" AS v{j}")
            if "{k}" in used:
                more.append(fill(TOKENS_SQL if text else "{c}", j) + f" AS k{j}")
            if "{n}" in used:
                more.append(f"length(c{j}) AS n{j}")
            # the delimiter is read off each whole cell, so only one character travels
            first = fill(f"min_by({DELIMITER_SQL}, {'CASE WHEN {c} IS NOT NULL THEN o END' if order_by else '{c}'})", j)
            aggs += [fill(t.replace("{first}", first), j) + f" AS a{j}_{key}" for key, t in exprs.items()]
            label = "'" + name.replace("'", "\\'") + "' AS column_name"
            rows.append(f"struct({label}, " + ", ".join(f"a{j}_{k} AS {k}" for k in exprs) + ")")
        if order_by:
            cells.append(f"`{order_by}` AS o")
        base = df.selectExpr(*cells).selectExpr("*", *more)
        parts.append(base.groupBy().agg(*[F.expr(a) for a in aggs]).selectExpr(f"inline(array({', '.join(rows)}))"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def spread(df: DataFrame) -> DataFrame:
    """Spreads an input with fewer splits than cores before costly text work; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---- type rules over the facts (Column expressions, one row per column) ------------------------------

def _share(part: str) -> Column:
    return F.col(part) / F.nullif(F.col("nonnull"), F.lit(0))


def is_list(detect_lists: bool = True) -> Column:
    """More than 1 % of cells hold a delimiter, or three in a 500-cell sample would hold several tokens."""
    seen = F.least(F.lit(500), F.col("nonnull"))
    rule = (_share("n_delimited") > 0.01) | (_share("n_multi") * seen >= 3)
    return (F.col("kind") == "array") | (F.lit(detect_lists) & (F.col("kind") == "string") & F.coalesce(rule, F.lit(False)))


def detected_type() -> Column:
    """Logical type of a column from its facts, in the order of the reference rules."""
    return F.expr("""
        CASE WHEN nonnull = 0 THEN 'unknown'
             WHEN kind IN ('temporal', 'interval') THEN 'datetime'
             WHEN kind = 'boolean' THEN 'boolean'
             WHEN kind = 'integral' THEN if(n_encoded_date / nonnull > 0.8, 'date', 'integer')
             WHEN kind = 'fractional' THEN if(n_whole / nonnull > 0.95, 'integer', 'float')
             WHEN is_list THEN if(coalesce(tokens_numeric / nullif(tokens, 0), 0) > 0.9, 'list_numeric', 'list_string')
             WHEN n_number / nonnull >= 0.9 THEN if(n_number_whole = n_number, 'integer', 'float')
             WHEN n_boolean = nonnull THEN 'boolean'
             WHEN cell_distinct / nonnull < 0.1 AND cell_distinct < 20 THEN 'categorical'
             WHEN n_date / nonnull > 0.8 THEN 'date'
             WHEN n_time / nonnull > 0.8 THEN 'datetime'
             ELSE 'string' END""")


def cardinality_type(ratio: Column) -> Column:
    return F.when(ratio < 0.05, "low").when(ratio < 0.5, "medium").otherwise("high")


def list_delimiter(cell: Column) -> Column:
    """First of comma, semicolon, pipe and space that occurs in the cell; comma when none does."""
    out = F.lit(",")
    for mark in reversed(DELIMITERS):
        out = F.when(F.contains(cell, F.lit(mark)), mark).otherwise(out)
    return out
