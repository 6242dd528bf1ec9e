"""Descriptions of columns as text.

The wording of each description is a fixed value, written as a template: ``{field}`` inserts text,
``{field:2}`` a number with two decimals, ``{field%1}`` a share as a percentage with one decimal.
Numbers are rounded half to even, then written out in plain digits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_TEXT = (
    "{column_name}: {samples}. This {cardinality_type} cardinality {data_type} sequence has {cardinality} distinct combinations "
    "from {total_count} total entries. Token value range: {min_value:0} to {max_value:0}, average value: {avg_value:0}. "
    "Sequence length statistics: average {tokens_avg:1}, range {tokens_min:0}-{tokens_max:0} tokens. "
    "Distribution uniformity: {uniformity%1}, uniqueness ratio: {uniqueness_ratio%2}. Most frequent token: {first_mode}. "
    "Table: {table_name}. Context: {contextual_description}"
)
STRING_TEXT = (
    "{column_name}: {sample} (length: {sample_length} chars, {popularity} value). String statistics: min {len_min:0}, "
    "max {len_max:0}, mean {len_mean:1}, median {len_median:1}, std {len_std:2}. Cardinality: {cardinality_type} "
    "({cardinality} distinct values). Distribution: uniformity {uniformity%1}, top frequency {top_value_frequency%2}. "
    "Uniqueness ratio: {uniqueness_ratio:3}. Table: {table_name} ({total_count} entries). Context: {contextual_description}"
)
BOOLEAN_TEXT = (
    "{column_name}: {flag} ({status}, {case_type} case). Data type: {data_type} with {cardinality_type} cardinality. "
    "Distribution: top value frequency {top_value_frequency%1}, uniformity {uniformity%1}. Mode value: {first_mode}. "
    "Uniqueness ratio: {uniqueness_ratio:9}. Total entries: {total_grouped}, distinct values: {cardinality}. "
    "Table: {table_name}. Context: {contextual_description}"
)
DATE_TEXT = (
    "{column_name}: {day} ({weekday}, {month} {day_number}, {year}). Date range: {temporal_min} to {temporal_max}. "
    "Cardinality: {cardinality_type} ({cardinality} unique dates). Distribution: uniformity {uniformity%2}, "
    "top frequency {top_value_frequency%2}. Most frequent: {first_mode}. Uniqueness ratio: {uniqueness_ratio:8}. "
    "Total events: {total_grouped} in table {table_name}. Context: {contextual_description}"
)

TYPE_HINTS = {
    "numeric": "Focus on distribution, range, mean, and outliers.",
    "temporal": "Focus on temporal patterns: earliest, latest, and frequency.",
    "categorical": "Focus on category frequency, cardinality, and common values.",
    "text": "Focus on text characteristics: average length, unique values overview, and sample texts.",
}
HINT_GROUPS = {
    "numeric": ["int", "integer", "numeric", "float", "int64"],
    "temporal": ["datetime", "date", "timestamp", "datetime64[ns]"],
    "categorical": ["categorical", "category"],
}

# Adaptive one-line description: {head} is "name (N uniques (x% unique), type: t".
HEAD = "{column_name} ({cardinality} {noun} ({uniqueness_ratio%1} unique), type: {data_type}"
LINES = {
    "values": HEAD + "): {samples}",
    "modes": HEAD + "): {modes}",
    "numeric": HEAD + ", min: {min_text}, max: {max_text}, μ: {avg_text}, Q1: {q1_text}, Median: {median_text}, Q3: {q3_text}, samples: [{modes}])",
    "temporal": HEAD + ", start: {temporal_min}, end: {temporal_max}), samples: [{modes}]",
    "string": HEAD + ", samples: [{modes}])",
}


def fixed(expr: str, digits: int) -> str:
    return f"cast(cast(bround({expr}, {digits}) AS decimal(38, {digits})) AS string)"


def render(template: str, number=fixed, cast: str = "cast({} AS string)") -> str:
    """SQL concatenation for a template; ``number`` and ``cast`` state how the engine writes values."""
    parts = []
    for text, name, sign, digits in re.findall(r"([^{}]+)|\{(\w+)(?:([:%])(\d))?\}", template):
        if text:
            parts.append("'" + text.replace("'", "''") + "'")
        elif sign == "%":
            parts.append(number(f"{name} * 100", int(digits)) + " || '%'")
        elif sign == ":":
            parts.append(number(name, int(digits)))
        else:
            parts.append(cast.format(name))
    return " || ".join(parts)


def line_kind() -> str:
    """Which one-line form applies and whether it says 'unique' or 'uniques'; SQL that both engines read."""
    return """CASE WHEN is_effectively_categorical THEN if(cardinality_type = 'low', 'values', 'modes')
        WHEN data_type IN ('integer', 'float') THEN 'numeric' WHEN data_type IN ('date', 'datetime') THEN 'temporal'
        WHEN data_type = 'categorical' THEN if(cardinality_type = 'low', 'values', 'modes')
        WHEN data_type = 'string' AND cardinality_type IN ('high', 'medium') THEN 'string'
        WHEN data_type = 'string' THEN 'values' WHEN samples <> '' THEN 'values' ELSE 'name' END"""


NOUN = """CASE WHEN is_effectively_categorical OR data_type IN ('integer', 'float', 'date', 'datetime') THEN 'uniques'
        WHEN data_type = 'categorical' AND cardinality_type = 'low' THEN 'uniques' ELSE 'unique' END"""


def _plain(expr: str) -> str:
    """Shortest exact text of a number, in plain digits where 18 places before and after the point hold it; empty for NULL."""
    text = f"cast(cast({expr} AS double) AS string)"
    number = f"try_cast({text} AS decimal(38, 18))"
    return (f"coalesce(CASE WHEN cast({number} AS double) = {expr} THEN regexp_replace(cast({number} AS string), '\\\\.?0+$', '') "
            f"ELSE {text} END, '')")


def _steady(expr: str) -> str:
    """A sum or mean without the last digits, which depend on the order of rows: twelve significant digits."""
    return f"try_cast(format_string('%.11e', {expr}) AS double)"


def column_text(prof: DataFrame) -> DataFrame:
    """Adds ``text``: the adaptive one-line description of each profiled column."""
    fields = prof.selectExpr(
        "*", "array_join(mode_values, ', ') AS modes",
        "array_join(if(data_type = 'string' AND size(sampled_values) = 0, mode_values, sampled_values), ', ') AS samples",
        *[f"{_plain(c)} AS {n}_text" for c, n in (("min_value", "min"), ("max_value", "max"), (_steady("avg_value"), "avg"), ("q1", "q1"),
                                                  ("median", "median"), ("q3", "q3"))],
        f"{NOUN} AS noun")
    cases = " ".join(f"WHEN '{k}' THEN {render(v)}" for k, v in LINES.items())
    return fields.selectExpr(*prof.columns, f"CASE {line_kind()} {cases} ELSE column_name END AS text")


def described_fields(prof: DataFrame) -> DataFrame:
    """Fields that the long descriptions insert."""
    return prof.selectExpr(
        "*", "array_join(sampled_values, ', ') AS samples", "get(mode_values, 0) AS raw_mode",
        "if(kind = 'boolean', initcap(get(mode_values, 0)), get(mode_values, 0)) AS first_mode",
        "coalesce(get(sampled_values, 0), '') AS sample", "length(coalesce(get(sampled_values, 0), '')) AS sample_length",
        "if(array_contains(mode_values, coalesce(get(sampled_values, 0), '')), 'mode', 'non-mode') AS popularity",
        "value_lengths.min AS len_min", "value_lengths.max AS len_max", "value_lengths.mean AS len_mean",
        "value_lengths.median AS len_median", "value_lengths.std AS len_std",
        "coalesce(list.tokens_avg, 1D) AS tokens_avg", "coalesce(list.tokens_min, 1) AS tokens_min",
        "coalesce(list.tokens_max, 1) AS tokens_max",
        "if(lower(get(mode_values, 0)) IN ('true', '1', 'yes', 'y', 't'), 'True', 'False') AS flag",
        "format_number(total_count, 0) AS total_grouped",
        "CASE WHEN get(mode_values, 0) RLIKE '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$' THEN try_to_timestamp(get(mode_values, 0), 'yyyy-M-d') END AS mode_day",
    ).selectExpr(
        "*", "if(flag = 'True', 'enabled', 'disabled') AS status", "if(kind = 'boolean', 'majority', 'minority') AS case_type",
        "CASE WHEN mode_day IS NOT NULL THEN raw_mode END AS day", "date_format(mode_day, 'EEEE') AS weekday",
        "date_format(mode_day, 'MMMM') AS month", "day(mode_day) AS day_number", "year(mode_day) AS year")


LONG_TEXTS = {
    "numeric": (["integer", "float"], NUMERIC_TEXT), "string": (["string"], STRING_TEXT),
    "boolean": (["boolean", "categorical"], BOOLEAN_TEXT), "date": (["date", "datetime"], DATE_TEXT),
}


def long_text(prof: DataFrame, only: str | None = None) -> DataFrame:
    """Adds ``text``: the long description by data type; where one cannot be built, the contextual description."""
    chosen = {k: v for k, v in LONG_TEXTS.items() if only in (None, k)}
    cases = " ".join(f"WHEN data_type IN ({', '.join(repr(t) for t in types)}) THEN {render(template)}" for types, template in chosen.values())
    rows = described_fields(prof)
    if only:
        rows = rows.filter(F.col("data_type").isin(chosen[only][0]))
    return rows.selectExpr(*prof.columns, f"coalesce(CASE {cases} END, contextual_description) AS text")


def type_hint(data_type: Column) -> Column:
    """Instruction for a written description of a column of this type."""
    kind = F.lower(data_type)
    out = None
    for group, words in HINT_GROUPS.items():
        out = F.when(kind.isin(words), TYPE_HINTS[group]) if out is None else out.when(kind.isin(words), TYPE_HINTS[group])
    return out.otherwise(TYPE_HINTS["text"])
