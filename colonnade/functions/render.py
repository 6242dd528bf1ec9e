"""Filling text templates and reading structured answers, as batch column work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_template(template: Column, variables: Column) -> Column:
    """Replaces ``{key}`` for each entry of a string map; reports placeholders that remain."""
    filled = F.aggregate(
        F.map_entries(variables), template,
        lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    open_names = F.regexp_extract_all(filled, F.lit(r"(\{[\w_]+\})"), 1)
    return F.when(F.size(open_names) > 0, F.concat(
        F.lit("Error: unsubstituted placeholders in prompt: "), F.array_join(open_names, ", "))).otherwise(filled)


def clean_answer(answer: Column) -> Column:
    """Answer text without code fences and wrapping quotes."""
    text = F.trim(answer)
    inner = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    body = F.when(text.rlike(r"```(?:json)?\s*[\s\S]*?\s*```"), inner).otherwise(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    return F.regexp_replace(F.trim(body), r"""^(["'])([\s\S]*)\1$""", "$2")


def _parsed(text: Column) -> Column:
    """The text when it is a JSON object or array, else NULL."""
    return F.when(F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*[\[{]"), text)


def unescaped(text: Column) -> Column:
    """Text whose quotes and line breaks are escaped, as inside a JSON string; NULL when it is no such text."""
    wrapped = F.concat(F.lit('{"v":"'), text, F.lit('"}'))
    return F.from_json(wrapped, "v string", {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"})["v"]


def close_brackets(text: Column) -> Column:
    """Appends the closing brackets that are missing by count."""
    def missing(opening: str, closing: str) -> Column:
        count = F.length(text) - F.length(F.replace(text, F.lit(opening), F.lit("")))
        closed = F.length(text) - F.length(F.replace(text, F.lit(closing), F.lit("")))
        return F.repeat(F.lit(closing), F.greatest(count - closed, F.lit(0)))
    return F.concat(text, missing("[", "]"), missing("{", "}"))


def answer_json(answer: Column) -> Column:
    """JSON text out of a free answer: widest bracketed part, the answer without escapes, the largest fragment that parses, or the
    answer with its missing brackets added; NULL when nothing parses."""
    body = clean_answer(answer)
    widest = F.regexp_extract(body, r"(\{[\s\S]*\}|\[[\s\S]*\])", 1)
    pieces = F.concat(F.regexp_extract_all(body, F.lit(r"(\{[\s\S]*?\})"), 1), F.regexp_extract_all(body, F.lit(r"(\[[\s\S]*?\])"), 1))
    good = F.filter(pieces, lambda p: F.try_parse_json(p).isNotNull())
    largest = F.sort_array(F.transform(good, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))), asc=False)
    start = F.regexp_extract(body, r"([\[{][\s\S]*)", 1)
    return F.coalesce(_parsed(widest), _parsed(unescaped(body)), F.when(F.size(good) > 0, largest[0]["p"]), _parsed(close_brackets(start)))


def parse_answers(df: DataFrame, column: str) -> DataFrame:
    """Adds ``json`` and ``error`` for a column of answers."""
    text = F.col(column)
    rows = df.withColumn("json", F.when(F.trim(text) != "", answer_json(text)))
    return rows.withColumn("error", F.when(text.isNull() | (F.trim(text) == ""), "Empty response").when(F.col("json").isNull(), "Failed to parse JSON"))
