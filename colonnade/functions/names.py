"""Name normalisation and small vector and key functions, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once however often it is read: as the only element of an array."""
    return F.transform(F.array(value), use)[0]


def camel_name(name: Column) -> Column:
    """Property name in camelCase; 'property' when nothing is left, 'p' in front of a digit."""
    plain = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), "[^a-zA-Z0-9]+", " "))

    def join(text: Column) -> Column:
        first = F.substring_index(text, " ", 1)
        return F.concat(F.lower(first), F.replace(F.initcap(F.substr(text, F.length(first) + 1)), F.lit(" "), F.lit("")))

    def named(joined: Column) -> Column:
        return F.when(joined == "", "property").when(joined.rlike("^[a-zA-Z]"), joined).otherwise(F.concat(F.lit("p"), joined))
    return _once(_once(plain, join), named)


def snake_name(name: Column) -> Column:
    """Relation type or header in lower snake_case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def plain_name(name: Column) -> Column:
    """Lower case without underscores, hyphens and dots, for comparisons."""
    return F.translate(F.lower(name), "_-.", "")


def lower_if_all_caps(label: Column) -> Column:
    return F.when((label == F.upper(label)) & (label != F.lower(label)), F.lower(label)).otherwise(label)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


PAIR_MARK = " <-> "


def pair_key(table_a: Column, column_a: Column, table_b: Column, column_b: Column) -> Column:
    return F.concat(table_a, F.lit("."), column_a, F.lit(PAIR_MARK), table_b, F.lit("."), column_b)


def parse_pair_key(key: Column) -> Column:
    """Struct (table_a, column_a, table_b, column_b): halves at the mark, then at the first dot."""
    left, right = F.split(key, PAIR_MARK, 2)[0], F.split(key, PAIR_MARK, 2)[1]
    return F.struct(F.split(left, r"\.", 2)[0].alias("table_a"), F.split(left, r"\.", 2)[1].alias("column_a"),
                    F.split(right, r"\.", 2)[0].alias("table_b"), F.split(right, r"\.", 2)[1].alias("column_b"))


def class_label(answer: Column, fallback: Column) -> Column:
    """'entity' or 'property' out of a free-text classification."""
    text = F.lower(answer)
    return (F.when(text.contains("entity") & ~text.contains("property"), "entity")
            .when(text.contains("property"), "property").otherwise(fallback))


def confidence(value: Column, default: float = 0.5) -> Column:
    """Confidence as a number, ``default`` for anything that is none."""
    return F.coalesce(value.try_cast("double"), F.lit(default))
