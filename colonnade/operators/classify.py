"""Entity or property: rules over the profile, answers, fallbacks and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions import names

# Fixed values of the reference rules.
UNIQUENESS_THRESHOLD = 0.9
LOW_CARDINALITY_SHARE = 0.1
PATTERN_SHARE = 0.5
FORCED_TYPES = ["date", "datetime", "float", "integer"]
NUMERIC_PATTERNS = ["phone", "credit_card", "numeric_id"]
ENTITY_KEYWORDS = ["id", "code", "city", "country", "state", "region", "category"]


def with_patterns(prof: DataFrame, patterns: DataFrame) -> DataFrame:
    """Profile with the value-pattern shares, 0 where a column has none."""
    keys = [c for c in ("table", "column_name") if c in prof.columns and c in patterns.columns]
    joined = prof.join(patterns, keys, "left")
    return joined.fillna(0.0, [c for c in patterns.columns if c.endswith("_ratio")])


def _forced() -> tuple[Column, Column, Column]:
    numeric = F.greatest(*[F.col(f"{p}_ratio") for p in NUMERIC_PATTERNS]) > PATTERN_SHARE
    return F.col("data_type").isin(FORCED_TYPES), F.col("email_ratio") > PATTERN_SHARE, numeric


def classify_rule(df: DataFrame) -> DataFrame:
    """Property by type or pattern, otherwise entity; confidence 1.0 and the reason."""
    by_type, by_mail, by_number = _forced()
    reason = (F.when(by_type, F.concat(F.lit("property, as its data type is "), "data_type"))
              .when(by_mail, "property, as most values are mail addresses")
              .when(by_number, "property, as most values are numbers that name something")
              .otherwise("entity, as nothing speaks for a property"))
    return df.withColumns({
        "classification": F.when(by_type | by_mail | by_number, "property").otherwise("entity"),
        "confidence": F.lit(1.0), "reason": reason})


def classify_rule_v2(df: DataFrame, unique_from: float = UNIQUENESS_THRESHOLD, low: float = LOW_CARDINALITY_SHARE) -> DataFrame:
    """As the first rule, then by uniqueness and low cardinality."""
    by_type, by_mail, by_number = _forced()
    few = (F.col("cardinality") > 1) & (F.col("cardinality") < F.col("total_rows") * low)
    return df.withColumns({"classification": F.when(by_type | by_mail | by_number, "property").when(F.col("uniqueness_ratio") > unique_from, "entity")
                           .when(few, "entity").otherwise("property"), "confidence": F.lit(1.0), "source": F.lit("rule_based")})


def keyword_fallback(name: Column, uniqueness: Column) -> tuple[Column, Column]:
    """(classification, confidence) from keywords in the column name and uniqueness."""
    lower = F.lower(name)
    likely = F.lit(False)
    for word in ENTITY_KEYWORDS:
        likely = likely | lower.contains(word)
    label = F.when(likely | (uniqueness > UNIQUENESS_THRESHOLD), "entity").otherwise("property")
    return label, F.when(likely, 0.7).otherwise(0.6)


def unclear_fallback(name: Column, data_type: Column, uniqueness: Column) -> Column:
    """Decision for an unclear answer: numbers, times, mail and id columns are properties."""
    lower = F.lower(name)
    prop = data_type.isin("integer", "float", "date", "datetime") | lower.contains("email") | lower.contains("id")
    return F.when(prop, "property").when(uniqueness > UNIQUENESS_THRESHOLD, "entity").otherwise("property")


def classify_fallback(df: DataFrame) -> DataFrame:
    label, conf = keyword_fallback(F.col("column_name"), F.col("uniqueness_ratio"))
    return df.withColumns({
        "basic": F.when(F.col("uniqueness_ratio") > UNIQUENESS_THRESHOLD, "entity").otherwise("property"),
        "keyword": label, "keyword_confidence": conf,
        "unclear": unclear_fallback(F.col("column_name"), F.col("data_type"), F.col("uniqueness_ratio"))})


def classify(prof: DataFrame, answers: DataFrame, rules: DataFrame) -> DataFrame:
    """Answer where valid, else rule, else keyword fallback. Inputs share (table, column_name); answers carry
    ``answer`` and ``answer_confidence``; columns without a profile are left out."""
    keys = ["table", "column_name"]
    r = rules.select(*keys, F.col("classification").alias("rule"), F.col("confidence").alias("rule_confidence"))
    rows = prof.join(answers, keys, "left").join(r, keys, "left")
    label, conf = keyword_fallback(F.col("column_name"), F.col("uniqueness_ratio"))
    unclear = F.coalesce("rule", unclear_fallback(F.col("column_name"), F.col("data_type"), F.col("uniqueness_ratio")))
    answered = F.col("answer").isNotNull()
    return rows.withColumns({
        "classification": F.when(answered, names.class_label(F.col("answer"), unclear)).otherwise(F.coalesce("rule", label)),
        "confidence": F.when(answered, names.confidence(F.col("answer_confidence"))).otherwise(F.coalesce("rule_confidence", conf)),
        "source": F.when(answered, "answer").when(F.col("rule").isNotNull(), "rule_based").otherwise("enhanced_fallback")})


def reconcile(header: DataFrame, answered: DataFrame, rules: DataFrame) -> DataFrame:
    """One consensus per header column: equal classes keep the answered row with its confidence, unequal ones take the surer side
    (the rule on a tie), missing ones stay empty. Entities carry their uniqueness."""
    keys = ["table", "column_name"]
    a = answered.select(*keys, F.col("classification").alias("a"), F.col("confidence").alias("ac"))
    r = rules.select(*keys, F.col("classification").alias("r"), F.col("confidence").alias("rc"), "uniqueness_ratio")
    rows = header.join(a, keys, "left").join(r, keys, "left")
    surer = F.when(F.col("ac") > F.col("rc"), F.col("a")).otherwise(F.col("r"))
    label = F.when(F.col("a") == F.col("r"), F.col("a")).when(F.col("a").isNull() | F.col("r").isNull(), F.coalesce("a", "r")).otherwise(surer)
    out = rows.withColumn("classification", F.coalesce(label, F.lit("")))
    return out.select(*header.columns, "classification",
                      F.coalesce(F.when(F.col("a") == F.col("r"), F.col("ac")), F.greatest("ac", "rc"), F.lit(0.0)).alias("confidence"),
                      F.when(F.col("a") != F.col("r"), True).otherwise(False).alias("was_conflict"),
                      F.when(F.col("classification") == "entity", F.col("uniqueness_ratio")).alias("entity_uniqueness"))
