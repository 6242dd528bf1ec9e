"""Entities of a table, their relations, and the graph element each column belongs to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.operators.profile import compact

# Endings that mark an identifier column, and the short table prefix that is not part of the name.
ID_SUFFIXES = ["_id", "Id", "ID", "key"]
NAME_PREFIX = "^[a-z]{1,2}_"


def entity_label(column: Column, suffixes: list[str] = ID_SUFFIXES, prefix: str = NAME_PREFIX) -> Column:
    """Entity named by an identifier column, NULL for other columns."""
    ending = "(" + "|".join(suffixes) + ")$"
    base = F.regexp_replace(F.regexp_replace(column, ending, ""), prefix, "")
    is_id = column.rlike(ending) & (base != "")
    named = F.when(is_id, base).when(column.rlike("Ref$"), column)
    return F.concat(F.upper(F.left(named, F.lit(1))), F.substr(named, F.lit(2)))


def detect_entities(prof: DataFrame) -> DataFrame:
    """(table, column_name, label, uniqueness_ratio, cardinality, confidence) for identifier columns; dates,
    fractions and flags are descriptive."""
    rows = prof.withColumn("label", entity_label(F.col("column_name"))).filter(
        F.col("label").isNotNull() & ~F.col("data_type").isin("float", "date", "datetime", "boolean"))
    conf = F.when(F.col("uniqueness_ratio") > 0.8, 0.95).when(F.col("uniqueness_ratio") > 0.5, 0.8).otherwise(0.65)
    return rows.select("table", "column_name", "label", "uniqueness_ratio", "cardinality", conf.alias("confidence"))


def table_entities(entities: DataFrame) -> DataFrame:
    """Per table: the row entity (identifier of largest uniqueness, then first by name) and the number of entities."""
    rank = F.struct(F.col("uniqueness_ratio"), F.col("cardinality"), F.col("label"))
    return entities.groupBy("table").agg(
        F.max_by("label", rank).alias("row_entity"), F.max("uniqueness_ratio").alias("row_uniqueness"),
        F.count_distinct("label").alias("entities"))


def intra_relations(entities: DataFrame, default_type: str = "contains") -> DataFrame:
    """Row entity -> every other entity of its table; none for tables with fewer than two entities."""
    rows = entities.join(table_entities(entities).filter("entities >= 2"), "table").filter(F.col("label") != F.col("row_entity"))
    return rows.select("table", F.col("row_entity").alias("source_entity"), F.lit(default_type).alias("relationship_type"),
                       F.col("label").alias("target_entity"), F.lit("source_to_target").alias("direction"), "confidence").distinct()


def map_columns(prof: DataFrame, entities: DataFrame, with_ignore: bool = False) -> DataFrame:
    """Graph element of every column: identifiers belong to their entity; measures of a bridge table (several
    entities, no unique identifier) to its relation; the rest to the row entity. ``with_ignore`` keeps
    constant columns and tables without entities as 'ignore'."""
    tables = table_entities(entities)
    own = entities.select("table", "column_name", "label")
    rows = prof.join(own, ["table", "column_name"], "left").join(tables, "table", "left")
    bridge = (F.col("entities") >= 2) & (F.col("row_uniqueness") < 0.9)
    measure = F.col("data_type").isin("integer", "float") & F.col("label").isNull()
    element = F.when(F.col("label").isNotNull(), "entity_property").when(bridge & measure, "relationship_property").otherwise("entity_property")
    owner = F.when(F.col("label").isNotNull(), F.col("label")).when(bridge & measure, "contains").otherwise(F.col("row_entity"))
    confidence = F.when(F.col("label").isNotNull(), 0.95).when(F.col("row_uniqueness") >= 0.9, 0.85).when(bridge & measure, 0.6).otherwise(0.5)
    if with_ignore:
        skip = F.col("row_entity").isNull() | (F.col("cardinality") <= 1)
        element, owner = F.when(skip, "ignore").otherwise(element), F.when(skip, "").otherwise(owner)
        confidence = F.when(skip, 0.9).otherwise(confidence)
    else:
        rows = rows.filter(F.col("row_entity").isNotNull())
    return rows.select(*prof.columns, element.alias("graph_element_type"), owner.alias("belongs_to"), confidence.alias("confidence"))


# Up to this many pairs each get their own branch (a scan of those two columns); more share one scan.
BRANCHES = 64


def dependency_scores(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(left, right, left_distinct, pair_distinct, score): how far each left value has a single right value; missing cells do not count.

    A pair's rows are made distinct with partial results in every map task, and two counts follow. The left value is part of every key, so
    neither a column nor a pair gathers in one task. Up to `BRANCHES` pairs are each read by themselves, with values as they are; of more, one scan
    gives one entry a row and pair, with values as texts. No pairs give no rows."""
    pairs = [(a, b) for a in left for b in right if a != b]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, left_distinct bigint, pair_distinct bigint, score double")
    plain = (T.IntegralType, T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)

    def cell(name: str, as_text: bool) -> Column:
        kind = df.schema[name].dataType
        if not as_text and isinstance(kind, plain):
            return F.col(f"`{name}`")
        value = F.col(f"`{name}`")
        value = (value + F.lit(0.0) if isinstance(kind, (T.FloatType, T.DoubleType)) else value).cast("string")  # zeros of both signs are one value
        return F.when(F.length(value) > 60, F.sha2(value, 256)).otherwise(value)  # a digest is longer than any plain value
    if len(pairs) <= BRANCHES:
        per_value = []
        for a, b in pairs:
            both = df.select(cell(a, False).alias("a"), cell(b, False).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
            counts = both.distinct().groupBy("a").agg(F.count(F.lit(1)).alias("m"))
            per_value.append(counts.select(F.lit(a).alias("left"), F.lit(b).alias("right"), "m"))
        per_value = reduce(DataFrame.unionByName, per_value)
    else:
        entries = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), cell(a, True).alias("a"), cell(b, True).alias("b")) for a, b in pairs])
        distinct = df.select(F.inline(entries)).filter("a IS NOT NULL AND b IS NOT NULL").groupBy("left", "right", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        per_value = distinct.groupBy("left", "right", "a").agg(F.count(F.lit(1)).alias("m"))
    counts = per_value.groupBy("left", "right").agg(F.count(F.lit(1)).alias("left_distinct"), F.sum("m").alias("pair_distinct"))
    every = df.sparkSession.createDataFrame(pairs, "left string, right string")  # pairs without rows keep their place
    return every.join(counts, ["left", "right"], "left").select(
        "left", "right", F.coalesce("left_distinct", F.lit(0).cast("bigint")).alias("left_distinct"), F.coalesce("pair_distinct", F.lit(0).cast("bigint")).alias("pair_distinct"),
        F.coalesce(F.col("left_distinct") / F.nullif(F.col("pair_distinct"), F.lit(0)), F.lit(0.0)).alias("score"))


def map_properties(scores: DataFrame) -> DataFrame:
    """One entity per property: strongest dependency, then the entity with fewest values (the closest owner)."""
    rank = F.struct(F.col("score"), -F.col("left_distinct"), F.col("left"))
    return scores.groupBy(F.col("right").alias("property")).agg(
        F.max_by("left", rank).alias("entity"), F.max("score").alias("confidence"))


def entity_pairs(entities: DataFrame) -> DataFrame:
    """Each unordered pair of distinct entities of a table once; a table has at most as many entities as columns."""
    sets = entities.groupBy("table").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    first = sets.select("table", "labels", F.posexplode("labels").alias("at", "entity_a"))
    return first.select("table", "entity_a", F.explode(F.slice("labels", F.col("at") + 2, F.greatest(F.size("labels"), F.lit(1)))).alias("entity_b"))


def keep_sure(relations: DataFrame, above: float = 0.5) -> DataFrame:
    """Relations with both ends, a type and a confidence above the limit."""
    return relations.filter(F.col("source_entity").isNotNull() & F.col("target_entity").isNotNull()
                            & F.col("relationship_type").isNotNull() & (F.col("confidence") > above))


def add_reverse(relations: DataFrame) -> DataFrame:
    """Appends the swapped row of every bidirectional relation."""
    both = relations.filter("bidirectional").withColumns({"source_entity": F.col("target_entity"), "target_entity": F.col("source_entity")})
    return relations.unionByName(both)


def infer_relations(scores: DataFrame) -> DataFrame:
    """Relations between entity columns from dependency scores of both directions: kept above 0.5, swapped rows
    added where each side determines the other."""
    back = scores.select(F.col("left").alias("right"), F.col("right").alias("left"), F.col("score").alias("back"))
    pairs = scores.join(back, ["left", "right"]).filter(F.col("left") < F.col("right"))
    forward = F.col("score") >= F.col("back")
    relations = pairs.select(
        F.when(forward, F.col("left")).otherwise(F.col("right")).alias("source_entity"),
        F.when(forward, F.col("right")).otherwise(F.col("left")).alias("target_entity"), F.lit("belongs_to").alias("relationship_type"),
        F.greatest("score", "back").alias("confidence"), ((F.col("score") == 1) & (F.col("back") == 1)).alias("bidirectional"))
    return add_reverse(keep_sure(relations))


def associated_entity(classes: DataFrame) -> DataFrame:
    """Entity of every non-entity row: the named one, else the primary, else the first by position.

    Input: table, pos, column_name, type, entity_type, is_primary, associated_entity.
    """
    found = F.struct(F.col("column_name"), F.col("entity_type"))
    entities = classes.filter("type = 'entity'")
    named = entities.groupBy("table", F.lower("entity_type").alias("_key")).agg(F.min_by(found, "pos").alias("named"))
    defaults = entities.groupBy("table").agg(
        F.min_by(found, F.when(F.col("is_primary"), F.col("pos"))).alias("_any_primary"), F.bool_or("is_primary").alias("_has"),
        F.min_by(found, "pos").alias("first"))
    rows = classes.filter("type <> 'entity'").withColumn("_key", F.lower("associated_entity"))
    joined = rows.join(named, ["table", "_key"], "left").join(defaults, "table", "left")
    pick = F.coalesce("named", F.when(F.col("_has"), F.col("_any_primary")), "first")
    return joined.select("table", "pos", "column_name", pick["entity_type"].alias("entity_type"), pick["column_name"].alias("entity_column"))


def associated_relation(classes: DataFrame, relation: str = "associated_relationship") -> DataFrame:
    """Source (primary entity) and target (first entity whose type ends the relation's name) of a relation.

    The ending is found by joining on the name's suffixes, so no row meets entities it cannot match.
    """
    entities = classes.filter("type = 'entity'")
    primary = entities.filter("is_primary").groupBy("table").agg(F.min_by("entity_type", "pos").alias("source_entity"))
    by_name = entities.groupBy("table", F.lower("entity_type").alias("suffix")).agg(F.min(F.struct("pos", "entity_type")).alias("hit"))
    rows = classes.filter(F.col("type") != "entity").filter(F.coalesce(F.col(relation), F.lit("")) != "")
    suffixes = rows.select("table", "pos", "column_name", F.col(relation).alias("relationship_type"), F.explode(F.transform(
        F.sequence(F.lit(1), F.length(relation)), lambda i: F.substring(F.lower(F.col(relation)), i, F.length(relation)))).alias("suffix"))
    target = suffixes.join(by_name, ["table", "suffix"]).groupBy("table", "pos", "column_name", "relationship_type").agg(
        F.min("hit")["entity_type"].alias("target_entity"))
    return target.join(primary, "table")


def entity_columns(mapped: DataFrame, prof: DataFrame) -> DataFrame:
    """(label, table, column_name and the compact statistics) of the columns that belong to an entity."""
    own = mapped.filter("graph_element_type = 'entity_property'").select("table", "column_name", F.col("belongs_to").alias("label"))
    return own.join(compact(prof.drop("dataset")), ["table", "column_name"])


def enrich_properties(mapped: DataFrame, prof: DataFrame) -> DataFrame:
    """Columns that belong to an element, with what their profile says of them: type, counts, missing share and samples."""
    kept = mapped.filter("graph_element_type <> 'ignore'").select("table", "column_name", F.col("belongs_to").alias("label"))
    facts = prof.select("table", "column_name", "data_type", "cardinality", "uniqueness_ratio", "missing_percentage", "sampled_values")
    return kept.join(facts, ["table", "column_name"], "left")


def evidence_lines(prof: DataFrame, samples_only: bool = False) -> DataFrame:
    """'column | json' lines of each table, joined in column order; a table has as many lines as columns."""
    fields = ["sampled_values"] if samples_only else ["data_type", "cardinality", "uniqueness_ratio", "missing_percentage", "sampled_values"]
    line = F.concat("column_name", F.lit(" | "), F.to_json(F.struct(*fields)))
    return prof.groupBy("table").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("column_name", line.alias("l")))),
                                                              lambda x: x["l"]), "\n").alias("lines"))
