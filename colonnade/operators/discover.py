"""From profiled tables to a property-graph schema in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions import names
from colonnade.operators import mapping, merge, schema
from colonnade.operators import profile as pf


def property_name(column):
    """camelCase name of a column without the short prefix of its table."""
    return names.camel_name(F.regexp_replace(column, mapping.NAME_PREFIX, ""))


def discover_from_profile(prof: DataFrame, synonyms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the schema behind profiled columns (table, column_name and the profile's fields).

    Identifier columns name entities; every column goes to its entity or, in bridge tables, to the relation; labels of one stem
    (or one synonym group) merge, the most frequent one staying. nodes: type, attributes; edges: type, source, target,
    attributes. All inputs have one row per column, so every step is small next to the data.
    """
    entities = mapping.detect_entities(prof)
    mapped = mapping.map_columns(prof, entities)
    merges = merge.propose_label_merges(entities.groupBy("label").agg(F.count(F.lit(1)).alias("n")), synonyms)
    labels = merges.select(F.col("src").alias("label"), F.col("dst").alias("merged"))
    own = mapped.filter("graph_element_type = 'entity_property'").select(F.col("belongs_to").alias("label"), property_name(F.col("column_name")).alias("property"))
    nodes = schema.schema_nodes(schema.schema_attributes(own, labels, merge.consolidate_properties(own, labels)))
    between = mapped.filter("graph_element_type = 'relationship_property'").select("table", property_name(F.col("column_name")).alias("attr"))
    relations = mapping.intra_relations(entities).select("table", F.col("source_entity").alias("source"), F.col("relationship_type").alias("type"),
                                                         F.col("target_entity").alias("target")).join(between, "table", "left")
    return nodes, schema.document_edges(schema.attributed_edges(relations, labels))


def discover_schema(tables: dict[str, DataFrame], dataset: str = "demo", synonyms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the schema behind a set of tables: profile, entities, mapping, merges, schema."""
    return discover_from_profile(pf.profile_catalog(tables, dataset, counted_only=True), synonyms)
