"""Assembly of the property-graph schema and the node and edge tables behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions import names
from colonnade.operators import merge


def schema_attributes(mapped: DataFrame, mapping: DataFrame, consolidated: DataFrame) -> DataFrame:
    """Attributes per label: the consolidated list where the label has one, else the union of its columns.

    mapped (label, property); mapping (label, merged); consolidated (label, properties).
    """
    union = merge.property_union(merge.relabel(mapped, mapping, ["label"])).withColumnRenamed("properties", "mapped_properties")
    return union.join(consolidated, "label", "full_outer").select(
        "label", F.coalesce("properties", "mapped_properties").alias("properties"))


def schema_edges(relations: DataFrame, mapping: DataFrame, relation_merges: DataFrame | None = None) -> DataFrame:
    """Distinct (source, type, target) after relabelling, self relations dropped; relation-type merges on request."""
    rows = merge.drop_self(merge.relabel(relations.select("source", "type", "target").distinct(), mapping, ["source", "target"]), ignore_case=False)
    if relation_merges is not None:
        m = relation_merges.groupBy("from_type").agg(F.min("to_type").alias("_to"))
        rows = rows.join(m, F.col("type") == F.col("from_type"), "left").withColumn("type", F.coalesce("_to", "type")).drop("_to", "from_type")
    return rows.select("source", "type", "target").distinct()


def attributed_edges(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source, type, target, attributes) from relations with one row per attribute (``attr``, NULL for none), relabelled; self
    relations go. An edge of several tables has the attributes of all of them."""
    rows = merge.drop_self(merge.relabel(relations.select("source", "type", "target", "attr").distinct(), mapping, ["source", "target"]), ignore_case=False)
    return rows.groupBy("source", "type", "target").agg(F.sort_array(F.collect_set("attr")).alias("attributes"))


def last_relation(relations: DataFrame, order: Column) -> DataFrame:
    """One row per (source, type, target), the last by ``order``; bounded state per key, no sort of a group."""
    rest = [c for c in relations.columns if c not in ("source", "type", "target")]
    return relations.groupBy("source", "type", "target").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("source", "type", "target", "_r.*")


def schema_nodes(attributes: DataFrame) -> DataFrame:
    """Node types of the schema: labels written in capitals only are lowered, attributes sorted."""
    return attributes.select(names.lower_if_all_caps(F.col("label")).alias("type"), F.sort_array("properties").alias("attributes"))


def document_edges(edges: DataFrame) -> DataFrame:
    """Edges as they are written: labels in capitals only are lowered; attributes stay."""
    rest = [c for c in ("attributes",) if c in edges.columns]
    return edges.select("type", *[names.lower_if_all_caps(F.col(c)).alias(c) for c in ("source", "target")], *rest)


def align_edges(edges: DataFrame, golden: DataFrame) -> DataFrame:
    """Turns an edge around when the golden schema lacks it as it is but has the reverse; other columns stay."""
    keys = golden.select(F.col("type").alias("_t"), F.col("source").alias("_s"), F.col("target").alias("_g")).distinct()
    exact, back = keys.withColumn("_exact", F.lit(True)), keys.withColumn("_back", F.lit(True))
    rows = edges.join(exact, (F.col("type") == F.col("_t")) & (F.col("source") == F.col("_s")) & (F.col("target") == F.col("_g")), "left").drop("_t", "_s", "_g")
    rows = rows.join(back, (F.col("type") == F.col("_t")) & (F.col("source") == F.col("_g")) & (F.col("target") == F.col("_s")), "left").drop("_t", "_s", "_g")
    flip = F.col("_exact").isNull() & F.col("_back").isNotNull()
    return rows.withColumns({"source": F.when(flip, F.col("target")).otherwise(F.col("source")),
                             "target": F.when(flip, F.col("source")).otherwise(F.col("target")), "flipped": flip}).drop("_exact", "_back")


def node_id(label: str, key: Column) -> Column:
    """Repeatable unique id of a node."""
    return F.sha2(F.concat(F.lit(label + "|"), key.cast("string")), 256)


def property_names(columns: list[str], prefix: str = "^[a-z]{1,2}_") -> dict[str, str]:
    """camelCase property name of each column."""
    import re
    out = {}
    for c in columns:
        words = re.sub("[^a-zA-Z0-9]+", " ", re.sub(prefix, "", c)).split() or ["property"]
        name = words[0].lower() + "".join(w.capitalize() for w in words[1:])
        out[c] = name if name[0].isalpha() else "p" + name
    return out


def materialize_nodes(df: DataFrame, label: str, key: str, properties: list[str], unique_key: bool = False) -> DataFrame:
    """One node per entity key with a repeatable id and camelCase properties. ``unique_key`` skips the
    grouping where the key is known to be unique, so the step needs no shuffle."""
    named = property_names(properties)
    rows = df.filter(F.col(key).isNotNull())
    if unique_key:
        values = rows.select(key, *properties)
    else:
        values = rows.groupBy(key).agg(F.min(F.struct(*properties)).alias("_p")).select(key, "_p.*") if properties else rows.select(key).distinct()
    return values.select(node_id(label, F.col(key)).alias("id"), F.lit(label).alias("label"), F.col(key).cast("string").alias("key"),
                         *[F.col(c).alias(n) for c, n in named.items()])


def materialize_edges(df: DataFrame, kind: str, source_label: str, source_key: str, target_label: str, target_key: str,
                      targets: DataFrame | None = None, target_column: str | None = None, properties: list[str] = (), together: str | None = None) -> DataFrame:
    """Edges between two keys of a row. With ``targets`` only edges whose target exists are kept (join on the
    foreign key; Spark picks the strategy by size). ``together`` names the key whose rows are to lie side by side, for tables that are
    written: ids don't compress unless equal ones meet, and two short keys are shuffled instead. A key with very many rows is split."""
    rows = df.filter(F.col(source_key).isNotNull() & F.col(target_key).isNotNull())
    if targets is not None:
        rows = rows.join(targets.select(F.col(target_column).alias(target_key)), target_key, "left_semi")
    if together is not None:
        rows = rows.select(*dict.fromkeys([source_key, target_key, *properties])).hint("rebalance", F.col(together)).sortWithinPartitions(together)
    named = property_names(list(properties))
    return rows.select(node_id(source_label, F.col(source_key)).alias("source_id"), F.lit(kind).alias("type"),
                       node_id(target_label, F.col(target_key)).alias("target_id"), *[F.col(c).alias(n) for c, n in named.items()])


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """Node ids that occur more than once; empty when the uniqueness constraint holds."""
    return nodes.groupBy("id").count().filter("count > 1")
