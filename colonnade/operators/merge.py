"""Merging labels, properties and relation types across tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions import names
from colonnade.session import stage


def stem(label: Column) -> Column:
    """Label without case, separators and plural ending."""
    plain = names.plain_name(F.regexp_replace(label, r"\s+", ""))
    return F.when(plain.rlike("[^s]s$") & (F.length(plain) > 3), F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain)


def property_union(props: DataFrame) -> DataFrame:
    """Sorted distinct properties per label over all tables, from (label, property) rows."""
    distinct = props.select("label", "property").distinct()
    return distinct.groupBy("label").agg(F.sort_array(F.collect_list("property")).alias("properties"))


def distinct_labels(detections: DataFrame) -> DataFrame:
    """Distinct referenced entities of the tables that have any, from (has_entity_references, referenced_entities)."""
    return detections.filter("has_entity_references").select(F.explode("referenced_entities").alias("label")).distinct()


def propose_label_merges(counts: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(src, dst, group_key, confidence): labels with the same stem (or synonym group) merge into the most frequent one.

    Input (label, n), distinct labels; a group holds the spellings of one stem.
    """
    keyed = stage(counts, "label_counts").withColumn("group_key", stem(F.col("label")))  # read twice below
    if synonyms is not None:
        keyed = keyed.join(synonyms.select(F.col("synonym").alias("group_key"), "canonical").distinct(), "group_key", "left").withColumn(
            "group_key", F.coalesce("canonical", "group_key")).drop("canonical")
    best = keyed.groupBy("group_key").agg(F.max_by("label", F.struct("n", "label")).alias("dst"), F.count(F.lit(1)).alias("size")).filter("size >= 2")
    rows = keyed.join(best, "group_key").filter(F.col("label") != F.col("dst"))
    sure = F.when(F.lower("label") == F.lower("dst"), 0.95).otherwise(0.8)
    return rows.select(F.col("label").alias("src"), "dst", "group_key", sure.alias("confidence"))


def normalise_merges(df: DataFrame) -> DataFrame:
    """Merge rows with ``from``/``to`` or ``source``/``target``, single values or lists, as (from_labels, to_label)."""
    def as_list(single: str, many: str) -> Column:
        return F.coalesce(F.col(many), F.when(F.col(single).isNotNull(), F.array(single)))
    return df.select("merge_id", F.coalesce(as_list("source", "from_list")).alias("from_labels"), F.coalesce("to_label", "target").alias("to_label"))


def explode_merges(merges: DataFrame) -> DataFrame:
    """One row per source label; identity merges are dropped, ignoring case."""
    rows = merges.select(*[c for c in merges.columns if c != "from_labels"], F.explode("from_labels").alias("from_label"))
    return rows.filter(F.lower("from_label") != F.lower("to_label"))


def validate_merges(merges: DataFrame, evidence: DataFrame, minimum: float = 0.6) -> DataFrame:
    """Keeps merges whose labels' columns agree in type and overlap in range, with a confidence from both.

    Evidence: (label, data_type, min_value, max_value), one row per column, so small next to the data.
    """
    a = evidence.select(F.col("label").alias("src"), F.col("data_type").alias("ta"), F.col("min_value").alias("lo_a"), F.col("max_value").alias("hi_a"))
    b = evidence.select(F.col("label").alias("dst"), F.col("data_type").alias("tb"), F.col("min_value").alias("lo_b"), F.col("max_value").alias("hi_b"))
    rows = merges.filter(F.lower("src") != F.lower("dst")).join(a, "src").join(b, "dst")
    same = F.col("ta") == F.col("tb")
    overlap = (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a"))
    scored = rows.groupBy("src", "dst").agg(F.avg(same.cast("double")).alias("type_share"), F.avg(F.when(
        same, F.coalesce(overlap, F.lit(True)).cast("double")).otherwise(0.0)).alias("overlap_share"))
    return scored.withColumn("confidence", F.col("type_share") * 0.5 + F.col("overlap_share") * 0.5).filter(F.col("confidence") >= minimum)


def merge_map(merges: DataFrame) -> DataFrame:
    """(label, merged): each source label and the first target by order."""
    return merges.groupBy(F.col("src").alias("label")).agg(F.min_by("dst", "pos").alias("merged"))


def relabel(df: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces labels by their merged label where there is one."""
    for c in columns:
        m = mapping.select(F.col("label").alias("_label"), F.col("merged").alias("_merged"))
        df = df.join(m, F.col(c) == F.col("_label"), "left").withColumn(c, F.coalesce("_merged", c)).drop("_label", "_merged")
    return df


def merge_evidence(merges: DataFrame, mapped: DataFrame, columns: DataFrame) -> DataFrame:
    """Statistics behind a merge: columns mapped to one of its labels; where there is none, columns whose
    ``table.column`` key mentions a label.

    The mention is found by joining on the key's substrings of the lengths that labels have.
    """
    labels = merges.select("merge_id", F.explode(F.array("src", "dst")).alias("label")).distinct()
    direct = labels.join(mapped.withColumnRenamed("belongs_to", "label"), "label").select("merge_id", "label", "table", "column_name", F.lit("mapped").alias("evidence"))
    rest = labels.join(direct.select("merge_id").distinct(), "merge_id", "left_anti").withColumn("_needle", F.lower("label"))
    lengths = rest.agg(F.collect_set(F.length("_needle")).alias("_lengths"))  # one row
    keyed = columns.select("table", "column_name", F.lower(F.concat_ws(".", "table", "column_name")).alias("_key")).join(F.broadcast(lengths), how="cross")
    cut = F.transform("_lengths", lambda n: F.when((n > 0) & (n <= F.length("_key")), F.transform(
        F.sequence(F.lit(1), F.length("_key") - n + 1), lambda i: F.substring(F.col("_key"), i, n))).otherwise(F.array().cast("array<string>")))
    pieces = keyed.select("table", "column_name", F.explode(F.array_distinct(F.flatten(cut))).alias("_needle"))
    mentioned = rest.join(pieces, "_needle").select("merge_id", "label", "table", "column_name", F.lit("mentioned").alias("evidence"))
    return direct.unionByName(mentioned)


def consolidate_properties(props: DataFrame, merges: DataFrame) -> DataFrame:
    """Properties per target label after a merge: those that differ only in casing or separators are one,
    in the target's spelling where it has it. Input (label, property) and (label, merged)."""
    mapped = props.join(merges.select("label", "merged"), "label", "left")
    targets = merges.select(F.col("merged").alias("target")).distinct()
    rows = mapped.withColumn("target", F.coalesce("merged", "label")).join(targets, "target")
    own = F.struct(F.when(F.col("merged").isNull(), 0).otherwise(1).alias("rank"), F.col("property"))
    kept = rows.groupBy("target", names.plain_name(F.col("property")).alias("plain")).agg(F.min(own)["property"].alias("property"))
    return kept.groupBy(F.col("target").alias("label")).agg(F.sort_array(F.collect_list("property")).alias("properties"))


# ---- relation types ---------------------------------------------------------------------------------

def drop_self(relations: DataFrame, source: str = "source", target: str = "target", ignore_case: bool = True) -> DataFrame:
    s, t = (F.lower(source), F.lower(target)) if ignore_case else (F.col(source), F.col(target))
    return relations.filter(s != t)


def undirected(relations: DataFrame) -> DataFrame:
    """Distinct (a, type, b) with sorted ends and normalised type."""
    return relations.select(F.least("source", "target").alias("a"), names.snake_name(F.col("type")).alias("type"),
                            F.greatest("source", "target").alias("b")).distinct()


def relation_candidates(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Undirected triples of relations with at least one merged end, relabelled, without self relations."""
    touched = relations.select("source", "type", "target").distinct()
    for side in ("source", "target"):
        m = mapping.select(F.col("label").alias(f"_{side}"), F.col("merged").alias(f"_{side}_to"))
        touched = touched.join(m, F.col(side) == F.col(f"_{side}"), "left")
    hit = touched.filter(F.col("_source_to").isNotNull() | F.col("_target_to").isNotNull())
    renamed = hit.select(F.coalesce("_source_to", "source").alias("source"), "type", F.coalesce("_target_to", "target").alias("target"))
    return undirected(drop_self(renamed))


def type_sets(triples: DataFrame) -> DataFrame:
    """Sorted types per undirected pair."""
    return triples.groupBy("a", "b").agg(F.sort_array(F.collect_set("type")).alias("types"))


def property_counts(relations: DataFrame) -> DataFrame:
    """Distinct property names seen per normalised type, from a ``properties`` map."""
    keys = relations.select(names.snake_name(F.col("type")).alias("type"), F.explode(F.map_keys("properties")).alias("key")).distinct()
    return keys.groupBy("type").agg(F.count(F.lit(1)).alias("property_count"))


def merge_relation_types(types: DataFrame) -> DataFrame:
    """Groups of equivalent types and the name they merge into.

    Input (pair, type, richness): two or more types of one undirected pair with equal stems form a group; its name is the
    richest type. Groups are taken in the order of their pairs, and one with a type that has been merged already is left out
    as a whole. Types of different stems never meet, so each stem is settled by itself, from its distinct groups: a later copy of
    a group never counts.
    """
    rows = types.withColumn("stem", stem(F.regexp_replace("type", "^(has|is|the)_", ""))).select(
        "pair", "stem", F.struct("richness", "type").alias("member"))
    groups = rows.groupBy("pair", "stem").agg(F.array_sort(F.collect_set("member")).alias("members")).filter(F.size("members") >= 2)
    first = groups.groupBy("stem", "members").agg(F.min("pair").alias("pair"))
    listed = first.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("pair", "members"))).alias("groups"))

    def sources(group: Column) -> Column:
        return F.slice(group["members"], F.lit(1), F.size(group["members"]) - 1)  # all but the richest

    def taken(kept: Column) -> Column:
        return F.flatten(F.transform(kept, lambda g: F.transform(sources(g), lambda m: m["type"])))
    kept = F.aggregate("groups", F.filter("groups", lambda g: F.lit(False)), lambda kept, g: F.when(
        F.arrays_overlap(taken(kept), F.transform(sources(g), lambda m: m["type"])), kept).otherwise(F.array_append(kept, g)))
    one = listed.select(F.explode(kept).alias("g")).select("g.pair", F.element_at("g.members", -1)["type"].alias("to_type"), F.explode(sources(F.col("g"))).alias("m"))
    return one.select(F.col("m.type").alias("from_type"), "to_type", "pair", F.col("m.richness").alias("richness"))
