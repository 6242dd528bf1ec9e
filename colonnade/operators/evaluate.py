"""Scoring generated schemas against golden ones, all runs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions import names


def canonical_names(df: DataFrame, column: str, synonyms: DataFrame) -> DataFrame:
    """Adds ``canonical`` for a name column: the first synonym entry (by position) whose canonical name or any
    synonym occurs in the normalised name; the normalised name itself when none does.

    synonyms: (pos, canonical, synonym). Only distinct names are compared.
    """
    entries = synonyms.select("pos", names.plain_name(F.col("canonical")).alias("canonical"), names.plain_name(F.col("synonym")).alias("synonym"))
    needles = entries.select("pos", "canonical", F.explode(F.array("canonical", "synonym")).alias("needle")).filter("needle IS NOT NULL").groupBy(
        "needle").agg(F.min(F.struct("pos", "canonical")).alias("entry"))
    distinct = df.select(F.col(column).alias("_name")).distinct().withColumn("_plain", names.plain_name(F.col("_name")))
    # one row: the lengths in use, and the entry of the empty needle, which every name contains
    known = needles.agg(F.array_sort(F.collect_set(F.nullif(F.length("needle"), F.lit(0)))).alias("_lengths"),
                        F.min(F.when(F.col("needle") == "", F.col("entry"))).alias("_any"))
    sized = distinct.join(F.broadcast(known), how="cross")
    cut = F.transform("_lengths", lambda n: F.when(n <= F.length("_plain"), F.transform(
        F.sequence(F.lit(1), F.length("_plain") - n + 1), lambda i: F.substring(F.col("_plain"), i, n))).otherwise(F.array().cast("array<string>")))
    parts = sized.select("_name", F.explode(F.array_distinct(F.flatten(cut))).alias("needle"))
    hits = parts.join(needles, "needle").groupBy("_name").agg(F.min("entry").alias("_hit"))
    named = sized.join(hits, "_name", "left").withColumn(
        "canonical", F.when(F.col("_plain").isNotNull(), F.coalesce(F.least("_hit", "_any")["canonical"], "_plain")))
    lookup = named.select("_name", "canonical")
    return df.join(lookup, F.col(column) == F.col("_name"), "left").drop("_name")


def canonical_nodes(rows: DataFrame, node_synonyms: DataFrame, property_synonyms: DataFrame) -> DataFrame:
    """Distinct (run_id, node, attr) with canonical names; nodes of the same canonical name merge."""
    named = canonical_names(rows, "node", node_synonyms).withColumn("node", F.col("canonical")).drop("canonical")
    return canonical_names(named, "attr", property_synonyms).withColumn("attr", F.col("canonical")).select("run_id", "node", "attr").distinct()


def edge_sets(rows: DataFrame) -> DataFrame:
    """Distinct edges (run_id, type, source, target, attrs) from one row per (run_id, edge_id, type, source, target, attr)."""
    grouped = rows.groupBy("run_id", "edge_id", "type", "source", "target").agg(F.sort_array(F.collect_set("attr")).alias("attrs"))
    return grouped.select("run_id", "type", "source", "target", "attrs").distinct()


def _runs(generated: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The runs to score: those given, which may have no rows at all, or those with rows."""
    return (generated if runs is None else runs).select("run_id").distinct()


def node_diff(generated: DataFrame, golden: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run_id, node, status): found, missing or extra. Every golden node is a row of every run, also of runs without any node (`runs` lists
    them), so runs and golden nodes are multiplied on purpose; all else is a join."""
    gold = golden.select("node").distinct().withColumn("_gold", F.lit(True))
    gen = generated.select("run_id", "node").distinct().withColumn("_gen", F.lit(True))
    wanted = _runs(generated, runs).crossJoin(gold)
    status = F.when(F.col("_gold").isNull(), "extra").when(F.col("_gen").isNull(), "missing").otherwise("found")
    return wanted.join(gen, ["run_id", "node"], "full_outer").select("run_id", "node", status.alias("status"))


def _ratio(found: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(found / F.nullif(total, F.lit(0)))


def node_score(generated: DataFrame, golden: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per run: found, missing and extra nodes and the share of golden nodes found (1 when there is none)."""
    # counts instead of the run x golden grid: found by semi join, the rest by arithmetic
    gold = golden.select("node").distinct()
    total = gold.agg(F.count(F.lit(1)).alias("golden_nodes"))
    gen = generated.select("run_id", "node").distinct().join(gold.withColumn("_hit", F.lit(1)), "node", "left")
    per_run = gen.groupBy("run_id").agg(F.count("_hit").alias("found"), F.count(F.lit(1)).alias("generated"))
    rows = _runs(generated, runs).join(per_run, "run_id", "left").fillna(0, ["found", "generated"]).join(F.broadcast(total))  # one row
    return rows.select("run_id", "found", (F.col("golden_nodes") - F.col("found")).alias("missing"), (F.col("generated") - F.col("found")).alias("extra"),
                       _ratio(F.col("found"), F.col("golden_nodes")).alias("node_score"))


def property_score(generated: DataFrame, golden: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per run: mean over golden nodes of the share of their attributes found (1 for nodes without attributes)."""
    gold = golden.select("node", "attr").distinct()
    sizes = gold.groupBy("node").agg(F.count("attr").alias("wanted"))
    total = sizes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("wanted") == 0).alias("empty_nodes"))
    hits = generated.select("run_id", "node", "attr").distinct().join(gold.filter("attr IS NOT NULL"), ["node", "attr"])
    per_node = hits.groupBy("run_id", "node").agg(F.count(F.lit(1)).alias("found")).join(sizes, "node")
    sums = per_node.groupBy("run_id").agg(F.sum(F.col("found") / F.col("wanted")).alias("shares"))
    rows = _runs(generated, runs).join(sums, "run_id", "left").join(F.broadcast(total))  # one row
    score = (F.coalesce("shares", F.lit(0.0)) + F.col("empty_nodes")) / F.nullif(F.col("nodes"), F.lit(0))
    return rows.select("run_id", F.coalesce(score, F.lit(1.0)).alias("property_score"))


def match_edges(generated: DataFrame, golden: DataFrame) -> DataFrame:
    """(run_id, type, source, target) of golden edges met by a generated edge between the same two nodes, in
    either direction, whose attributes include the golden ones; the type does not count.

    Edges meet on (pair, attribute): a golden edge is met when one generated edge shares all its attributes,
    so no list of edges per pair is built.
    """
    def paired(df: DataFrame) -> DataFrame:
        return df.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})
    gold = paired(golden).select("type", "source", "target", "a", "b", "attrs").distinct()
    gen = paired(generated).select("run_id", "a", "b", "attrs").distinct()
    plain = gold.filter(F.size("attrs") == 0).join(gen.select("run_id", "a", "b").distinct(), ["a", "b"])
    gen_rows = gen.select("run_id", "a", "b", F.xxhash64("attrs").alias("_g"), F.explode("attrs").alias("attr"))
    gold_rows = gold.select("type", "source", "target", "a", "b", F.array_sort("attrs").alias("attrs"), F.size("attrs").alias("need"), F.explode("attrs").alias("attr"))
    met = gold_rows.join(gen_rows, ["a", "b", "attr"]).groupBy("run_id", "type", "source", "target", "attrs", "need", "_g").agg(
        F.count(F.lit(1)).alias("have")).filter("have = need")
    return plain.select("run_id", "type", "source", "target", "attrs").unionByName(met.select("run_id", "type", "source", "target", "attrs")).distinct()


def relation_score(generated: DataFrame, golden: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per run: golden edges found and missing, generated edges on unmatched pairs, and the share found."""
    met = match_edges(generated, golden)
    total = golden.select("type", "source", "target", "attrs").distinct().agg(F.count(F.lit(1)).alias("golden_edges"))
    found = met.groupBy("run_id").agg(F.count(F.lit(1)).alias("found"))
    pairs = met.select("run_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    gen = generated.select("run_id", "type", "source", "target", "attrs").distinct().withColumns(
        {"a": F.least("source", "target"), "b": F.greatest("source", "target")})
    extra = gen.join(pairs, ["run_id", "a", "b"], "left_anti").groupBy("run_id").agg(F.count(F.lit(1)).alias("extra"))
    rows = _runs(generated, runs).join(found, "run_id", "left").join(extra, "run_id", "left").join(F.broadcast(total))  # one row
    rows = rows.fillna(0, ["found", "extra"])
    return rows.select("run_id", "found", (F.col("golden_edges") - F.col("found")).alias("missing"), "extra",
                       _ratio(F.col("found"), F.col("golden_edges")).alias("relation_score"))


def overall_score(nodes: DataFrame, properties: DataFrame, relations: DataFrame) -> DataFrame:
    """Per run: the three scores and their mean. Score all three for the same runs, as ``score_runs`` does."""
    rows = nodes.select("run_id", "node_score").join(properties, "run_id").join(relations.select("run_id", "relation_score"), "run_id")
    return rows.withColumn("overall_score", (F.col("node_score") + F.col("property_score") + F.col("relation_score")) / 3)


def score_runs(nodes: DataFrame, gold_nodes: DataFrame, edges: DataFrame, gold_edges: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """All scores of all runs: those given, or those with a node or an edge. A run without rows is scored like any other: 0
    where something golden is missing, 1 where nothing is."""
    runs = nodes.select("run_id").unionByName(edges.select("run_id")).distinct() if runs is None else runs
    return overall_score(node_score(nodes, gold_nodes, runs), property_score(nodes, gold_nodes, runs), relation_score(edges, gold_edges, runs))


def over_runs(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and standard deviation of the scores over all runs."""
    return scores.agg(F.count(F.lit(1)).alias("runs"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are new, gone or changed between two snapshots, with the names of the changed fields. A missing key is a key like others."""
    fields = [c for c in new.columns if c not in keys]
    o = old.select(*[F.col(c).alias(f"_old_{c}") for c in [*keys, *fields]], F.lit(True).alias("_in_old"))
    n = new.select(*keys, *fields, F.lit(True).alias("_in_new"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys])
    both = n.join(o, same, "full_outer").withColumns({k: F.when(F.col("_in_new").isNull(), F.col(f"_old_{k}")).otherwise(F.col(k)) for k in keys})
    changed = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_old_{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    status = F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "gone").when(F.size(changed) > 0, "changed")
    return both.select(*keys, status.alias("status"), F.when(status == "changed", F.array_join(changed, ",")).alias("changed_fields")).filter("status IS NOT NULL")
