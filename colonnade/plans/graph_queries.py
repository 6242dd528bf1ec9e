"""Relations, label merging, schema assembly, graph tables and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.operators import evaluate as ev
from colonnade.operators import mapping, merge, schema, stats
from colonnade.plans.registry import Tables, query
from colonnade.session import new_path, stage
from colonnade.sources import store

# Relations between nations through the line items: supplier nation --(order priority)-> customer nation.
TRADE = """(SELECT l_orderkey, l_linenumber, ns.n_name AS source, o_orderpriority AS type, nc.n_name AS target, l_discount * 10 AS confidence,
    l_linestatus = 'O' AS bidirectional, CAST(year(l_shipdate) AS VARCHAR) AS run_id, l_returnflag AS flag, p_brand AS brand, p_name AS pname
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN part ON l_partkey = p_partkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN nation nc ON c_nationkey = nc.n_nationkey)"""
MERGES = "(SELECT n_name AS label, r_name AS merged FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey < 2)"


def trade(t: Tables) -> DataFrame:
    ns = t.nation.selectExpr("n_nationkey AS sk", "n_name AS source")
    nc = t.nation.selectExpr("n_nationkey AS ck", "n_name AS target")
    rows = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(ns, F.col("s_nationkey") == F.col("sk")).join(nc, F.col("c_nationkey") == F.col("ck")))
    return rows.selectExpr("l_orderkey", "l_linenumber", "source", "o_orderpriority AS type", "target", "l_discount * 10 AS confidence",
                           "l_linestatus = 'O' AS bidirectional", "cast(year(l_shipdate) AS string) AS run_id", "l_returnflag AS flag",
                           "p_brand AS brand", "p_name AS pname")


def merges(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).filter("n_regionkey < 2").selectExpr("n_name AS label", "r_name AS merged")


def as_relations(df: DataFrame) -> DataFrame:
    return df.selectExpr("source AS source_entity", "type AS relationship_type", "target AS target_entity", "confidence", "bidirectional")


COUNTED = "SELECT source, type, target, count(*) AS n FROM ({}) GROUP BY source, type, target"


def counted(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "type", "target").agg(F.count(F.lit(1)).alias("n"))


@query("relation_filter", COUNTED.format(f"SELECT * FROM {TRADE} WHERE confidence > 0.5"))
def relation_filter(t: Tables) -> DataFrame:
    kept = mapping.keep_sure(as_relations(trade(t)))
    return counted(kept.selectExpr("source_entity AS source", "relationship_type AS type", "target_entity AS target"))


@query("no_self_relations", COUNTED.format(f"SELECT * FROM {TRADE} WHERE lower(source) <> lower(target)"))
def no_self_relations(t: Tables) -> DataFrame:
    return counted(merge.drop_self(trade(t)))


SNAKE = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("relation_triples", f"SELECT DISTINCT least(source, target) AS a, {SNAKE.format('type')} AS type, greatest(source, target) AS b FROM {TRADE}")
def relation_triples(t: Tables) -> DataFrame:
    return merge.undirected(trade(t))


@query("relation_dedupe", f"""SELECT source, type, target, round(confidence, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY source, type, target
    ORDER BY l_orderkey DESC, l_linenumber DESC, confidence DESC) AS r FROM {TRADE}) WHERE r = 1""")
def relation_dedupe(t: Tables) -> DataFrame:
    rows = trade(t).select("source", "type", "target", "confidence", "l_orderkey", "l_linenumber")
    return schema.last_relation(rows, F.struct("l_orderkey", "l_linenumber", "confidence")).select(
        "source", "type", "target", F.round("confidence", 4).alias("confidence"))


@query("relation_bidirectional", COUNTED.format(f"SELECT source, type, target FROM {TRADE} UNION ALL SELECT target, type, source FROM {TRADE} WHERE bidirectional"))
def relation_bidirectional(t: Tables) -> DataFrame:
    both = mapping.add_reverse(as_relations(trade(t)))
    return counted(both.selectExpr("source_entity AS source", "relationship_type AS type", "target_entity AS target"))


RELABELLED = f"""SELECT coalesce(a.merged, source) AS source, type, coalesce(b.merged, target) AS target FROM {TRADE} x
    LEFT JOIN {MERGES} a ON source = a.label LEFT JOIN {MERGES} b ON target = b.label"""


@query("relabel_relations", COUNTED.format(RELABELLED))
def relabel_relations(t: Tables) -> DataFrame:
    return counted(merge.relabel(trade(t).select("source", "type", "target"), merges(t), ["source", "target"]))


CANDIDATES = f"""(SELECT DISTINCT least(s, g) AS a, {SNAKE.format('type')} AS type, greatest(s, g) AS b FROM (
    SELECT coalesce(a.merged, source) AS s, type, coalesce(b.merged, target) AS g FROM {TRADE} x
    LEFT JOIN {MERGES} a ON source = a.label LEFT JOIN {MERGES} b ON target = b.label WHERE a.merged IS NOT NULL OR b.merged IS NOT NULL) WHERE lower(s) <> lower(g))"""


@query("relation_candidates", f"SELECT * FROM {CANDIDATES}")
def relation_candidates(t: Tables) -> DataFrame:
    return merge.relation_candidates(trade(t), merges(t))


@query("relation_type_sets", f"SELECT a, b, string_agg(type, ',' ORDER BY type) AS types FROM {CANDIDATES} GROUP BY a, b")
def relation_type_sets(t: Tables) -> DataFrame:
    return merge.type_sets(merge.relation_candidates(trade(t), merges(t))).select("a", "b", F.array_join("types", ",").alias("types"))


# types with variants: every second line says "has <priority>s"
VARIANT = "CASE WHEN l_linenumber % 2 = 0 THEN 'Has ' || substr(type, 3) || 's' ELSE substr(type, 3) END"


@query("relation_prop_counts", f"""SELECT {SNAKE.format('v')} AS type, count(DISTINCT pname) AS property_count FROM (SELECT {VARIANT} AS v, pname FROM {TRADE}) GROUP BY 1""")
def relation_prop_counts(t: Tables) -> DataFrame:
    rows = trade(t).select(F.expr(VARIANT).alias("type"), F.create_map("pname", "brand").alias("properties"))
    return merge.property_counts(rows)


STEM = "CASE WHEN regexp_matches({0}, '[^s]s$') AND length({0}) > 3 THEN left({0}, length({0}) - 1) ELSE {0} END"
PLAIN_STEM = STEM.format("translate(regexp_replace(type, '^(has|is|the)_', ''), '_-.', '')")


@query("relation_merges", f"""WITH raw AS (SELECT least(source, target) || '|' || greatest(source, target) AS pair, {SNAKE.format('v')} AS type, pname
      FROM (SELECT *, {VARIANT} AS v FROM {TRADE}) WHERE source <> target),
    rich AS (SELECT type, count(DISTINCT pname) AS richness FROM raw GROUP BY type),
    s AS (SELECT DISTINCT pair, type, richness, {PLAIN_STEM} AS stem FROM raw JOIN rich USING (type)),
    g AS (SELECT pair, stem, arg_max(type, (richness, type)) AS to_type FROM s GROUP BY pair, stem HAVING count(*) >= 2),
    f AS (SELECT stem, min(pair) AS pair FROM g GROUP BY stem) -- every stem has two types here, so all groups of a stem are equal
    SELECT type AS from_type, to_type, pair, richness FROM s JOIN g USING (pair, stem) JOIN f USING (pair, stem) WHERE type <> to_type""")
def relation_merges(t: Tables) -> DataFrame:
    rows = trade(t).withColumn("type", F.expr(VARIANT))
    rich = merge.property_counts(merge.drop_self(rows).select("type", F.create_map("pname", "brand").alias("properties")))
    pairs = merge.undirected(merge.drop_self(rows)).select(F.concat_ws("|", "a", "b").alias("pair"), "type")
    return merge.merge_relation_types(pairs.join(rich.withColumnRenamed("property_count", "richness"), "type"))


# ---- labels and properties --------------------------------------------------------------------------

WORDS = "(SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS label FROM documents)"


@query("label_merges", f"""WITH c AS (SELECT label, count(*) AS n FROM {WORDS} GROUP BY label),
    k AS (SELECT *, {STEM.format('lower(label)')} AS group_key FROM c),
    b AS (SELECT group_key, arg_max(label, (n, label)) AS dst, count(*) AS size FROM k GROUP BY group_key)
    SELECT label AS src, dst, group_key, CASE WHEN lower(label) = lower(dst) THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS confidence
    FROM k JOIN b USING (group_key) WHERE size >= 2 AND label <> dst""")
def label_merges(t: Tables) -> DataFrame:
    words = stats.spread(t.documents.select("text")).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))).alias("label"))
    return merge.propose_label_merges(words.groupBy("label").agg(F.count(F.lit(1)).alias("n")))


@query("property_union", """SELECT p_brand AS label, string_agg(p, ',' ORDER BY p) AS properties FROM (SELECT DISTINCT p_brand, p_type || ' ' || p_name AS p FROM part) GROUP BY p_brand""")
def property_union(t: Tables) -> DataFrame:
    props = t.part.selectExpr("p_brand AS label", "p_type || ' ' || p_name AS property")
    return merge.property_union(props).select("label", F.array_join("properties", ",").alias("properties"))


@query("entity_labels", """SELECT DISTINCT label FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS label FROM documents WHERE lang <> 'en')""")
def entity_labels(t: Tables) -> DataFrame:
    found = t.documents.select((F.col("lang") != "en").alias("has_entity_references"),
                               F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)")).alias("referenced_entities"))
    return merge.distinct_labels(found)


PART_PROPS = "(SELECT p_brand AS label, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS property FROM part)"
BRANDS = "(SELECT DISTINCT p_brand AS label, left(p_brand, 7) AS merged FROM part WHERE length(p_brand) = 8)"


@query("property_consolidate", f"""WITH m AS (SELECT coalesce(merged, p.label) AS target, merged IS NOT NULL AS moved, property FROM {PART_PROPS} p LEFT JOIN {BRANDS} b ON p.label = b.label),
    k AS (SELECT target, translate(lower(property), '_-.', '') AS plain, arg_min(property, (moved, property)) AS property FROM m
      WHERE target IN (SELECT merged FROM {BRANDS}) GROUP BY ALL)
    SELECT target AS label, string_agg(property, ',' ORDER BY property) AS properties FROM k GROUP BY target""")
def property_consolidate(t: Tables) -> DataFrame:
    return merge.consolidate_properties(part_props(t), brand_merges(t)).select("label", F.array_join("properties", ",").alias("properties"))


def part_props(t: Tables) -> DataFrame:
    return t.part.selectExpr("p_brand AS label", "if(p_size % 2 = 0, upper(p_name), p_name) AS property")


def brand_merges(t: Tables) -> DataFrame:
    return t.part.filter("length(p_brand) = 8").selectExpr("p_brand AS label", "left(p_brand, 7) AS merged").distinct()


@query("merge_map", "SELECT source AS label, arg_min(lang, doc_id) AS merged FROM documents GROUP BY source")
def merge_map(t: Tables) -> DataFrame:
    """The first of a source's many targets, by document."""
    return merge.merge_map(t.documents.select(F.col("source").alias("src"), F.col("lang").alias("dst"), F.col("doc_id").alias("pos")))


DOC_MERGES = """(SELECT doc_id AS merge_id, CASE WHEN doc_id % 2 = 0 THEN source END AS source, CASE WHEN doc_id % 2 = 1 THEN regexp_extract_all(text, '[A-Za-z]+') END
    AS from_list, CASE WHEN doc_id % 3 = 0 THEN lang END AS to_label, upper(source) AS target FROM documents)"""
NORMALISED = f"(SELECT merge_id, coalesce(from_list, CASE WHEN source IS NOT NULL THEN [source] END) AS from_labels, coalesce(to_label, target) AS to_label FROM {DOC_MERGES})"


def doc_merges(t: Tables) -> DataFrame:
    return t.documents.selectExpr("doc_id AS merge_id", "CASE WHEN doc_id % 2 = 0 THEN source END AS source",
                                  "CASE WHEN doc_id % 2 = 1 THEN regexp_extract_all(text, '([A-Za-z]+)') END AS from_list",
                                  "CASE WHEN doc_id % 3 = 0 THEN lang END AS to_label", "upper(source) AS target")


@query("merge_normalise", f"SELECT merge_id, array_to_string(from_labels, ',') AS from_labels, to_label FROM {NORMALISED}")
def merge_normalise(t: Tables) -> DataFrame:
    return merge.normalise_merges(doc_merges(t)).select("merge_id", F.array_join("from_labels", ",").alias("from_labels"), "to_label")


@query("merge_explode", f"SELECT * FROM (SELECT merge_id, to_label, unnest(from_labels) AS from_label FROM {NORMALISED}) WHERE lower(from_label) <> lower(to_label)")
def merge_explode(t: Tables) -> DataFrame:
    return merge.explode_merges(merge.normalise_merges(doc_merges(t)))


EVIDENCE = """(SELECT p_brand AS label, 'integer' AS data_type, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part GROUP BY p_brand UNION ALL
    SELECT p_brand, 'integer', min(p_partkey)::DOUBLE, max(p_partkey)::DOUBLE FROM part GROUP BY p_brand UNION ALL
    SELECT p_brand, 'float', min(p_retailprice), max(p_retailprice) FROM part GROUP BY p_brand HAVING count(*) % 2 = 0)"""


@query("merge_validate", f"""SELECT * FROM (SELECT src, dst, round(avg((ta = tb)::INT), 6) AS type_share, round(avg(CASE WHEN ta = tb AND la <= hb AND lb <= ha THEN 1 ELSE 0 END), 6)
    AS overlap_share, round(avg((ta = tb)::INT) * 0.5 + avg(CASE WHEN ta = tb AND la <= hb AND lb <= ha THEN 1 ELSE 0 END) * 0.5, 6) AS confidence FROM (
      SELECT m.label AS src, m.merged AS dst, a.data_type AS ta, b.data_type AS tb, a.lo AS la, a.hi AS ha, b.lo AS lb, b.hi AS hb
      FROM {BRANDS} m JOIN {EVIDENCE} a ON a.label = m.label JOIN {EVIDENCE} b ON b.label = m.merged) GROUP BY src, dst) WHERE confidence >= 0.6""")
def merge_validate(t: Tables) -> DataFrame:
    ranges = t.part.groupBy("p_brand").agg(F.min("p_size").alias("a"),
                                          F.max("p_size").alias("b"), F.min("p_partkey").alias("c"), F.max("p_partkey").alias("d"),
                                          F.min("p_retailprice").alias("e"), F.max("p_retailprice").alias("f"), (F.count(F.lit(1)) % 2 == 0).alias("even"))
    evidence = ranges.selectExpr("p_brand AS label", "even", "stack(3, 'integer', cast(a AS double), cast(b AS double), 'integer', cast(c AS double), cast(d AS double), "
                                 "'float', e, f) AS (data_type, min_value, max_value)").filter("even OR data_type = 'integer'").drop("even")
    out = merge.validate_merges(brand_merges(t).selectExpr("label AS src", "merged AS dst"), evidence)
    return out.select("src", "dst", *[F.round(c, 6).alias(c) for c in ("type_share", "overlap_share", "confidence")])


# ---- schema -----------------------------------------------------------------------------------------

ATTRIBUTES = f"""(WITH m AS (SELECT DISTINCT coalesce(merged, p.label) AS label, property FROM {PART_PROPS} p LEFT JOIN {BRANDS} b ON p.label = b.label),
    u AS (SELECT label, list(property ORDER BY property) AS up FROM m GROUP BY label),
    x AS (SELECT coalesce(merged, p.label) AS target, merged IS NOT NULL AS moved, property FROM {PART_PROPS} p LEFT JOIN {BRANDS} b ON p.label = b.label),
    k AS (SELECT target, translate(lower(property), '_-.', '') AS plain, arg_min(property, (moved, property)) AS property FROM x
      WHERE target IN (SELECT merged FROM {BRANDS}) GROUP BY ALL),
    c AS (SELECT target AS label, list(property ORDER BY property) AS cp FROM k GROUP BY target)
    SELECT label, coalesce(cp, up) AS props FROM u FULL JOIN c USING (label))"""


def attributes(t: Tables) -> DataFrame:
    consolidated = merge.consolidate_properties(part_props(t), brand_merges(t))
    return schema.schema_attributes(part_props(t), brand_merges(t), consolidated)


@query("schema_attributes", f"SELECT label, array_to_string(props, ',') AS properties FROM {ATTRIBUTES}")
def schema_attributes(t: Tables) -> DataFrame:
    return attributes(t).select("label", F.array_join("properties", ",").alias("properties"))


@query("graph_schema_nodes", f"""SELECT CASE WHEN label = upper(label) AND label <> lower(label) THEN lower(label) ELSE label END AS type, array_to_string(props, ',') AS attributes FROM (
    SELECT upper(label) AS label, props FROM {ATTRIBUTES})""")
def graph_schema_nodes(t: Tables) -> DataFrame:
    return schema.schema_nodes(attributes(t).withColumn("label", F.upper("label"))).select("type", F.array_join("attributes", ",").alias("attributes"))


@query("schema_edges", f"SELECT DISTINCT source, type, target FROM ({RELABELLED}) WHERE source <> target")
def schema_edges(t: Tables) -> DataFrame:
    return schema.schema_edges(trade(t), merges(t))


@query("graph_schema_edges", f"""SELECT DISTINCT type, lower(source) AS source, lower(target) AS target FROM ({RELABELLED}) WHERE source <> target""")
def graph_schema_edges(t: Tables) -> DataFrame:
    edges = schema.document_edges(schema.schema_edges(trade(t), merges(t)))
    nodes = schema.schema_nodes(attributes(t))
    path = new_path(t.spark, "schema")
    store.write_graph_schema(nodes, edges, path)
    return t.spark.read.json(f"{path}/edges").select("type", "source", "target")


GEN_EDGES = f"(SELECT DISTINCT type, source, target, run_id FROM {TRADE} WHERE flag = 'R')"
GOLD_EDGES = f"(SELECT DISTINCT type, source, target FROM {TRADE} WHERE flag = 'A' AND confidence > 0.95)"


@query("edge_flip", f"""SELECT type, run_id, CASE WHEN flip THEN target ELSE source END AS source, CASE WHEN flip THEN source ELSE target END AS target, flip AS flipped FROM (
    SELECT g.*, NOT EXISTS (SELECT 1 FROM {GOLD_EDGES} x WHERE x.type = g.type AND x.source = g.source AND x.target = g.target)
      AND EXISTS (SELECT 1 FROM {GOLD_EDGES} x WHERE x.type = g.type AND x.source = g.target AND x.target = g.source) AS flip FROM {GEN_EDGES} g)""")
def edge_flip(t: Tables) -> DataFrame:
    rows = trade(t)
    gen = rows.filter("flag = 'R'").select("type", "source", "target", "run_id").distinct()
    return schema.align_edges(gen, rows.filter("flag = 'A' AND confidence > 0.95").select("type", "source", "target"))


# ---- graph tables -----------------------------------------------------------------------------------

def node_sql(label: str, table: str, key: str, props: dict[str, str]) -> str:
    cols = ", ".join(f"{c} AS {n}" for c, n in props.items())
    return f"SELECT sha256('{label}|' || {key}) AS id, '{label}' AS label, CAST({key} AS VARCHAR) AS key, {cols} FROM {table}"


@query("graph_nodes", node_sql("Customer", "customer", "c_custkey", {"c_name": "name", "c_mktsegment": "mktsegment", "c_acctbal": "acctbal"}))
def graph_nodes(t: Tables) -> DataFrame:
    return schema.materialize_nodes(t.customer, "Customer", "c_custkey", ["c_name", "c_mktsegment", "c_acctbal"])


def all_edges(t: Tables) -> DataFrame:
    placed = schema.materialize_edges(t.orders, "PLACED", "Customer", "o_custkey", "Order", "o_orderkey", together="o_custkey")
    contains = schema.materialize_edges(t.lineitem, "CONTAINS", "Order", "l_orderkey", "Part", "l_partkey", t.part, "p_partkey", together="l_partkey")
    supplied = schema.materialize_edges(t.lineitem, "SUPPLIED_BY", "Part", "l_partkey", "Supplier", "l_suppkey", t.supplier, "s_suppkey", together="l_partkey")
    nation = schema.materialize_edges(t.customer, "IN_NATION", "Customer", "c_custkey", "Nation", "c_nationkey", t.nation, "n_nationkey")
    return placed.unionByName(contains).unionByName(supplied).unionByName(nation)


@query("graph_edges", """SELECT sha256('Customer|' || o_custkey) AS source_id, 'PLACED' AS type, sha256('Order|' || o_orderkey) AS target_id FROM orders
    UNION ALL SELECT sha256('Order|' || l_orderkey), 'CONTAINS', sha256('Part|' || l_partkey) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)
    UNION ALL SELECT sha256('Part|' || l_partkey), 'SUPPLIED_BY', sha256('Supplier|' || l_suppkey) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT sha256('Customer|' || c_custkey), 'IN_NATION', sha256('Nation|' || c_nationkey) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)""")
def graph_edges(t: Tables) -> DataFrame:
    return all_edges(t)


def all_nodes(t: Tables) -> DataFrame:
    parts = [("Customer", t.customer, "c_custkey"), ("Order", t.orders, "o_orderkey"), ("Part", t.part, "p_partkey"),
             ("Supplier", t.supplier, "s_suppkey"), ("Nation", t.nation, "n_nationkey"), ("Region", t.region, "r_regionkey")]
    out = None
    for label, df, key in parts:
        part = schema.materialize_nodes(df, label, key, [])
        out = part if out is None else out.unionByName(part)
    return out


NODE_COUNTS = " UNION ALL ".join(f"SELECT '{label}' AS label, count(DISTINCT {key}) AS n FROM {table}" for label, table, key in (
    ("Customer", "customer", "c_custkey"), ("Order", "orders", "o_orderkey"), ("Part", "part", "p_partkey"), ("Supplier", "supplier", "s_suppkey"),
    ("Nation", "nation", "n_nationkey"), ("Region", "region", "r_regionkey")))


@query("graph_id_unique", f"SELECT CAST(sum(n) AS BIGINT) AS nodes, 0::BIGINT AS repeated_ids FROM ({NODE_COUNTS})")
def graph_id_unique(t: Tables) -> DataFrame:
    nodes = all_nodes(t)
    bad = schema.repeated_ids(nodes).agg(F.count(F.lit(1)).alias("repeated_ids"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(bad))  # one row each


@query("graph_node_peek", "SELECT * FROM (SELECT sha256('Order|' || o_orderkey) AS id, CAST(o_orderkey AS VARCHAR) AS key FROM orders) ORDER BY id LIMIT 5")
def graph_node_peek(t: Tables) -> DataFrame:
    return schema.materialize_nodes(t.orders, "Order", "o_orderkey", []).select("id", "key").orderBy("id").limit(5)


@query("graph_export_counts", f"""SELECT 'nodes' AS kind, label AS name, n FROM ({NODE_COUNTS}) UNION ALL SELECT 'edges', 'PLACED', count(*) FROM orders
    UNION ALL SELECT 'edges', 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'edges', 'SUPPLIED_BY', count(*) FROM lineitem
    UNION ALL SELECT 'edges', 'IN_NATION', count(*) FROM customer""")
def graph_export_counts(t: Tables) -> DataFrame:
    path = new_path(t.spark, "graph")
    store.write_graph_table(all_nodes(t), "nodes", "label", path)
    store.write_graph_table(all_edges(t), "edges", "type", path)
    nodes = t.spark.read.parquet(f"{path}/nodes").groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    edges = t.spark.read.parquet(f"{path}/edges").groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select(F.lit("nodes").alias("kind"), "name", "n").unionByName(edges.select(F.lit("edges").alias("kind"), "name", "n"))


# ---- evaluation: golden rows are the accepted lines, each year of returned lines is one run -----------

GOLD_NODES = f"(SELECT DISTINCT source AS node, brand || ' ' || pname AS attr FROM {TRADE} WHERE flag = 'A' AND source <> 'NATION_7')"
GEN_NODES = f"(SELECT DISTINCT run_id, source AS node, brand || ' ' || pname AS attr FROM {TRADE} WHERE flag = 'R' AND NOT (source = 'NATION_3' AND run_id < '1999'))"


def gold_nodes(rows: DataFrame) -> DataFrame:
    return rows.filter("flag = 'A' AND source <> 'NATION_7'").selectExpr("source AS node", "brand || ' ' || pname AS attr").distinct()


def gen_nodes(rows: DataFrame) -> DataFrame:
    return rows.filter("flag = 'R' AND NOT (source = 'NATION_3' AND run_id < '1999')").selectExpr("run_id", "source AS node", "brand || ' ' || pname AS attr").distinct()


RUNS = f"(SELECT DISTINCT run_id FROM {GEN_NODES})"
NODE_STATUS = f"""(SELECT run_id, node, CASE WHEN g AND o THEN 'found' WHEN o THEN 'missing' ELSE 'extra' END AS status FROM (
    SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.node, b.node) AS node, a.node IS NOT NULL AS g, b.node IS NOT NULL AS o
    FROM (SELECT DISTINCT run_id, node FROM {GEN_NODES}) a FULL JOIN (SELECT run_id, node FROM {RUNS}, (SELECT DISTINCT node FROM {GOLD_NODES})) b
    ON a.run_id = b.run_id AND a.node = b.node))"""


@query("schema_node_diff", f"SELECT * FROM {NODE_STATUS}")
def schema_node_diff(t: Tables) -> DataFrame:
    rows = trade(t)
    return ev.node_diff(gen_nodes(rows), gold_nodes(rows))


@query("schema_set_ops", f"""SELECT 'both' AS part, count(*) AS n FROM (SELECT node, attr FROM {GEN_NODES} INTERSECT SELECT node, attr FROM {GOLD_NODES})
    UNION ALL SELECT 'golden only', count(*) FROM (SELECT node, attr FROM {GOLD_NODES} EXCEPT SELECT node, attr FROM {GEN_NODES})
    UNION ALL SELECT 'generated only', count(*) FROM (SELECT node, attr FROM {GEN_NODES} EXCEPT SELECT node, attr FROM {GOLD_NODES})""")
def schema_set_ops(t: Tables) -> DataFrame:
    rows = trade(t)
    gen, gold = gen_nodes(rows).select("node", "attr"), gold_nodes(rows)
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return size(gen.intersect(gold), "both").unionByName(size(gold.subtract(gen), "golden only")).unionByName(size(gen.subtract(gold), "generated only"))


NODE_SCORE = f"""(SELECT run_id, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra,
    count(*) FILTER (status = 'found') / count(*) FILTER (status <> 'extra') AS node_score FROM {NODE_STATUS} GROUP BY run_id)"""
PROPERTY_SCORE = f"""(SELECT run_id, avg(share) AS property_score FROM (SELECT r.run_id, o.node, count(g.attr) / count(o.attr) AS share
    FROM {RUNS} r CROSS JOIN {GOLD_NODES} o LEFT JOIN {GEN_NODES} g ON g.run_id = r.run_id AND g.node = o.node AND g.attr = o.attr GROUP BY ALL) GROUP BY run_id)"""


@query("eval_node_score", f"SELECT run_id, found, missing, extra, round(node_score, 6) AS node_score FROM {NODE_SCORE}")
def eval_node_score(t: Tables) -> DataFrame:
    rows = trade(t)
    return ev.node_score(gen_nodes(rows), gold_nodes(rows)).withColumn("node_score", F.round("node_score", 6))


@query("eval_property_score", f"SELECT run_id, round(property_score, 6) AS property_score FROM {PROPERTY_SCORE}")
def eval_property_score(t: Tables) -> DataFrame:
    rows = trade(t)
    return ev.property_score(gen_nodes(rows), gold_nodes(rows)).withColumn("property_score", F.round("property_score", 6))


def edge_rows_sql(flag: str, extra: str) -> str:
    return f"""(SELECT run_id, type, source, target, list(brand ORDER BY brand) AS attrs FROM (SELECT DISTINCT run_id, type, source, target, brand FROM {TRADE}
      WHERE flag = '{flag}' {extra}) GROUP BY run_id, type, source, target)"""


GEN_SETS = edge_rows_sql("R", "")
GOLD_SETS = f"(SELECT DISTINCT type, source, target, attrs FROM {edge_rows_sql('A', 'AND confidence > 0.95')})"


def edge_rows(rows: DataFrame, condition: str) -> DataFrame:
    """Edge sets with brands as attributes; each edge of a year is one edge."""
    return ev.edge_sets(rows.filter(condition).select("run_id", F.concat_ws("|", "type", "source", "target").alias("edge_id"), "type", "source", "target", F.col("brand").alias("attr")))


MET = f"""(SELECT DISTINCT g.run_id, o.type, o.source, o.target, o.attrs FROM {GOLD_SETS} o JOIN {GEN_SETS} g ON least(o.source, o.target) = least(g.source, g.target)
    AND greatest(o.source, o.target) = greatest(g.source, g.target) AND len(list_filter(o.attrs, lambda x: NOT list_contains(g.attrs, x))) = 0)"""
RELATION_SCORE = f"""(SELECT run_id, coalesce(f, 0) AS found, total - coalesce(f, 0) AS missing, coalesce(e, 0) AS extra, coalesce(f, 0) / total AS relation_score
    FROM (SELECT DISTINCT run_id FROM {GEN_SETS}) LEFT JOIN (SELECT run_id, count(*) AS f FROM {MET} GROUP BY run_id) USING (run_id)
    LEFT JOIN (SELECT run_id, count(*) AS e FROM {GEN_SETS} g WHERE NOT EXISTS (SELECT 1 FROM {MET} m WHERE m.run_id = g.run_id
      AND least(m.source, m.target) = least(g.source, g.target) AND greatest(m.source, m.target) = greatest(g.source, g.target)) GROUP BY run_id) USING (run_id),
    (SELECT count(*) AS total FROM {GOLD_SETS}))"""


def edge_inputs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return edge_rows(rows, "flag = 'R'"), edge_rows(rows, "flag = 'A' AND confidence > 0.95").select("type", "source", "target", "attrs").distinct()


@query("schema_edge_match", f"SELECT run_id, type, source, target, array_to_string(attrs, ',') AS attrs FROM {MET}")
def schema_edge_match(t: Tables) -> DataFrame:
    return ev.match_edges(*edge_inputs(trade(t))).withColumn("attrs", F.array_join("attrs", ","))


@query("eval_relation_score", f"SELECT run_id, found, missing, extra, round(relation_score, 6) AS relation_score FROM {RELATION_SCORE}")
def eval_relation_score(t: Tables) -> DataFrame:
    return ev.relation_score(*edge_inputs(trade(t))).withColumn("relation_score", F.round("relation_score", 6))


OVERALL = f"""(SELECT run_id, node_score, property_score, relation_score, (node_score + property_score + relation_score) / 3 AS overall_score
    FROM {NODE_SCORE} JOIN {PROPERTY_SCORE} USING (run_id) JOIN {RELATION_SCORE} USING (run_id))"""
SCORES = ["node_score", "property_score", "relation_score", "overall_score"]


def overall(t: Tables) -> DataFrame:
    rows = stage(trade(t).filter("flag <> 'N'").drop("l_orderkey", "l_linenumber", "bidirectional"), "trade")  # read by three scores
    gen, gold = gen_nodes(rows), gold_nodes(rows)
    return ev.score_runs(gen, gold, *edge_inputs(rows))


@query("eval_overall", f"SELECT run_id, {', '.join(f'round({c}, 6) AS {c}' for c in SCORES)} FROM {OVERALL}")
def eval_overall(t: Tables) -> DataFrame:
    return overall(t).select("run_id", *[F.round(c, 6).alias(c) for c in SCORES])


@query("eval_runs", f"SELECT count(*) AS runs, {', '.join(f'round({f}({c}), 6) AS {n}_{c}' for c in SCORES for n, f in (('mean', 'avg'), ('std', 'stddev_samp')))} FROM {OVERALL}")
def eval_runs(t: Tables) -> DataFrame:
    out = ev.over_runs(overall(t), SCORES)
    return out.select("runs", *[F.round(c, 6).alias(c) for c in out.columns if c != "runs"])


SYNONYMS = "(SELECT n_regionkey AS pos, r_name AS canonical, n_name AS synonym FROM nation JOIN region ON n_regionkey = r_regionkey)"
NAMES = "(SELECT DISTINCT n_name || '-' || c_mktsegment AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def plain(x: str) -> str:
    return f"translate(lower({x}), '_-.', '')"


def canonical_sql(names: str, column: str, synonyms: str) -> str:
    return f"""(SELECT {column}, coalesce((SELECT arg_min({plain('canonical')}, pos) FROM {synonyms} s WHERE contains({plain(column)}, {plain('canonical')})
      OR contains({plain(column)}, {plain('synonym')})), {plain(column)}) AS canonical FROM {names})"""


def nation_synonyms(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("n_regionkey AS pos", "r_name AS canonical", "n_name AS synonym")


@query("synonym_canonical", f"SELECT * FROM {canonical_sql(NAMES, 'name', SYNONYMS)}")
def synonym_canonical(t: Tables) -> DataFrame:
    names = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("n_name || '-' || c_mktsegment AS name").distinct()
    return ev.canonical_names(names, "name", nation_synonyms(t))


BRAND_SYNONYMS = "(SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS pos, p_brand AS canonical, 'x' || p_type || right(p_brand, 1) AS synonym FROM part WHERE length(p_brand) = 7)"


def brand_synonyms(t: Tables) -> DataFrame:
    return t.part.filter("length(p_brand) = 7").selectExpr("cast(substr(p_brand, 7) AS int) AS pos", "p_brand AS canonical", "'x' || p_type || right(p_brand, 1) AS synonym").distinct()


@query("eval_nodes", f"""SELECT DISTINCT run_id, n.canonical AS node, b.canonical AS attr FROM (SELECT DISTINCT run_id, source, brand FROM {TRADE} WHERE flag = 'R') r
    JOIN {canonical_sql('(SELECT DISTINCT n_name AS name FROM nation)', 'name', SYNONYMS)} n ON n.name = source
    JOIN {canonical_sql('(SELECT DISTINCT p_brand AS name FROM part)', 'name', BRAND_SYNONYMS)} b ON b.name = brand""")
def eval_nodes(t: Tables) -> DataFrame:
    rows = trade(t).filter("flag = 'R'").selectExpr("run_id", "source AS node", "brand AS attr").distinct()
    return ev.canonical_nodes(rows, nation_synonyms(t), brand_synonyms(t))


@query("eval_edges", f"""SELECT DISTINCT run_id, type, source, target, attrs FROM (SELECT run_id, e, {plain('type')} AS type, n.canonical AS source, m.canonical AS target,
      string_agg(DISTINCT b.canonical, ',' ORDER BY b.canonical) AS attrs FROM (SELECT DISTINCT run_id, type || source || target AS e, type, source, target, brand FROM {TRADE} WHERE flag = 'R') r
    JOIN {canonical_sql('(SELECT DISTINCT n_name AS name FROM nation)', 'name', SYNONYMS)} n ON n.name = r.source
    JOIN {canonical_sql('(SELECT DISTINCT n_name AS name FROM nation)', 'name', SYNONYMS)} m ON m.name = r.target
    JOIN {canonical_sql('(SELECT DISTINCT p_brand AS name FROM part)', 'name', BRAND_SYNONYMS)} b ON b.name = brand GROUP BY ALL)""")
def eval_edges(t: Tables) -> DataFrame:
    rows = trade(t).filter("flag = 'R'").select("run_id", F.concat("type", "source", "target").alias("edge_id"), "type", "source", "target", F.col("brand").alias("attr")).distinct()
    empty = t.spark.createDataFrame([], "pos int, canonical string, synonym string")
    for column, synonyms in (("type", empty), ("source", nation_synonyms(t)), ("target", nation_synonyms(t)), ("attr", brand_synonyms(t))):
        rows = ev.canonical_names(rows, column, synonyms).withColumn(column, F.col("canonical")).drop("canonical")
    return ev.edge_sets(rows).withColumn("attrs", F.array_join("attrs", ","))


STATE = "SELECT p_name AS name, count(*) AS n, max(l_quantity) AS top FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = '{}' GROUP BY p_name"


@query("profile_drift", f"""SELECT name, status, CASE WHEN status = 'changed' THEN concat_ws(',', CASE WHEN n IS DISTINCT FROM n2 THEN 'n' END, CASE WHEN top IS DISTINCT FROM top2 THEN 'top' END) END AS changed_fields
    FROM (SELECT coalesce(a.name, b.name) AS name, b.n, b.top, a.n AS n2, a.top AS top2, CASE WHEN a.name IS NULL THEN 'new' WHEN b.name IS NULL THEN 'gone'
      WHEN a.n IS DISTINCT FROM b.n OR a.top IS DISTINCT FROM b.top THEN 'changed' END AS status
      FROM ({STATE.format('A')}) a FULL JOIN ({STATE.format('R')}) b ON a.name = b.name) WHERE status IS NOT NULL""")
def profile_drift(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    def state(flag: str) -> DataFrame:
        return rows.filter(F.col("l_returnflag") == flag).groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("top"))
    path = new_path(t.spark, "runs")
    for run, flag in (("first", "A"), ("second", "R")):
        store.write_snapshot(state(flag), path, run, "parts")
    return ev.snapshot_diff(store.read_snapshot(t.spark, path, "first", "parts"), store.read_snapshot(t.spark, path, "second", "parts"), ["name"])


# exported graph: label or type -> table, its key columns and properties
EXPORT = {"nodes": {"Customer": ("customer", ["c_custkey", "c_name", "c_acctbal"]), "Order": ("orders", ["o_orderkey", "o_totalprice", "o_orderdate"])},
          "edges": {"PLACED": ("orders", ["o_custkey", "o_orderkey", "o_orderpriority"])}}


@query("graph_export_properties", " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{name}' AS name, '{c}' AS property, count(*) AS in_manifest, count({c}) AS filled, CAST(min({c}) AS VARCHAR) AS least FROM {table}"
    for kind, parts in EXPORT.items() for name, (table, columns) in parts.items() for c in columns if not c.endswith(("price", "acctbal", "date"))))
def graph_export_properties(t: Tables) -> DataFrame:
    """Nodes and edges with their typed properties, written one folder a label or type and read back."""
    path = new_path(t.spark, "graph")
    made = [{name: getattr(t, table).select(*columns) for name, (table, columns) in EXPORT[kind].items()} for kind in ("nodes", "edges")]
    manifest, out = store.write_graph(*made, path), None
    for kind, parts in zip(("nodes", "edges"), store.read_graph(t.spark, path)):
        for name, df in parts.items():
            wanted = [c for c in df.columns if not c.endswith(("price", "acctbal", "date"))]
            facts = df.agg(*[x for c in wanted for x in (F.count(c).alias(f"n_{c}"), F.min(c).cast("string").alias(f"m_{c}"))])
            rows = facts.select(F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(c).alias("property"), F.col(f"n_{c}").alias("filled"), F.col(f"m_{c}").alias("least")) for c in wanted])))
            out = rows if out is None else out.unionByName(rows)
    return out.join(manifest.select("kind", "name", F.col("rows").alias("in_manifest")), ["kind", "name"]).select("kind", "name", "property", "in_manifest", "filled", "least")
