"""Similarity, containment, classification and mapping over a catalog of profiled columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions import text
from colonnade.operators import classify, containment, discover, mapping, merge, similar
from colonnade.operators import evaluate as ev
from colonnade.operators import profile as pf
from colonnade.plans import oracle
from colonnade.plans.registry import Tables, query
from colonnade.session import new_path, stage, stage_counts
from colonnade.sources import store

CATALOG = list(oracle.COLUMNS)
_STORED: dict[tuple, DataFrame] = {}


def _state(t: Tables) -> tuple:
    """Name, size and time of every file of the catalog's tables."""
    conf, out = t.spark._jsc.hadoopConfiguration(), []
    for name in CATALOG:
        for file in sorted(getattr(t, name).inputFiles()):
            path = t.spark._jvm.org.apache.hadoop.fs.Path(file)
            status = path.getFileSystem(conf).getFileStatus(path)
            out.append((file, status.getLen(), status.getModificationTime()))
    return tuple(out)


def catalog(t: Tables, counted_only: bool = False) -> DataFrame:
    """Stored profile of all tables: computed once for the state that their files are in, then read back."""
    key = (t.spark.sparkContext.applicationId, counted_only, _state(t))
    if key not in _STORED:
        _STORED[key] = stage(pf.profile_catalog({n: getattr(t, n) for n in CATALOG}, "demo", counted_only=counted_only), "catalog")
    return _STORED[key]


def facts(t: Tables) -> DataFrame:
    """The catalog for queries that read types, counts and ranges only."""
    return catalog(t, counted_only=True)


CAT = "(" + " UNION ALL ".join(f"SELECT '{t}' AS tbl, column_name, data_type, total_rows, cardinality, uniqueness_ratio, missing_percentage, min_value, max_value FROM ({oracle.facts_sql(t)})" for t in CATALOG) + ")"

# ---- similar columns --------------------------------------------------------------------------------

PAIRS = """(SELECT a.label::VARCHAR AS table_a, a.vec_id::VARCHAR AS column_a, b.label::VARCHAR AS table_b, b.vec_id::VARCHAR AS column_b,
    list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.label::VARCHAR < b.label::VARCHAR
    WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4)"""


def vector_pairs(t: Tables) -> DataFrame:
    vecs = t.embeddings.select(F.col("label").alias("table"), F.col("vec_id").alias("column"), F.col("embedding").alias("vec"))
    return similar.similar_columns(vecs, 0.4)


@query("similar_columns", f"SELECT table_a, column_a, table_b, column_b, round(similarity, 4) AS similarity FROM {PAIRS}")
def similar_columns(t: Tables) -> DataFrame:
    return vector_pairs(t).withColumn("similarity", F.round("similarity", 4))


@query("similar_with_context", f"""SELECT table_a, column_a, table_b, column_b, round(similarity, 4) AS similarity, 'vector ' || column_a || ' of ' || table_a AS text_a,
    'vector ' || column_b || ' of ' || table_b AS text_b FROM {PAIRS}""")
def similar_with_context(t: Tables) -> DataFrame:
    texts = t.embeddings.selectExpr("cast(label AS string) AS table", "cast(vec_id AS string) AS column", "concat('vector ', vec_id, ' of ', label) AS text")
    return similar.with_context(vector_pairs(t), texts).withColumn("similarity", F.round("similarity", 4))


@query("pairs_per_table", f"SELECT x AS table_name, count(*) AS pairs FROM (SELECT unnest([table_a, table_b]) AS x FROM {PAIRS}) GROUP BY x")
def pairs_per_table(t: Tables) -> DataFrame:
    return similar.pairs_per_table(vector_pairs(t)).groupBy(F.col("table").alias("table_name")).agg(F.count(F.lit(1)).alias("pairs"))


@query("similar_catalog_columns")
def similar_catalog_columns(t: Tables) -> DataFrame:
    texts = text.column_text(catalog(t)).select("table", "column_name", "text")
    vecs = similar.hashed_vectors(texts, ["table", "column_name"], "text").select("table", F.col("column_name").alias("column"), "vec")
    return similar.similar_columns(vecs, 0.5)


# ---- containment ------------------------------------------------------------------------------------

SLOTS = {"integral": "{c}::BIGINT AS i, NULL::DOUBLE AS d, NULL::VARCHAR AS s", "fractional": "NULL::BIGINT AS i, {c}::DOUBLE AS d, NULL::VARCHAR AS s",
         "temporal": "epoch_us({c}::TIMESTAMP) AS i, NULL::DOUBLE AS d, NULL::VARCHAR AS s", "array": "NULL::BIGINT AS i, NULL::DOUBLE AS d, {c}::VARCHAR AS s"}


def values_sql(t: str, c: str) -> str:
    kind = oracle.COLUMNS[t][c]
    kind, slots = ("string" if kind == "list" else kind), SLOTS.get(kind, "NULL::BIGINT AS i, NULL::DOUBLE AS d, {c} AS s").replace("{c}", c)
    return f"SELECT '{t}' AS tbl, '{c}' AS col, '{kind}' AS kind, {slots}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"


# every column of all tables; a pair without a shared value is no row
VALUES = "(" + " UNION ALL ".join(values_sql(t, c) for t, cs in oracle.COLUMNS.items() for c in cs) + ")"
CONTAINED = f"""(WITH f AS MATERIALIZED (SELECT tbl, col, kind, n, coalesce(i::VARCHAR, d::VARCHAR, s) AS v FROM {VALUES}),
    k AS (SELECT tbl, col, kind, count(*) AS d, count(*) / sum(n) AS u FROM f GROUP BY ALL),
    m AS (SELECT a.tbl AS ct, a.col AS cc, b.tbl AS pt, b.col AS pc, count(*) AS matched FROM f a JOIN f b ON a.v = b.v AND a.kind = b.kind WHERE a.tbl <> b.tbl GROUP BY ALL)
    SELECT c.tbl AS child_table, c.col AS child_column, p.tbl AS parent_table, p.col AS parent_column, c.d AS child_distinct, p.d AS parent_distinct, c.u AS child_uniqueness, p.u AS parent_uniqueness,
      matched, matched / c.d AS containment FROM m JOIN k c ON ct = c.tbl AND cc = c.col JOIN k p ON pt = p.tbl AND pc = p.col WHERE c.d <= p.d)"""
PAIR_COLUMNS = containment.SIDES


def catalog_values(t: Tables) -> DataFrame:
    tables = {n: getattr(t, n) for n in oracle.COLUMNS}
    return stage_counts(containment.catalog_values(tables), "key_values", list(tables.values()))


def overlapping(t: Tables) -> DataFrame:
    values = catalog_values(t)
    return containment.containment(values, stage(containment.column_keys(values), "keys"))


def contained(t: Tables, parent_uniqueness: float = 0.0) -> DataFrame:
    values = catalog_values(t)
    return containment.contained(values, stage(containment.column_keys(values), "keys"), parent_uniqueness)  # one row per column, read five times


@query("inclusion_dependency", f"SELECT {', '.join(PAIR_COLUMNS)}, child_distinct, matched, round(containment, 6) AS containment FROM {CONTAINED}")
def inclusion_dependency(t: Tables) -> DataFrame:
    return overlapping(t).select(*PAIR_COLUMNS, "child_distinct", "matched", F.round("containment", 6).alias("containment"))


@query("fk_discovery", f"SELECT {', '.join(PAIR_COLUMNS)} FROM {CONTAINED} WHERE containment = 1 AND parent_uniqueness >= 0.9")
def fk_discovery(t: Tables) -> DataFrame:
    return containment.foreign_keys(contained(t, containment.UNIQUE_FROM)).select(*PAIR_COLUMNS)


@query("inverted_column_sets", f"""SELECT kind, array_to_string(columns, ',') AS columns, count(*) AS n FROM (
    SELECT kind, v, list_sort(list(tbl || '.' || col)) AS columns FROM (SELECT tbl, col, kind, coalesce(i::VARCHAR, d::VARCHAR, s) AS v FROM {VALUES}) GROUP BY kind, v HAVING count(*) > 1) GROUP BY ALL""")
def inverted_column_sets(t: Tables) -> DataFrame:
    names = F.array_sort(F.transform("columns", lambda c: F.concat_ws(".", c["table"], c["column_name"])))
    return containment.inverted_sets(catalog_values(t)).select("kind", F.array_join(names, ",").alias("columns"), "n")


@query("sketch_pruning")
def sketch_pruning(t: Tables) -> DataFrame:
    """Column pairs left to verify by size of the sketches, and the pairs that are contained. Hashes have no SQL; tested against plain sets."""
    values = catalog_values(t)
    keys = stage(containment.column_keys(values), "keys")
    sizes = [1, 4, 16, containment.SKETCH]
    found = stage(containment.candidates_by_size(values, keys, sizes), "candidates")
    sure = containment.contained(values, keys, pairs=found.filter(F.col("size") == containment.SKETCH).drop("size"))
    out = sure.agg(F.count(F.lit(1)).alias("pairs")).withColumn("step", F.lit("contained"))
    for size in sizes:
        pairs = found.filter(F.col("size") == size).agg(F.count(F.lit(1)).alias("pairs"))
        out = out.unionByName(pairs.withColumn("step", F.lit(f"sketch of {size}")))
    return out.select("step", "pairs")


CARD = "CASE WHEN parent_uniqueness >= 0.9 AND child_uniqueness >= 0.9 THEN '1:1' WHEN parent_uniqueness >= 0.9 THEN '1:N' ELSE 'M:N' END"


@query("relation_cardinality", f"SELECT {', '.join(PAIR_COLUMNS)}, {CARD} AS cardinality FROM {CONTAINED} WHERE containment = 1")
def relation_cardinality(t: Tables) -> DataFrame:
    return containment.relation_cardinality(contained(t)).select(*PAIR_COLUMNS, "cardinality")


@query("column_relation", f"""SELECT {', '.join(PAIR_COLUMNS)}, {CARD} AS cardinality, kind AS relation_type, kind IS NOT NULL AS has_relationship,
    CASE kind WHEN 'foreign_key' THEN 'parent_to_child' WHEN 'attribute_synonym' THEN 'bidirectional' WHEN 'shared_attribute' THEN 'undirected' END AS direction FROM (
      SELECT *, CASE WHEN containment = 1 AND parent_uniqueness >= 0.9 THEN 'foreign_key' WHEN containment = 1 AND child_distinct = parent_distinct THEN 'attribute_synonym'
        WHEN matched > 0 THEN 'shared_attribute' END AS kind FROM {CONTAINED})""")
def column_relation(t: Tables) -> DataFrame:
    return containment.column_relation(overlapping(t)).select(*PAIR_COLUMNS, "cardinality", "relation_type", "has_relationship", "direction")


@query("derived_value", """SELECT count(*) AS compared, count(*) FILTER (abs(n_chars - s) <= 0.01) AS equal_rows, count(*) FILTER (abs(n_chars - s) <= 0.01) / count(*) AS share FROM (
    SELECT d.doc_id, any_value(n_chars) AS n_chars, sum(length(w)) AS s FROM documents d, LATERAL (SELECT unnest(string_split(text, ' ')) AS w) GROUP BY d.doc_id)""")
def derived_value(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("w")).select("doc_id", F.length("w").alias("len"))
    return containment.derived_value(words, "doc_id", "len", t.documents, "doc_id", "n_chars")


DETAILS, TOTALS = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["lines", "quantity", "top_price"]
TOTAL = "(SELECT l_orderkey AS k, count(*) AS lines, sum(l_quantity) AS quantity, max(l_extendedprice) AS top_price FROM lineitem GROUP BY l_orderkey)"


@query("derived_columns", " UNION ALL ".join(f"""SELECT '{d}' AS detail_column, '{m}' AS master_column, count(*) AS compared, count(*) FILTER (abs({m} - s) <= 0.01) AS equal_rows,
    round(count(*) FILTER (abs({m} - s) <= 0.01) / count(*), 6) AS share FROM {TOTAL} JOIN (SELECT l_orderkey AS k, sum({d}::DOUBLE) AS s FROM lineitem GROUP BY l_orderkey) USING (k)"""
                                            for d in DETAILS for m in TOTALS))
def derived_columns(t: Tables) -> DataFrame:
    """All numeric columns of the lines against totals of the orders, one of which is the sum of a column."""
    totals = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("top_price"))
    return containment.derived_columns(t.lineitem, "l_orderkey", totals, "k").withColumn("share", F.round("share", 6))


@query("table_relations", """SELECT * FROM (VALUES ('staff', 'boss', 'staff', 'id', 'hierarchical_link', 'parent_to_child'), ('bonus', 'staff_id', 'staff', 'id', 'foreign_key', 'parent_to_child'),
    ('bonus', 'amount', 'staff', 'total', 'derived_value', 'child_to_parent'), ('staff', 'id', 'bonus', 'staff_id', 'attribute_synonym', 'bidirectional'),
    ('staff', 'boss', 'bonus', 'staff_id', 'shared_attribute', 'undirected'), ('staff', 'circle', 'bonus', 'staff_id', 'shared_attribute', 'undirected')) v(child_table, child_column, parent_table, parent_column, relation_type, direction) WHERE (SELECT count(*) FROM supplier) > 4""")
def table_relations(t: Tables) -> DataFrame:
    """Suppliers as staff with a boss each and bonuses whose sums they carry; a second pointer that runs in circles is no hierarchy."""
    staff = t.supplier.selectExpr("s_suppkey AS id", "IF(s_suppkey > 1, s_suppkey div 2, NULL) AS boss", "s_suppkey % 2 + 1 AS circle", "s_suppkey * 3 + 1000003 AS total")
    bonus = staff.selectExpr("id AS staff_id", "explode(array(id * 2 + 1000000, id + 3)) AS amount")
    return containment.table_relations({"staff": staff, "bonus": bonus})


# ---- classification ---------------------------------------------------------------------------------

def patterns(t: Tables) -> DataFrame:
    out = None
    for name in CATALOG:
        df = getattr(t, name)
        texts = [c for c, k in oracle.COLUMNS[name].items() if k in ("string", "list")]
        if texts:
            part = pf.pattern_ratios(df, texts).withColumn("table", F.lit(name))
            out = part if out is None else out.unionByName(part)
    return out


def ruled(t: Tables) -> DataFrame:
    return classify.with_patterns(facts(t), patterns(t))


FORCED = "data_type IN ('date', 'datetime', 'float', 'integer')"
RULE1 = f"CASE WHEN {FORCED} THEN 'property' ELSE 'entity' END"
RULE2 = f"CASE WHEN {FORCED} THEN 'property' WHEN uniqueness_ratio > 0.9 THEN 'entity' WHEN cardinality > 1 AND cardinality < total_rows * 0.1 THEN 'entity' ELSE 'property' END"


@query("classify_rule", f"""SELECT tbl AS table_name, column_name, {RULE1} AS classification, CASE WHEN {FORCED} THEN 'property, as its data type is ' || data_type
    ELSE 'entity, as nothing speaks for a property' END AS reason FROM {CAT}""")
def classify_rule(t: Tables) -> DataFrame:
    return classify.classify_rule(ruled(t)).selectExpr("`table` AS table_name", "column_name", "classification", "reason")


@query("classify_rule_v2", f"SELECT tbl AS table_name, column_name, {RULE2} AS classification FROM {CAT}")
def classify_rule_v2(t: Tables) -> DataFrame:
    return classify.classify_rule_v2(ruled(t)).selectExpr("`table` AS table_name", "column_name", "classification")


KEYWORD = "regexp_matches(lower(column_name), 'id|code|city|country|state|region|category')"
UNCLEAR = "CASE WHEN data_type IN ('integer','float','date','datetime') OR contains(lower(column_name), 'email') OR contains(lower(column_name), 'id') THEN 'property' WHEN uniqueness_ratio > 0.9 THEN 'entity' ELSE 'property' END"


@query("classify_fallback", f"""SELECT tbl AS table_name, column_name, CASE WHEN uniqueness_ratio > 0.9 THEN 'entity' ELSE 'property' END AS basic,
    CASE WHEN {KEYWORD} OR uniqueness_ratio > 0.9 THEN 'entity' ELSE 'property' END AS keyword, CASE WHEN {KEYWORD} THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS keyword_confidence,
    {UNCLEAR} AS unclear FROM {CAT}""")
def classify_fallback(t: Tables) -> DataFrame:
    return classify.classify_fallback(facts(t)).selectExpr("`table` AS table_name", "column_name", "basic", "keyword", "keyword_confidence", "unclear")


ANSWER = "CASE cardinality % 4 WHEN 0 THEN 'Entity' WHEN 1 THEN 'a PROPERTY' WHEN 2 THEN 'unclear' END"
ANSWER_CONF = "CASE WHEN cardinality % 3 = 0 THEN '0.9' WHEN cardinality % 3 = 1 THEN '0.7' ELSE 'high' END"


def answers(t: Tables) -> DataFrame:
    """Answers per column as a model would give them, here read off the cardinality; some are missing."""
    return facts(t).selectExpr("table", "column_name", f"{ANSWER} AS answer", f"{ANSWER_CONF} AS answer_confidence").filter("answer IS NOT NULL")


def rules(t: Tables) -> DataFrame:
    return classify.classify_rule_v2(ruled(t)).filter("cardinality % 5 <> 0")


ANSWERED = f"""(SELECT *, CASE cardinality % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'property' WHEN 2 THEN coalesce(r, {UNCLEAR}) ELSE coalesce(r, CASE WHEN {KEYWORD} OR uniqueness_ratio > 0.9 THEN 'entity' ELSE 'property' END) END AS classification,
    CASE WHEN cardinality % 4 = 3 THEN CASE WHEN r IS NOT NULL THEN 1.0::DOUBLE WHEN {KEYWORD} THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END ELSE coalesce(TRY_CAST({ANSWER_CONF} AS DOUBLE), 0.5::DOUBLE) END AS confidence,
    CASE WHEN cardinality % 4 <> 3 THEN 'answer' WHEN r IS NOT NULL THEN 'rule_based' ELSE 'enhanced_fallback' END AS source
    FROM (SELECT *, CASE WHEN cardinality % 5 <> 0 THEN {RULE2} END AS r FROM {CAT}))"""


@query("classify_columns", f"SELECT tbl AS table_name, column_name, classification, confidence, source FROM {ANSWERED}")
def classify_columns(t: Tables) -> DataFrame:
    return classify.classify(facts(t), answers(t), rules(t)).selectExpr("`table` AS table_name", "column_name", "classification", "confidence", "source")


@query("reconcile_classes", f"""SELECT tbl AS table_name, column_name, c AS classification, conf AS confidence, conflict AS was_conflict, CASE WHEN c = 'entity' AND r IS NOT NULL THEN round(uniqueness_ratio, 6) END AS entity_uniqueness FROM (
    SELECT *, CASE WHEN r IS NULL OR classification = r THEN classification WHEN confidence > 1.0 THEN classification ELSE r END AS c, CASE WHEN classification = r THEN confidence ELSE greatest(confidence, CASE WHEN r IS NOT NULL THEN 1.0::DOUBLE END) END AS conf,
    coalesce(classification <> r, false) AS conflict FROM {ANSWERED})""")
def reconcile_classes(t: Tables) -> DataFrame:
    answered = classify.classify(facts(t), answers(t), rules(t))
    out = classify.reconcile(facts(t).select("table", "column_name"), answered, rules(t))
    return out.selectExpr("`table` AS table_name", "column_name", "classification", "confidence", "was_conflict", "round(entity_uniqueness, 6) AS entity_uniqueness")


# ---- entities and mapping ---------------------------------------------------------------------------

ENDING = "(_id|Id|ID|key)$"
BASE = f"regexp_replace(regexp_replace(column_name, '{ENDING}', ''), '^[a-z]{{1,2}}_', '')"
ENTITIES = f"""(SELECT tbl, column_name, upper(left(b, 1)) || substr(b, 2) AS label, uniqueness_ratio, cardinality,
    CASE WHEN uniqueness_ratio > 0.8 THEN 0.95::DOUBLE WHEN uniqueness_ratio > 0.5 THEN 0.8::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM (SELECT *, {BASE} AS b FROM {CAT})
    WHERE regexp_matches(column_name, '{ENDING}') AND b <> '' AND data_type NOT IN ('float', 'date', 'datetime', 'boolean'))"""
TABLES = f"(SELECT tbl, arg_max(label, (uniqueness_ratio, cardinality, label)) AS row_entity, max(uniqueness_ratio) AS ru, count(DISTINCT label) AS entities FROM {ENTITIES} GROUP BY tbl)"


def entities(t: Tables) -> DataFrame:
    return mapping.detect_entities(facts(t))


@query("entities_detected", f"SELECT tbl AS table_name, column_name, label, confidence FROM {ENTITIES}")
def entities_detected(t: Tables) -> DataFrame:
    return entities(t).selectExpr("`table` AS table_name", "column_name", "label", "confidence")


@query("entity_pairs", f"SELECT DISTINCT a.tbl AS table_name, a.label AS entity_a, b.label AS entity_b FROM {ENTITIES} a JOIN {ENTITIES} b ON a.tbl = b.tbl AND a.label < b.label")
def entity_pairs(t: Tables) -> DataFrame:
    return mapping.entity_pairs(entities(t)).withColumnRenamed("table", "table_name")


@query("intra_relations", f"""SELECT DISTINCT tbl AS table_name, row_entity AS source_entity, 'contains' AS relationship_type, label AS target_entity, confidence FROM {ENTITIES} JOIN {TABLES} USING (tbl)
    WHERE entities >= 2 AND label <> row_entity""")
def intra_relations(t: Tables) -> DataFrame:
    return mapping.intra_relations(entities(t)).selectExpr("`table` AS table_name", "source_entity", "relationship_type", "target_entity", "confidence")


def mapped_sql(with_ignore: bool) -> str:
    bridge = "entities >= 2 AND ru < 0.9 AND data_type IN ('integer', 'float')"
    skip = "row_entity IS NULL OR cardinality <= 1" if with_ignore else "false"
    where = "" if with_ignore else " WHERE row_entity IS NOT NULL"
    return f"""(SELECT c.tbl, c.column_name, c.data_type, c.cardinality, c.uniqueness_ratio, CASE WHEN {skip} THEN 'ignore' WHEN label IS NOT NULL THEN 'entity_property' WHEN {bridge} THEN 'relationship_property' ELSE 'entity_property' END AS graph_element_type,
      CASE WHEN {skip} THEN '' WHEN label IS NOT NULL THEN label WHEN {bridge} THEN 'contains' ELSE row_entity END AS belongs_to,
      CASE WHEN {skip} THEN 0.9::DOUBLE WHEN label IS NOT NULL THEN 0.95::DOUBLE WHEN ru >= 0.9 THEN 0.85::DOUBLE WHEN {bridge} THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS confidence
      FROM (SELECT tbl, column_name, data_type, cardinality, uniqueness_ratio FROM {CAT}) c LEFT JOIN (SELECT tbl, column_name, label FROM {ENTITIES}) e ON c.tbl = e.tbl AND c.column_name = e.column_name
      LEFT JOIN {TABLES} t ON c.tbl = t.tbl{where})"""


def mapped_query(name: str, with_ignore: bool) -> None:
    @query(name, f"SELECT tbl AS table_name, column_name, graph_element_type, belongs_to, confidence FROM {mapped_sql(with_ignore)}")
    def run(t: Tables) -> DataFrame:
        return mapping.map_columns(facts(t), entities(t), with_ignore).selectExpr("`table` AS table_name", "column_name", "graph_element_type", "belongs_to", "confidence")


mapped_query("column_mapping", False)
mapped_query("column_mapping_ignore", True)


@query("entity_column_stats", f"""SELECT belongs_to AS label, count(*) AS columns, string_agg(tbl || '.' || column_name, ',' ORDER BY tbl || '.' || column_name) AS members, CAST(max(cardinality) AS BIGINT) AS top_cardinality
    FROM {mapped_sql(False)} WHERE graph_element_type = 'entity_property' GROUP BY belongs_to""")
def entity_column_stats(t: Tables) -> DataFrame:
    rows = mapping.entity_columns(mapping.map_columns(facts(t), entities(t)), facts(t))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("columns"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(".", "table", "column_name"))), ",").alias("members"),
                                     F.max("cardinality").alias("top_cardinality"))


# ---- the whole chain ---------------------------------------------------------------------------------

def camel_sql(column: str) -> str:
    words = f"string_split(trim(regexp_replace(regexp_replace({column}, '^[a-z]{{1,2}}_', ''), '[^a-zA-Z0-9]+', ' ', 'g')), ' ')"
    return f"lower({words}[1]) || array_to_string(list_transform({words}[2:], lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')"


# no two labels of the catalog have one stem, so none merges
FOUND_NODES = f"""(SELECT belongs_to AS type, list(DISTINCT p ORDER BY p) AS attributes FROM (SELECT belongs_to, {camel_sql('column_name')} AS p FROM {mapped_sql(False)}
    WHERE graph_element_type = 'entity_property') GROUP BY belongs_to)"""
FOUND_EDGES = f"""(WITH b AS (SELECT tbl, {camel_sql('column_name')} AS p FROM {mapped_sql(False)} WHERE graph_element_type = 'relationship_property')
    SELECT row_entity AS source, label AS target, coalesce(list(DISTINCT p ORDER BY p) FILTER (p IS NOT NULL), []) AS attributes FROM {ENTITIES} JOIN {TABLES} USING (tbl) LEFT JOIN b USING (tbl)
    WHERE entities >= 2 AND label <> row_entity GROUP BY row_entity, label)"""


@query("discovered_schema_nodes", f"SELECT type, array_to_string(attributes, ',') AS attributes FROM {FOUND_NODES}")
def discovered_schema_nodes(t: Tables) -> DataFrame:
    nodes, _ = discover.discover_from_profile(facts(t))
    return nodes.withColumn("attributes", F.array_join("attributes", ","))


@query("discovered_schema_edges", f"SELECT 'contains' AS type, source, target, array_to_string(attributes, ',') AS attributes FROM {FOUND_EDGES}")
def discovered_schema_edges(t: Tables) -> DataFrame:
    _, edges = discover.discover_from_profile(facts(t))
    return edges.withColumn("attributes", F.array_join("attributes", ","))


@query("schema_write_read_eval", f"""SELECT 'found' AS run_id, 1.0::DOUBLE AS node_score, 1.0::DOUBLE AS property_score, 1.0::DOUBLE AS relation_score,
    (SELECT count(*) FROM {FOUND_NODES}) AS nodes, (SELECT CAST(sum(len(attributes)) AS BIGINT) FROM {FOUND_EDGES}) AS edge_attributes""")
def schema_write_read_eval(t: Tables) -> DataFrame:
    """The discovered schema, written, read back and scored against itself."""
    nodes, edges = discover.discover_from_profile(facts(t))
    path = new_path(t.spark, "schema")
    store.write_graph_schema(nodes, edges, path)
    rows = stage(store.read_graph_schema(t.spark, path, "found"), "schema_rows")
    gen = rows.filter("element = 'node'").select("run_id", F.col("type").alias("node"), "attr")
    sets = ev.edge_sets(rows.filter("element = 'edge'").select("run_id", F.col("at").alias("edge_id"), "type", "source", "target", "attr"))
    scores = ev.score_runs(gen, nodes.select(F.col("type").alias("node"), F.explode_outer("attributes").alias("attr")),
                           sets, edges.select("type", "source", "target", F.col("attributes").alias("attrs")))
    sizes = rows.agg(F.count_distinct(F.when(F.col("element") == "node", F.col("type"))).alias("nodes"),
                     F.count(F.when(F.col("element") == "edge", F.col("attr"))).alias("edge_attributes"))
    return scores.drop("overall_score").join(F.broadcast(sizes), how="cross")  # one row


@query("property_enriched", f"""SELECT tbl AS table_name, column_name, belongs_to AS label, m.data_type, m.cardinality, round(m.uniqueness_ratio, 6) AS uniqueness_ratio,
    round(missing_percentage, 6) AS missing_percentage FROM {mapped_sql(True)} m JOIN (SELECT tbl, column_name, missing_percentage FROM {CAT}) USING (tbl, column_name) WHERE graph_element_type <> 'ignore'""")
def property_enriched(t: Tables) -> DataFrame:
    rows = mapping.enrich_properties(mapping.map_columns(facts(t), entities(t), True), catalog(t))
    return rows.withColumnRenamed("table", "table_name").drop("sampled_values").withColumns({c: F.round(c, 6) for c in ("uniqueness_ratio", "missing_percentage")})


@query("evidence_lines")
def evidence_lines(t: Tables) -> DataFrame:
    return mapping.evidence_lines(catalog(t))


# labels to merge, a user's input: the first pair has mapped columns, the second is only mentioned in names
PROPOSED = [(1, "Cust", "Order"), (2, "price", "segment")]
PROPOSED_SQL = "(VALUES (1, 'Cust', 'Order'), (2, 'price', 'segment')) AS p(merge_id, src, dst)"


@query("merge_evidence", f"""WITH l AS (SELECT DISTINCT merge_id, unnest([src, dst]) AS label FROM {PROPOSED_SQL}),
    d AS (SELECT merge_id, label, tbl, column_name FROM l JOIN {mapped_sql(False)} ON belongs_to = label WHERE graph_element_type = 'entity_property')
    SELECT merge_id, label, tbl AS table_name, column_name, 'mapped' AS evidence FROM d UNION ALL
    SELECT merge_id, label, tbl, column_name, 'mentioned' FROM l JOIN {CAT} c ON contains(lower(tbl || '.' || column_name), lower(label)) WHERE merge_id NOT IN (SELECT merge_id FROM d)""")
def merge_evidence(t: Tables) -> DataFrame:
    proposed = t.spark.createDataFrame(PROPOSED, "merge_id int, src string, dst string")
    mapped = mapping.map_columns(facts(t), entities(t)).filter("graph_element_type = 'entity_property'").select("table", "column_name", "belongs_to")
    return merge.merge_evidence(proposed, mapped, facts(t).select("table", "column_name")).withColumnRenamed("table", "table_name")


OWNED = "(SELECT o_orderkey, o_custkey, c_nationkey, o_totalprice, o_orderdate, c_name, c_acctbal, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
OWNERS, OWNED_PROPERTIES = ["o_orderkey", "o_custkey", "c_nationkey"], ["o_totalprice", "o_orderdate", "c_name", "c_acctbal", "n_name"]


def owned(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return stage(rows.select(*OWNERS, *OWNED_PROPERTIES), "owned")  # every column pair reads it


def score_sql(left: list[str], right: list[str]) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{a}' AS l, '{b}' AS r, count(DISTINCT {a}) AS ld, count(*) AS pd, count(DISTINCT {a}) / count(*) AS score FROM (SELECT DISTINCT {a}, {b} FROM {OWNED})"
                                    for a in left for b in right if a != b) + ")"


@query("property_entity", f"SELECT r AS property, arg_max(l, (score, -ld, l)) AS entity, round(max(score), 6) AS confidence FROM {score_sql(OWNERS, OWNED_PROPERTIES)} GROUP BY r")
def property_entity(t: Tables) -> DataFrame:
    return mapping.map_properties(mapping.dependency_scores(owned(t), OWNERS, OWNED_PROPERTIES)).withColumn("confidence", F.round("confidence", 6))


ENTITY_RELATIONS = f"""(SELECT CASE WHEN a.score >= b.score THEN a.l ELSE a.r END AS source_entity, CASE WHEN a.score >= b.score THEN a.r ELSE a.l END AS target_entity, greatest(a.score, b.score) AS confidence, a.score = 1 AND b.score = 1 AS bidirectional
    FROM {score_sql([*OWNERS, 'c_name'], [*OWNERS, 'c_name'])} a JOIN {score_sql([*OWNERS, 'c_name'], [*OWNERS, 'c_name'])} b ON a.l = b.r AND a.r = b.l WHERE a.l < a.r AND greatest(a.score, b.score) > 0.5)"""


@query("entity_relations", f"""SELECT source_entity, target_entity, round(confidence, 6) AS confidence, bidirectional FROM (SELECT * FROM {ENTITY_RELATIONS}
    UNION ALL SELECT target_entity, source_entity, confidence, bidirectional FROM {ENTITY_RELATIONS} WHERE bidirectional)""")
def entity_relations(t: Tables) -> DataFrame:
    columns = [*OWNERS, "c_name"]
    out = mapping.infer_relations(mapping.dependency_scores(owned(t), columns, columns))
    return out.select("source_entity", "target_entity", F.round("confidence", 6).alias("confidence"), "bidirectional")


CLASSES = """(SELECT source AS tbl, doc_id AS pos, 'col' || doc_id AS column_name, CASE WHEN doc_id // 20 % 4 = 0 THEN 'entity' ELSE 'property' END AS type, CASE WHEN doc_id // 20 % 4 = 0 THEN 'L' || lang END AS entity_type,
    doc_id // 20 % 4 = 0 AND n_chars % 3 = 0 AS is_primary, CASE WHEN n_chars % 2 = 0 THEN upper('l' || lang) END AS associated_entity, CASE WHEN n_chars % 5 > 1 THEN 'HAS_L' || upper(lang) END AS associated_relationship FROM documents)"""


def classes(t: Tables) -> DataFrame:
    return t.documents.selectExpr(
        "source AS table", "doc_id AS pos", "'col' || doc_id AS column_name", "if(doc_id DIV 20 % 4 = 0, 'entity', 'property') AS type", "CASE WHEN doc_id DIV 20 % 4 = 0 THEN 'L' || lang END AS entity_type",
        "doc_id DIV 20 % 4 = 0 AND n_chars % 3 = 0 AS is_primary", "CASE WHEN n_chars % 2 = 0 THEN upper('l' || lang) END AS associated_entity",
        "CASE WHEN n_chars % 5 > 1 THEN 'HAS_L' || upper(lang) END AS associated_relationship")


@query("associated_entity", f"""WITH k AS MATERIALIZED (SELECT * FROM {CLASSES}), e AS (SELECT * FROM k WHERE type = 'entity'),
    n AS (SELECT tbl, lower(entity_type) AS key, arg_min(column_name, pos) AS c, arg_min(entity_type, pos) AS e FROM e GROUP BY ALL), p AS (SELECT tbl, arg_min(column_name, pos) AS c, arg_min(entity_type, pos) AS e FROM e WHERE is_primary GROUP BY tbl),
    f AS (SELECT tbl, arg_min(column_name, pos) AS c, arg_min(entity_type, pos) AS e FROM e GROUP BY tbl)
    SELECT k.tbl AS table_name, k.pos, coalesce(n.e, p.e, f.e) AS entity_type, coalesce(n.c, p.c, f.c) AS entity_column FROM k LEFT JOIN n ON n.tbl = k.tbl AND n.key = lower(k.associated_entity)
    LEFT JOIN p ON p.tbl = k.tbl LEFT JOIN f ON f.tbl = k.tbl WHERE k.type <> 'entity'""")
def associated_entity(t: Tables) -> DataFrame:
    return mapping.associated_entity(classes(t)).select(F.col("table").alias("table_name"), "pos", "entity_type", "entity_column")


@query("associated_relation", f"""WITH k AS MATERIALIZED (SELECT * FROM {CLASSES}), e AS (SELECT * FROM k WHERE type = 'entity'), p AS (SELECT tbl, arg_min(entity_type, pos) AS s FROM e WHERE is_primary GROUP BY tbl)
    SELECT k.tbl AS table_name, k.pos, k.associated_relationship AS relationship_type, p.s AS source_entity, arg_min(e.entity_type, e.pos) AS target_entity FROM k JOIN p ON p.tbl = k.tbl
    JOIN e ON e.tbl = k.tbl AND ends_with(lower(k.associated_relationship), lower(e.entity_type)) WHERE k.type <> 'entity' GROUP BY ALL""")
def associated_relation(t: Tables) -> DataFrame:
    return mapping.associated_relation(classes(t)).select(F.col("table").alias("table_name"), "pos", "relationship_type", "source_entity", "target_entity")


@query("annotate_rules", f"""SELECT tbl AS table_name, column_name, a AS answer, a AS json, CAST(NULL AS VARCHAR) AS error FROM (SELECT tbl, column_name,
    '{{"classification": "' || CASE WHEN data_type IN ('integer', 'float', 'date', 'datetime') THEN 'property' ELSE 'entity' END || '", "confidence": 1.0}}' AS a FROM {CAT})""")
def annotate_rules(t: Tables) -> DataFrame:
    """Batch annotation with a deterministic client over prompts built from the catalog."""
    from colonnade.functions import annotate, render
    variables = F.create_map(F.lit("table_name"), F.col("table"), F.lit("column_name"), F.col("column_name"), F.lit("data_type"), F.col("data_type"))
    prompts = facts(t).select("table", "column_name", render.fill_template(F.lit("{table_name}.{column_name} is {data_type}"), variables).alias("prompt"))
    return annotate.annotate(prompts, annotate.rule_client).drop("prompt").withColumnRenamed("table", "table_name")
