"""Names, texts, templates, answers and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions import language, names, render, text
from colonnade.operators import profile as pf
from colonnade.plans import oracle
from colonnade.plans.registry import Tables, query


@query("name_camel", r"""SELECT doc_id, CASE WHEN j = '' THEN 'property' WHEN regexp_matches(j, '^[a-zA-Z]') THEN j ELSE 'p' || j END AS property_name FROM (
    SELECT doc_id, lower(w[1]) || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || lower(x[2:])), '') AS j FROM (
      SELECT doc_id, string_split(trim(regexp_replace(s, '[^a-zA-Z0-9]+', ' ', 'g')), ' ') AS w
      FROM (SELECT doc_id, n_chars || '_' || source || '-' || lang || ' ' || text AS s FROM documents)))""")
def name_camel(t: Tables) -> DataFrame:
    raw = t.documents.selectExpr("doc_id", "n_chars || '_' || source || '-' || lang || ' ' || text AS s")
    return raw.select("doc_id", names.camel_name(F.col("s")).alias("property_name"))


@query("name_snake", """SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text, ' ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')
    AS relation_type FROM documents""")
def name_snake(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", names.snake_name(F.col("text")).alias("relation_type"))


@query("name_norm", "SELECT page_id, translate(lower(url), '_-.', '') AS plain FROM pages")
def name_norm(t: Tables) -> DataFrame:
    return t.pages.select("page_id", names.plain_name(F.col("url")).alias("plain"))


@query("cosine_labels", """WITH c AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i
      FROM embeddings) GROUP BY label, i),
    k AS (SELECT label, list(m ORDER BY i) AS centre FROM c GROUP BY label)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centre), 4) AS similarity FROM embeddings JOIN k USING (label)""")
def cosine_labels(t: Tables) -> DataFrame:
    centres = t.embeddings.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    # one entry per dimension
    centres = centres.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centre"))
    return t.embeddings.join(centres, "label").select(
        "vec_id", F.round(names.cosine(F.col("embedding"), F.col("centre")), 4).alias("similarity"))


@query("pair_key", """SELECT o_orderkey, k AS pair_key, split_part(split_part(k, ' <-> ', 1), '.', 1) AS table_a, split_part(split_part(k, ' <-> ', 1), '.', 2) AS column_a,
    split_part(split_part(k, ' <-> ', 2), '.', 1) AS table_b, split_part(split_part(k, ' <-> ', 2), '.', 2) AS column_b
    FROM (SELECT o_orderkey, o_orderstatus || '.' || o_orderpriority || ' <-> ' || o_custkey || '.' || o_orderkey AS k FROM orders)""")
def pair_key(t: Tables) -> DataFrame:
    keys = t.orders.select("o_orderkey", names.pair_key(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string"),
                                                        F.col("o_orderkey").cast("string")).alias("pair_key"))
    return keys.select("*", names.parse_pair_key(F.col("pair_key")).alias("p")).select("o_orderkey", "pair_key", "p.*")


# ---- descriptions -----------------------------------------------------------------------------------

def duck_fixed(expr: str, digits: int) -> str:
    return f"CAST(CAST(round_even({expr}, {digits}) AS DECIMAL(38, {digits})) AS VARCHAR)"


def duck(template: str) -> str:
    return text.render(template, duck_fixed, "CAST({} AS VARCHAR)")


def unlisted(table: str) -> dict[str, str]:
    """Columns whose samples the SQL side can state (the random token samples it cannot)."""
    return {c: k for c, k in oracle.COLUMNS[table].items() if k not in ("list", "array")}


def described_sql(table: str) -> str:
    """Profile facts with the sample policy and contextual description, unrounded."""
    from colonnade.plans.profile_queries import DESCRIBED, samples_sql
    cols = unlisted(table)
    return f"""SELECT f.*, s.samples, {DESCRIBED} AS contextual_description,
        CASE WHEN uniqueness_ratio < 0.05 THEN 'low' WHEN uniqueness_ratio < 0.5 THEN 'medium' ELSE 'high' END AS cardinality_type,
        coalesce(data_type IN ('integer', 'float') AND cardinality / total_count <= 0.05, false) AS is_effectively_categorical,
        CASE WHEN distinct_n > 1 THEN top_n / counted ELSE 0.0 END AS top_value_frequency,
        CASE WHEN distinct_n > 1 THEN 1 - top_n / counted ELSE 0.0 END AS uniformity,
        '{table}' AS table_name
      FROM ({oracle.facts_sql(table, cols)}) f JOIN ({samples_sql(table)}) s USING (column_name)"""


def prof(t: Tables, table: str, ranked: bool = True) -> DataFrame:
    return pf.profile(getattr(t, table), list(unlisted(table)), ranked=ranked).withColumn("table_name", F.lit(table))


def lines_sql(table: str) -> str:
    nums = ", ".join(f"coalesce({oracle.num_text(c)}, '') AS {n}_text" for c, n in (
        ("min_value", "min"), ("max_value", "max"), ("avg_value", "avg"), ("q1", "q1"), ("median", "median"), ("q3", "q3")))
    cases = " ".join(f"WHEN '{k}' THEN {duck(v)}" for k, v in text.LINES.items())
    kind = text.line_kind().replace("if(cardinality_type = 'low', 'values', 'modes')", "CASE WHEN cardinality_type = 'low' THEN 'values' ELSE 'modes' END")
    return f"""SELECT table_name, column_name, CASE {kind} {cases} ELSE column_name END AS text FROM (
        SELECT * REPLACE (CASE WHEN data_type = 'string' AND samples = '' THEN modes ELSE samples END AS samples), {nums}, {text.NOUN} AS noun
        FROM ({described_sql(table)}))"""


def trimmed(df: DataFrame) -> DataFrame:
    """Means enter texts with four decimals so that summation order cannot show."""
    return df.withColumn("avg_value", F.round("avg_value", 4))


@query("column_text", " UNION ALL ".join(lines_sql(t).replace("min_value", "min_value").replace(
    oracle.num_text("avg_value"), oracle.num_text("round(avg_value, 4)")) for t in ("customer", "orders", "supplier")))
def column_text(t: Tables) -> DataFrame:
    out = None
    for table in ("customer", "orders", "supplier"):
        part = text.column_text(trimmed(prof(t, table))).select("table_name", "column_name", "text")
        out = part if out is None else out.unionByName(part)
    return out


FIELDS = """SELECT *, string_split(modes, ', ')[1] AS first_mode, string_split(samples, ', ')[1] AS sample,
    length(string_split(samples, ', ')[1]) AS sample_length,
    CASE WHEN list_contains(string_split(modes, ', '), string_split(samples, ', ')[1]) THEN 'mode' ELSE 'non-mode' END AS popularity,
    CASE WHEN lower(string_split(modes, ', ')[1]) IN ('true','1','yes','y','t') THEN 'True' ELSE 'False' END AS flag,
    CASE WHEN lower(string_split(modes, ', ')[1]) IN ('true','1','yes','y','t') THEN 'enabled' ELSE 'disabled' END AS status,
    'minority' AS case_type, format('{:,}', total_count) AS total_grouped, string_split(modes, ', ')[1] AS day,
    dayname(try_strptime(string_split(modes, ', ')[1], '%Y-%m-%d')) AS weekday, monthname(try_strptime(string_split(modes, ', ')[1], '%Y-%m-%d')) AS month,
    day(try_strptime(string_split(modes, ', ')[1], '%Y-%m-%d')) AS day_number, year(try_strptime(string_split(modes, ', ')[1], '%Y-%m-%d')) AS year
    FROM (SELECT * REPLACE (1.0 AS tokens_avg, 1 AS tokens_min, 1 AS tokens_max) FROM ({src}))"""


def long_sql(table: str, only: str | None = None) -> str:
    chosen = {k: v for k, v in text.LONG_TEXTS.items() if only in (None, k)}
    cases = " ".join(f"WHEN data_type IN ({', '.join(repr(x) for x in types)}) THEN {duck(tpl)}" for types, tpl in chosen.values())
    where = f" WHERE data_type IN ({', '.join(repr(x) for x in chosen[only][0])})" if only else ""
    return (f"SELECT table_name, column_name, coalesce(CASE {cases} END, contextual_description) AS text "
            f"FROM ({FIELDS.replace('{src}', described_sql(table))}){where}")


def long_query(name: str, tables: list[str], only: str | None) -> None:
    @query(name, " UNION ALL ".join(long_sql(x, only) for x in tables))
    def run(t: Tables) -> DataFrame:
        out = None
        for table in tables:
            part = text.long_text(prof(t, table, only not in ("boolean", "date")), only).select("table_name", "column_name", "text")
            out = part if out is None else out.unionByName(part)
        return out


long_query("text_numeric", ["lineitem"], "numeric")
long_query("text_string", ["supplier", "part", "customer"], "string")
long_query("text_boolean", ["lineitem", "events"], "boolean")
long_query("text_date", ["orders", "lineitem"], "date")
long_query("text_dispatch", ["customer", "orders", "part"], None)


@query("type_hint", f"""SELECT column_name, CASE WHEN data_type IN ('integer', 'float') THEN '{text.TYPE_HINTS["numeric"]}'
    WHEN data_type IN ('date', 'datetime') THEN '{text.TYPE_HINTS["temporal"]}' WHEN data_type = 'categorical' THEN '{text.TYPE_HINTS["categorical"]}'
    ELSE '{text.TYPE_HINTS["text"]}' END AS hint FROM ({oracle.facts_sql("customer")})""")
def type_hint(t: Tables) -> DataFrame:
    return pf.profile(t.customer).select("column_name", text.type_hint(F.col("data_type")).alias("hint"))


@query("column_text_roundtrip", f"SELECT 'demo' AS dataset, table_name, column_name, text FROM ({long_sql('orders')})")
def column_text_roundtrip(t: Tables) -> DataFrame:
    from colonnade.sources import store
    texts = text.long_text(prof(t, "orders")).select(F.lit("demo").alias("dataset"), F.col("table_name").alias("table"), "column_name", "text")
    return store.roundtrip_text(texts).withColumnRenamed("table", "table_name")


# ---- templates and answers --------------------------------------------------------------------------

@query("render_prompts", """SELECT doc_id, 'Document ' || doc_id || ' in ' || lang || ' from ' || source || ': ' || text AS prompt FROM documents
    WHERE NOT regexp_matches(text, '\\{[\\w_]+\\}')""")
def render_prompts(t: Tables) -> DataFrame:
    variables = F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"),
                             F.lit("start"), F.col("text"))
    filled = t.documents.select("doc_id", render.fill_template(F.lit("Document {id} in {lang} from {source}: {start}"), variables).alias("prompt"))
    return filled.filter(~F.col("prompt").startswith("Error: unsubstituted"))


WRAPPED = """CASE turn % 4 WHEN 0 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN 1 THEN 'Sure: ' || j || ' done'
    WHEN 2 THEN left(j, length(j) - 1) ELSE role END"""


@query("parse_answers", """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE role END AS role, CASE WHEN turn % 4 = 3 THEN NULL ELSE length(text) END AS n,
    CASE WHEN turn % 4 = 3 THEN 'Failed to parse JSON' END AS error FROM conversations""")
def parse_answers(t: Tables) -> DataFrame:
    raw = t.conversations.withColumn("j", F.to_json(F.struct("role", F.length("text").alias("n"))))
    answers = raw.selectExpr("conv_id", "turn", f"{WRAPPED} AS answer")
    return render.parse_answers(answers, "answer").selectExpr(
        "conv_id", "turn", "get_json_object(json, '$.role') AS role", "cast(get_json_object(json, '$.n') AS bigint) AS n", "error")


@query("class_label", """SELECT doc_id, CASE WHEN contains(a, 'entity') AND NOT contains(a, 'property') THEN 'entity' WHEN contains(a, 'property') THEN 'property'
    ELSE lang END AS classification, coalesce(TRY_CAST(c AS DOUBLE), 0.5) AS confidence FROM (SELECT doc_id, lang,
      CASE WHEN n_chars % 3 = 0 THEN 'an entity' WHEN n_chars % 3 = 1 THEN 'property of an entity' ELSE 'unclear' END AS a,
      CASE WHEN n_chars % 2 = 0 THEN '0.9' ELSE 'high' END AS c FROM documents)""")
def class_label(t: Tables) -> DataFrame:
    raw = t.documents.selectExpr(
        "doc_id", "lang", "CASE n_chars % 3 WHEN 0 THEN 'An ENTITY' WHEN 1 THEN 'Property of an entity' ELSE 'unclear' END AS a",
        "if(n_chars % 2 = 0, '0.9', 'high') AS c")
    return raw.select("doc_id", names.class_label(F.col("a"), F.col("lang")).alias("classification"), names.confidence(F.col("c")).alias("confidence"))


@query("language_match", """SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' ELSE lang END
    AS language, lang IN ('fr', 'en') AND (n_chars % 2 = 0) = (lang = 'fr') AS is_match FROM documents""")
def language_match(t: Tables) -> DataFrame:
    raw = t.documents.selectExpr("doc_id", "lang", "if(n_chars % 2 = 0, 'French', ' ENGLISH ') AS other")
    named = language.normalise_language(raw, "lang", "language")
    return language.match_languages(named, "lang", "other").select("doc_id", "language", "is_match")
