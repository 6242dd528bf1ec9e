"""Names, answers, similarity, containment, merging, schemas and evaluation on small inputs."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.functions import annotate, names, render, text
from colonnade.operators import classify, containment, evaluate, header, mapping, merge, sampling, schema, similar
from colonnade.sources import csv, documents, store


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw,camel", [("first_name", "firstName"), ("Customer ID", "customerId"), ("2nd-value", "p2ndValue"), ("***", "property"), (None, "property")])
def test_camel_name(spark, raw, camel):
    assert one(spark, names.camel_name, raw) == camel


def test_other_names(spark):
    assert one(spark, names.snake_name, " Belongs To--X ") == "belongs_to_x"
    assert one(spark, names.plain_name, "User_Id-2.x") == "userid2x"
    assert one(spark, names.lower_if_all_caps, "USER") == "user" and one(spark, names.lower_if_all_caps, "User") == "User"
    p = one(spark, lambda c: names.parse_pair_key(c), "a.b.c <-> d.e")
    assert tuple(p) == ("a", "b.c", "d", "e")


@pytest.mark.parametrize("answer,want", [
    ('```json\n{"a": 1}\n```', {"a": 1}), ('Here: {"a": [1, 2]} done', {"a": [1, 2]}), ('"{"a": 1}"', {"a": 1}), ('{"a": [1, 2', {"a": [1, 2]}),
    ("no json", None), ("", None), ('{\\"a\\": \\"x\\\\ny\\"}', {"a": "x\ny"}), ('{\\"a\\": \\"\\u00e9\\"}', {"a": "é"}), ('{bad} and {"ok": true}', {"ok": True}),
])
def test_answers(spark, answer, want):
    r = render.parse_answers(spark.createDataFrame([(answer,)], "answer string"), "answer").first()
    assert (json.loads(r["json"]) if r["json"] else None) == want
    assert (r["error"] is None) == (want is not None)


def test_templates(spark):
    df = spark.createDataFrame([("x {a} {b}", {"a": "1", "b": "2"}), ("x {a} {c}", {"a": "1"})], "t string, v map<string,string>")
    got = [r[0] for r in df.select(render.fill_template(F.col("t"), F.col("v"))).collect()]
    assert got == ["x 1 2", "Error: unsubstituted placeholders in prompt: {c}"]


def test_annotation_retries_and_reports(spark):
    def client(prompts):
        return ['{"ok": 1}' if "Return only" in p else "plain" for p in prompts]
    def broken(prompts):
        raise RuntimeError("down")
    df = spark.createDataFrame([("p",)], "prompt string")
    assert annotate.annotate(df, client).first()["json"] == '{"ok": 1}'
    assert annotate.annotate(df, broken).first()["error"] == "Empty response"


def test_type_hint(spark):
    assert one(spark, text.type_hint, "float") == text.TYPE_HINTS["numeric"] and one(spark, text.type_hint, "other") == text.TYPE_HINTS["text"]


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_similar_columns_match_brute_force(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    vecs = [(f"t{i % 4}", f"c{i}", [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.3]) for i in range(40)]
    vecs += [("t0", "empty", []), ("t1", "zero", [0.0] * 8)] + [(f"t{i}", "same", [1.0] * 8) for i in range(4)]  # equal distances
    want = set()
    for (ta, ca, a), (tb, cb, b) in itertools.combinations(vecs, 2):
        if ta != tb and a and b and np.linalg.norm(a) and np.linalg.norm(b):
            if np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.85:
                want.add(((ta, ca), (tb, cb)) if ta < tb else ((tb, cb), (ta, ca)))
    df = spark.createDataFrame(vecs, "table string, column string, vec array<float>")
    got = [((r["table_a"], r["column_a"]), (r["table_b"], r["column_b"])) for r in similar.similar_columns(df, 0.85, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_embedders(spark):
    df = spark.createDataFrame([("a", "customer id"), ("b", "customer ids"), ("c", "zzz"), ("d", "")], "k string, t string")
    v = {r["k"]: np.array(r["vec"]) for r in similar.hashed_vectors(df, ["k"], "t").collect()}
    assert v["a"] @ v["b"] > 0.8 > v["a"] @ v["c"] and len(v["d"]) == 0
    def flaky(texts):
        if "zzz" in texts:
            raise ValueError("no")
        return [[1.0, 2.0]] * len(texts)
    got = {r["k"]: list(r["vec"]) for r in similar.embed(df.coalesce(1), "t", flaky).collect()}
    assert got["a"] == [1.0, 2.0] and got["c"] == []


def test_foreign_keys(spark):
    tables = {"customers": spark.createDataFrame([("a@x", 1), ("b@x", 2), ("c@x", 3)], "email string, n int"),
              "orders": spark.createDataFrame([("a@x", 1), ("a@x", 2), ("b@x", 9)], "customer_email string, q int")}
    values = containment.catalog_values(tables)
    pairs = containment.containment(values, containment.column_keys(values))
    fks = {(r["child_column"], r["parent_column"]) for r in containment.foreign_keys(pairs).collect()}
    assert fks == {("customer_email", "email")}
    assert containment.relation_cardinality(containment.foreign_keys(pairs)).first()["cardinality"] == "1:N"


def test_containment_equals_plain_sets(spark):
    r = np.random.default_rng(3)
    pool = {"i": [int(x) for x in range(300)], "s": [f"w{x}" * (1 + 30 * (x % 2)) for x in range(300)], "d": [x / 8 for x in range(300)]}
    plain, tables = {}, {}
    for t in range(5):
        n = 120 * (t + 1)
        part = {f"{k}{j}": [None if r.random() < 0.1 else v[int(x)] for x in r.integers(0, 1 + 290 * (j + 1) // 2 // (5 - t), n)] for k, v in pool.items() for j in range(2)}
        plain |= {(f"t{t}", c): set(v) - {None} for c, v in part.items()}
        kinds = {"i": "bigint", "s": "string", "d": "double"}
        tables[f"t{t}"] = spark.createDataFrame(list(zip(*part.values())), ", ".join(f"{c} {kinds[c[0]]}" for c in part))
    values = containment.catalog_values(tables)
    keys = containment.column_keys(values)
    want = {(*a, *b): len(x & y) for a, x in plain.items() for b, y in plain.items() if a[0] != b[0] and a[1][0] == b[1][0] and len(x) <= len(y) and x & y}
    got = {tuple(p[c] for c in containment.SIDES): p["matched"] for p in containment.containment(values, keys).collect()}
    assert got == want
    full = {p for p, m in want.items() if m == len(plain[p[:2]])}
    assert {tuple(p[c] for c in containment.SIDES) for p in containment.contained(values, keys, size=4).collect()} == full and full
    left = [containment.candidates(values, keys, size=k).count() for k in (1, 4, 64)]
    assert left[0] > left[1] >= left[2] >= len(full)


def test_containment_plan_has_no_pair_join(spark):
    """Columns meet through values only: no join on (table, column) before the counts, and no nested loops."""
    values = containment.catalog_values({"a": spark.range(5).toDF("x"), "b": spark.range(9).toDF("y")})
    plan = containment.shared_values(containment.inverted_sets(values))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "NestedLoop" not in plan
    assert containment.shared_values(containment.inverted_sets(values)).count() == 2


def test_dependencies_of_all_pairs(spark):
    rows = [(1, "a", 1.5, None), (1, "a", 2.5, "z"), (2, "b", 2.5, None), (3, None, 1.5, None), (None, "b", 1.5, None)]
    df = spark.createDataFrame(rows, "k int, t string, v double, n string")
    got = {(r["left"], r["right"]): (r["left_distinct"], r["pair_distinct"]) for r in mapping.dependency_scores(df, df.columns, df.columns).collect()}
    for i, a in enumerate(df.columns):
        for j, b in enumerate(df.columns):
            pairs = {(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None}
            assert i == j or got[a, b] == (len({p[0] for p in pairs}), len(pairs))
    assert mapping.dependency_scores(df, [], ["k"]).count() == 0 == mapping.dependency_scores(df, ["k"], ["k"]).count()


def test_derived_value(spark):
    detail = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0)], "k int, v double")
    master = spark.createDataFrame([(1, 5.0), (2, 7.0)], "k int, total double")
    assert containment.derived_value(detail, "k", "v", master, "k", "total").first()["share"] == 0.5


def test_classify_rules(spark):
    df = spark.createDataFrame([("t", "a", "float", 0.99, 99, 100, 0.0, 0.0, 0.0, 0.0), ("t", "b", "string", 0.95, 95, 100, 0.0, 0.0, 0.0, 0.0),
                                ("t", "c", "string", 0.05, 5, 100, 0.0, 0.0, 0.0, 0.0), ("t", "d", "string", 0.5, 50, 100, 0.9, 0.0, 0.0, 0.0),
                                ("t", "e", "string", 0.5, 50, 100, 0.0, 0.0, 0.0, 0.0)],
                               "table string, column_name string, data_type string, uniqueness_ratio double, cardinality int, total_rows int, "
                               "email_ratio double, phone_ratio double, credit_card_ratio double, numeric_id_ratio double")
    assert [r["classification"] for r in classify.classify_rule(df).orderBy("column_name").collect()] == ["property", "entity", "entity", "property", "entity"]
    assert [r["classification"] for r in classify.classify_rule_v2(df).orderBy("column_name").collect()] == ["property", "entity", "entity", "property", "property"]


@pytest.mark.parametrize("column,label", [("customerId", "Customer"), ("order_id", "Order"), ("c_custkey", "Cust"), ("anotherRef", "AnotherRef"), ("amount", None), ("id", None)])
def test_entity_label(spark, column, label):
    assert one(spark, mapping.entity_label, column) == label


def test_associated_rows(spark):
    df = spark.createDataFrame([("t", 0, "e0", "entity", "Person", False, None, None), ("t", 1, "e1", "entity", "City", True, None, None),
                                ("t", 2, "p", "property", None, False, "person", None), ("t", 3, "q", "property", None, False, None, "LIVES_IN_CITY")],
                               "table string, pos int, column_name string, type string, entity_type string, is_primary boolean, associated_entity string, associated_relationship string")
    assert {r["column_name"]: r["entity_type"] for r in mapping.associated_entity(df).collect()} == {"p": "Person", "q": "City"}
    r = mapping.associated_relation(df).first()
    assert (r["column_name"], r["source_entity"], r["target_entity"]) == ("q", "City", "City")


def test_label_merges(spark):
    df = spark.createDataFrame([("Product", 9), ("Products", 2), ("product", 1), ("Order", 5)], "label string, n int")
    got = {(r["src"], r["dst"]) for r in merge.propose_label_merges(df).collect()}
    assert got == {("Products", "Product"), ("product", "Product")}
    synonyms = spark.createDataFrame([("order", "product")], "synonym string, canonical string")
    assert ("Order", "Product") in {(r["src"], r["dst"]) for r in merge.propose_label_merges(df, synonyms).collect()}


def test_relation_types_first_group_wins(spark):
    df = spark.createDataFrame([("a|b", "has_orders", 3), ("a|b", "order", 1), ("a|c", "order", 1), ("a|c", "orders", 1)], "pair string, type string, richness int")
    got = [(r["from_type"], r["to_type"], r["pair"]) for r in merge.merge_relation_types(df).collect()]
    assert got == [("order", "has_orders", "a|b")]


GOLD = [("user", "id"), ("user", "age"), ("movie", "id"), ("movie", "title"), ("genre", "name"), ("rating", "value"), ("tag", "text")]
EDGES = [("rates", "user", "movie", ["at", "value"]), ("in", "movie", "genre", []), ("tags", "user", "tag", ["at"])]


def scores(spark, nodes, edges):
    gold = spark.createDataFrame(GOLD, "node string, attr string")
    gen = spark.createDataFrame([("r", *n) for n in nodes], "run_id string, node string, attr string")
    schema_text = "type string, source string, target string, attrs array<string>"
    ge, ee = spark.createDataFrame(EDGES, schema_text), spark.createDataFrame([("r", *e) for e in edges], "run_id string, " + schema_text)
    r = evaluate.overall_score(evaluate.node_score(gen, gold), evaluate.property_score(gen, gold), evaluate.relation_score(ee, ge)).first()
    return r["node_score"], r["property_score"], r["relation_score"]


def test_evaluation_scores(spark):
    assert scores(spark, GOLD, EDGES) == (1.0, 1.0, 1.0)
    assert scores(spark, [n for n in GOLD if n[0] != "genre"], EDGES)[0] == pytest.approx(4 / 5)
    assert scores(spark, [n for n in GOLD if n != ("user", "age")], EDGES)[1] == pytest.approx(1 - 1 / (2 * 5))
    turned = [(t, g, s, a) for t, s, g, a in EDGES]
    assert scores(spark, GOLD, turned)[2] == 1.0
    short = [("rates", "user", "movie", ["at"])] + EDGES[1:]
    assert scores(spark, GOLD, short)[2] == pytest.approx(2 / 3)
    split = [("rates", "user", "movie", ["at"]), ("rates", "user", "movie", ["value"])] + EDGES[1:]
    assert scores(spark, GOLD, split)[2] == pytest.approx(2 / 3)  # no single edge has both attributes


def test_canonical_names(spark):
    syn = spark.createDataFrame([(0, "user", "person"), (0, "user", "client"), (1, "item", "product"), (2, "click", "person_event")], "pos int, canonical string, synonym string")
    df = spark.createDataFrame([("App_User",), ("Person-Event",), ("my.product",), ("Other_Thing",)], "name string")
    want = {"App_User": "user", "Person-Event": "user", "my.product": "item", "Other_Thing": "otherthing"}
    assert {r["name"]: r["canonical"] for r in evaluate.canonical_names(df, "name", syn).collect()} == want
    empty = syn.unionByName(spark.createDataFrame([(1, "any", "-_")], syn.schema))  # normalises to nothing, so every name contains it
    got = {r["name"]: r["canonical"] for r in evaluate.canonical_names(df, "name", empty).collect()}
    assert got == want | {"my.product": "any" if "any" < "item" else "item", "Other_Thing": "any"}
    assert {r["canonical"] for r in evaluate.canonical_names(df, "name", syn.limit(0)).collect()} == {"appuser", "personevent", "myproduct", "otherthing"}


def test_edge_alignment_and_last_relation(spark):
    gold = spark.createDataFrame([("r", "a", "b")], "type string, source string, target string")
    gen = spark.createDataFrame([("r", "b", "a", "x"), ("r", "a", "b", "y"), ("q", "b", "a", "z")], "type string, source string, target string, attr string")
    got = {(r["attr"], r["source"], r["flipped"]) for r in schema.align_edges(gen, gold).collect()}
    assert got == {("x", "a", True), ("y", "a", False), ("z", "b", False)}
    last = schema.last_relation(gen.withColumn("pos", F.lit(1)), F.col("attr")).count()
    assert last == 3


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "y")], "k string, n int, s string")
    new = spark.createDataFrame([("a", 1, None), ("b", 2, "z"), ("d", 4, "w")], "k string, n int, s string")
    got = {r["k"]: (r["status"], r["changed_fields"]) for r in evaluate.snapshot_diff(old, new, ["k"]).collect()}
    assert got == {"b": ("changed", "s"), "c": ("gone", None), "d": ("new", None)}


@pytest.mark.parametrize("n", [1, 2, 6, 10])
def test_head_mid_tail(spark, n):
    df = spark.range(0, 100).selectExpr("id * 3 AS k", "id AS v")
    third = max(1, n // 3)
    first, last, mid = third, third, n - 2 * third
    if mid <= 0:
        first, last, mid = (n + 1) // 2, n // 2, 0
    want = set(range(first)) | set(range(50 - mid // 2, 50 - mid // 2 + mid)) | set(range(100 - last, 100))
    got = {r["v"] for r in sampling.head_mid_tail(df, "k", n).collect()}
    assert got == set(sorted(want)[:n])


def test_header_detection(spark):
    df = spark.createDataFrame([("h", 0, ["id", "name"]), ("h", 1, ["1", "x y"]), ("h", 2, ["2", "z w"]), ("n", 0, ["1", "9.5"]), ("n", 1, ["2", "8.5"])], "table string, pos int, cells array<string>")
    assert {r["table"]: r["has_header"] for r in header.detect_header(df).collect()} == {"h": True, "n": False}
    assert {r["table"]: r["is_header"] for r in header.guess_header(df).collect()} == {"h": True, "n": False}
    with pytest.raises(ValueError):
        header.apply_header(spark.range(3), ["a", "b"])


def test_language(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the house", "en"), (4, "la maison et le jardin", "fr"), (5, "x", "en")], "k int, t string, l string")
    model = header.train_language_model(df, "t", "l")
    want = {1: "en", 2: "fr", 3: "en", 4: "fr", 5: "en"}
    assert {r["k"]: r["detected"] for r in header.detect_language(df, "k", "t", model).collect()} == want


def test_language_of_unseen_texts(spark):
    """Each half is labelled by a model of the other half; rows without text, language or known trigrams have a defined result."""
    texts = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the house and the garden", "en"), ("la maison et le jardin", "fr"), ("x", "en"), (None, "fr"), ("the", None), ("\u6f22\u5b57\u6f22", "en")]
    df = spark.createDataFrame([(2 * i + h, t, lang, h) for i, (t, lang) in enumerate(texts) for h in (0, 1)], "k int, t string, l string, half int")
    model = header.train_language_model(df.where("k < 14"), "t", "l", F.col("half"), 2)
    assert {(r["fold"], r["lang"]) for r in model.collect()} == {(h, x) for h in (0, 1) for x in ("en", "fr")}
    got = {r["k"]: (r["detected"], r["confidence"]) for r in header.detect_language(df, "k", "t", model, F.col("half")).collect()}
    want = [("en", 0.8), ("fr", 0.8), ("en", 0.8), ("fr", 0.8), ("en", 0.5), ("en", 0.5), ("en", 0.8), ("en", 0.5)]
    assert got == {2 * i + h: w for i, w in enumerate(want) for h in (0, 1)}
    # the model of a half ignores that half: with only its own rows there is none
    assert header.train_language_model(df.where("half = 0"), "t", "l", F.col("half"), 2).select("fold").distinct().collect() == [(1,)]


def test_language_pieces_and_plan(spark, monkeypatch):
    """Long texts are taken in pieces without losing a trigram; neither training nor labelling shuffles trigrams of texts."""
    import numpy as np

    text = "abcdefghij" * 7
    whole = np.sort(np.concatenate(list(header._slots(text))))
    monkeypatch.setattr(header, "PIECE", 5)
    assert (np.sort(np.concatenate(list(header._slots(text)))) == whole).all() and len(whole) == len(text) - 2
    df = spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr")], "k int, t string, l string")
    plan = header.detect_language(df, "k", "t", header.train_language_model(df, "t", "l"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("block", [7, 2000])
def test_similar_columns_brute_force(spark, block):
    """Clusters, equal vectors, and vectors that are null, empty or zero, against all pairs."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 16))
    vectors = [centers[i % 6] + rng.normal(size=16) * 0.25 for i in range(120)] + [centers[0], centers[0], centers[1] * 3]
    rows = [(f"t{i % 4}", f"c{i}", [float(x) for x in v]) for i, v in enumerate(vectors)] + [("t9", "null", None), ("t9", "empty", []), ("t9", "zero", [0.0] * 16)]
    df = spark.createDataFrame(rows, "table string, column string, vec array<float>")
    unit = np.array([np.float32(v) for v in vectors], dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cos = unit @ unit.T
    want = {tuple(sorted([rows[i][:2], rows[j][:2]])) for i in range(len(vectors)) for j in range(i) if rows[i][0] != rows[j][0] and cos[i, j] >= 0.85}
    got = [((r["table_a"], r["column_a"]), (r["table_b"], r["column_b"])) for r in similar.similar_columns(df, 0.85, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert similar.similar_columns(df.filter("table = 't9'"), 0.85, block).count() == 0


def test_similar_columns_prunes_blocks(spark):
    """On clustered vectors under a tenth of the block pairs are left, and no plan multiplies blocks by blocks."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 64))
    vectors = centers[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64)) * 0.1
    df = spark.createDataFrame([("t", str(i), v.tolist()) for i, v in enumerate(vectors)], "table string, column string, vec array<double>")
    unit = similar._unit(df)
    points = similar._pivots(unit, similar.PIVOTS)
    placed = similar.stage(similar._blocks(unit, points, 40), "placed")
    blocks = placed.select("block").distinct().count()
    assert placed.count() == 4000 and placed.groupBy("block").count().agg(F.max("count")).first()[0] <= 80
    pairs = similar.block_pairs(placed, len(points), 0.85)
    assert blocks >= 100 and pairs.count() < 0.1 * blocks * (blocks + 1) / 2
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_schema_documents(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("nodes:\n - type: User\n   attributes: [id, {age: int}]\n - type: Empty\nedges:\n - {type: r, source: User, target: Empty, properties: [at]}\n")
    (tmp_path / "b.json").write_text(json.dumps({"nodes": [{"type": "X", "properties": ["p"]}]}))
    got = {(r["run_id"], r["element"], r["type"], r["attr"]) for r in documents.read_graph_schemas(spark, str(tmp_path)).collect()}
    assert got == {("a", "node", "User", "id"), ("a", "node", "User", "age"), ("a", "node", "Empty", None), ("a", "edge", "r", "at"), ("b", "node", "X", "p")}


def test_csv_table(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("id;name;zip\n1;Zoë, A;01234\n2;Bob;99\n".encode("latin-1"))
    df = csv.read_csv_table(spark, str(tmp_path / "t.csv"), overrides={"zip": "string"})
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "Zoë, A", "01234"), (2, "Bob", "99")]


def test_samples_text(spark):
    df = spark.createDataFrame([(["a", "b c"],)], "s array<string>")
    line = df.select(store.join_samples(F.col("s")).alias("l"))
    assert line.select(store.split_samples(F.concat("l", F.lit(", ,")))).first()[0] == ["a", "b c"]


def test_graph_tables(spark):
    df = spark.createDataFrame([(1, 7, "x"), (2, 8, "y"), (3, None, "z")], "a_id int, b_id int, a_first_name string")
    nodes = schema.materialize_nodes(df, "A", "a_id", ["a_first_name"])
    assert nodes.columns == ["id", "label", "key", "firstName"] and schema.repeated_ids(nodes).count() == 0
    edges = schema.materialize_edges(df, "R", "A", "a_id", "B", "b_id", spark.createDataFrame([(7,)], "k int"), "k")
    assert edges.count() == 1 and edges.first()["source_id"] == nodes.filter("key = '1'").first()["id"]


def test_schema_files_and_snapshots(spark, tmp_path):
    nodes = schema.schema_nodes(spark.createDataFrame([("USER", ["b", "a"])], "label string, properties array<string>"))
    edges = schema.document_edges(spark.createDataFrame([("r", "USER", "Item")], "type string, source string, target string"))
    store.write_graph_schema(nodes, edges, str(tmp_path / "s"))
    assert tuple(spark.read.json(str(tmp_path / "s/nodes")).select("type", "attributes").first()) == ("user", ["a", "b"])
    assert spark.read.json(str(tmp_path / "s/edges")).first()["source"] == "user"
    for run in ("a", "b"):
        store.write_snapshot(spark.createDataFrame([(run, 1)], "k string, n int"), str(tmp_path / "runs"), run, "one")
    assert [tuple(r) for r in store.read_snapshot(spark, str(tmp_path / "runs"), "b", "one").collect()] == [("b", 1)]


def test_head_mid_tail_of_repeated_text_and_large_keys(spark):
    for expr, keys in (("id % 20", 20), ("concat('k', id % 20)", 20), ("date_add(DATE '2024-01-01', cast(id AS int))", 60), ("1700000000000000000 + id", 60)):
        df = spark.range(60).selectExpr(f"{expr} AS k", "id AS v")
        rows = sampling.head_mid_tail(df, "k", 10).collect()
        order = sorted(r["k"] for r in df.collect())
        assert len(rows) == 10 and sorted(r["k"] for r in rows) == sorted(order[:3] + order[28:32] + order[-3:])
    hot = spark.range(500).selectExpr("if(id < 300, NULL, 7) AS k", "id AS v")
    assert [r["k"] for r in sampling.head_mid_tail(hot, "k", 6).collect()] == [None] * 4 + [7] * 2


def test_quantiles_of_large_integers(spark):
    import pandas as pd

    from colonnade.operators import freq

    ids = [1_700_000_000_000_000_000 + i for i in range(1000)]
    rows = spark.createDataFrame([("c", float(i), 1) for i in ids], "column_name string, x double, n bigint")
    want = pd.Series(ids).quantile([0.25, 0.5, 0.75]).tolist()
    assert freq.quantiles(rows).first()["q"] == pytest.approx(want, rel=1e-15)
    assert freq.quantiles(rows, ["c"]).first()["q"] == pytest.approx(want, rel=1e-15)


def test_texts_keep_digits_and_fractions(spark):
    from colonnade.operators import freq, stats

    df = spark.createDataFrame([(4e-7, "2024-01-01 10:00:00.000250"), (3e-7, "2024-01-01 10:00:00"), (1200.0, "2024-01-01"), (-0.1, None), (1e-30, None)], "d double, t string")
    assert [r[0] for r in df.select(freq.num_text(F.col("d"))).collect()] == ["0.0000004", "0.0000003", "1200", "-0.1", "1.0E-30"]
    assert [r[0] for r in df.select(stats.iso_text(F.col("t").cast("timestamp"))).collect()][:3] == ["2024-01-01 10:00:00.000250", "2024-01-01 10:00:00", "2024-01-01"]


def test_header_row_goes_alone(spark):
    df = spark.createDataFrame([(1, "h"), (1, "a"), (None, "b"), (2, "c")], "k int, v string")
    left = header.apply_header(df, ["x", "y"], "k").collect()
    assert len(left) == 3 and sorted(r["y"] for r in left if r["x"] != 1 or r["x"] is None) == ["b", "c"]
    names_of = spark.createDataFrame([("t", i, n) for i, n in enumerate(["x", "x", "x_2", "X", ""])], "table string, pos int, name string")
    assert [r["header"] for r in header.snake_headers(names_of).orderBy("pos").collect()] == ["x", "x_2", "x_2_2", "x_3", "column"]


def test_relation_merge_needs_a_group(spark):
    from colonnade.operators import merge

    rows = [("p1", "buy", 1), ("p2", "buy", 1), ("p2", "buys", 3), ("p3", "buy", 1), ("p3", "buys", 3), ("p3", "has_buy", 2), ("p4", "own", 1)]
    got = merge.merge_relation_types(spark.createDataFrame(rows, "pair string, type string, richness int")).collect()
    assert {(r["from_type"], r["to_type"], r["pair"]) for r in got} == {("buy", "buys", "p2")}  # p3's group has a type that is merged already


def test_runs_without_rows_are_scored(spark):
    gen = spark.createDataFrame([("a", "user", "id")], "run_id string, node string, attr string")
    gold = gen.drop("run_id")
    edges = spark.createDataFrame([], "run_id string, type string, source string, target string, attrs array<string>")
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    got = {r["run_id"]: (r["node_score"], r["property_score"], r["relation_score"]) for r in evaluate.score_runs(gen, gold, edges, edges.drop("run_id"), runs).collect()}
    assert got == {"a": (1.0, 1.0, 1.0), "b": (0.0, 0.0, 1.0)}


def test_csv_cells_types_and_charsets(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,zip\n1,"he said ""hi, you"" now",01234\n2,"two\nlines",99\n', encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("id,text,zip\n3,café,7.5\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text("id,text,zip\n4,Zoë,8\n", encoding="utf-8")
    df = csv.read_csv_table(spark, str(tmp_path), overrides={"zip": "string"})
    assert dict(df.dtypes)["id"] == "int" and dict(df.dtypes)["zip"] == "string"
    assert sorted(tuple(r) for r in df.collect()) == [(1, 'he said "hi, you" now', "01234"), (2, "two\nlines", "99"), (3, "café", "7.5"), (4, "Zoë", "8")]
    assert dict(csv.read_csv_table(spark, str(tmp_path)).dtypes)["zip"] == "double"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.csv").write_text('name;"a,b,c,d"\nx;1\ny;2\n')
    assert csv.read_csv_table(spark, str(tmp_path / "d"), header=None).count() == 2


def test_staging_needs_a_shared_folder(spark):
    from colonnade import session

    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(type("Session", (), {"conf": Conf, "sparkContext": Context}))


def test_repeated_snapshot_replaces(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1)], "k string, n int")
    for _ in range(2):
        store.write_snapshot(rows, str(tmp_path / "s"), "run", "one")
    store.write_snapshot(rows, str(tmp_path / "s"), "run", "two")
    assert store.read_snapshot(spark, str(tmp_path / "s"), "run", "one").count() == 1 == store.read_snapshot(spark, str(tmp_path / "s"), "run", "two").count()


def test_runs_without_nodes_miss_all_golden_nodes(spark):
    gen = spark.createDataFrame([("a", "X"), ("a", "Y")], "run_id string, node string")
    gold = spark.createDataFrame([("X",), ("Z",)], "node string")
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    got = {(r["run_id"], r["node"]): r["status"] for r in evaluate.node_diff(gen, gold, runs).collect()}
    assert got == {("a", "X"): "found", ("a", "Y"): "extra", ("a", "Z"): "missing", ("b", "X"): "missing", ("b", "Z"): "missing"}


def test_snapshots_match_missing_keys(spark):
    old = spark.createDataFrame([(None, 1), ("x", 1), ("y", 1)], "k string, v int")
    new = spark.createDataFrame([(None, 1), ("x", 2), ("z", 1)], "k string, v int")
    got = {r["k"]: (r["status"], r["changed_fields"]) for r in evaluate.snapshot_diff(old, new, ["k"]).collect()}
    assert got == {"x": ("changed", "v"), "y": ("gone", None), "z": ("new", None)}


def test_header_row_goes_whatever_the_partitions(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), (None, 3), ("a", 1)], "k string, v int")
    got = [sorted(map(tuple, header.apply_header(df.repartition(n), ["x", "y"], drop_first_by="k").collect()), key=str) for n in (1, 2, 5)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 4 and (None, 3) in got[0]


def test_equal_classes_keep_the_answers_confidence(spark):
    head = spark.createDataFrame([("t", "c"), ("t", "d")], "table string, column_name string")
    answered = spark.createDataFrame([("t", "c", "entity", 0.7), ("t", "d", "entity", 0.7)], "table string, column_name string, classification string, confidence double")
    rules = spark.createDataFrame([("t", "c", "entity", 1.0, 0.5), ("t", "d", "property", 0.6, 0.5)], "table string, column_name string, classification string, confidence double, uniqueness_ratio double")
    got = {r["column_name"]: (r["classification"], r["confidence"], r["was_conflict"]) for r in classify.reconcile(head, answered, rules).collect()}
    assert got == {"c": ("entity", 0.7, False), "d": ("entity", 0.7, True)}


def test_hierarchies_and_circles(spark):
    chain = spark.range(1, 40).selectExpr("id", "if(id > 1, id - 1, null) AS up", "id % 39 + 1 AS ring", "id AS own")
    assert containment.is_hierarchy(chain, "up", "id") and not containment.is_hierarchy(chain, "ring", "id") and not containment.is_hierarchy(chain, "own", "id")
    assert containment.is_hierarchy(chain.limit(0), "up", "id")
    tail = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3), (5, 4)], "id long, up long")
    assert not containment.is_hierarchy(tail, "up", "id")


def test_derived_columns_of_all_pairs(spark):
    detail = spark.createDataFrame([(1, 2.0, 1), (1, 3.0, None), (2, None, 7), (3, 1.0, 1)], "k int, a double, b int")
    master = spark.createDataFrame([(1, 5.0, 1), (2, 4.0, 7), (9, 0.0, 0)], "id int, x double, y int")
    got = {(r["detail_column"], r["master_column"]): (r["compared"], r["equal_rows"]) for r in containment.derived_columns(detail, "k", master, "id").collect()}
    assert got == {("a", "x"): (1, 1), ("a", "y"): (1, 0), ("b", "x"): (2, 0), ("b", "y"): (2, 2)}
    assert containment.derived_columns(detail.select("k"), "k", master, "id").count() == 0


def test_annotations_are_asked_once(spark, tmp_path):
    calls, path = spark.sparkContext.accumulator(0), str(tmp_path / "answers")

    def client(prompts):
        calls.add(len(prompts))
        return ['{"ok": 1}' if "bad" not in p else "" for p in prompts] if not any("down" in p for p in prompts) else 1 / 0
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "prompt string, k int")
    first = sorted((r["k"], r["json"], r["error"]) for r in annotate.annotate_once(df, client, path).collect())
    assert first == [(1, '{"ok":1}', None), (2, '{"ok":1}', None), (3, '{"ok":1}', None), (4, None, "Empty response")] or [x[0] for x in first] == [1, 2, 3, 4]
    assert calls.value == 2
    assert sorted((r["k"], r["json"], r["error"]) for r in annotate.annotate_once(df, client, path).collect()) == first and calls.value == 2
    more = df.unionByName(spark.createDataFrame([("c", 5)], df.schema))
    assert annotate.annotate_once(more, client, path).count() == 5 and calls.value == 3
    broken = spark.createDataFrame([("down", 1)], df.schema)
    assert annotate.annotate_once(broken, client, path).first()["error"] == "Empty response"
    assert annotate.stored_answers(df, path).count() == 3


def test_graph_export_with_properties(spark, tmp_path):
    people = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "id long, name string, score double")
    knows = spark.createDataFrame([(1, 2, True)], "source long, target long, close boolean")
    manifest = {(r["kind"], r["name"]): r["rows"] for r in store.write_graph({"Person": people, "None": people.limit(0)}, {"KNOWS": knows}, str(tmp_path)).collect()}
    assert manifest == {("nodes", "Person"): 2, ("nodes", "None"): 0, ("edges", "KNOWS"): 1}
    nodes, edges = store.read_graph(spark, str(tmp_path))
    assert sorted(map(tuple, nodes["Person"].collect())) == [(1, "a", 1.5), (2, None, 2.5)] and dict(nodes["Person"].dtypes)["score"] == "double"
    assert [tuple(r) for r in edges["KNOWS"].collect()] == [(1, 2, True)]


def test_samples_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("d", "t", "01", ["a", "b c"]), ("d", "t", "x", []), ("d", "u", "x", ["line\nbreak"])], "dataset string, table string, column_name string, sampled_values array<string>")
    store.write_samples(df, str(tmp_path / "s"))
    got = {tuple(r)[:3]: r["sampled_values"] for r in store.read_samples(spark, str(tmp_path / "s")).collect()}
    assert got == {("d", "t", "01"): ["a", "b c"], ("d", "t", "x"): [], ("d", "u", "x"): ["line break"]}
