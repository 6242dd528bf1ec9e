"""Cases that larger tables brought up."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from colonnade.functions import names
from colonnade.operators import containment, header, profile
from colonnade.sources import csv, store


def test_snake_headers_of_one_large_table(spark):
    """Every name is numbered as one pass in order would, without a list of all names of a table."""
    rng = random.Random(1)
    rows = [("t", i, rng.choice(["x", "x_2", "X 2", "x_2_2", "x_3", "y", "", "9", "9_2", "x_02", None]) if i % 3 else f"n {i // 7}") for i in range(6_000)]
    seen, want = set(), []
    for _, _, name in rows:
        base = name if name is None else "_".join(name.lower().split()) or "column"
        new, k = base, 2
        while base is not None and new in seen:
            new, k = f"{base}_{k}", k + 1
        seen.add(new)
        want.append(new)
    out = header.snake_headers(spark.createDataFrame(rows, "table string, pos int, name string"))
    assert [r["header"] for r in out.orderBy("pos").collect()] == want
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_header_guess_past_a_part_without_rows(spark, tmp_path):
    """The first part holds a header line only, as Spark writes it for an empty first task."""
    (tmp_path / "part-0.csv").write_text("id|name\n")
    (tmp_path / "part-1.csv").write_text("id|name\n1|a\n2|b\n")
    rows = csv.read_csv_table(spark, str(tmp_path), header=None)
    assert rows.columns == ["id", "name"] and sorted(map(tuple, rows.collect())) == [(1, "a"), (2, "b")]


def test_negative_zeros_meet_by_their_text(spark):
    """A column whose only zero is -0.0 shares it with no column of plain zeros; one with both signs does."""
    tables = {"a": spark.createDataFrame([(-0.0, -0.0), (1.0, 0.0), (None, 2.0)], "m double, both double"), "b": spark.createDataFrame([(0.0,), (2.0,)], "p double"),
              "c": spark.createDataFrame([(-0.0,), (7.0,)], "m double")}
    sets = containment.inverted_sets(containment.catalog_values(tables))
    got = {tuple(f"{c['table']}.{c['column_name']}" for c in r["columns"]): r["n"] for r in sets.collect()}
    assert got == {("a.m", "c.m"): 1, ("a.both", "b.p"): 2}


def test_short_texts_count_by_their_language(spark):
    df = spark.createDataFrame([("t", "abc", "de", "English"), ("t", None, "fr", "English"), ("t", "long text", "en", "English")], "table string, text string, detected string, target string")
    assert header.language_mismatches(df, "text", "detected", "target", least=0).first().asDict() == {"table": "t", "too_short": 0, "mismatches": 2, "is_in_target_language": False}
    assert header.language_mismatches(df, "text", "detected", "target").first()["too_short"] == 2


def test_header_detection_never_gathers_a_table(spark):
    """The first row of each table is found without bringing a table's rows into one task."""
    df = spark.createDataFrame([("h", 0, ["id", "name"]), ("h", 1, ["1", "x y"]), ("h", 2, ["2", None])], "table string, pos int, cells array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = header.detect_header(df)
        assert not re.search(r"SortMergeJoin \[table#\d+\]", out._jdf.queryExecution().executedPlan().toString())
        assert out.first()["has_header"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_counted_fields_are_those_of_the_profile(spark):
    """What needs no ranking comes without the frequency table, and is the same."""
    df = spark.createDataFrame([(i, f"k{i % 3}", float(i % 5) / 4, "a, b" if i % 2 else None, i % 2 == 0) for i in range(40)], "i long, k string, d double, l string, b boolean")
    full = profile.profile_catalog({"t": df}, "x")
    counted = profile.profile_catalog({"t": df}, "x", counted_only=True)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, full.select(*counted.columns).collect()))
    assert {"data_type", "cardinality", "uniqueness_ratio", "missing_percentage", "min_value", "max_value", "total_rows"} <= set(counted.columns)


def test_graph_tables_are_written_short(spark, tmp_path):
    """Hexadecimal ids go out in a compression that shortens them."""
    rows = spark.range(5_000).selectExpr("sha2(cast(id AS string), 256) AS id", "'n' AS label")
    store.write_graph_table(rows, "nodes", "label", str(tmp_path))
    files = list((tmp_path / "nodes").rglob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 5_000 * 64 * 0.7 and spark.read.parquet(str(tmp_path / "nodes")).count() == 5_000


def test_camel_name_reads_its_text_once(spark):
    """The pattern runs over a text once, however often the name is read."""
    df = spark.createDataFrame([("12_ab-C dE  x9",), ("",), (None,), ("--a",), ("Été 3x",)], "s string")
    out = df.select(names.camel_name(F.col("s")).alias("n"))
    assert [r["n"] for r in out.collect()] == ["p12AbCDeX9", "property", "property", "a", "t3x"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[^a-zA-Z0-9]+") == 1


def test_sketches_of_all_sizes_come_from_one_pass(spark):
    """Each size leaves the pairs it leaves by itself, and the values are not shuffled to meet the sketches."""
    tables = {f"t{k}": spark.range(40 * k).selectExpr("id AS a", "id % 7 AS b", "cast(id / 3 AS string) AS c") for k in (1, 2, 3)}
    values = containment.catalog_values(tables)
    keys = containment.column_keys(values)
    found = containment.candidates_by_size(values, keys, [1, 4, 64])
    got = {(r["size"], *[r[c] for c in containment.SIDES]) for r in found.collect()}
    want = {(s, *[r[c] for c in containment.SIDES]) for s in (1, 4, 64) for r in containment.candidates(values, keys, size=s).collect()}
    assert got == want and len(got) > 6


def test_profile_without_ranks(spark, monkeypatch):
    """Modes, samples and counts are the same, and no quantile is worked out."""
    df = spark.range(300).selectExpr("id % 40 AS a", "id / 7 AS b", "concat('w', id % 9) AS c", "id % 2 = 0 AS d", "timestamp_seconds(id % 50) AS e", "concat('x y', id % 5) AS f")
    fields = ["column_name", "data_type", "cardinality", "mode_values", "sampled_values", "top_value_frequency", "uniformity", "temporal_min", "temporal_max"]
    want = sorted(map(str, profile.profile(df).select(*fields).collect()))
    monkeypatch.setattr(profile.fq, "summary", None)
    assert sorted(map(str, profile.profile(df, ranked=False).select(*fields).collect())) == want


def test_encoded_dates_follow_the_calendar_without_a_parser(spark):
    """keys of large tables lie in the range of YYYYMMDD; a parser took an error for almost every one of them."""
    from datetime import datetime

    from colonnade.operators import freq, stats

    def is_date(n):
        try:
            return bool(datetime.strptime(str(n), "%Y%m%d")) and 10000101 <= n <= 99991231
        except ValueError:
            return False
    years = (999, 1000, 1582, 1700, 1900, 2000, 2023, 2024, 2100, 9996, 9999, 10000)
    numbers = [y * 10000 + m * 100 + d for y in years for m in (0, 1, 2, 4, 6, 9, 11, 12, 13, 99) for d in (0, 1, 28, 29, 30, 31, 32, 99)] + [0, -20200101, 2**62, None]
    rows = spark.createDataFrame([(n,) for n in numbers], "i bigint").selectExpr("i", stats.ENCODED_DATE.replace("{c}", "i") + " AS fits").collect()
    assert {r["i"]: bool(r["fits"]) for r in rows} == {n: n is not None and len(str(n)) == 8 and is_date(n) for n in numbers}
    facts = freq.freq_facts(freq.value_freq(spark.range(5), with_missing=True))
    assert "yyyyMMdd" not in facts._jdf.queryExecution().optimizedPlan().toString()


def test_dependencies_compare_values_as_they_are(spark, monkeypatch):
    """few pairs are grouped by their own values, not by texts; many pairs, in one scan, give the same. Zeros of both signs are one value."""
    from colonnade.operators import mapping

    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.choice([0.0, -0.0, 1.5, None]), rng.choice(["a", "b", "x" * 80, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "k bigint, d double, s string")
    at = {"k": 0, "d": 1, "s": 2}
    want = {}
    for a in at:
        for b in at:
            both = {(r[at[a]], r[at[b]]) for r in rows if r[at[a]] is not None and r[at[b]] is not None}
            if a != b:
                want[a, b] = (len({x for x, _ in both}), len(both))
    few = mapping.dependency_scores(df, list(at), list(at))
    assert "cast(k#" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(mapping, "BRANCHES", 0)
    for out in (few, mapping.dependency_scores(df, list(at), list(at))):
        assert {(r["left"], r["right"]): (r["left_distinct"], r["pair_distinct"]) for r in out.collect()} == want


def test_edges_with_one_id_lie_side_by_side(spark):
    """ids of 64 digits only compress where equal ones meet; the keys are shuffled instead. The rows are the same, whatever else the table holds."""
    import pandas as pd

    from colonnade.operators import schema
    from colonnade.plans import graph_queries
    from colonnade.plans.registry import Tables

    edges = graph_queries.graph_edges(Tables(spark, "/root/testdata/sf0.001"))
    for kind, column in (("PLACED", "source_id"), ("CONTAINS", "target_id"), ("SUPPLIED_BY", "source_id")):
        ids = edges.filter(F.col("type") == kind).select(F.col(column).alias("v"))

        def runs(batches):
            last = None
            for b in batches:
                yield pd.DataFrame({"n": [sum(x != y for x, y in zip(b["v"], [last, *b["v"]]))]})
                last = b["v"].iloc[-1] if len(b) else last
        assert ids.mapInPandas(runs, "n long").agg(F.sum("n")).first()[0] == ids.distinct().count() < ids.count(), kind
    df = spark.createDataFrame([(1, 7, "x"), (1, 7, "x"), (2, 8, None), (None, 7, "y"), (3, None, "z"), (1, 8, "q")], "a_id int, b_id int, p_note string")
    for target, key in (("B", "b_id"), ("A", "a_id")):
        plain, near = [sorted(map(str, schema.materialize_edges(df, "R", "A", "a_id", target, key, properties=["p_note"], together=t).collect())) for t in (None, "a_id")]
        assert plain == near


def test_partitions_of_counted_values_follow_the_rows(spark, monkeypatch):
    """with a fixed number of partitions, joined up to 64 MB, one task held all values of a column. The session's settings come back."""
    from colonnade import session
    from colonnade.plans import catalog_queries
    from colonnade.plans.registry import Tables

    seen, written = [], session.stage
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(k) for k in keys]

    def spy(df, name):
        seen.append((name, *[spark.conf.get(k) for k in keys]))
        return written(df, name)
    monkeypatch.setattr(session, "stage", spy)
    monkeypatch.setattr(session, "ROWS_A_PART", 200)
    t = Tables(spark, "/root/testdata/sf0.001")
    values = catalog_queries.catalog_values(t)
    assert seen == [("key_values", str(-(-t.lineitem.count() // 200)), str(4 << 20))] and [spark.conf.get(k) for k in keys] == before
    tables = {n: getattr(t, n) for n in catalog_queries.oracle.COLUMNS}
    want = containment.catalog_values(tables)
    assert values.count() == want.count() and values.exceptAll(want).count() == 0
    profile.profile(t.orders.select("o_orderkey", "o_orderstatus"))
    assert [int(n) for name, n, _ in seen if name == "value_freq"] == [max(int(before[0]), -(-t.orders.count() // 200))]


ODD_TEXTS = ["", None, " ", "\r", "a\r\n", '""', 'a "b"\n\x00"', "\x00,\n", "\uffff", 'x\uffff"\n\ufffe1', "\ufffe", "\ufffen", "\ufeffa", "null", "\\", 'a\\"']


def test_texts_and_large_keys_go_through_csv(spark, tmp_path):
    """Sums of keys pass the range of an int, empty texts stay apart from missing ones, and no character is lost or ends a record."""
    import __spark_entry__ as e

    docs = [(2**62 + i if i else None, t, "en") for i, t in enumerate(ODD_TEXTS)]  # with a missing key
    turns = [(2_147_483_000 + i // 2, i % 2, "user", t) for i, t in enumerate(ODD_TEXTS)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = [("documents", i, t) for i, t, _ in docs] + [("conversations", c * 1000 + turn, t) for c, turn, _, t in turns]
    want = {(table, i): (None, None) if t is None else (hashlib.md5(t.encode()).hexdigest(), len(t)) for table, i, t in rows}
    got = e.queries()["csv_text_roundtrip"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["table_name"], r["id"]): (r["digest"], r["chars"]) for r in got} == want


def test_empty_quotes_are_no_number_and_no_fault(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,n,t\n1,"",""\n2,,\n3,7,x\n4,"y","z\x00"\n')
    df = csv.read_csv_table(spark, str(tmp_path), schema="id int, n int, t string", bad="_line")
    assert sorted((tuple(r) for r in df.collect()), key=str) == [(1, None, "", None), (2, None, None, None), (3, 7, "x", None), (4, None, "z\x00", '4,"y","z\x00"')]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.csv").write_text("t,id\n\ufeff,1\n\ufeffa\ufffe,2\n", encoding="utf-8")
    assert sorted((r["id"], r["t"]) for r in csv.read_csv_table(spark, str(tmp_path / "c")).collect()) == [(1, "\ufeff"), (2, "\ufeffa\ufffe")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.csv").write_text('id,n,t\n1,"",""\n2,,\n3,7,x\n')
    assert dict(csv.read_csv_table(spark, str(tmp_path / "b")).dtypes) == {"id": "int", "n": "int", "t": "string"}
