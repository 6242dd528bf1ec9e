"""Profile of small tables, worked out by hand, and of random ones against pandas."""

import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colonnade.operators import freq as fq
from colonnade.operators import profile as pf
from colonnade.operators import ranks, stats


def rows(df):
    return {r["column_name"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([
        (1, "John Doe", 30, "john@example.com", "New York"), (2, "Jane Smith", 25, "jane@example.com", "Los Angeles"),
        (3, "Bob Johnson", 40, "bob@example.com", "Chicago"), (4, "Alice Brown", 35, "alice@example.com", "Houston"),
        (5, "Charlie Davis", 28, "charlie@example.com", "Phoenix")], "id int, name string, age int, email string, city string")


def test_types_of_small_table(people):
    got = rows(pf.profile(people))
    assert {c: r["data_type"] for c, r in got.items()} == {"id": "integer", "name": "string", "age": "integer", "email": "string", "city": "string"}
    assert got["name"]["is_list"] and got["city"]["is_list"] and not got["email"]["is_list"]
    assert got["name"]["total_count"] == 10 and got["name"]["cardinality"] == 5  # tokens and cells
    assert got["name"]["list"]["delimiter"] == " "
    assert got["email"]["value_lengths"]["min"] == 15.0


def test_numeric_column_modes_and_uniqueness(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 5, 4, 3, 2, 1]], "x int")
    r = rows(pf.profile(df))["x"]
    assert (r["uniqueness_ratio"], r["cardinality"], r["mode_values"]) == (0.5, 5, ["1", "2", "3", "4", "5"])
    assert (r["min_value"], r["max_value"], r["avg_value"], r["median"]) == (1.0, 5.0, 3.0, 3.0)
    assert r["contextual_description"] == "symmetric, light tails"


def test_text_modes(spark):
    df = spark.createDataFrame([(v,) for v in ["apple", "banana", "apple", "cherry", "banana"]], "x string")
    r = rows(pf.profile(df))["x"]
    assert (r["uniqueness_ratio"], r["mode_values"], r["sampled_values"]) == (0.6, ["apple", "banana"], ["apple", "banana", "cherry"])


def test_constant_empty_and_missing_columns(spark):
    df = spark.createDataFrame([("USD", None, 1.0), ("USD", None, float("nan")), ("USD", None, 3.0)], "c string, e string, f double")
    got = rows(pf.profile(df))
    assert (got["c"]["uniformity"], got["c"]["top_value_frequency"], got["c"]["unique_count"]) == (0.0, 0.0, None)
    assert got["e"]["data_type"] == "unknown" and got["e"]["missing_percentage"] == 1.0
    assert got["f"]["missing_percentage"] == pytest.approx(1 / 3) and got["f"]["cardinality"] == 2 and got["f"]["data_type"] == "integer"


def test_empty_table(spark):
    got = rows(pf.profile(spark.createDataFrame([], "a int, b string")))
    assert got["a"]["data_type"] == "unknown" and got["b"]["total_count"] == 0 and got["a"]["uniqueness_ratio"] == 0.0


@pytest.mark.parametrize("values,expected", [
    (["1", "2", "-3"], "integer"), (["1.5", "2", "3"], "float"), (["yes", "NO", "t"], "boolean"), (["2024-01-05", "2023-12-1", "2022-02-02"], "date"),
    (["05/01/2024", "31/12/2023", "1/2/2022"], "date"), (["1,2", "3,4", "5"], "integer"), (["1.5;2", "3;4", "5;1"], "float"),
    (["abc", "def", "ghi"], "string"), (["0", "1", "0"], "integer"),
])
def test_string_types(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    assert rows(pf.profile(df))["x"]["data_type"] == expected


def test_categorical_and_encoded_date_and_temporal(spark):
    df = spark.range(200).selectExpr("concat('v', id % 3) AS cat", "cast(20240100 + id % 28 + 1 AS int) AS day", "timestamp_seconds(id * 86400) AS ts", "id % 2 = 0 AS flag")
    got = rows(pf.profile(df))
    assert {c: got[c]["data_type"] for c in got} == {"cat": "categorical", "day": "date", "ts": "datetime", "flag": "boolean"}
    assert got["ts"]["temporal_min"] == "1970-01-01" and got["cat"]["contextual_description"] == "3 unique"


def test_array_column(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([2.0],), ([1.0, 2.0],)], "v array<float>")
    r = rows(pf.profile(df))["v"]
    assert r["is_list"] and r["total_count"] == 5 and r["cardinality"] == 2 and r["mode_values"] == ["2"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=5, max_size=40))
def test_against_pandas(spark, values):
    s = pd.Series(values, dtype="float64")
    if s.dropna().empty:
        return
    r = rows(pf.profile(spark.createDataFrame([(v,) for v in values], "x bigint")))["x"]
    assert r["cardinality"] == s.nunique() and r["missing_percentage"] == pytest.approx(s.isna().mean())
    assert (r["q1"], r["median"], r["q3"]) == pytest.approx(tuple(s.quantile([0.25, 0.5, 0.75])))
    for got, want in ((r["skew"], s.skew()), (r["kurt"], s.kurtosis())):
        assert (got is None and math.isnan(want)) or got == pytest.approx(want, abs=1e-6)
    assert r["mode_values"] == [str(int(v)) for v in s.mode()[:5]]


def test_rank_narrowing_matches_sorting(spark):
    values = [float((i * 7919) % 5003) for i in range(5003)]
    df = spark.createDataFrame([("a", v, 1 + int(v) % 3) for v in values], "key string, x double, n int")
    flat = sorted(v for v in values for _ in range(1 + int(v) % 3))
    wanted = [0, 17, len(flat) // 2, len(flat) - 1]
    found = ranks.values_at_ranks(df, {"a": wanted}, limit=20)
    assert [found["a", r] for r in wanted] == [flat[r] for r in wanted]


def test_large_column_quantiles_take_the_narrowing_path(spark):
    df = spark.range(3000).selectExpr("cast(id * id AS double) AS x")
    freq = fq.value_freq(df).select("column_name", fq.number_of().alias("x"), "n")
    small = fq.quantiles(freq).first()["q"]
    assert fq.quantiles(freq, ["x"]).first()["q"] == pytest.approx(small)


def test_wide_tables_share_branches(spark):
    df = spark.range(20).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(80)])
    got = {r["column_name"]: r["distinct_n"] for r in fq.freq_summary(fq.value_freq(df)).collect()}
    assert len(got) == 80 and got["c4"] == 5 and got["c79"] == 20


def test_renamed_profile_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    r = rows(pf.profile(df, original={"key": "k"}))
    assert r["key"]["original_column"] == "k" and list(r) == ["key"]
    assert pf.duplicate_row_count(df).first()[0] == 1


def test_mode_ranking_is_limited_before_the_shuffle(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet")
    plan = fq.top_values(fq.value_freq(df))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "WindowGroupLimit" in plan


def test_frequency_scan_reads_one_column_per_branch(spark, data):
    plan = fq.value_freq(spark.read.parquet(f"{data}/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line]
    assert len(schemas) == 11 and all(s.count(":") == 1 for s in schemas)


def test_facts_are_one_scan(spark, data):
    plan = stats.per_column(spark.read.parquet(f"{data}/orders.parquet"), ["o_custkey", "o_totalprice"], {"lo": "min({c})"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_durations(spark):
    df = spark.sql("SELECT make_dt_interval(id, 0, 0, 5) AS d FROM range(3)")
    freq = {r["i"] for r in fq.value_freq(df).collect()}
    assert freq == {5_000_000, 86_405_000_000, 172_805_000_000}
    assert tuple(pf.interval_profile(df, "d").first()) == (5, 172805, 86405.0)
    assert rows(pf.profile(df))["d"]["data_type"] == "datetime"


def test_reduced_profiles(spark):
    prof = pf.profile(spark.createDataFrame([(1, "a b")], "k int, v string"))
    assert pf.compact(prof).columns == ["column_name", *pf.COMPACT]
    assert pf.samples_only(prof).columns == ["column_name", "sampled_values"]
    assert "mode_values" not in pf.scalars(prof).columns and "cardinality" in pf.scalars(prof).columns


def test_text_times_without_lists(spark):
    from colonnade.operators.profile import profile

    df = spark.createDataFrame([(f"2024-01-{d:02d} 10:00:00", f"2024-01-{d:02d}") for d in range(1, 21)], "t string, d string")
    assert {r["column_name"]: r["data_type"] for r in profile(df, detect_lists=False).collect()} == {"t": "datetime", "d": "date"}
