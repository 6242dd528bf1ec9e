"""Some registered queries against their SQL on the smallest tables (tests/compare.py runs all)."""

import pytest

from compare import compare, connect

NAMES = ["profile_lineitem", "profile_documents", "profile_modes", "profile_quantiles", "column_text", "text_string", "similar_columns", "fk_discovery",
         "column_mapping", "relation_merges", "property_consolidate", "graph_edges", "eval_overall", "language_detect", "sample_hmt", "csv_charset_groups"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, name):
    assert compare(spark, connect(data), name, data) is None


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 140
