"""Builds the DuckDB side of profile queries, column by column, straight from the type and profile rules."""

from __future__ import annotations

NUM = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
TOK = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"

COLUMNS = {
    "region": {"r_regionkey": "integral", "r_name": "list"},
    "nation": {"n_nationkey": "integral", "n_name": "string", "n_regionkey": "integral"},
    "customer": {"c_custkey": "integral", "c_name": "string", "c_nationkey": "integral", "c_acctbal": "fractional",
                 "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "integral", "s_name": "string", "s_nationkey": "integral", "s_acctbal": "fractional"},
    "part": {"p_partkey": "integral", "p_name": "list", "p_brand": "string", "p_type": "string", "p_size": "integral",
             "p_retailprice": "fractional"},
    "orders": {"o_orderkey": "integral", "o_custkey": "integral", "o_orderstatus": "string", "o_totalprice": "fractional",
               "o_orderdate": "temporal", "o_orderpriority": "list"},
    "lineitem": {"l_orderkey": "integral", "l_partkey": "integral", "l_suppkey": "integral", "l_linenumber": "integral",
                 "l_quantity": "fractional", "l_extendedprice": "fractional", "l_discount": "fractional", "l_tax": "fractional",
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "temporal"},
    "events": {"event_id": "integral", "ts": "temporal", "user_id": "integral", "event_type": "string", "value": "fractional",
               "props": "list"},
    "documents": {"doc_id": "integral", "text": "list", "lang": "string", "source": "string", "n_chars": "integral"},
    "embeddings": {"vec_id": "integral", "embedding": "array", "label": "integral"},
    "pages": {"page_id": "integral", "url": "string", "html": "list"},
    "benchmark": {"item_id": "integral", "text": "list"},
    "labels": {"doc_id": "integral", "quality": "integral", "toxic": "integral"},
    "conversations": {"conv_id": "integral", "turn": "integral", "role": "string", "text": "list"},
}


def num_text(expr: str) -> str:
    """The shortest text that gives the double back, in plain digits."""
    return f"regexp_replace(CAST(CAST(CAST(CAST({expr} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)) AS VARCHAR), '\\.?0+$', '')"


def time_text(expr: str) -> str:
    return (f"CASE WHEN date_trunc('day', {expr}) = {expr} THEN strftime({expr}, '%Y-%m-%d') "
            f"WHEN date_trunc('second', {expr}) = {expr} THEN strftime({expr}, '%Y-%m-%d %H:%M:%S') "
            f"ELSE strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') END")


def tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[ ,;|]+'), lambda x: x <> '')"


def values_of(src: str, c: str, kind: str) -> str:
    """SELECT of the values that distribution and modes are taken over."""
    if kind == "list":
        return f"SELECT unnest({tokens(c)}) AS v FROM {src} WHERE {c} IS NOT NULL"
    if kind == "array":
        return f"SELECT unnest({c}) AS v FROM {src}"
    return f"SELECT {c} AS v FROM {src} WHERE {c} IS NOT NULL"


def shown(v: str, kind: str) -> str:
    return {"fractional": num_text(v), "temporal": time_text(v), "array": num_text(v)}.get(kind, f"CAST({v} AS VARCHAR)")


def type_sql(c: str, kind: str) -> str:
    """CASE for the logical type, evaluated as an aggregate over the table."""
    n = f"nullif(count({c}), 0)"
    if kind == "temporal":
        return "'datetime'"
    if kind == "integral":
        return (f"CASE WHEN count(*) FILTER ({c} BETWEEN 10000101 AND 99991231 AND try_strptime(CAST({c} AS VARCHAR), '%Y%m%d') "
                f"IS NOT NULL) / {n} > 0.8 THEN 'date' ELSE 'integer' END")
    if kind == "fractional":
        return f"CASE WHEN count(*) FILTER ({c} % 1 = 0) / {n} > 0.95 THEN 'integer' ELSE 'float' END"
    if kind == "array":
        return "'float'"
    num = f"count(*) FILTER (regexp_matches({c}, '{NUM}'))"
    toks = tokens(c)
    return f"""CASE WHEN count(*) FILTER (regexp_matches({c}, '[,;| ]')) / {n} > 0.01
          OR count(*) FILTER (len({toks}) > 1) / {n} * least(500, count({c})) >= 3 THEN
          CASE WHEN sum(len(list_filter({toks}, lambda x: regexp_matches(x, '{TOK}')))) / nullif(sum(len({toks})), 0) <= 0.9 THEN 'string'
               WHEN sum(len(list_filter({toks}, lambda x: regexp_matches(x, '^[0-9]+$')))) = sum(len({toks})) THEN 'integer' ELSE 'float' END
        WHEN {num} / {n} >= 0.9 THEN CASE WHEN count(*) FILTER (TRY_CAST({c} AS DOUBLE) % 1 = 0) = {num} THEN 'integer' ELSE 'float' END
        WHEN bool_and(lower({c}) IN ('true','false','yes','no','y','n','1','0','t','f')) THEN 'boolean'
        WHEN count(DISTINCT {c}) / {n} < 0.1 AND count(DISTINCT {c}) < 20 THEN 'categorical'
        ELSE 'string' END"""


def column_sql(src: str, c: str, kind: str) -> str:
    """One row with the profile of a column."""
    quoted = f'"{c}"'
    values = values_of(src, quoted, kind)
    listy = kind in ("list", "array")
    num = kind in ("integral", "fractional")
    total = "(SELECT count(*) FROM vals)" if listy else "count(*)"
    dbl = f"CAST({quoted} AS DOUBLE)"

    def numeric(e: str) -> str:
        return f"CAST({e} AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"

    length = (lambda e: f"CAST({e} AS DOUBLE)") if kind in ("list", "string") else (lambda e: "CAST(NULL AS DOUBLE)")
    size = f"len({tokens(quoted)})" if kind == "list" else f"len({quoted})"
    sized = (lambda e: f"CAST({e} AS DOUBLE)") if listy else (lambda e: "CAST(NULL AS DOUBLE)")
    temporal = kind == "temporal"
    return f"""SELECT '{c}' AS column_name, a.*, t.top_n, t.counted, t.distinct_n, t.modes, t.mode_count FROM (
      WITH vals AS ({values})
      SELECT {type_sql(quoted, kind)} AS data_type, CAST({total} AS BIGINT) AS total_count, count(*) AS total_rows,
        count(*) FILTER ({quoted} IS NULL) / nullif(count(*), 0) AS missing_percentage,
        count(DISTINCT {quoted}) AS cardinality, count(DISTINCT {quoted}) / nullif(count(*), 0) AS uniqueness_ratio,
        {numeric(f'min({quoted})')} AS min_value, {numeric(f'max({quoted})')} AS max_value, {numeric(f'avg({dbl})')} AS avg_value,
        {numeric(f'quantile_cont({dbl}, 0.25)')} AS q1, {numeric(f'quantile_cont({dbl}, 0.5)')} AS median,
        {numeric(f'quantile_cont({dbl}, 0.75)')} AS q3,
        {numeric(f'CASE WHEN stddev_pop({dbl}) = 0 THEN 0 ELSE skewness({dbl}) END')} AS skew,
        {numeric(f'CASE WHEN stddev_pop({dbl}) = 0 THEN 0 ELSE kurtosis({dbl}) END')} AS kurt,
        {time_text(f'min({quoted})') if temporal else 'CAST(NULL AS VARCHAR)'} AS temporal_min,
        {time_text(f'max({quoted})') if temporal else 'CAST(NULL AS VARCHAR)'} AS temporal_max,
        {length(f'min(length({quoted}))')} AS len_min, {length(f'max(length({quoted}))')} AS len_max,
        {length(f'avg(length({quoted}))')} AS len_mean, {length(f'quantile_cont(CAST(length({quoted}) AS DOUBLE), 0.5)')} AS len_median,
        {length(f'stddev_samp(length({quoted}))')} AS len_std,
        {sized(f'min({size})')} AS tokens_min, {sized(f'max({size})')} AS tokens_max, {sized(f'avg({size})')} AS tokens_avg,
        {f"CASE WHEN contains(min({quoted}), ',') THEN ',' WHEN contains(min({quoted}), ';') THEN ';' WHEN contains(min({quoted}), '|') THEN '|' WHEN contains(min({quoted}), ' ') THEN ' ' ELSE ',' END" if kind == "list" else "','" if kind == "array" else "CAST(NULL AS VARCHAR)"} AS delimiter,
        {str(listy).lower()} AS is_list
      FROM {src}) a,
      (WITH f AS (SELECT v, count(*) AS n FROM ({values}) GROUP BY v),
            m AS (SELECT v, row_number() OVER (ORDER BY v) AS r FROM f WHERE n = (SELECT max(n) FROM f))
       SELECT (SELECT max(n) FROM f) AS top_n, (SELECT CAST(sum(n) AS BIGINT) FROM f) AS counted, (SELECT count(*) FROM f) AS distinct_n,
              (SELECT string_agg({shown('v', kind)}, ', ' ORDER BY r) FROM m WHERE r <= 5) AS modes,
              (SELECT least(5, count(*)) FROM m) AS mode_count) t"""


def facts_sql(table: str, columns: dict[str, str] | None = None, source: str | None = None) -> str:
    """UNION ALL over the columns of a table, every fact as a scalar."""
    cols = columns or COLUMNS[table]
    return "\nUNION ALL\n".join(column_sql(source or table, c, k) for c, k in cols.items())


def profile_sql(table: str, columns: dict[str, str] | None = None, source: str | None = None) -> str:
    """Facts plus derived fields, one row per column; the rounding matches the Spark side."""
    return f"""SELECT column_name, data_type, total_count, total_rows, is_list,
        round(missing_percentage, 6) AS missing_percentage, cardinality, round(uniqueness_ratio, 6) AS uniqueness_ratio,
        CASE WHEN uniqueness_ratio < 0.05 THEN 'low' WHEN uniqueness_ratio < 0.5 THEN 'medium' ELSE 'high' END AS cardinality_type,
        data_type IN ('integer', 'float') AND cardinality / total_count <= 0.05 AS is_effectively_categorical,
        CASE WHEN distinct_n > 1 THEN round(top_n / counted, 6) ELSE 0.0 END AS top_value_frequency,
        CASE WHEN distinct_n > 1 THEN round(1 - top_n / counted, 6) ELSE 0.0 END AS uniformity,
        mode_count, modes, round(min_value, 4) AS min_value, round(max_value, 4) AS max_value, round(avg_value, 4) AS avg_value,
        round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(skew, 4) AS skew, round(kurt, 4) AS kurt,
        temporal_min, temporal_max, len_min, len_max, round(len_mean, 4) AS len_mean, len_median, round(len_std, 4) AS len_std,
        tokens_min, tokens_max, round(tokens_avg, 4) AS tokens_avg, delimiter
      FROM ({facts_sql(table, columns, source)})"""
