"""The preparation steps and the value filters."""

from __future__ import annotations

from .common import Query, formula, keep, prepared

QUERIES: dict[str, Query] = {}


def add(name: str, table: str, *steps, sql: str) -> None:
    QUERIES[name] = Query(prepared(table, *steps), sql)


# ------------------------------------------------------------------------------- columns

add(
    "step_rename",
    "orders",
    (
        "rename",
        {
            "renames": [
                {"from": "o_orderstatus", "to": "o_orderpriority"},
                {"from": "o_orderpriority", "to": "o_orderstatus"},
                {"from": "o_orderkey", "to": "order_id"},
            ]
        },
    ),
    sql="""select o_orderkey as order_id, o_custkey, o_orderstatus as o_orderpriority,
        o_totalprice, o_orderdate, o_orderpriority as o_orderstatus from orders""",
)
add(
    "step_keep_columns",
    "lineitem",
    keep("l_quantity", "l_orderkey", "l_shipdate"),
    sql="select l_orderkey, l_quantity, l_shipdate from lineitem",
)
add(
    "step_delete_columns",
    "orders",
    ("keep_delete", {"columns": ["o_orderdate", "o_totalprice"]}),
    sql="select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders",
)
add(
    "step_concat_columns",
    "customer",
    formula("c_mktsegment", "nullif(c_mktsegment, 'BUILDING')"),
    (
        "concat_columns",
        {"columns": ["c_custkey", "c_mktsegment", "c_name"], "into": "label", "separator": " - "},
    ),
    keep("c_custkey", "label"),
    sql="""select c_custkey, c_custkey::varchar || ' - '
        || coalesce(nullif(c_mktsegment, 'BUILDING'), '') || ' - ' || c_name as label
        from customer""",
)
add(
    "step_split_column",
    "part",
    ("split_column", {"column": "p_name", "separator": " ", "count": 3}),
    ("split_column", {"column": "p_brand", "separator": "#"}),
    sql="""select *, split_part(p_name, ' ', 1) as p_name_1, split_part(p_name, ' ', 2) as p_name_2,
        split_part(p_name, ' ', 3) as p_name_3, split_part(p_brand, '#', 1) as p_brand_1,
        split_part(p_brand, '#', 2) as p_brand_2 from part""",
)
add(
    "step_split_urls",
    "pages",
    ("split_column", {"column": "url", "separator": "/", "count": 5}),
    ("keep_delete", {"columns": ["html"]}),
    sql="""select page_id, url, split_part(url, '/', 1) as url_1, split_part(url, '/', 2) as url_2,
        split_part(url, '/', 3) as url_3, split_part(url, '/', 4) as url_4,
        split_part(url, '/', 5) as url_5 from pages""",
)
add(
    "step_unpivot",
    "lineitem",
    formula("l_discount", "nullif(l_discount, 0)"),
    keep("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"),
    (
        "unpivot",
        {
            "columns": ["l_quantity", "l_discount", "l_tax"],
            "name_into": "measure",
            "value_into": "amount",
        },
    ),
    sql="""select l_orderkey, l_linenumber, 'l_quantity' as measure, l_quantity as amount
        from lineitem union all
        select l_orderkey, l_linenumber, 'l_discount', nullif(l_discount, 0) from lineitem
        union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem""",
)

_STATUSES = ["F", "O", "Été"]
_PIVOT_SQL = {
    "max": "max(case when o_orderstatus = '{v}' then o_totalprice end)",
    "min": "min(case when o_orderstatus = '{v}' then o_totalprice end)",
    "sum": "sum(case when o_orderstatus = '{v}' then round(o_totalprice) end)",
    "avg": "avg(case when o_orderstatus = '{v}' then round(o_totalprice) end)",
    "count": "count(case when o_orderstatus = '{v}' then 1 end)",
}
for _fn, _expr in _PIVOT_SQL.items():
    _names = [("st_f", "F"), ("st_o", "O"), ("st_ete", "Été")]
    # Whole amounts: their sums are exact in any order, so no result depends on it.
    _whole = [("round", {"column": "o_totalprice"})] if _fn in ("sum", "avg") else []
    add(
        f"step_pivot_{_fn}",
        "orders",
        *_whole,
        (
            "pivot",
            {
                "key_columns": ["o_custkey"],
                "name_column": "o_orderstatus",
                "value_column": "o_totalprice",
                "values": _STATUSES,
                "aggregate": _fn,
                "prefix": "st_",
            },
        ),
        sql="select o_custkey, "
        + ", ".join(f"{_expr.format(v=v)} as {n}" for n, v in _names)
        + " from orders group by o_custkey",
    )
add(
    "step_pivot_without_key",
    "events",
    (
        "pivot",
        {
            "name_column": "event_type",
            "value_column": "value",
            "values": ["click", "error", "view"],
            "aggregate": "count",
        },
    ),
    sql="""select count(case when event_type = 'click' then 1 end) as click,
        count(case when event_type = 'error' then 1 end) as error,
        count(case when event_type = 'view' then 1 end) as "view" from events""",
)

# ------------------------------------------------------------------------------ formulas

add(
    "step_formula_new",
    "lineitem",
    formula("net", "round(l_extendedprice * (1 - l_discount), 4)"),
    keep("l_orderkey", "l_linenumber", "net"),
    sql="""select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net
        from lineitem""",
)
add(
    "step_formula_replace",
    "customer",
    formula("c_mktsegment", "lower(c_mktsegment);"),
    sql="""select c_custkey, c_name, c_nationkey, c_acctbal,
        lower(c_mktsegment) as c_mktsegment from customer""",
)
add(
    "step_if_then_else",
    "orders",
    (
        "if_then_else",
        {
            "into": "size",
            "condition": "o_totalprice > 250000",
            "then": "'large'",
            "otherwise": "o_orderpriority",
        },
    ),
    keep("o_orderkey", "size"),
    sql="""select o_orderkey, case when o_totalprice > 250000 then 'large'
        else o_orderpriority end as size from orders""",
)
add(
    "step_if_then_else_defaults",
    "orders",
    ("if_then_else", {"into": "done", "condition": "nullif(o_orderstatus, 'P') = 'F'"}),
    keep("o_orderkey", "done"),
    sql="""select o_orderkey, case when nullif(o_orderstatus, 'P') = 'F' then true end as done
        from orders""",
)

# ------------------------------------------------------------------------------- filters

# Orders with NULLs and blank cells in them.
_HOLES = (
    formula("o_orderstatus", "nullif(o_orderstatus, 'P')"),
    formula("o_totalprice", "case when o_totalprice <= 400000 then o_totalprice end"),
    formula(
        "o_orderpriority",
        "case o_orderpriority when '5-LOW' then null when '2-HIGH' then '  ' "
        "else o_orderpriority end",
    ),
)
_HOLES_SQL = """with o as (select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as o_orderstatus,
    case when o_totalprice <= 400000 then o_totalprice end as o_totalprice, o_orderdate,
    case o_orderpriority when '5-LOW' then null when '2-HIGH' then '  '
    else o_orderpriority end as o_orderpriority from orders) """

# operator -> (column, settings, the predicate in SQL)
_OPERATORS = {
    "eq": ("o_orderstatus", {"value": "F"}, "o_orderstatus = 'F'"),
    "ne": ("o_orderstatus", {"value": "F"}, "o_orderstatus <> 'F'"),
    "gt": ("o_totalprice", {"value": "200000"}, "o_totalprice > 200000"),
    "gte": ("o_totalprice", {"value": 200000.5}, "o_totalprice >= 200000.5"),
    "lt": ("o_totalprice", {"value": "2e5"}, "o_totalprice < 200000"),
    "lte": ("o_orderdate", {"value": "1998-06-30"}, "o_orderdate <= timestamp '1998-06-30'"),
    "in": ("o_custkey", {"values": ["1", "2", 3]}, "o_custkey in (1, 2, 3)"),
    "not_in": ("o_orderstatus", {"values": ["F", "X"]}, "o_orderstatus not in ('F', 'X')"),
    "contains": ("o_orderpriority", {"value": "-"}, "contains(o_orderpriority, '-')"),
    "starts_with": ("o_orderpriority", {"value": "1"}, "starts_with(o_orderpriority, '1')"),
    "ends_with": ("o_orderpriority", {"value": "UM"}, "suffix(o_orderpriority, 'UM')"),
    "empty": ("o_orderpriority", {}, "(o_orderpriority is null or trim(o_orderpriority) = '')"),
    "not_empty": (
        "o_orderpriority",
        {},
        "(o_orderpriority is not null and trim(o_orderpriority) <> '')",
    ),
}
for _op, (_column, _values, _test) in _OPERATORS.items():
    _params = {"column": _column, "operator": _op, **_values}
    add(
        f"filter_{_op}_keep",
        "orders",
        *_HOLES,
        ("filter_value", {**_params, "action": "keep"}),
        sql=_HOLES_SQL + f"select * from o where {_test}",
    )
    add(
        f"filter_{_op}_remove",
        "orders",
        *_HOLES,
        ("filter_value", _params),
        sql=_HOLES_SQL + f"select * from o where coalesce(not ({_test}), true)",
    )
    add(
        f"filter_{_op}_clear",
        "orders",
        *_HOLES,
        ("filter_value", {**_params, "action": "clear"}),
        sql=_HOLES_SQL
        + f"select o.* replace (case when {_test} then null else {_column} end as {_column}) from o",
    )
for _action in ("keep", "remove"):
    _test = "o_totalprice > 100000 and o_orderstatus = 'O'"
    add(
        f"step_filter_formula_{_action}",
        "orders",
        *_HOLES,
        ("filter_formula", {"condition": _test, "action": _action}),
        sql=_HOLES_SQL
        + "select * from o where "
        + (_test if _action == "keep" else f"coalesce(not ({_test}), true)"),
    )
add(
    "step_remove_empty",
    "orders",
    *_HOLES,
    ("remove_empty", {"column": "o_orderpriority"}),
    sql=_HOLES_SQL
    + "select * from o where o_orderpriority is not null and trim(o_orderpriority) <> ''",
)
add(
    "filter_documents_contains",
    "documents",
    ("filter_value", {"column": "text", "operator": "contains", "value": "%", "action": "keep"}),
    sql="select * from documents where contains(text, '%')",
)
add(
    "filter_documents_contains_marks",
    "documents",
    ("filter_value", {"column": "text", "operator": "contains", "value": ".*", "action": "keep"}),
    sql="select * from documents where contains(text, '.*')",
)

# ------------------------------------------------------------------------------ cleaning

add(
    "step_fill_empty_text",
    "orders",
    *_HOLES,
    ("fill_empty", {"column": "o_orderpriority", "value": "unknown"}),
    sql=_HOLES_SQL
    + """select o.* replace (case when o_orderpriority is null or trim(o_orderpriority) = ''
    then 'unknown' else o_orderpriority end as o_orderpriority) from o""",
)
add(
    "step_fill_empty_number",
    "orders",
    *_HOLES,
    ("fill_empty", {"column": "o_totalprice", "value": "0"}),
    sql=_HOLES_SQL + "select o.* replace (coalesce(o_totalprice, 0) as o_totalprice) from o",
)
add(
    "step_find_replace",
    "documents",
    ("find_replace", {"column": "text", "find": "the", "replace": "[x.$1]"}),
    sql="select d.* replace (replace(text, 'the', '[x.$1]') as text) from documents d",
)
_TEXT_SQL = {
    "upper": "upper({})",
    "lower": "lower({})",
    "trim": "trim({})",
    "capitalize": "upper(substring({0}, 1, 1)) || lower(substring({0}, 2, length({0})))",
    "trim_lower": "lower(trim({}))",
}
for _mode, _expr in _TEXT_SQL.items():
    _raw = "p_name" if _mode == "capitalize" else "'  ' || p_name || ' ' || p_type || ' '"
    add(
        f"step_text_{_mode}",
        "part",
        formula("p_name", _raw),
        ("text_transform", {"column": "p_name", "mode": _mode}),
        keep("p_partkey", "p_name"),
        sql=f"select p_partkey, {_expr.format('(' + _raw + ')')} as p_name from part",
    )
# type -> (table, key, column, target in SQL)
_CASTS = {
    "varchar": ("orders", "o_orderkey", "o_custkey", "varchar"),
    "integer": ("lineitem", "l_orderkey", "l_quantity", "integer"),
    "bigint": ("part", "p_partkey", "p_size", "bigint"),
    "double": ("part", "p_partkey", "p_size", "double"),
    "decimal": ("lineitem", "l_orderkey", "l_extendedprice", "decimal(18,2)"),
    "date": ("orders", "o_orderkey", "o_orderdate", "date"),
    "boolean": ("labels", "doc_id", "toxic", "boolean"),
}
for _name, (_table, _key, _column, _target) in _CASTS.items():
    add(
        f"step_change_type_{_name}",
        _table,
        ("change_type", {"column": _column, "to": _target}),
        keep(_key, _column),
        sql=f"select {_key}, cast({_column} as {_target}) as {_column} from {_table}",
    )
add(
    "step_change_type_timestamp",
    "orders",
    ("change_type", {"column": "o_orderdate", "to": "varchar"}),
    ("change_type", {"column": "o_orderdate", "to": "timestamp"}),
    sql="select * from orders",
)
add(
    "step_round",
    "orders",
    ("round", {"column": "o_totalprice"}),
    sql="select o.* replace (round(o_totalprice, 0) as o_totalprice) from orders o",
)
add(
    "step_round_hundreds",
    "orders",
    ("round", {"column": "o_totalprice", "decimals": -2}),
    sql="select o.* replace (round(o_totalprice, -2) as o_totalprice) from orders o",
)

# --------------------------------------------------------------------------------- dates

add(
    "step_parse_date_format",
    "orders",
    formula(
        "o_orderdate",
        "case when o_orderstatus = 'P' then 'no date' else date_format(o_orderdate, 'd/M/yyyy') end",
    ),
    ("parse_date", {"column": "o_orderdate", "format": "%d/%m/%Y", "into": "parsed"}),
    keep("o_orderkey", "parsed"),
    sql="""select o_orderkey, case when o_orderstatus <> 'P' then o_orderdate end as parsed
        from orders""",
)
add(
    "step_parse_date_compact",
    "events",
    formula("ts", "date_format(ts, 'yyyyMMddHHmmss')"),
    ("parse_date", {"column": "ts", "format": "%Y%m%d%H%M%S"}),
    keep("event_id", "ts"),
    sql="select event_id, date_trunc('second', ts) as ts from events",
)
add(
    "step_parse_date_short_year",
    "orders",
    formula(
        "text",
        "concat(date_format(o_orderdate, 'EEE dd.MM.'),"
        " lpad(cast(pmod(o_orderkey, 100) as string), 2, '0'))",
    ),
    ("parse_date", {"column": "text", "format": "%a %d.%m.%y", "into": "parsed"}),
    keep("o_orderkey", "parsed"),
    sql="""select o_orderkey, try_strptime(strftime(o_orderdate, '%a %d.%m.')
        || lpad((o_orderkey % 100)::varchar, 2, '0'), '%a %d.%m.%y') as parsed from orders""",
)
add(
    "step_parse_date_offset",
    "events",
    formula(
        "text",
        "concat(date_format(ts, 'EEEE, yyyy-MM-dd HH:mm:ss'),"
        " case pmod(event_id, 3) when 0 then '+0530' when 1 then '-08' else ' UTC' end)",
    ),
    ("parse_date", {"column": "text", "format": "%A, %Y-%m-%d %H:%M:%S%z", "into": "at"}),
    keep("event_id", "at"),
    sql="""select event_id, date_trunc('second', ts) + case event_id % 3
        when 0 then -interval '330 minutes' when 1 then interval 8 hours end as at from events""",
)
add(
    "step_parse_date",
    "orders",
    formula(
        "text",
        "case when o_orderstatus = 'P' then 'no date' "
        "else substring(cast(o_orderdate as string), 1, 10) end",
    ),
    ("parse_date", {"column": "text"}),
    keep("o_orderkey", "text"),
    sql="""select o_orderkey, case when o_orderstatus <> 'P' then o_orderdate::date end as text
        from orders""",
)
add(
    "step_extract_date_parts",
    "orders",
    (
        "extract_date_parts",
        {"column": "o_orderdate", "parts": ["year", "month", "day", "quarter", "week", "dow"]},
    ),
    sql="""select *, extract(year from o_orderdate) as o_orderdate_year,
        extract(month from o_orderdate) as o_orderdate_month,
        extract(day from o_orderdate) as o_orderdate_day,
        extract(quarter from o_orderdate) as o_orderdate_quarter,
        extract(week from o_orderdate) as o_orderdate_week,
        extract(dow from o_orderdate) as o_orderdate_dow from orders""",
)

# ---------------------------------------------------------------------------------- rows

add(
    "step_distinct_rows",
    "lineitem",
    formula("l_returnflag", "nullif(l_returnflag, 'N')"),
    keep("l_returnflag", "l_linestatus", "l_shipdate"),
    ("distinct_rows", {}),
    sql="""select distinct nullif(l_returnflag, 'N') as l_returnflag, l_linestatus, l_shipdate
        from lineitem""",
)
add(
    "step_distinct_documents",
    "documents",
    keep("text", "lang"),
    ("distinct_rows", {}),
    sql="select distinct text, lang from documents",
)
for _way in ("asc", "desc"):
    add(
        f"step_sort_{_way}",
        "lineitem",
        keep("l_orderkey", "l_linenumber", "l_returnflag"),
        ("sort", {"column": "l_returnflag", "descending": _way == "desc"}),
        sql=f"""select l_orderkey, l_linenumber, l_returnflag from lineitem
        order by l_returnflag {_way} nulls last""",
    )
add(
    "step_dedup_one",
    "events",
    (
        "dedup_key",
        {
            "keys": ["user_id", "event_type"],
            "order_by": [{"column": "ts", "descending": True}, {"column": "event_id"}],
        },
    ),
    sql="""select * from events qualify row_number() over (partition by user_id, event_type
        order by ts desc nulls last, event_id asc nulls last) = 1""",
)
add(
    "step_dedup_nulls_last",
    "orders",
    formula("o_totalprice", "case when o_totalprice <= 300000 then o_totalprice end"),
    (
        "dedup_key",
        {
            "keys": ["o_custkey"],
            "order_by": [{"column": "o_totalprice", "descending": True}, {"column": "o_orderkey"}],
        },
    ),
    sql="""select o.* replace (case when o_totalprice <= 300000 then o_totalprice end
        as o_totalprice) from orders o qualify row_number() over (partition by o_custkey order by
        case when o_totalprice <= 300000 then o_totalprice end desc nulls last, o_orderkey) = 1""",
)
add(
    "step_dedup_all",
    "lineitem",
    (
        "dedup_key",
        {
            "keys": ["l_suppkey"],
            "order_by": [{"column": "l_quantity", "descending": True}],
            "ties": "all",
        },
    ),
    sql="""select * from lineitem qualify rank() over (partition by l_suppkey
        order by l_quantity desc nulls last) = 1""",
)
