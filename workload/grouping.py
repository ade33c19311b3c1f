"""Group, stack and SQL recipes, and recipes chained into one plan."""

from __future__ import annotations

from plumbline import run_recipe

from .common import Query, Tables, formula, keep, rounded, through

QUERIES: dict[str, Query] = {}


def measure(fn: str, column: str, alias: str, where: str = "") -> dict:
    return {"fn": fn, "column": column, "alias": alias, "filter": where}


def grouped(table: str, keys: list[str], measures: list[dict], before=(), after=()):
    def run(spark, folder):
        df = through(spark, Tables(spark, folder)[table], *before)
        spec = {
            "type": "group",
            "inputs": [{"ref": table}],
            "group_by": keys,
            "aggregations": measures,
        }
        return through(spark, run_recipe(spark, spec, {table: df}), *after)

    return run


_FNS = {
    "count": "count(l_quantity)",
    "count_distinct": "count(distinct l_quantity)",
    "sum": "sum(l_quantity)",
    "avg": "avg(l_quantity)",
    "min": "min(l_quantity)",
    "max": "max(l_quantity)",
    "median": "median(l_quantity)",
}
for _fn, _expr in _FNS.items():
    QUERIES[f"group_{_fn}"] = Query(
        grouped(
            "lineitem",
            ["l_returnflag", "l_suppkey"],
            [measure(_fn, "l_quantity", "m")],
            [formula("l_quantity", "nullif(l_quantity, 1)")],
        ),
        f"""select l_returnflag, l_suppkey, {_expr} as m
        from (select * replace (nullif(l_quantity, 1) as l_quantity) from lineitem) l
        group by l_returnflag, l_suppkey""",
    )
QUERIES["group_rows"] = Query(
    grouped(
        "events",
        ["event_type"],
        [measure("count", "*", "n"), measure("count_distinct", "user_id", "users")],
        [formula("event_type", "nullif(event_type, 'click')")],
    ),
    """select nullif(event_type, 'click') as event_type, count(*) as n,
    count(distinct user_id) as users from events group by 1""",
)
QUERIES["row_count"] = Query(
    grouped("lineitem", [], [measure("count", "*", "n")]),
    "select count(*) as n from lineitem",
)
QUERIES["group_filtered"] = Query(
    grouped(
        "lineitem",
        ["l_shipdate"],
        [
            measure("count", "*", "returned", "l_returnflag = 'R'"),
            measure("sum", "l_quantity", "open_quantity", "l_linestatus = 'O'"),
            measure("max", "l_extendedprice", "best_cheap", "l_discount > 0.05"),
            measure("count_distinct", "l_suppkey", "suppliers", "l_returnflag = 'A'"),
            measure("median", "l_quantity", "middle", "l_linestatus = 'F'"),
        ],
    ),
    """select l_shipdate, count(case when l_returnflag = 'R' then 1 end) as returned,
    sum(case when l_linestatus = 'O' then l_quantity end) as open_quantity,
    max(case when l_discount > 0.05 then l_extendedprice end) as best_cheap,
    count(distinct case when l_returnflag = 'A' then l_suppkey end) as suppliers,
    median(case when l_linestatus = 'F' then l_quantity end) as middle
    from lineitem group by l_shipdate""",
)
QUERIES["group_global"] = Query(
    grouped(
        "lineitem",
        [],
        [
            measure("count", "*", "n"),
            measure("sum", "l_quantity", "quantity"),
            measure("max", "l_shipdate", "last"),
            measure("median", "l_extendedprice", "middle"),
            measure("count_distinct", "l_partkey", "parts"),
        ],
    ),
    """select count(*) as n, sum(l_quantity) as quantity, max(l_shipdate) as last,
    median(l_extendedprice) as middle, count(distinct l_partkey) as parts from lineitem""",
)
QUERIES["group_median_few_groups"] = Query(
    grouped(
        "lineitem",
        ["l_returnflag", "l_linestatus"],
        [measure("median", "l_extendedprice", "middle"), measure("count", "*", "n")],
    ),
    """select l_returnflag, l_linestatus, median(l_extendedprice) as middle, count(*) as n
    from lineitem group by l_returnflag, l_linestatus""",
)
QUERIES["group_documents"] = Query(
    grouped(
        "documents",
        ["lang", "source"],
        [
            measure("count", "*", "n"),
            measure("sum", "n_chars", "chars"),
            measure("count_distinct", "text", "texts"),
            measure("avg", "n_chars", "mean"),
        ],
    ),
    """select lang, source, count(*) as n, cast(sum(n_chars) as bigint) as chars,
    count(distinct text) as texts, avg(n_chars) as mean
    from documents group by lang, source""",
)


def stacked(mode: str):
    def run(spark, folder):
        tables = Tables(spark, folder)
        datasets = {
            "customers": through(
                spark,
                tables["customer"],
                keep("c_custkey", "c_nationkey", "c_mktsegment"),
                ("rename", {"renames": [{"from": "c_nationkey", "to": "nation"}]}),
                ("rename", {"renames": [{"from": "c_custkey", "to": "id"}]}),
            ),
            "suppliers": through(
                spark,
                tables["supplier"],
                keep("s_nationkey", "s_acctbal", "s_suppkey"),
                ("rename", {"renames": [{"from": "s_nationkey", "to": "nation"}]}),
                ("rename", {"renames": [{"from": "s_suppkey", "to": "id"}]}),
            ),
        }
        if mode == "distinct":
            datasets = {n: through(spark, df, keep("nation")) for n, df in datasets.items()}
        spec = {"type": "stack", "mode": mode, "inputs": [{"ref": n} for n in datasets]}
        return run_recipe(spark, spec, datasets)

    return run


QUERIES["stack_all"] = Query(
    stacked("all"),
    """select c_custkey as id, c_nationkey as nation, c_mktsegment, null::double as s_acctbal
    from customer union all
    select s_suppkey, s_nationkey, null, s_acctbal from supplier""",
)
QUERIES["stack_distinct"] = Query(
    stacked("distinct"),
    "select c_nationkey as nation from customer union select s_nationkey from supplier",
)


def _sql_recipe(spark, folder):
    text = """select c_mktsegment, count(*) as n, cast(max(o_orderdate) as date) as last
        from {{ ref('orders') }} o join {c} on o_custkey = c_custkey
        where o_orderstatus <> 'P' group by c_mktsegment;"""
    spec = {
        "type": "sql",
        "inputs": [{"ref": "orders"}, {"ref": "customer", "alias": "c"}],
        "sql": text,
    }
    return run_recipe(spark, spec, Tables(spark, folder))


QUERIES["sql_recipe"] = Query(
    _sql_recipe,
    """select c_mktsegment, count(*) as n, cast(max(o_orderdate) as date) as last
    from orders join customer on o_custkey = c_custkey
    where o_orderstatus <> 'P' group by c_mktsegment""",
)


def revenue_by_segment(spark, folder):
    """Three chained recipes as one plan: join, then prepare, then group."""
    tables = Tables(spark, folder)
    joined = run_recipe(
        spark,
        {
            "type": "join",
            "inputs": [{"ref": "orders", "alias": "o"}, {"ref": "customer", "alias": "c"}],
            "joins": [{"type": "left", "on": [{"left": "o_custkey", "right": "c_custkey"}]}],
        },
        tables,
    )
    cleaned = through(
        spark,
        joined,
        ("filter_value", {"column": "o_orderstatus", "value": "P"}),
        ("extract_date_parts", {"column": "o_orderdate", "parts": ["year"]}),
    )
    spec = {
        "type": "group",
        "inputs": [{"ref": "cleaned"}],
        "group_by": ["c_mktsegment", "o_orderdate_year"],
        "aggregations": [
            measure("count", "*", "n"),
            measure("sum", "o_totalprice", "revenue"),
            measure("sum", "o_totalprice", "urgent", "o_orderpriority = '1-URGENT'"),
        ],
    }
    return through(
        spark, run_recipe(spark, spec, {"cleaned": cleaned}), rounded("revenue"), rounded("urgent")
    )


QUERIES["chained_recipes"] = Query(
    revenue_by_segment,
    """select c_mktsegment, extract(year from o_orderdate) as o_orderdate_year, count(*) as n,
    round(sum(o_totalprice), 2) as revenue,
    round(sum(case when o_orderpriority = '1-URGENT' then o_totalprice end), 2) as urgent
    from orders left join customer on o_custkey = c_custkey where o_orderstatus <> 'P'
    group by 1, 2""",
)
