"""The window functions, with and without partitions."""

from __future__ import annotations

from .common import Query, formula, keep, prepared

QUERIES: dict[str, Query] = {}

# Orders per customer by date; some prices are missing, and dates repeat. Amounts are whole
# numbers, whose sums are exact in any order.
_PRICE = "case when o_totalprice <= 400000 then round(o_totalprice) end"
_BY_DATE = [{"column": "o_orderdate", "descending": True}, {"column": "o_orderkey"}]
_OVER = "partition by o_custkey order by o_orderdate desc nulls last, o_orderkey asc nulls last"

# function -> (settings, the SQL)
_CALLS = {
    "row_number": ({"order_by": _BY_DATE}, f"row_number() over ({_OVER})"),
    "rank": (
        {"order_by": [{"column": "o_orderstatus"}]},
        "rank() over (partition by o_custkey order by o_orderstatus nulls last)",
    ),
    "dense_rank": (
        {"order_by": [{"column": "o_orderstatus", "descending": True}]},
        "dense_rank() over (partition by o_custkey order by o_orderstatus desc nulls last)",
    ),
    "lag": ({"order_by": _BY_DATE}, f"lag(price, 1) over ({_OVER})"),
    "lead": ({"order_by": _BY_DATE, "offset": 2}, f"lead(price, 2) over ({_OVER})"),
    "running_sum": (
        {"order_by": _BY_DATE},
        f"sum(price) over ({_OVER} rows between unbounded preceding and current row)",
    ),
    "moving_avg": (
        {"order_by": _BY_DATE, "window_rows": 4},
        f"avg(price) over ({_OVER} rows between 3 preceding and current row)",
    ),
    "sum": ({}, "sum(price) over (partition by o_custkey)"),
    "avg": ({}, "avg(price) over (partition by o_custkey)"),
    "min": ({}, "min(price) over (partition by o_custkey)"),
    "max": ({}, "max(price) over (partition by o_custkey)"),
    "count": ({}, "count(*) over (partition by o_custkey)"),
}
FUNCTIONS = tuple(_CALLS)
for _fn, (_settings, _expr) in _CALLS.items():
    QUERIES[f"window_{_fn}"] = Query(
        prepared(
            "orders",
            formula("price", _PRICE),
            (
                "window_function",
                {"fn": _fn, "column": "price", "partition_by": ["o_custkey"], "into": "w", **_settings},
            ),
            keep("o_orderkey", "w"),
        ),
        f"select o_orderkey, {_expr} as w "
        f"from (select *, {_PRICE} as price from orders) o",
    )

# One partition with a third of the rows or more: flags and types have very few values.
for _fn, _order in {
    "row_number": ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    "rank": ["l_shipdate"],
    "dense_rank": ["l_shipdate", "l_quantity"],
    "running_sum": ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
}.items():
    _terms = ", ".join(f"{c} asc nulls last" for c in _order)
    _call = "sum(l_quantity)" if _fn == "running_sum" else f"{_fn}()"
    _frame = " rows between unbounded preceding and current row" if _fn == "running_sum" else ""
    QUERIES[f"window_few_groups_{_fn}"] = Query(
        prepared(
            "lineitem",
            (
                "window_function",
                {
                    "fn": _fn,
                    "column": "l_quantity",
                    "partition_by": ["l_returnflag"],
                    "order_by": [{"column": c} for c in _order],
                    "into": "w",
                },
            ),
            keep("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "w"),
        ),
        f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_call} over (
        partition by l_returnflag order by {_terms}{_frame}) as w from lineitem""",
    )

# No partition at all: the whole table is one window.
_EVENT_ORDER = [{"column": "ts"}, {"column": "event_id"}]
_GLOBAL = {
    "row_number": ({"order_by": _EVENT_ORDER}, "row_number() over (order by ts, event_id)"),
    "lag": (
        {"order_by": _EVENT_ORDER, "offset": 3},
        "lag(value, 3) over (order by ts, event_id)",
    ),
    "running_sum": (
        {"order_by": _EVENT_ORDER},
        "sum(value) over (order by ts, event_id rows unbounded preceding)",
    ),
    "moving_avg": (
        {"order_by": _EVENT_ORDER, "window_rows": 7},
        "avg(value) over (order by ts, event_id rows between 6 preceding and current row)",
    ),
    "rank": ({"order_by": [{"column": "event_type"}]}, "rank() over (order by event_type)"),
    "max": ({}, "max(value) over ()"),
    "count": ({}, "count(*) over ()"),
}
WITHOUT_KEYS = tuple(_GLOBAL)
for _fn, (_settings, _expr) in _GLOBAL.items():
    QUERIES[f"window_global_{_fn}"] = Query(
        prepared(
            "events",
            formula("value", "round(value * 100)"),
            ("window_function", {"fn": _fn, "column": "value", "into": "w", **_settings}),
            keep("event_id", "w"),
        ),
        f"select event_id, {_expr} as w "
        "from (select * replace (round(value * 100) as value) from events) e",
    )
QUERIES["window_replaces_column"] = Query(
    prepared(
        "events",
        (
            "window_function",
            {
                "fn": "row_number",
                "partition_by": ["user_id"],
                "order_by": _EVENT_ORDER,
                "into": "props",
            },
        ),
    ),
    """select e.* replace (row_number() over (partition by user_id order by ts, event_id)
    as props) from events e""",
)
