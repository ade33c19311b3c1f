"""Outputs and incremental loads: several builds over growing data, then the table they left."""

from __future__ import annotations

from datetime import datetime

from plumbline import RecipeTable, build, load_arrivals, preview, read_csv
from plumbline.plans.recipe import PREVIEW_ROWS

from .common import Query, Tables, formula, keep, new_target, through

QUERIES: dict[str, Query] = {}


def recipe(kind: str = "prepare", inputs=("src",), steps=(), output=None, **more) -> dict:
    return {
        "name": "loaded",
        "type": kind,
        "inputs": [i if isinstance(i, dict) else {"ref": i} for i in inputs],
        "steps": [{"type": t, "params": p} for t, p in steps],
        "output": {"materialized": "incremental", **(output or {})},
        **more,
    }


def only(condition: str):
    return "filter_formula", {"condition": condition}


def loads(spec: dict, table: str, *versions: list, moments=None, refresh=False):
    """Builds ``spec`` once per version of the table: the steps that make its input."""

    def run(spark, folder):
        source, target = Tables(spark, folder)[table], new_target(spark)
        for n, steps in enumerate(versions):
            build(
                spark,
                spec,
                {"src": through(spark, source, *steps)},
                target,
                now=moments[n] if moments else None,
                full_refresh=refresh and n == len(versions) - 1,
            )
        return RecipeTable(spark, target).read()

    return run


# ------------------------------------------------------------------------------- outputs


def _table(spark, folder):
    spec = recipe(steps=[only("o_orderstatus = 'F'")], output={"materialized": "table"})
    return build(spark, spec, {"src": Tables(spark, folder)["orders"]}, new_target(spark))


def _view(spark, folder):
    spec = recipe(steps=[only("o_orderstatus = 'F'")], output={"materialized": "view"})
    build(spark, {**spec, "name": "finished"}, {"src": Tables(spark, folder)["orders"]})
    return spark.table("finished")


def _ephemeral(spark, folder):
    spec = recipe(steps=[only("o_orderstatus = 'F'")], output={"materialized": "ephemeral"})
    return build(spark, spec, {"src": Tables(spark, folder)["orders"]})


for _name, _run in {"table": _table, "view": _view, "ephemeral": _ephemeral}.items():
    QUERIES[f"output_{_name}"] = Query(_run, "select * from orders where o_orderstatus = 'F'")


def _preview(spark, folder):
    spec = recipe(
        steps=[("sort", {"column": "o_orderkey", "descending": True}), ("round", {"column": "x"})],
        output={"materialized": "view"},
    )
    return preview(spark, spec, {"src": Tables(spark, folder)["orders"]}, upto=1)


QUERIES["preview_partial"] = Query(
    _preview, f"select * from orders order by o_orderkey desc limit {PREVIEW_ROWS}"
)


def _seed(spark, folder):
    customers, where = Tables(spark, folder)["customer"], new_target(spark)
    customers.write.option("header", True).csv(where)
    return read_csv(spark, where, customers.schema)


QUERIES["seed_csv"] = Query(_seed, "select * from customer")

# ------------------------------------------------------------- bound, append, replacement

_EARLY = only("ts < timestamp_ntz '2024-01-11'")
_BY_EVENT = {"unique_key": ["event_id"]}
QUERIES["inc_append"] = Query(
    loads(
        recipe(output={"incremental_strategy": "append", "incremental": {"column": "ts"}}),
        "events",
        [only("ts < timestamp_ntz '2024-01-06'")],
        [_EARLY],
        [_EARLY],
        [],
    ),
    "select * from events",
)
QUERIES["inc_gte"] = Query(
    loads(
        recipe(output={**_BY_EVENT, "incremental": {"column": "day", "operator": "gte"}}),
        "events",
        # The last day of the first load is read again by the second, which completes it.
        [formula("day", "cast(ts as date)"), only("ts < timestamp_ntz '2024-01-11 12:00:00'")],
        [formula("day", "cast(ts as date)")],
    ),
    "select *, ts::date as day from events",
)
QUERIES["inc_lookback"] = Query(
    loads(
        recipe(
            output={**_BY_EVENT, "incremental": {"column": "ts", "lookback": {"n": 3, "unit": "day"}}}
        ),
        "events",
        [_EARLY, only("event_type <> 'error'")],
        [],
    ),
    """select * from events where event_type <> 'error' or ts > (select max(ts) from events
    where ts < '2024-01-11' and event_type <> 'error') - interval 3 day""",
)
QUERIES["inc_lookback_hours"] = Query(
    loads(
        recipe(
            output={
                **_BY_EVENT,
                "incremental_strategy": "merge",
                "incremental": {"column": "ts", "lookback": {"n": 36, "unit": "hour"}},
            }
        ),
        "events",
        [_EARLY, only("event_type <> 'error'")],
        [],
    ),
    """select * from events where event_type <> 'error' or ts > (select max(ts) from events
    where ts < '2024-01-11' and event_type <> 'error') - interval 36 hour""",
)

_OLD_ORDERS = only("o_orderdate < timestamp_ntz '1998-01-01'")
_BY_DATE = {"column": "o_orderdate"}
_REPLACED_SQL = """with fresh as (select * from orders where o_orderdate >
    (select max(o_orderdate) from orders where o_orderdate < '1998-01-01'))
    select * from fresh union all select * from orders where o_orderdate < '1998-01-01'
    and o_custkey not in (select o_custkey from fresh)"""
QUERIES["inc_delete_insert"] = Query(
    loads(
        recipe(output={"unique_key": ["o_custkey"], "incremental": _BY_DATE}),
        "orders",
        [_OLD_ORDERS],
        [],
    ),
    _REPLACED_SQL,
)
QUERIES["inc_delete_insert_partitioned"] = Query(
    loads(
        recipe(
            output={
                "unique_key": ["o_custkey"],
                "incremental": _BY_DATE,
                "partition_by": ["o_orderpriority"],
            }
        ),
        "orders",
        [_OLD_ORDERS],
        [],
    ),
    _REPLACED_SQL,
)
_LATEST = (
    "dedup_key",
    {
        "keys": ["o_custkey"],
        "order_by": [
            {"column": "o_orderdate", "descending": True},
            {"column": "o_orderkey", "descending": True},
        ],
    },
)
_LATEST_SQL = """select * from orders qualify row_number() over (partition by o_custkey
    order by o_orderdate desc, o_orderkey desc) = 1"""
for _strategy in ("merge", "delete+insert"):
    QUERIES[f"inc_{_strategy.replace('+', '_')}_latest_per_key"] = Query(
        loads(
            recipe(
                steps=[_LATEST],
                output={
                    "incremental_strategy": _strategy,
                    "unique_key": ["o_custkey"],
                    "incremental": _BY_DATE,
                },
            ),
            "orders",
            [only("o_orderdate < timestamp_ntz '1997-01-01'")],
            [_OLD_ORDERS],
            [],
        ),
        _LATEST_SQL,
    )
QUERIES["inc_full_refresh"] = Query(
    loads(
        recipe(output={"unique_key": ["o_custkey"], "incremental": _BY_DATE}),
        "orders",
        [_OLD_ORDERS],
        [only("o_orderstatus <> 'P'")],
        refresh=True,
    ),
    "select * from orders where o_orderstatus <> 'P'",
)

# -------------------------------------------------------------------- other recipe kinds

QUERIES["inc_group"] = Query(
    loads(
        recipe(
            "group",
            group_by=["o_custkey"],
            aggregations=[
                {"fn": "count", "column": "*", "alias": "n"},
                {"fn": "max", "column": "o_totalprice", "alias": "best"},
                {"fn": "max", "column": "o_orderdate", "alias": "o_orderdate"},
            ],
            output={"unique_key": ["o_custkey"], "incremental": _BY_DATE},
        ),
        "orders",
        [_OLD_ORDERS],
        [only("o_orderdate < timestamp_ntz '1999-01-01'")],
        [],
    ),
    """select o_custkey, count(*) as n, max(o_totalprice) as best,
    max(o_orderdate) as o_orderdate from orders group by o_custkey""",
)
_MERGEABLE = [
    {"fn": "count", "column": "*", "alias": "n"},
    {"fn": "count", "column": "o_orderpriority", "alias": "urgent",
     "filter": "o_orderpriority < '2'"},
    {"fn": "sum", "column": "o_custkey", "alias": "total"},
    {"fn": "avg", "column": "o_custkey", "alias": "mean"},
    {"fn": "min", "column": "o_totalprice", "alias": "cheapest"},
    {"fn": "max", "column": "o_orderdate", "alias": "o_orderdate"},
]
QUERIES["inc_group_append_only"] = Query(
    loads(
        recipe(
            "group",
            group_by=["o_orderstatus", "o_orderpriority"],
            aggregations=_MERGEABLE,
            output={
                "unique_key": ["o_orderstatus", "o_orderpriority"],
                "incremental": {**_BY_DATE, "append_only": True},
            },
        ),
        "orders",
        [only("o_orderdate < timestamp_ntz '1995-01-01'")],
        [_OLD_ORDERS],
        [],
    ),
    """select o_orderstatus, o_orderpriority, count(*) as n,
    count(case when o_orderpriority < '2' then o_orderpriority end) as urgent,
    sum(o_custkey)::bigint as total, avg(o_custkey) as mean, min(o_totalprice) as cheapest,
    max(o_orderdate) as o_orderdate from orders group by o_orderstatus, o_orderpriority""",
)
QUERIES["inc_group_two_keys"] = Query(
    loads(
        recipe(
            "group",
            group_by=["user_id", "event_type"],
            aggregations=[
                {"fn": "count_distinct", "column": "props", "alias": "kinds"},
                {"fn": "max", "column": "ts", "alias": "ts"},
            ],
            output={
                "unique_key": ["event_type", "user_id"],
                "incremental_strategy": "merge",
                "incremental": {"column": "ts"},
            },
        ),
        "events",
        [_EARLY],
        [],
    ),
    """select user_id, event_type, count(distinct props) as kinds, max(ts) as ts
    from events group by user_id, event_type""",
)
QUERIES["inc_pivot"] = Query(
    loads(
        recipe(
            steps=[
                (
                    "pivot",
                    {
                        "key_columns": ["user_id", "day"],
                        "name_column": "event_type",
                        "value_column": "value",
                        "values": ["click", "error"],
                        "aggregate": "max",
                    },
                )
            ],
            output={"unique_key": ["user_id", "day"], "incremental": {"column": "day"}},
        ),
        "events",
        [formula("day", "cast(ts as date)"), _EARLY],
        [formula("day", "cast(ts as date)")],
    ),
    """select user_id, ts::date as day, max(case when event_type = 'click' then value end)
    as click, max(case when event_type = 'error' then value end) as error
    from events group by user_id, ts::date""",
)


def _join(spark, folder):
    """Customers change between two loads: orders already written keep what they had."""
    tables, target = Tables(spark, folder), new_target(spark)
    spec = recipe(
        "join",
        ["o", "c"],
        joins=[{"type": "left", "on": [{"left": "o_custkey", "right": "c_custkey"}]}],
        select=[{"from": "o", "column": c} for c in ("o_orderkey", "o_custkey", "o_orderdate")]
        + [{"from": "c", "column": "c_mktsegment", "as": "segment"}],
        output={"incremental_strategy": "append", "incremental": _BY_DATE},
    )
    before = {
        "o": through(spark, tables["orders"], _OLD_ORDERS),
        "c": through(spark, tables["customer"], formula("c_mktsegment", "lower(c_mktsegment)")),
    }
    build(spark, spec, before, target)
    return build(spark, spec, {"o": tables["orders"], "c": tables["customer"]}, target)


QUERIES["inc_join"] = Query(
    _join,
    """select o_orderkey, o_custkey, o_orderdate, case when o_orderdate < '1998-01-01'
    then lower(c_mktsegment) else c_mktsegment end as segment
    from orders left join customer on o_custkey = c_custkey""",
)


def _stack(spark, folder):
    events, target = Tables(spark, folder)["events"], new_target(spark)
    spec = recipe(
        "stack",
        ["clicks", "others"],
        output={"incremental_strategy": "append", "incremental": {"column": "ts"}},
    )
    for steps in ([_EARLY], []):
        inputs = {
            "clicks": through(spark, events, only("event_type = 'click'"), *steps),
            "others": through(
                spark, events, only("event_type <> 'click'"), *steps, ("keep_delete", {"columns": ["props"]})
            ),
        }
        build(spark, spec, inputs, target)
    return RecipeTable(spark, target).read()


QUERIES["inc_stack"] = Query(
    _stack,
    """select event_id, ts, user_id, event_type, value,
    case when event_type = 'click' then props end as props from events
    where ts < '2024-01-11' or ts > (select max(ts) from events where ts < '2024-01-11')""",
)

# --------------------------------------------------------------------------- microbatch


def sliced(column: str, begin: str, size: str, lookback: int = 1) -> dict:
    return {
        "incremental_strategy": "microbatch",
        "microbatch": {
            "event_time": column,
            "begin": begin,
            "batch_size": size,
            "lookback": lookback,
        },
    }


_DOUBLED = formula("value", "value * 2")
_EVENTS_IN = ({"ref": "src", "event_time": "ts"},)
for _size, _last in {"hour": "2024-01-10 13:00:00", "day": "2024-01-11"}.items():
    QUERIES[f"inc_microbatch_{_size}"] = Query(
        loads(
            recipe(inputs=_EVENTS_IN, output=sliced("ts", "2024-01-03", _size)),
            "events",
            [],
            [_DOUBLED],
            moments=[datetime(2024, 1, 10, 12), datetime(2024, 2, 10)],
        ),
        # The last slice written, and the one before it, are computed again.
        f"""select event_id, ts, user_id, event_type, case when ts >= (select
        date_trunc('{_size}', max(ts)) - interval 1 {_size} from events where ts < '{_last}')
        then value * 2 else value end as value, props
        from events where ts >= '2024-01-03'""",
    )
_ORDERS_IN = ({"ref": "src", "event_time": "o_orderdate"},)
for _size, _cut in {"month": "1998-06-01", "year": "1998-01-01"}.items():
    QUERIES[f"inc_microbatch_{_size}"] = Query(
        loads(
            recipe(inputs=_ORDERS_IN, output=sliced("o_orderdate", "1996-01-01", _size, 0)),
            "orders",
            [],
            [formula("o_orderstatus", "lower(o_orderstatus)")],
            moments=[datetime(1998, 6, 15), datetime(2002, 1, 1)],
        ),
        f"""select o_orderkey, o_custkey, case when o_orderdate >= '{_cut}'
        then lower(o_orderstatus) else o_orderstatus end as o_orderstatus, o_totalprice,
        o_orderdate, o_orderpriority from orders where o_orderdate >= '1996-01-01'""",
    )
QUERIES["inc_microbatch_group"] = Query(
    loads(
        recipe(
            "group",
            inputs=_ORDERS_IN,
            group_by=["o_orderdate"],
            aggregations=[{"fn": "count", "column": "*", "alias": "n"}],
            output=sliced("o_orderdate", "1995-01-01", "month"),
        ),
        "orders",
        [only("o_orderstatus <> 'P'")],
        [],
        moments=[datetime(1998, 6, 15), datetime(2002, 1, 1)],
    ),
    """select o_orderdate, count(*) as n from orders
    where o_orderstatus <> 'P' or o_orderdate >= '1998-05-01' group by o_orderdate""",
)
QUERIES["inc_microbatch_emptied_slice"] = Query(
    loads(
        recipe(inputs=_ORDERS_IN, output=sliced("o_orderdate", "1995-01-01", "month")),
        "orders",
        [],
        [only("o_orderdate < timestamp_ntz '1998-06-01' or o_orderdate >= timestamp_ntz '1999-01-01'")],
        moments=[datetime(1998, 6, 15), datetime(2002, 1, 1)],
    ),
    """select * from orders where o_orderdate < '1998-06-01' or o_orderdate >= '1999-01-01'""",
)


def _sliced_join(*timed: str):
    """Orders with their lines by year, built twice: timed inputs match within a year only."""
    times = {"o": "o_orderdate", "l": "l_shipdate"}
    spec = recipe(
        "join",
        inputs=[
            {"ref": "orders", "alias": "o", **({"event_time": times["o"]} if "o" in timed else {})},
            {"ref": "lineitem", "alias": "l", **({"event_time": times["l"]} if "l" in timed else {})},
        ],
        joins=[{"type": "left", "on": [{"left": "o_orderkey", "right": "l_orderkey"}]}],
        select=[
            {"from": "o", "column": "o_orderkey"},
            {"from": "o", "column": "o_orderdate"},
            {"from": "l", "column": "l_linenumber"},
            {"from": "l", "column": "l_shipdate"},
        ],
        output=sliced("o_orderdate", "1996-01-01", "year"),
    )

    def run(spark, folder):
        tables, target = Tables(spark, folder), new_target(spark)
        for moment in (datetime(1999, 6, 15), datetime(2002, 1, 1)):
            build(spark, spec, tables, target, now=moment)
        return RecipeTable(spark, target).read()

    return run


_SAME_YEAR = "and date_trunc('year', o_orderdate) = date_trunc('year', l_shipdate)"
for _name, _timed, _same in (
    ("driver", "o", ""),
    ("dimension", "l", _SAME_YEAR),
    ("both", "ol", _SAME_YEAR),
):
    QUERIES[f"inc_microbatch_join_{_name}"] = Query(
        _sliced_join(*_timed),
        f"""select o_orderkey, o_orderdate, l_linenumber, l_shipdate from orders
        left join lineitem on o_orderkey = l_orderkey {_same}
        where o_orderdate >= '1996-01-01'""",
    )

_BY_MONTH = sliced("o_orderdate", "1998-01-01", "month")
_BY_MONTH["microbatch"]["concurrent_batches"] = True
QUERIES["inc_microbatch_sql_concurrent"] = Query(
    loads(
        recipe(
            "sql",
            inputs=({"ref": "src", "event_time": "o_orderdate"},),
            # The share of its month, so that a slice must see its own rows alone.
            sql="""select o_orderkey, o_orderdate, o_totalprice,
            count(*) over () as in_month from {src}""",
            output=_BY_MONTH,
        ),
        "orders",
        [],
        [only("o_orderstatus <> 'P'")],
        moments=[datetime(1998, 6, 15), datetime(1998, 12, 1)],
    ),
    # Written first up to June, then from May on without the pending orders.
    """with seen as (select * from orders where o_orderdate >= '1998-01-01' and o_orderdate < '1999-01-01' and
        (o_orderdate < '1998-05-01' or o_orderstatus <> 'P'))
    select o_orderkey, o_orderdate, o_totalprice,
    count(*) over (partition by date_trunc('month', o_orderdate)) as in_month from seen""",
)

# -------------------------------------------------------------------------- SQL and tests

QUERIES["inc_sql"] = Query(
    loads(
        recipe(
            "sql",
            sql="""select event_id, ts, user_id, value from {src}
            {% if is_incremental() %} where ts > (select max(ts) from {{ this }}) {% endif %}""",
            output={"incremental_strategy": "append"},
        ),
        "events",
        [only("ts < timestamp_ntz '2024-01-11'")],
        [_DOUBLED],
    ),
    """select event_id, ts, user_id, case when ts > (select max(ts) from events
    where ts < '2024-01-11') then value * 2 else value end as value from events""",
)


def _build_with_tests(spark, folder):
    spec = recipe(
        output={
            "materialized": "table",
            "columns": [
                {"name": "o_orderkey", "tests": ["not_null", "unique"]},
                {
                    "name": "o_orderstatus",
                    "tests": [{"name": "accepted_values", "values": ["F"], "severity": "warn"}],
                },
            ],
        }
    )
    return build(spark, spec, {"src": Tables(spark, folder)["orders"]}, new_target(spark))


QUERIES["build_with_tests"] = Query(_build_with_tests, "select * from orders")

# ------------------------------------------------------------------------ schema changes

_NARROW = keep("event_id", "ts", "user_id", "value")
_CHANGED = ("keep_delete", {"columns": ["value"]})
_LATE_SQL = "ts >= '2024-01-11'"
for _policy, _sql in {
    "append_new_columns": f"""select event_id, ts, user_id, case when not {_LATE_SQL} then value
        end as value, case when {_LATE_SQL} then event_type end as event_type,
        case when {_LATE_SQL} then props end as props from events""",
    "sync_all_columns": f"""select event_id, ts, user_id, case when {_LATE_SQL} then event_type end
        as event_type, case when {_LATE_SQL} then props end as props from events""",
}.items():
    for _strategy in ("append", "delete+insert"):
        QUERIES[f"inc_schema_{_policy.split('_')[0]}_{_strategy.replace('+', '_')}"] = Query(
            loads(
                recipe(
                    output={
                        **_BY_EVENT,
                        "incremental_strategy": _strategy,
                        "incremental": {"column": "ts"},
                        "on_schema_change": _policy,
                    }
                ),
                "events",
                [_EARLY, _NARROW],
                [_CHANGED],
            ),
            _sql,
        )
QUERIES["inc_schema_ignore"] = Query(
    loads(
        recipe(
            output={
                "incremental_strategy": "append",
                "incremental": {"column": "ts"},
                "on_schema_change": "ignore",
            }
        ),
        "events",
        [_EARLY, _NARROW],
        [],
    ),
    "select event_id, ts, user_id, value from events",
)
QUERIES["inc_merge_keeps_missing_columns"] = Query(
    loads(
        recipe(
            output={
                "unique_key": ["o_orderkey"],
                "incremental_strategy": "merge",
                "incremental": {"column": "o_totalprice", "operator": "gte"},
            }
        ),
        "orders",
        [only("o_orderstatus <> 'P'")],
        # The dearest order comes again, without its priority and with another status.
        [("keep_delete", {"columns": ["o_orderpriority"]}), formula("o_orderstatus", "'X'")],
    ),
    """with top as (select max(o_totalprice) as p from orders where o_orderstatus <> 'P')
    select o_orderkey, o_custkey, case when o_totalprice >= p then 'X' else o_orderstatus
    end as o_orderstatus, o_totalprice, o_orderdate,
    case when o_orderstatus <> 'P' then o_orderpriority end as o_orderpriority
    from orders, top where o_orderstatus <> 'P' or o_totalprice >= p""",
)

# ------------------------------------------------------------------------------- stream


def _stream(spark, folder):
    """Orders arrive in two deliveries; the second one corrects a part of the first."""
    orders = Tables(spark, folder)["orders"]
    landing, target, state = (new_target(spark) for _ in range(3))
    spec = recipe(
        steps=[("text_transform", {"column": "o_orderpriority", "mode": "lower"})],
        output={"unique_key": ["o_orderkey"]},
    )
    wrong = formula("o_orderstatus", "'?'")
    deliveries = ([_OLD_ORDERS, wrong], [only("o_orderdate >= timestamp_ntz '1997-01-01'")])
    for steps in deliveries:
        through(spark, orders, *steps).write.mode("append").parquet(landing)
        load_arrivals(spark, spec, landing, orders.schema, target, state)
    return RecipeTable(spark, target).read()


QUERIES["stream_delete_insert"] = Query(
    _stream,
    """select o.* replace (lower(o_orderpriority) as o_orderpriority,
    case when o_orderdate < '1997-01-01' then '?' else o_orderstatus end as o_orderstatus)
    from orders o""",
)


def _append_stream(spark, folder):
    """Events arrive in two deliveries, each row once."""
    events = Tables(spark, folder)["events"]
    landing, target, state = (new_target(spark) for _ in range(3))
    spec = recipe(
        steps=[("text_transform", {"column": "event_type", "mode": "upper"})],
        output={"incremental_strategy": "append"},
    )
    for steps in ([_EARLY], [only("ts >= timestamp_ntz '2024-01-11'")]):
        through(spark, events, *steps).coalesce(1).write.mode("append").parquet(landing)
        load_arrivals(spark, spec, landing, events.schema, target, state)
    return RecipeTable(spark, target).read()


QUERIES["stream_append"] = Query(
    _append_stream, "select * replace (upper(event_type) as event_type) from events"
)
