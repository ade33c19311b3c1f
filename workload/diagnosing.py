"""Data tests, freshness, profiles and join diagnoses."""

from __future__ import annotations

from datetime import datetime

from plumbline import (
    diagnose_join,
    failing_rows,
    freshness,
    full_profile,
    join_findings,
    profile_of_change,
    quality_profile,
    run_tests,
    sample_failing_rows,
)

from .common import Query, Tables, formula, through

QUERIES: dict[str, Query] = {}

# ---------------------------------------------------------------------------- data tests


def failing(table: str, test: dict, *steps):
    def run(spark, folder):
        tables = Tables(spark, folder)
        return failing_rows(through(spark, tables[table], *steps), test, tables)

    return run


QUERIES["test_not_null"] = Query(
    failing(
        "orders",
        {"name": "not_null", "column": "o_orderpriority"},
        formula("o_orderpriority", "nullif(o_orderpriority, '5-LOW')"),
    ),
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
    null::varchar as o_orderpriority from orders where o_orderpriority = '5-LOW'""",
)
QUERIES["test_unique"] = Query(
    failing("lineitem", {"name": "unique", "column": "l_extendedprice"}),
    """select l_extendedprice as unique_field, count(*) as n_records from lineitem
    where l_extendedprice is not null group by 1 having count(*) > 1""",
)
QUERIES["test_accepted_values"] = Query(
    failing(
        "customer",
        {"name": "accepted_values", "column": "c_mktsegment", "values": ["BUILDING", "MACHINERY"]},
    ),
    """select c_mktsegment as value_field, count(*) as n_records from customer
    where c_mktsegment not in ('BUILDING', 'MACHINERY') group by 1""",
)
QUERIES["test_failing_sample"] = Query(
    lambda spark, folder: sample_failing_rows(
        Tables(spark, folder)["events"],
        {"name": "accepted_values", "column": "event_type", "values": ["click"]},
        limit=200,
    ),
    """select event_type as value_field, count(*) as n_records from events
    where event_type <> 'click' group by 1""",
)
QUERIES["test_relationships"] = Query(
    failing("documents", {"name": "relationships", "column": "doc_id", "to": "labels", "field": "doc_id"}),
    """select doc_id as from_field from documents
    where doc_id is not null and doc_id not in (select doc_id from labels)""",
)


def _suite(spark, folder):
    tables = Tables(spark, folder)
    tests = [
        {"name": "not_null", "column": "doc_id"},
        {"name": "not_null", "column": "lang"},
        {"name": "unique", "column": "doc_id"},
        {"name": "unique", "column": "text", "severity": "warn"},
        {"name": "accepted_values", "column": "lang", "values": ["en", "fr"]},
        {"name": "relationships", "column": "doc_id", "to": "labels", "field": "doc_id"},
    ]
    return run_tests(tables["documents"], tests, tables)


QUERIES["test_suite"] = Query(
    _suite,
    """with r as (
    select 'not_null' as test, 'doc_id' as "column", 'error' as severity,
        count(*) filter (doc_id is null) as failures from documents union all
    select 'not_null', 'lang', 'error', count(*) filter (lang is null) from documents union all
    select 'unique', 'doc_id', 'error', count(*) from (select doc_id from documents
        where doc_id is not null group by 1 having count(*) > 1) union all
    select 'unique', 'text', 'warn', count(*) from (select text from documents
        where text is not null group by 1 having count(*) > 1) union all
    select 'accepted_values', 'lang', 'error', count(distinct lang) from documents
        where lang not in ('en', 'fr') union all
    select 'relationships', 'doc_id', 'error', count(*) from documents
        where doc_id not in (select doc_id from labels))
    select *, case when failures = 0 then 'pass' when severity = 'warn' then 'warn'
    else 'fail' end as status from r""",
)

# ---------------------------------------------------------------------------- freshness


def _freshness(settings: dict):
    now = datetime(2024, 2, 1)
    return lambda spark, folder: freshness(Tables(spark, folder)["events"], settings, now)


for _name, _field, _warn, _error, _status in (
    ("column", "ts", {"count": 36, "period": "hour"}, {"count": 10, "period": "day"}, "pass"),
    ("expression", "cast(cast(ts as date) as timestamp_ntz)", {"count": 60, "period": "minute"}, None, "warn"),
    ("late", "ts", None, {"count": 3, "period": "hour"}, "error"),
):
    _newest = "max(ts)" if _field == "ts" else "date_trunc('day', max(ts))"
    QUERIES[f"freshness_{_name}"] = Query(
        _freshness({"loaded_at_field": _field, "warn_after": _warn, "error_after": _error}),
        f"""select {_newest}::timestamp as max_loaded_at, timestamp '2024-02-01' as snapshotted_at,
        cast((epoch_us(timestamp '2024-02-01') - epoch_us({_newest}::timestamp)) // 1000000 as bigint)
        as age_seconds, '{_status}' as status from events""",
    )

# ----------------------------------------------------------------------------- profiles

# Storage of a column -> the meaning its type gives it.
_MEANING = {"int": "integer", "bigint": "integer", "double": "decimal", "date": "datetime"}


def _quality_sql(relation: str, columns: dict[str, str]) -> str:
    """The counts of every column, and for text the meaning they add up to."""
    parts = []
    for i, (name, storage) in enumerate(columns.items()):
        text = f"trim({name}::varchar, ' ' || chr(9) || chr(10) || chr(13))"
        tests = {
            "email": rf"regexp_matches(v, '(?i)^[^@\s]+@[^@\s]+\.[a-z]{{2,}}$')",
            "url": r"regexp_matches(v, '(?i)^https?://\S+$')",
            "ip": r"regexp_matches(v, '^\d+(\.\d+){3}$')",
            "date": r"(regexp_matches(v, '^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}.*)?$') "
            "and try_cast(v as timestamp) is not null)",
            "country": "regexp_matches(v, '^[A-Z]{2}$')",
            "integer": r"regexp_matches(v, '^-?\d+$')",
            "decimal": r"regexp_matches(v, '^-?\d*[.,]?\d+([eE][-+]?\d+)?$')",
            "boolean": "lower(v) in ('true','false','0','1','yes','no','oui','non','t','f')",
        }
        counts = ", ".join(f"count(*) filter ({t}) as h_{m}" for m, t in tests.items())
        majority = " ".join(
            f"when h_{m} >= 0.9 * filled then '{m}'" for m in list(tests)[:5]
        ) + " ".join(f" when h_{m} = filled then '{m}'" for m in list(tests)[5:])
        typed = _MEANING.get(storage)
        meaning = f"'{typed}'" if typed else f"case when filled = 0 then 'text' {majority} else 'text' end"
        valid = " ".join(f"when '{m}' then h_{m}" for m in tests)
        ok = "filled" if storage == "date" else f"case {meaning} {valid} else filled end"
        parts.append(
            f"""select {i} as position, '{name}' as "column", '{storage}' as storage,
            {meaning} as meaning, {ok} as n_ok, n, filled from (select count(*) as n,
            count(v) as filled, {counts} from (select nullif({text}, '') as v from {relation}))"""
        )
    return f"""select position, "column", storage, meaning, n_ok, n - filled as n_empty,
        filled - n_ok as n_nok, round_even(100.0::double * n_ok / n, 1) as ok,
        round_even(100.0::double * (n - filled) / n, 1) as "empty",
        round_even(100.0::double * (filled - n_ok) / n, 1) as nok
        from ({' union all '.join(parts)})"""


def quality(table: str, *steps):
    return lambda spark, folder: quality_profile(through(spark, Tables(spark, folder)[table], *steps))


_COLUMNS = {
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "documents": {
        "doc_id": "bigint",
        "text": "string",
        "lang": "string",
        "source": "string",
        "n_chars": "bigint",
    },
    "orders": {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "date",
        "o_orderpriority": "string",
    },
}
for _table, _columns in _COLUMNS.items():
    QUERIES[f"profile_quality_{_table}"] = Query(quality(_table), _quality_sql(_table, _columns))
# Text whose meaning has to be found: numbers, dates, codes and mails written as text.
_WRITTEN = {
    "as_int": ("cast(c_custkey as string)", "c_custkey::varchar"),
    "as_decimal": ("cast(c_acctbal as string)", "c_acctbal::varchar"),
    "as_date": (
        "concat('2024-02-', lpad(cast(c_nationkey + 1 as string), 2, '0'), ' 10:30')",
        "'2024-02-' || lpad((c_nationkey + 1)::varchar, 2, '0') || ' 10:30'",
    ),
    "as_mail": (
        "case when c_nationkey = 3 then c_name else concat('c', cast(c_custkey as string), '@mail.org') end",
        "case when c_nationkey = 3 then c_name else 'c' || c_custkey || '@mail.org' end",
    ),
    "as_code": ("substring(c_mktsegment, 1, 2)", "substring(c_mktsegment, 1, 2)"),
    "as_flag": (
        "case when c_nationkey < 9 then 'Oui' when c_nationkey < 20 then 'non' end",
        "case when c_nationkey < 9 then 'Oui' when c_nationkey < 20 then 'non' end",
    ),
    "as_address": (
        "concat('10.0.', cast(c_nationkey as string), '.1')",
        "'10.0.' || c_nationkey || '.1'",
    ),
}
QUERIES["profile_quality_written_values"] = Query(
    quality(
        "customer",
        *[formula(n, spark_sql) for n, (spark_sql, _) in _WRITTEN.items()],
        ("keep_delete", {"columns": list(_WRITTEN), "action": "keep"}),
    ),
    _quality_sql(
        "(select " + ", ".join(f"{e} as {n}" for n, (_, e) in _WRITTEN.items()) + " from customer)",
        dict.fromkeys(_WRITTEN, "string"),
    ),
)


def _full_sql(relation: str, columns: dict[str, str]) -> str:
    parts = []
    for i, (name, storage) in enumerate(columns.items()):
        filled = f"trim({name}) <> ''" if storage == "string" else f"{name} is not null"
        parts.append(
            f"""select {i} as position, '{name}' as "column", count(*) as total,
            count(*) filter ({filled}) as filled, count(*) - count(*) filter ({filled}) as "empty",
            count(distinct {name}) as "distinct", min({name})::varchar as "min",
            max({name})::varchar as "max" from {relation}"""
        )
    return " union all ".join(parts)


_COLUMNS["lineitem"] = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "date",
}
for _table in ("orders", "lineitem", "documents"):
    QUERIES[f"profile_full_{_table}"] = Query(
        lambda spark, folder, t=_table: full_profile(Tables(spark, folder)[t]),
        _full_sql(_table, _COLUMNS[_table]),
    )


def changed(table: str, *steps):
    def run(spark, folder):
        before = Tables(spark, folder)[table]
        return profile_of_change(before, through(spark, before, *steps))

    return run


QUERIES["profile_delta_rows"] = Query(
    changed("orders", ("filter_value", {"column": "o_orderstatus", "value": "P"})),
    """select 'rows_removed' as kind, null::varchar as "column", count(*) as before,
    count(*) filter (o_orderstatus <> 'P') as after,
    round_even(100.0::double * count(*) filter (o_orderstatus = 'P') / count(*), 1) as pct
    from orders""",
)
QUERIES["profile_delta_emptied"] = Query(
    changed(
        "orders",
        ("filter_value", {"column": "o_orderstatus", "value": "F", "action": "clear"}),
        formula("o_totalprice", "case when o_totalprice <= 400000 then o_totalprice end"),
    ),
    """select 'emptied' as kind, 'o_orderstatus' as "column", 0::bigint as before,
    count(*) filter (o_orderstatus = 'F') as after, null::double as pct from orders union all
    select 'emptied', 'o_totalprice', 0, count(*) filter (o_totalprice > 400000), null
    from orders""",
)

# ------------------------------------------------------------------------ join diagnosis


def diagnosed(inputs: dict[str, str], joins: list[dict], made=None, findings: bool = False):
    def run(spark, folder):
        tables = Tables(spark, folder)
        datasets = {
            a: through(spark, tables[t], *(made or {}).get(a, [])) for a, t in inputs.items()
        }
        spec = {"type": "join", "inputs": [{"ref": a} for a in inputs], "joins": joins}
        if not findings:
            return diagnose_join(spark, spec, datasets)
        found = join_findings(spark, spec, datasets)
        rows = [(f["level"], f["kind"], f["alias"], f["n"]) for f in found]
        return spark.createDataFrame(rows, "level string, kind string, alias string, n bigint")

    return run


def on(left: str, right: str, kind: str = "left") -> dict:
    return {"type": kind, "on": [{"left": left, "right": right}]}


def _side_sql(n: int, alias: str, kind: str, driver: str, left: str, joined: str, right: str) -> str:
    return f"""select {n} as position, '{alias}' as alias, '{kind}' as type,
        '{left} = {right}' as keys, (select count(*) from {joined}) as joined_rows,
        (select count(distinct {left}) from {driver}) as driver_keys,
        (select coalesce(max(c), 0) from (select count(*) as c from {driver}
            where {left} is not null group by {left})) as driver_max,
        (select count(*) from {driver} where {left} is null) as driver_nulls,
        (select count(distinct {right}) from {joined}) as joined_keys,
        (select coalesce(max(c), 0) from (select count(*) as c from {joined}
            where {right} is not null group by {right})) as joined_max,
        (select count(*) from {joined} where {right} is null) as joined_nulls,
        (select count(*) from {driver} a where not exists
            (select 1 from {joined} b where a.{left} = b.{right})) as driver_orphans,
        (select count(*) from {joined} b where not exists
            (select 1 from {driver} a where a.{left} = b.{right})) as joined_orphans"""


def _diagnosis_sql(driver: str, result: str, *sides: str) -> str:
    return f"""select (select count(*) from {driver}) as driver_rows,
        (select count(*) from {result}) as output_rows, s.* from ({' union all '.join(sides)}) s"""


_MADE = {
    "o": [formula("o_custkey", "case when o_totalprice > 50000 then o_custkey end")],
    "c": [("filter_formula", {"condition": "c_acctbal > 0"})],
}
_O = """(select * replace (case when o_totalprice > 50000 then o_custkey end as o_custkey)
    from orders)"""
_C = "(select * from customer where c_acctbal > 0)"
for _kind in ("inner", "left", "right", "full"):
    QUERIES[f"join_diagnosis_{_kind}"] = Query(
        diagnosed({"o": "orders", "c": "customer"}, [on("o_custkey", "c_custkey", _kind)], _MADE),
        _diagnosis_sql(
            _O,
            f"{_O} o {_kind} join {_C} c on o.o_custkey = c.c_custkey",
            _side_sql(1, "c", _kind, _O, "o_custkey", _C, "c_custkey"),
        ),
    )
QUERIES["join_diagnosis_fan_out"] = Query(
    diagnosed({"o": "orders", "l": "lineitem"}, [on("o_orderkey", "l_orderkey")]),
    _diagnosis_sql(
        "orders",
        "orders left join lineitem on o_orderkey = l_orderkey",
        _side_sql(1, "l", "left", "orders", "o_orderkey", "lineitem", "l_orderkey"),
    ),
)
QUERIES["join_diagnosis_many_to_many"] = Query(
    diagnosed({"c": "customer", "s": "supplier"}, [on("c_nationkey", "s_nationkey", "inner")]),
    _diagnosis_sql(
        "customer",
        "customer join supplier on c_nationkey = s_nationkey",
        _side_sql(1, "s", "inner", "customer", "c_nationkey", "supplier", "s_nationkey"),
    ),
)
QUERIES["join_diagnosis_chain"] = Query(
    diagnosed(
        {"c": "customer", "s": "supplier", "o": "orders"},
        [on("c_nationkey", "s_nationkey", "left"), on("c_custkey", "o_custkey", "full")],
        {"o": _MADE["o"], "c": _MADE["c"]},
    ),
    _diagnosis_sql(
        _C,
        f"""{_C} c left join supplier s on c.c_nationkey = s.s_nationkey
        full join {_O} o on c.c_custkey = o.o_custkey""",
        _side_sql(1, "s", "left", _C, "c_nationkey", "supplier", "s_nationkey"),
        _side_sql(2, "o", "full", _C, "c_custkey", _O, "o_custkey"),
    ),
)
QUERIES["join_findings"] = Query(
    diagnosed(
        {"o": "orders", "l": "lineitem"},
        [on("o_orderkey", "l_orderkey", "inner")],
        {"o": [formula("o_orderkey", "case when o_totalprice <= 400000 then o_orderkey end")]},
        findings=True,
    ),
    f"""with o as (select case when o_totalprice <= 400000 then o_orderkey end as k from orders),
    m as ({_side_sql(1, 'l', 'inner', 'o', 'k', 'lineitem', 'l_orderkey')}),
    t as (select (select count(*) from o) as a,
        (select count(*) from o join lineitem on k = l_orderkey) as b)
    select case when b > a then 'bad' when b < a then 'warn' else 'ok' end as level,
        case when b > a then 'fan_out' when b < a then 'lost' else 'same' end as kind,
        'o' as alias, b as n from t union all
    select case when joined_max <= 1 then 'ok' else 'bad' end,
        case when joined_max <= 1 then case when driver_max <= 1 then '1-1' else 'N-1' end
        when driver_max <= 1 then '1-N' else 'N-N' end, 'l', joined_max from m union all
    select 'bad', 'orphans_dropped', 'o', driver_orphans from m where driver_orphans > 0 union all
    select 'bad', 'orphans_dropped', 'l', joined_orphans from m where joined_orphans > 0 union all
    select 'warn', 'null_keys', 'o', driver_nulls from m where driver_nulls > 0 union all
    select 'warn', 'null_keys', 'l', joined_nulls from m where joined_nulls > 0""",
)
