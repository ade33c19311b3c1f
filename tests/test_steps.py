from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plumbline import RecipeError, preview, run_recipe
from plumbline.operators.steps import pivot_column
from tests.conftest import PARCELS
from tests.helpers import column, rows, steps


def test_no_step_copies_the_input(spark, parcels):
    assert rows(steps(spark, parcels)) == rows(parcels)


def test_rename_swaps(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    out = steps(
        spark, df, ("rename", {"renames": [{"from": "a", "to": "b"}, {"from": "b", "to": "a"}]})
    )
    assert out.columns == ["b", "a"] and rows(out) == [(1, 2)]


@pytest.mark.parametrize("named", [["sent"], ["country", "hub"], ["weight", "parcel_id", "state"]])
def test_keep_and_delete_share_the_columns_out(spark, parcels, named):
    kept = steps(spark, parcels, ("keep_delete", {"columns": named, "action": "keep"})).columns
    left = steps(spark, parcels, ("keep_delete", {"columns": named})).columns
    assert kept == [c for c in parcels.columns if c in named]
    assert left == [c for c in parcels.columns if c not in named]


@pytest.mark.parametrize("separator", ["/", "", " + "])
def test_concat_keeps_separator_of_null(spark, parcels, separator):
    settings = {"columns": ["country", "hub", "state"], "into": "where", "separator": separator}
    out = steps(spark, parcels, ("concat_columns", settings)).collect()
    for r in out:
        pieces = ["" if r[c] is None else str(r[c]) for c in settings["columns"]]
        assert r["where"] == separator.join(pieces)


def test_split(spark):
    paths = ["berth/7/b", "berth", "/quay", ""]
    frame = spark.createDataFrame([(p,) for p in paths], "place string")
    found = steps(spark, frame, ("split_column", {"column": "place", "separator": "/", "count": 4}))
    assert found.columns == ["place", *(f"place_{n}" for n in range(1, 5))]
    for whole, *pieces in found.collect():
        assert pieces == (whole.split("/") + [""] * 4)[:4]
    two = steps(spark, frame.replace("/", ","), ("split_column", {"column": "place"}))
    assert two.columns == ["place", "place_1", "place_2"]
    dotted = spark.createDataFrame([("a.b.c",)], "x string")
    out = steps(spark, dotted, ("split_column", {"column": "x", "separator": ".", "count": 3}))
    assert rows(out) == [("a.b.c", "a", "b", "c")]


def test_formula_creates_and_replaces(spark, parcels):
    made = steps(spark, parcels, ("formula", {"into": "grams", "expression": "weight * 1000"}))
    assert made.columns == [*parcels.columns, "grams"]
    assert all(r["grams"] == (r["weight"] and r["weight"] * 1000) for r in made.collect())
    over = steps(spark, parcels, ("formula", {"into": "weight", "expression": "-weight;"}))
    assert over.columns == parcels.columns
    assert column(over, "weight") == column(parcels.selectExpr("-weight as weight"), "weight")


def test_if_then_else_treats_unknown_as_no(spark, parcels):
    params = {"into": "heavy", "condition": "weight >= 12.5", "then": "hub", "otherwise": "0"}
    out = steps(spark, parcels, ("if_then_else", params)).select("parcel_id", "heavy")
    assert rows(out) == [(11, 0), (12, 5), (12, 5), (13, 0), (7, 0), (8, 5), (9, 0)]


# What a filter asks of a column, and the same asked of a value that is not null.
FILTERS = [
    ("state", {"operator": "eq", "value": "sent"}, lambda v: v == "sent"),
    ("state", {"operator": "ne", "value": "sent"}, lambda v: v != "sent"),
    ("state", {"operator": "in", "values": ["lost", "Sent", "held"]}, lambda v: v in ("lost", "Sent")),
    ("state", {"operator": "not_in", "values": ["lost", "sent"]}, lambda v: v not in ("lost", "sent")),
    ("state", {"operator": "contains", "value": "n t"}, lambda v: "n t" in v),
    ("state", {"operator": "starts_with", "value": "s"}, lambda v: v.startswith("s")),
    ("state", {"operator": "ends_with", "value": "t"}, lambda v: v.endswith("t")),
    ("weight", {"operator": "gt", "value": "2"}, lambda v: v > 2),
    ("weight", {"operator": "gte", "value": 2}, lambda v: v >= 2),
    ("weight", {"operator": "lt", "value": "12.5"}, lambda v: v < 12.5),
    ("hub", {"operator": "lte", "value": "5"}, lambda v: v <= 5),
    ("country", {"operator": "not_empty"}, lambda v: v.strip() != ""),
]


@pytest.mark.parametrize("name, asked, holds", FILTERS)
def test_filters_split_the_rows(spark, parcels, name, asked, holds):
    params = {"column": name, **asked}
    yes = [r for r in map(tuple, PARCELS) if (v := r[parcels.columns.index(name)]) is not None and holds(v)]
    no = [r for r in PARCELS if r not in yes]
    assert yes and no
    assert rows(steps(spark, parcels, ("filter_value", {**params, "action": "keep"}))) == sorted(yes, key=repr)
    # Removing keeps every other row, the ones with an unknown answer included.
    assert rows(steps(spark, parcels, ("filter_value", params))) == sorted(no, key=repr)


def test_empty_is_the_opposite_of_not_empty(spark, parcels):
    for name in ("state", "weight", "country"):
        params = {"column": name, "action": "keep"}
        empty = steps(spark, parcels, ("filter_value", {**params, "operator": "empty"}))
        filled = steps(spark, parcels, ("filter_value", {**params, "operator": "not_empty"}))
        assert rows(empty.union(filled)) == rows(parcels) and 0 < empty.count() < 7


def test_removing_reaches_the_scan(spark, parcels, tmp_path):
    where = str(tmp_path / "parcels")
    parcels.write.parquet(where)
    out = steps(spark, spark.read.parquet(where), ("filter_value", {"column": "country", "value": "PT"}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(Not(EqualTo(country,PT)),IsNull(country))]" in plan
    assert column(out, "parcel_id") == [11, 12, 12, 13, 8]


def test_filter_clear(spark, parcels):
    clear = {"column": "weight", "operator": "lt", "value": 10, "action": "clear"}
    out = steps(spark, parcels, ("filter_value", clear))
    assert column(out, "weight") == [12.5, 31.75, 31.75, None, None, None, None]
    assert out.schema == parcels.schema


@pytest.mark.parametrize("text, found", [("%", "9 % off"), ("_", "snake_case"), ("!", "stop!"), ("\\", "c:\\dir"), (".", "v1.2")])
def test_wildcards_are_plain_characters(spark, text, found):
    df = spark.createDataFrame([(v,) for v in ("9 % off", "snakecase", "snake_case", "stop!", "stop", "c:\\dir", "v1.2", "v12")], "value string")
    out = steps(
        spark, df, ("filter_value", {"column": "value", "operator": "contains", "value": text, "action": "keep"})
    )
    assert column(out, "value") == [found]


def test_filter_formula(spark, parcels):
    condition = "weight < 10 and country = 'PT'"
    keep = steps(spark, parcels, ("filter_formula", {"condition": condition}))
    assert column(keep, "parcel_id") == [7, 9]
    # An unknown answer (parcels 11 and 13) is no reason to remove a row.
    gone = steps(spark, parcels, ("filter_formula", {"condition": condition, "action": "remove"}))
    assert column(gone, "parcel_id") == [11, 12, 12, 13, 8]


def test_empty_is_one_definition(spark):
    """Null and spaces alone, and nothing else: every step that asks agrees, value by value."""
    values = [None, "", " ", "     ", "\t", "\n ", "\u00a0", "0", " x "]
    frame = spark.createDataFrame(list(enumerate(values)), "n int, remark string")
    blank = {n for n, v in enumerate(values) if v is None or not v.strip(" ")}

    def left(kind, **params):
        return set(column(steps(spark, frame, (kind, {"column": "remark", **params})), "n"))

    assert left("filter_value", operator="empty", action="keep") == blank
    assert left("filter_value", operator="not_empty", action="remove") == blank
    assert left("remove_empty") == set(range(len(values))) - blank
    filled = steps(spark, frame, ("fill_empty", {"column": "remark", "value": "-?-"})).collect()
    assert {r["n"] for r in filled if r["remark"] == "-?-"} == blank
    assert all(r["remark"] == values[r["n"]] for r in filled if r["n"] not in blank)


def test_fill_empty_number(spark):
    df = spark.createDataFrame([(1, 1.5), (2, None)], "id int, n double")
    out = steps(spark, df, ("fill_empty", {"column": "n", "value": "0"}))
    assert rows(out) == [(1, 1.5), (2, 0.0)]
    assert out.schema["n"].dataType.simpleString() == "double"


def test_fill_empty_date_and_boolean(spark):
    df = spark.createDataFrame([(None, None)], "d date, b boolean")
    out = steps(
        spark, df, ("fill_empty", {"column": "d", "value": "2024-01-01"}), ("fill_empty", {"column": "b", "value": "true"})
    )
    assert rows(out) == [(date(2024, 1, 1), True)]


def test_find_replace_is_literal(spark):
    df = spark.createDataFrame([("a.b.c",)], "x string")
    assert rows(steps(spark, df, ("find_replace", {"column": "x", "find": ".", "replace": "-"}))) == [("a-b-c",)]


@pytest.mark.parametrize(
    "mode, made",
    [
        ("upper", str.upper),
        ("lower", str.lower),
        ("trim", lambda t: t.strip(" ")),
        ("trim_lower", lambda t: t.strip(" ").lower()),
        ("capitalize", lambda t: t[:1].upper() + t[1:].lower()),
    ],
)
def test_text_transform(spark, mode, made):
    texts = ["  two  wOrds ", "\tTab ", "o'NEIL-Smith", "x", "", "42 b", "éTÉ"]
    frame = spark.createDataFrame([(t, t) for t in texts], "kept string, t string")
    for kept, changed in steps(spark, frame, ("text_transform", {"column": "t", "mode": mode})).collect():
        assert changed == made(kept)


@pytest.mark.parametrize(
    "to, made",
    [
        ("varchar", "string"),
        ("integer", "int"),
        ("bigint", "bigint"),
        ("double", "double"),
        ("decimal(18,2)", "decimal(18,2)"),
        ("date", "date"),
        ("timestamp", "timestamp_ntz"),
        ("boolean", "boolean"),
    ],
)
def test_change_type(spark, to, made):
    value = {"date": "2024-01-02", "timestamp": "2024-01-02 03:04:05", "boolean": "true"}.get(to, "12")
    df = spark.createDataFrame([(value,)], "x string")
    out = steps(spark, df, ("change_type", {"column": "x", "to": to}))
    assert out.schema["x"].dataType.simpleString() == made and out.first()[0] is not None


def test_change_type_fails_on_a_bad_value(spark):
    df = spark.createDataFrame([("abc",)], "x string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        steps(spark, df, ("change_type", {"column": "x", "to": "integer"})).collect()


def test_round(spark):
    df = spark.createDataFrame([(1234.565, 1250)], "x double, n int")
    assert steps(spark, df, ("round", {"column": "x"})).first()[0] == 1235.0
    assert steps(spark, df, ("round", {"column": "x", "decimals": "1"})).first()[0] == 1234.6
    assert steps(spark, df, ("round", {"column": "n", "decimals": -2.0})).first()[1] == 1300


def test_parse_date(spark):
    known = {"1999-12-31": date(1999, 12, 31), "2031-02-29": None, "soon": None, "": None, None: None}
    frame = spark.createDataFrame([(t,) for t in known], "t string")
    found = steps(spark, frame, ("parse_date", {"column": "t", "into": "day"})).collect()
    assert {r["t"]: r["day"] for r in found} == known


@pytest.mark.parametrize(
    "text, fmt, expected",
    [
        ("01/02/2024", "%d/%m/%Y", datetime(2024, 2, 1)),
        ("1/2/2024", "%d/%m/%Y", datetime(2024, 2, 1)),
        ("2024-02-01 13:14:15", "%Y-%m-%d %H:%M:%S", datetime(2024, 2, 1, 13, 14, 15)),
        ("2024-02-01T13:14:15", "%Y-%m-%dT%H:%M:%S", datetime(2024, 2, 1, 13, 14, 15)),
        ("20240201", "%Y%m%d", datetime(2024, 2, 1)),
        ("20240201131415", "%Y%m%d%H%M%S", datetime(2024, 2, 1, 13, 14, 15)),
        ("3 Feb 2024", "%d %b %Y", datetime(2024, 2, 3)),
        ("2024-02-30", "%Y-%m-%d", None),
        ("01/02/2024 x", "%d/%m/%Y", None),
    ],
)
def test_parse_date_format(spark, text, fmt, expected):
    df = spark.createDataFrame([(text,)], "d string")
    out = steps(spark, df, ("parse_date", {"column": "d", "format": fmt, "into": "t"}))
    assert out.first()["t"] == expected and out.columns == ["d", "t"]


def test_date_parts(spark):
    df = spark.createDataFrame([(date(2024, 2, 29),), (date(2023, 1, 1),)], "d date")
    parts = ["year", "month", "day", "quarter", "week", "dow"]
    out = steps(spark, df, ("extract_date_parts", {"column": "d", "parts": parts}))
    assert rows(out.drop("d")) == [(2023, 1, 1, 1, 52, 0), (2024, 2, 29, 1, 9, 4)]
    assert out.schema["d_week"].dataType.simpleString() == "bigint"
    assert steps(spark, df, ("extract_date_parts", {"column": "d"})).columns == ["d", "d_year", "d_month"]


def test_distinct_rows_treats_nulls_as_equal(spark, parcels):
    assert rows(steps(spark, parcels, ("distinct_rows", {}))) == sorted(set(PARCELS), key=repr)


@pytest.mark.parametrize("descending", [False, True])
def test_sort_puts_nulls_last(spark, parcels, descending):
    out = steps(spark, parcels, ("sort", {"column": "hub", "descending": descending}))
    assert [r["hub"] for r in out.collect()] == sorted([3, 3, 5, 5, 5, 9], reverse=descending) + [None]


METERS = ["north", "south", "east"]


def _readings(seed):
    rng = random.Random(seed)
    return [
        (n % 7, *[None if rng.random() < 0.3 else float(rng.randint(-5, 5)) for _ in METERS])
        for n in range(20)
    ]


def test_unpivot_is_a_row_per_cell(spark):
    data = _readings(1)
    frame = spark.createDataFrame(data, "hall int, " + ", ".join(f"{m} double" for m in METERS))
    found = steps(spark, frame, ("unpivot", {"columns": METERS[:2], "name_into": "side", "value_into": "heat"}))
    assert found.columns == ["hall", "east", "side", "heat"]
    cells = [(hall, east, side, heat) for hall, north, south, east in data
             for side, heat in (("north", north), ("south", south))]
    assert Counter(map(tuple, found.collect())) == Counter(cells)


@pytest.mark.parametrize(
    "measure, made",
    [("sum", sum), ("max", max), ("min", min), ("avg", lambda v: sum(v) / len(v)), ("count", None)],
)
@pytest.mark.parametrize("keys", [["hall"], []])
def test_pivot_is_a_cell_per_value(spark, measure, made, keys):
    cells = [(hall, side, heat) for hall, *heats in _readings(2) for side, heat in zip(["Nord-Öst", "süd", "?"], heats)]
    frame = spark.createDataFrame(cells, "hall int, side string, heat double")
    listed = {"t_nord_ost": "Nord-Öst", "t_sud": "süd", "t_attic": "attic"}
    found = steps(spark, frame, ("pivot", {
        "key_columns": keys, "name_column": "side", "value_column": "heat", "aggregate": measure,
        "values": list(listed.values()), "prefix": "t_",
    }))
    assert found.columns == [*keys, *listed]
    expected = {}
    for hall in {c[0] for c in cells} if keys else {None}:
        for name, side in listed.items():
            mine = [h for k, s, h in cells if s == side and (not keys or k == hall)]
            filled = [h for h in mine if h is not None]
            value = len(mine) if measure == "count" else made(filled) if filled else None
            expected.setdefault(hall, {})[name] = pytest.approx(value)
    assert {r["hall"] if keys else None: {c: r[c] for c in listed} for r in found.collect()} == expected


@pytest.mark.parametrize(
    "value, name",
    [("fév", "fev"), ("  En cours ! ", "en_cours"), ("A__B", "a__b"), ("_x_", "x"), ("straße", "stra_e"), ("a - b", "a_b")],
)
def test_pivot_column_names(value, name):
    assert pivot_column(value) == name


def test_reserved_and_spaced_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["order", "select", "order total"])
    out = steps(
        spark,
        df,
        ("concat_columns", {"columns": ["order", "order total"], "into": "x"}),
        ("round", {"column": "order total"}),
        ("filter_value", {"column": "select", "value": "2", "action": "keep"}),
        ("window_function", {"fn": "sum", "column": "order total", "partition_by": ["select"], "into": "s"}),
        ("dedup_key", {"keys": ["order"], "order_by": [{"column": "order total"}]}),
    )
    assert rows(out) == [(1, 2, 3, "1 3", 3)]


def test_disabled_steps_and_upto(spark, parcels):
    spec = {
        "type": "prepare",
        "inputs": [{"ref": "o"}],
        "steps": [
            {"type": "formula", "params": {"into": "a", "expression": "1"}},
            {"type": "formula", "params": {"into": "b", "expression": "1"}, "enabled": False},
            {"type": "formula", "params": {"into": "c", "expression": "1"}},
            {"type": "rename", "params": {"renames": [{"from": "nope", "to": "x"}]}},
        ],
    }
    out = run_recipe(spark, spec, {"o": parcels}, upto=2)
    assert out.columns[-2:] == ["a", "c"]
    assert preview(spark, spec, {"o": parcels}, upto=1, limit=2).count() == 2
    with pytest.raises(RecipeError, match="'nope' does not exist.*Available columns: parcel_id"):
        run_recipe(spark, spec, {"o": parcels})
    with pytest.raises(RecipeError, match="1 to 5000"):
        preview(spark, spec, {"o": parcels}, upto=1, limit=5001)


REFUSED = [
    ("rename", {}, "no column given"),
    ("rename", {"renames": [{"from": "state", "to": "a b"}]}, "Invalid column name"),
    ("rename", {"renames": [{"from": "state", "to": "COUNTRY"}]}, "two columns are called"),
    ("keep_delete", {"columns": [], "action": "keep"}, "no column would be left"),
    ("concat_columns", {"columns": ["state"], "into": "x"}, "at least two"),
    ("concat_columns", {"columns": ["state", "country"], "into": "state"}, "two columns are called"),
    ("split_column", {"column": "state", "count": 11}, "between 1 and 10"),
    ("split_column", {"column": "state", "count": 0}, "at least 1"),
    ("split_column", {"column": "state", "count": True}, "whole number"),
    ("split_column", {"column": "state", "separator": ""}, "separator is empty"),
    ("formula", {"into": "x", "expression": " "}, "empty"),
    ("formula", {"into": "x", "expression": "1; select 2"}, "refused by Spark"),
    ("formula", {"into": "x", "expression": "select 2"}, "refused by Spark"),
    ("formula", {"into": "x", "expression": "nope + 1"}, "refused by Spark"),
    ("filter_formula", {"condition": "true limit 0"}, "refused by Spark"),
    ("filter_value", {"column": "state", "operator": "like", "value": "x"}, "unknown operator"),
    ("filter_value", {"column": "state", "operator": "eq"}, "no value"),
    ("filter_value", {"column": "state", "operator": "eq", "values": ["a", "b"]}, "compares one value"),
    ("filter_value", {"column": "nope", "value": "x"}, "does not exist"),
    ("text_transform", {"column": "state", "mode": "title"}, "unknown mode"),
    ("change_type", {"column": "state", "to": "int); drop"}, "Invalid type"),
    ("change_type", {"column": "state", "to": "notatype"}, "invalid type|refused"),
    ("round", {"column": "weight", "decimals": 1.9}, "whole number"),
    ("round", {"column": "weight", "decimals": "x"}, "whole number"),
    ("parse_date", {"column": "state", "format": "%U"}, "not supported"),
    ("extract_date_parts", {"column": "sent", "parts": ["era"]}, "Unknown date part"),
    ("dedup_key", {"order_by": [{"column": "state"}]}, "at least one key"),
    ("dedup_key", {"keys": ["state"]}, "what to sort on"),
    ("dedup_key", {"keys": ["state"], "order_by": [{"column": "state"}], "ties": "x"}, "tie rule"),
    ("unpivot", {"columns": ["state"]}, "at least two"),
    ("unpivot", {"columns": ["state", "weight"]}, "different kinds"),
    ("unpivot", {"columns": ["state", "country"], "name_into": "parcel_id"}, "already a column"),
    ("unpivot", {"columns": ["state", "country"], "name_into": "a", "value_into": "a"}, "different names"),
    ("pivot", {"name_column": "state", "value_column": "state", "values": ["a"]}, "must differ"),
    ("pivot", {"name_column": "state", "value_column": "weight"}, "list the values"),
    ("pivot", {"name_column": "state", "value_column": "weight", "values": ["1"]}, "valid column name"),
    ("pivot", {"name_column": "state", "value_column": "weight", "values": ["a"], "prefix": "1"}, "prefix"),
    ("pivot", {"name_column": "state", "value_column": "weight", "values": ["a"], "aggregate": "x"}, "unknown aggregation"),
    ("pivot", {"name_column": "state", "value_column": "weight", "values": ["a", "A "]}, "two output columns"),
    ("window_function", {"fn": "ntile", "into": "x"}, "unknown function"),
    ("window_function", {"fn": "rank", "into": "x"}, "needs an order"),
    ("window_function", {"fn": "sum", "column": "weight", "into": "x", "order_by": [{"column": "state"}]}, "takes no order"),
    ("window_function", {"fn": "moving_avg", "column": "weight", "into": "x", "order_by": [{"column": "state"}], "window_rows": 1}, "at least 2"),
    ("window_function", {"fn": "lag", "column": "weight", "into": "x", "order_by": [{"column": "state"}], "offset": 0}, "at least 1"),
    ("window_function", {"fn": "sum", "column": "weight", "into": "weight"}, "used by this window"),
    ("topn", {}, "Unknown step"),
]


@pytest.mark.parametrize("kind, params, message", REFUSED)
def test_refusals(spark, parcels, kind, params, message):
    with pytest.raises(RecipeError, match=message):
        steps(spark, parcels, (kind, params))


@pytest.mark.parametrize(
    "spec, message",
    [
        (None, "must be an object"),
        ({"type": 3}, "must be text"),
        ({"type": "nope"}, "Unknown recipe type"),
        ({"type": "distinct"}, "shortcut.*distinct_rows"),
        ({"inputs": "o"}, "'inputs' must be a list"),
        ({"inputs": [None]}, "Item 1 of 'inputs'"),
        ({"inputs": [{"ref": "o"}], "steps": [{"type": "rename", "params": ["x"]}]}, "params of step 1"),
        ({"inputs": [{"ref": "o"}], "steps": [{"type": "rename", "params": {"renames": [None]}}]}, "Item 1"),
        ({"inputs": [{"ref": "o"}], "output": {"unique_key": "id"}}, "must be a list"),
        ({"inputs": [{"ref": "o"}, {"ref": "o2"}]}, "exactly 1 input"),
        ({"inputs": [{"ref": "missing"}]}, "not available"),
        ({"type": "stack", "inputs": [{"ref": "o"}]}, "at least 2"),
        ({"type": "stack", "inputs": [{"ref": "o"}, {"ref": "O"}]}, "two columns are called|called"),
        ({"inputs": [{"ref": "o"}], "output": {"materialized": "cube"}}, "Unknown materialization"),
    ],
)
def test_malformed_specs(spark, parcels, spec, message):
    with pytest.raises(RecipeError, match=message):
        run_recipe(spark, spec, {"o": parcels})


def test_input_twins_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], ["id", "ID"])
    with pytest.raises(RecipeError, match="case is ignored"):
        steps(spark, df)


@pytest.mark.parametrize(
    "text, form, expected",
    [
        ("07-03-69", "%d-%m-%y", "1969-03-07 00:00:00"),
        ("07-03-68", "%d-%m-%y", "2068-03-07 00:00:00"),
        ("29.2.72", "%d.%m.%y", "1972-02-29 00:00:00"),
        ("710615", "%y%m%d", "1971-06-15 00:00:00"),
        ("wed 5 Jun 2030", "%a %d %b %Y", "2030-06-05 00:00:00"),
        ("Wedn 5 Jun 2030", "%a %d %b %Y", None),
        ("Saturday; 8h, 2001-09-08", "%A; %Hh, %Y-%m-%d", "2001-09-08 08:00:00"),
        ("2001-09-08 23:30 -0145", "%Y-%m-%d %H:%M %z", "2001-09-09 01:15:00"),
        ("2001-09-08 23:30 +12", "%Y-%m-%d %H:%M %z", "2001-09-08 11:30:00"),
        ("2001-09-08 23:30", "%Y-%m-%d %H:%M %z", None),
        ("1$ 2001-09-08 Sat", "1$ %Y-%m-%d %a", "2001-09-08 00:00:00"),
    ],
)
def test_short_years_weekdays_and_offsets(spark, text, form, expected):
    from plumbline.functions.dates import parsed_timestamp

    row = spark.createDataFrame([(text,)], "t string").select(
        parsed_timestamp(F.col("t"), form).cast("string").alias("at")
    )
    assert row.first()["at"] == expected


def test_one_year_and_one_offset(spark):
    from plumbline.functions.dates import parsed_timestamp

    for form in ("%y %Y", "%z %z", "%y %F"):
        with pytest.raises(RecipeError, match="both|once"):
            parsed_timestamp(F.lit("x"), form)
