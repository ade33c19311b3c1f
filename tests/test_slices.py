"""Loads by time slices."""

from __future__ import annotations

from datetime import date, datetime

import pytest

from plumbline import RecipeError, RecipeTable, build, run_recipe
from tests.helpers import column, rows


def spec_of(kind="prepare", inputs=(), steps=(), output=None, **more):
    return {
        "name": "sliced",
        "type": kind,
        "inputs": [{"ref": i} for i in inputs],
        "steps": [{"type": t, "params": p} for t, p in steps],
        "output": {"materialized": "incremental", **(output or {})},
        **more,
    }


def events(spark, *data):
    return spark.createDataFrame(list(data), "id int, at timestamp_ntz")


def sliced(size="day", lookback=0, **more):
    return {
        "incremental_strategy": "microbatch",
        "microbatch": {"event_time": "at", "begin": "2024-01-01", "batch_size": size, "lookback": lookback},
        **more,
    }


def test_microbatch_replaces_whole_slices(spark, target):
    spec = spec_of(inputs=["ev"], output=sliced())
    spec["inputs"][0]["event_time"] = "at"
    d = lambda day, hour=0: datetime(2024, 1, day, hour)
    early = events(spark, (0, datetime(2023, 12, 31)), (1, d(1)), (2, d(2)), (3, d(3, 5)), (9, d(9)))
    out = build(spark, spec, {"ev": early}, target, now=d(3, 12))
    assert column(out, "id") == [1, 2, 3] and out.columns == ["id", "at"]
    # Day 3 is rewritten and day 4 added; days 1 and 2 are frozen.
    later = events(spark, (10, d(1)), (30, d(3)), (4, d(4)))
    out = build(spark, spec, {"ev": later}, target, now=d(4, 1))
    assert column(out, "id") == [1, 2, 30, 4]
    # A slice whose rows have gone is emptied.
    spec["output"]["microbatch"]["lookback"] = 1
    out = build(spark, spec, {"ev": events(spark, (4, d(4)))}, target, now=d(4, 2))
    assert column(out, "id") == [1, 2, 4]
    out = build(spark, spec, {"ev": later}, target, now=d(4, 2), full_refresh=True)
    assert column(out, "id") == [10, 30, 4]


@pytest.mark.parametrize("size", ["hour", "month", "year"])
def test_microbatch_sizes(spark, target, size):
    spec = spec_of(inputs=["ev"], output=sliced(size))
    data = [(1, datetime(2024, 1, 1, 0, 30)), (2, datetime(2024, 1, 1, 1, 30)), (3, datetime(2024, 2, 1))]
    out = build(spark, spec, {"ev": events(spark, *data)}, target, now=datetime(2024, 2, 1))
    assert column(out, "id") == [1, 2, 3]
    folders = RecipeTable(spark, target).partition_values("_slice")
    expected = {"hour": ["2024-01-01T00", "2024-01-01T01", "2024-02-01T00"], "month": ["2024-01", "2024-02"], "year": ["2024"]}
    assert folders == expected[size]


def test_microbatch_date_column_and_group(spark, target):
    spec = spec_of(
        "group",
        ["ev"],
        group_by=["at"],
        aggregations=[{"fn": "count", "alias": "n"}],
        output=sliced("month"),
    )
    df = spark.createDataFrame([(date(2024, 1, 5),), (date(2024, 1, 5),), (date(2024, 2, 1),)], "at date")
    out = build(spark, spec, {"ev": df}, target, now=datetime(2024, 2, 2))
    assert rows(out) == [(date(2024, 1, 5), 2), (date(2024, 2, 1), 1)]


def test_microbatch_join_stays_inside_a_slice(spark, target):
    spec = spec_of(
        "join",
        ["a", "b"],
        joins=[{"type": "left", "on": [{"left": "id", "right": "id"}]}],
        select=[{"from": "a", "column": "id"}, {"from": "a", "column": "at"}, {"from": "b", "column": "at", "as": "other"}],
        output=sliced(),
    )
    for i in spec["inputs"]:
        i["event_time"] = "at"
    a = events(spark, (1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2)))
    b = events(spark, (1, datetime(2024, 1, 1, 3)), (2, datetime(2024, 1, 1)))
    out = build(spark, spec, {"a": a, "b": b}, target, now=datetime(2024, 1, 2))
    assert rows(out.select("id", "other")) == [(1, datetime(2024, 1, 1, 3)), (2, None)]


@pytest.mark.parametrize("timed", ["b", "ab"])
@pytest.mark.parametrize("kind", ["left", "inner", "full"])
@pytest.mark.parametrize("time_of", ["a", "b"])
def test_microbatch_join_does_not_depend_on_the_builds(spark, tmp_path, timed, kind, time_of):
    spec = spec_of(
        "join",
        ["a", "b"],
        joins=[{"type": kind, "on": [{"left": "id", "right": "id"}]}],
        select=[
            {"from": time_of, "column": "at"},
            {"from": "a", "column": "at", "as": "at_a"},
            {"from": "b", "column": "at", "as": "at_b"},
        ],
        output=sliced(lookback=0),
    )
    for i in spec["inputs"]:
        if i["ref"] in timed:
            i["event_time"] = "at"
    days = [datetime(2024, 1, d) for d in (1, 2, 3)]
    a = events(spark, (1, days[0]), (1, days[1]), (2, days[2]), (3, days[0]))
    b = events(spark, (1, days[1]), (2, days[0]), (2, days[2]), (4, days[1]), (3, days[1]))
    once, often = str(tmp_path / "once"), str(tmp_path / "often")
    out = build(spark, spec, {"a": a, "b": b}, once, now=days[2])
    for day in days:
        again = build(spark, spec, {"a": a, "b": b}, often, now=day)
    assert rows(out.select("at", "at_a", "at_b")) == rows(again.select("at", "at_a", "at_b"))
    met = [(x, y) for _, x, y in rows(out.select("at", "at_a", "at_b")) if x and y]
    if timed == "ab" or time_of == "a":
        assert met == [(days[1], days[1]), (days[2], days[2])]


def test_microbatch_schema_change(spark, target):
    spec = spec_of(inputs=["ev"], output=sliced())
    build(spark, spec, {"ev": events(spark, (1, datetime(2024, 1, 1)))}, target, now=datetime(2024, 1, 1))
    wider = spark.createDataFrame([(2, datetime(2024, 1, 2), "x")], "id int, at timestamp_ntz, note string")
    out = build(spark, spec, {"ev": wider}, target, now=datetime(2024, 1, 2))
    assert rows(out.select("id", "note")) == [(2, "x")]  # day 1 was rewritten, and is empty
    spec["output"]["on_schema_change"] = "sync_all_columns"
    out = build(spark, spec, {"ev": wider.drop("id")}, target, now=datetime(2024, 1, 3))
    assert out.columns == ["at", "note"] and out.count() == 1


def test_group_by_slices_needs_its_time(spark):
    spec = spec_of("group", ["ev"], group_by=["id"], aggregations=[{"fn": "max", "column": "at", "alias": "at"}], output=sliced())
    with pytest.raises(RecipeError, match="must group by its time column"):
        run_recipe(spark, spec, {"ev": events(spark, (1, datetime(2024, 1, 1)))})
