from __future__ import annotations

import random
from datetime import date

import pytest

from plumbline.errors import RecipeError
from plumbline.operators import windows
from plumbline.operators.skew import HotGroups, hot_groups

from tests.helpers import column, rows, steps

ALL = ["row_number", "rank", "dense_rank", "lag", "lead", "running_sum", "moving_avg"]
WHOLE = ["sum", "avg", "min", "max", "count"]


@pytest.fixture(scope="module")
def tides(spark):
    """Two ports; the second has one tide."""
    data = [("ebb", 4, 2.5), ("ebb", 10, -1.0), ("ebb", 16, 3.5), ("flood", 5, 8.0)]
    return spark.createDataFrame(data, "port string, hour int, height double")


def window(spark, df, fn, **params):
    return steps(spark, df, ("window_function", {"fn": fn, "into": "w", **params}))


BY_HOUR = {"partition_by": ["port"], "order_by": [{"column": "hour"}]}


@pytest.mark.parametrize(
    "fn, params, expected",
    [
        ("running_sum", {"column": "height", **BY_HOUR}, {4: 2.5, 10: 1.5, 16: 5.0, 5: 8.0}),
        ("max", {"column": "height", "partition_by": ["port"]}, {4: 3.5, 10: 3.5, 16: 3.5, 5: 8.0}),
        ("lag", {"column": "height", **BY_HOUR}, {4: None, 10: 2.5, 16: -1.0, 5: None}),
        ("lead", {"column": "height", "offset": 2, **BY_HOUR}, {4: 3.5, 10: None, 16: None, 5: None}),
        ("moving_avg", {"column": "height", "window_rows": 2, **BY_HOUR}, {4: 2.5, 10: 0.75, 16: 1.25, 5: 8.0}),
        ("row_number", BY_HOUR, {4: 1, 10: 2, 16: 3, 5: 1}),
        ("dense_rank", {"order_by": [{"column": "port", "descending": True}]}, {4: 2, 10: 2, 16: 2, 5: 1}),
        ("count", {}, {4: 4, 10: 4, 16: 4, 5: 4}),
    ],
)
def test_functions(spark, tides, fn, params, expected):
    assert {r["hour"]: r["w"] for r in window(spark, tides, fn, **params).collect()} == expected


def test_counts_are_bigint(spark, tides):
    for fn in ("row_number", "rank", "dense_rank", "count"):
        order = {} if fn == "count" else BY_HOUR
        assert window(spark, tides, fn, **order).schema["w"].dataType.simpleString() == "bigint"


def _reference(data, fn, by, descending, n):
    """Window functions in plain Python, to compare with."""
    groups = {}
    for r in data:
        groups.setdefault(r["k"] if by else None, []).append(r)
    out = []
    for group in groups.values():
        full = [r for r in group if r["o"] is not None]
        full.sort(key=lambda r: r["id"])
        full.sort(key=lambda r: r["o"], reverse=descending)
        group = full + sorted((r for r in group if r["o"] is None), key=lambda r: r["id"])
        seen, total = [], None
        for i, r in enumerate(group):
            if not seen or seen[-1] != r["o"]:
                seen.append(r["o"])
            values = [x["v"] for x in group]
            present = [v for v in values if v is not None]
            if r["v"] is not None:
                total = (total or 0) + r["v"]
            recent = [v for v in values[max(0, i - n + 1) : i + 1] if v is not None]
            first = next(j for j, x in enumerate(group) if x["o"] == r["o"])
            out.append(
                (
                    r["id"],
                    {
                        "row_number": i + 1,
                        "rank": first + 1,
                        "dense_rank": len(seen),
                        "lag": values[i - n] if i >= n else None,
                        "lead": values[i + n] if i + n < len(values) else None,
                        "running_sum": total,
                        "moving_avg": sum(recent) / len(recent) if recent else None,
                        "sum": sum(present) if present else None,
                        "avg": sum(present) / len(present) if present else None,
                        "min": min(present, default=None),
                        "max": max(present, default=None),
                        "count": len(group),
                    }[fn],
                )
            )
    return sorted(out)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = [
        {
            "id": i,
            # One key with most rows, a NULL key, a few small ones.
            "k": rng.choice(["hot"] * 6 + [None, None, "a", "b"]),
            "o": rng.choice([None, *range(12)]),
            "v": rng.choice([None, 1, 2, 3, 5, 8]),
        }
        for i in range(400)
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in data], "id int, k string, o int, v int")
    return data, df.repartition(5)


@pytest.mark.parametrize("by", [True, False])
@pytest.mark.parametrize("fn", ALL + WHOLE)
def test_hot_groups_give_the_same_result(spark, skewed, small_groups, fn, by):
    data, df = skewed
    ties = fn in ("rank", "dense_rank")
    params = {"column": "v", "partition_by": ["k"] if by else []}
    if fn in ALL:
        params["order_by"] = [{"column": "o", "descending": True}]
        if not ties:  # a total order, so the answer is unique
            params["order_by"].append({"column": "id"})
    n = 3
    params |= {"offset": n} if fn in ("lag", "lead") else {}
    params |= {"window_rows": n} if fn == "moving_avg" else {}
    expected = _reference(data, fn, by, True, n)
    plain = window(spark, df, fn, **params)
    with small_groups(20):
        split = window(spark, df, fn, **params)
    assert rows(plain.select("id", "w")) == sorted(expected, key=repr)
    assert rows(split.select("id", "w")) == sorted(expected, key=repr)
    assert plain.columns == split.columns


def test_only_hot_groups_are_split(spark, skewed, small_groups):
    _, df = skewed
    with small_groups(150):
        out = window(
            spark, df, "row_number", partition_by=["k"], order_by=[{"column": "o"}, {"column": "id"}]
        )
    assert out.count() == 400
    assert out.groupBy("k", "w").count().filter("count > 1").count() == 0


def test_many_copies_of_one_row(spark, small_groups):
    """Identical rows cannot be told apart, and still get numbers 1 to n."""
    df = spark.range(0, 300, 1, 6).selectExpr("'x' as k", "1 as o")
    with small_groups(10):
        out = window(spark, df, "row_number", partition_by=["k"], order_by=[{"column": "o"}])
    assert column(out, "w") == sorted(range(1, 301), key=repr)


def test_result_can_replace_a_column(spark, skewed, small_groups):
    _, df = skewed
    params = {"fn": "row_number", "into": "v", "order_by": [{"column": "id"}]}
    with small_groups(20):
        out = steps(spark, df, ("window_function", params))
    assert out.columns == ["id", "k", "o", "v"]
    assert all(r["v"] == r["id"] + 1 for r in out.collect())


@pytest.fixture
def updates(spark):
    data = [
        ("kestrel", date(2019, 5, 7), "marsh"),
        ("wren", None, "unseen"),
        ("kestrel", date(2019, 6, 2), "tower"),
        ("kestrel", date(2018, 9, 9), "barn"),
        ("wren", date(2017, 1, 3), "hedge"),
    ]
    return spark.createDataFrame(data, "bird string, sighted date, place string")


def dedup(spark, df, keys, column_, ties="one"):
    order = [{"column": column_, "descending": True}]
    return steps(spark, df, ("dedup_key", {"keys": keys, "order_by": order, "ties": ties}))


def test_dedup_keeps_the_latest_and_never_a_null(spark, updates):
    out = dedup(spark, updates, ["bird"], "sighted")
    assert column(out, "place") == ["hedge", "tower"] and out.columns == updates.columns


def test_dedup_ties(spark, small_groups):
    """All that share the first place stay, those without a date too where none has one."""
    data = [("owl", 3, "a"), ("owl", 3, "b"), ("owl", 1, "c"), ("owl", None, "d"),
            ("jay", None, "e"), ("jay", None, "f"), (None, 2, "g")]
    frame = spark.createDataFrame(data, "bird string, at int, note string")
    kept = {"a", "b", "e", "f", "g"}
    one = dedup(spark, frame, ["bird"], "at")
    assert one.count() == 3 and set(column(one, "note")) < kept
    for limit in (1, 10_000):
        with small_groups(limit):
            assert set(column(dedup(spark, frame, ["bird"], "at", "all"), "note")) == kept


def test_dedup_cuts_down_before_the_shuffle(spark, updates):
    plan = dedup(spark, updates, ["bird"], "sighted")._jdf.queryExecution().toString()
    assert "row_number(), 1, Partial" in plan


def test_every_hot_key_is_found(spark, small_groups):
    df = spark.range(6_000).selectExpr("id % 1500 as k", "id")
    with small_groups(3):
        hot = hot_groups(df, ["k"])
        assert len(hot.hashes) == 1_500 and hot.rows == 6_000
        assert hot.inside(df).count() == 6_000 and hot.outside(df).count() == 0


@pytest.mark.parametrize("kind", ["decimal(10,2)", "bigint", "double"])
@pytest.mark.parametrize("by", [["k"], []])
def test_running_sum_keeps_its_type_when_split(spark, small_groups, kind, by):
    df = spark.range(60).selectExpr("id", "id % 2 as k", f"cast(id as {kind}) as v")
    params = {"column": "v", "partition_by": by, "order_by": [{"column": "id"}]}
    plain = window(spark, df, "running_sum", **params)
    with small_groups(5):
        split = window(spark, df, "running_sum", **params)
    assert split.schema["w"].dataType == plain.schema["w"].dataType
    assert rows(split.select("id", "w")) == rows(plain.select("id", "w"))


def test_a_low_limit_asks_for_few_pieces(spark, small_groups):
    """Spark samples 300 rows a piece to the driver: pieces go by what a task can sort."""
    few = HotGroups(("k",), (1, 2, 3), 36_000_000, 3_000)
    assert 36 <= few.pieces <= 64
    assert HotGroups((), (), 9_000_000_000, 4_000_000).pieces >= 9_000
    df = spark.range(0, 4_000, 1, 4).selectExpr("id % 2 as k", "id div 4 as o", "id", "1 as v")
    params = {"column": "v", "partition_by": ["k"], "order_by": [{"column": "o"}, {"column": "id"}]}
    with small_groups(10):
        assert hot_groups(df, ["k"]).pieces < 100
        split = window(spark, df, "running_sum", **params)
    assert rows(split.select("id", "w")) == rows(df.selectExpr("id", "id div 2 + 1 as w"))


def test_rows_of_hot_groups_meet_small_sides_unshuffled(spark, small_groups):
    """Piece sizes and slice totals are broadcast: the rows are shuffled by slice alone."""
    df = spark.range(200).selectExpr("id % 2 as k", "id", "id as v")
    params = {"column": "v", "partition_by": ["k"], "order_by": [{"column": "id"}]}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with small_groups(20):
            split = window(spark, df, "running_sum", **params)
            plan = split._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_split_groups_carry_only_what_is_read(spark, small_groups, monkeypatch):
    """Columns that a keep step behind the window drops are not shuffled and written."""
    seen = []
    plain = windows.settled
    monkeypatch.setattr(windows, "settled", lambda df: seen.append(df.columns) or plain(df))
    df = spark.range(60).selectExpr("id", "repeat('x', 99) as note", "id % 2 as k", "1 as w", "id as v")
    params = {"fn": "running_sum", "into": "w", "column": "v", "partition_by": ["k"]}
    params["order_by"] = [{"column": "id"}]
    kept = {"columns": ["w", "id"], "action": "keep"}
    call = ("window_function", params)
    with small_groups(5):
        split = steps(spark, df, call, ("keep_delete", kept))
        whole = steps(spark, df, call)
    assert set(seen[0]) - {"piece", "serial"} <= {"id", "k", "w", "v", "__piece", "__serial"}
    assert any("note" in c for c in seen[1:])  # without that step all columns stay
    assert split.columns == ["id", "w"] and whole.columns == df.columns
    assert rows(split) == rows(whole.select("id", "w"))


def test_columns_are_refused_as_before_a_keep_step(spark, tides):
    for into, kept, message in (("HOUR", "HOUR", "refused"), ("w", "depth", "hour, height, w")):
        call = ("window_function", {"fn": "count", "into": into})
        with pytest.raises(RecipeError, match=message):
            steps(spark, tides, call, ("keep_delete", {"columns": [kept], "action": "keep"}))
