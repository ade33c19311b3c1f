"""Outputs and loads of a toll gate's records, against what a model of each strategy holds."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest

from plumbline import DataTestFailure, RecipeError, RecipeTable, build, load_arrivals, run_recipe

PASSES = "plate string, lane int, seen timestamp_ntz, toll double"
START = datetime(2031, 3, 30, 22)


def at(hours):
    return START + timedelta(hours=hours)


def passes(spark, *data, schema=PASSES):
    return spark.createDataFrame(list(data), schema)


def recipe(kind="prepare", inputs=("gate",), steps=(), output=None, **more):
    return {
        "name": "tolls",
        "type": kind,
        "inputs": [i if isinstance(i, dict) else {"ref": i} for i in inputs],
        "steps": [{"type": t, "params": p} for t, p in steps],
        "output": {"materialized": "incremental", **(output or {})},
        **more,
    }


def keyed(strategy="delete+insert", keys=("plate",), bound="seen", **more):
    return {
        "incremental_strategy": strategy, "unique_key": list(keys),
        "incremental": {"column": bound, **more.pop("bound_by", {})}, **more,
    }


def held(df):
    return Counter(map(tuple, df.collect()))


class Model:
    """What a table holds after loads of rows (plate, lane, seen, toll)."""

    def __init__(self, strategy, back=timedelta(0), inclusive=False):
        self.strategy, self.back, self.inclusive, self.rows = strategy, back, inclusive, []

    def load(self, source):
        times = [r[2] for r in self.rows if r[2]]
        fresh = source
        if times:
            bound = max(times) - self.back
            later = (lambda t: t >= bound) if self.inclusive or self.back else (lambda t: t > bound)
            fresh = [r for r in source if r[2] and later(r[2])]
        if self.strategy != "append":
            gone = {r[0] for r in fresh} - {None}
            self.rows = [r for r in self.rows if r[0] not in gone]
        self.rows = self.rows + fresh
        return Counter(self.rows)


def traffic(seed, late=0.0):
    """Deliveries of growing records; some rows arrive hours after they were seen."""
    rng, source = random.Random(seed), []
    for load in range(4):
        for k in rng.sample(range(40), 9):
            plate = None if k == 7 else f"P{k}"
            lag = rng.randint(1, 8) if rng.random() < late else 0
            source.append((plate, rng.randint(1, 3), at(10 * load + rng.randint(0, 9) - lag), float(k)))
        yield list(source)


@pytest.mark.parametrize(
    "strategy, bound_by, model",
    [
        ("append", {}, {}),
        ("delete+insert", {}, {}),
        ("delete+insert", {"operator": "gte"}, {"inclusive": True}),
        ("delete+insert", {"lookback": {"n": 7, "unit": "hour"}}, {"back": timedelta(hours=7)}),
        ("delete+insert", {"lookback": {"n": 1, "unit": "day"}}, {"back": timedelta(days=1)}),
    ],
)
@pytest.mark.parametrize("partitions", [[], ["lane"]])
def test_strategies_leave_what_their_models_hold(spark, target, strategy, bound_by, model, partitions):
    if strategy == "append" and partitions:
        output = {"incremental_strategy": strategy, "incremental": {"column": "seen"}, "partition_by": partitions}
    else:
        output = keyed(strategy, bound_by=bound_by, partition_by=partitions)
    known = Model(strategy, **model)
    for source in traffic(len(partitions) + 3, late=0.3):
        out = build(spark, recipe(output=output), {"gate": passes(spark, *source)}, target)
        assert held(out.select("plate", "lane", "seen", "toll")) == known.load(source)


def test_a_merge_is_one_row_per_key(spark, target):
    merge = recipe(output=keyed("merge"))
    first = [("A", 1, at(0), 1.0), ("B", 1, at(1), 1.0), (None, 2, at(1), 0.0)]
    build(spark, merge, {"gate": passes(spark, *first)}, target)
    twice = [("A", 2, at(5), 2.0), ("A", 3, at(6), 3.0)]
    with pytest.raises(RecipeError, match="several rows for the same key"):
        build(spark, merge, {"gate": passes(spark, *first, *twice)}, target)
    assert held(RecipeTable(spark, target).read()) == Counter(first)
    # Without a key nothing is matched, so such rows gather.
    more = [("A", 2, at(5), 2.0), (None, 2, at(6), 0.0)]
    out = build(spark, merge, {"gate": passes(spark, *first, *more)}, target)
    assert held(out) == Counter([first[1], first[2], *more])


@pytest.mark.parametrize(
    "kind, low, high",
    [("string", "a10", "a11"), ("date", date(2031, 3, 1), date(2031, 3, 2)), ("decimal(5,1)", 7, 8),
     ("timestamp", datetime(2031, 3, 1, 2), datetime(2031, 3, 1, 3)), ("bigint", 2**40, 2**40 + 1)],
)
def test_bounds_of_many_types(spark, target, kind, low, high):
    from decimal import Decimal

    if kind.startswith("decimal"):
        low, high = Decimal(low), Decimal(high)
    append = recipe(output={"incremental_strategy": "append", "incremental": {"column": "mark"}})
    frame = lambda *marks: spark.createDataFrame([(m,) for m in marks], f"mark {kind}")
    assert build(spark, append, {"gate": frame(None).limit(0)}, target).count() == 0
    assert build(spark, append, {"gate": frame(low, None)}, target).count() == 2
    out = build(spark, append, {"gate": frame(low, None, high, high)}, target)
    assert Counter(r["mark"] is None for r in out.collect()) == {True: 1, False: 3}


def test_the_scan_is_given_the_bound(spark, target, tmp_path):
    from plumbline.plans.build import arrivals_only

    source = str(tmp_path / "gate")
    passes(spark, ("A", 1, at(0), 1.0), ("B", 1, at(2), 1.0)).write.parquet(source)
    spec = recipe(output=keyed())
    build(spark, spec, {"gate": spark.read.parquet(source)}, target)
    seen = arrivals_only(spec, {"gate": spark.read.parquet(source)}, RecipeTable(spark, target))
    assert "GreaterThan(seen,2031-03-31T00:00)" in seen["gate"]._jdf.queryExecution().executedPlan().toString()


def test_views_tables_and_what_is_passed_on(spark, target):
    frame = passes(spark, ("A", 1, at(0), 1.0), ("B", 2, at(1), 3.0))
    dear = [("filter_formula", {"condition": "toll > 2"})]
    build(spark, recipe(steps=dear, output={"materialized": "view"}), {"gate": frame})
    assert [r["plate"] for r in spark.table("tolls").collect()] == ["B"]
    stage = build(spark, recipe(steps=dear, output={"materialized": "ephemeral"}), {"gate": frame})
    count = recipe("group", ["stage"], group_by=["lane"], aggregations=[{"fn": "count", "alias": "n"}],
                   output={"materialized": "table"})
    assert held(build(spark, count, {"stage": stage}, target)) == {(2, 1): 1}
    assert held(build(spark, count, {"stage": frame}, target)) == {(1, 1): 1, (2, 1): 1}
    with pytest.raises(RecipeError, match="target folder"):
        build(spark, count, {"stage": frame})


def test_only_the_version_before_is_kept(spark, target, tmp_path):
    whole = recipe(output={"materialized": "table"})
    for n in range(5):
        build(spark, whole, {"gate": passes(spark, ("A", n, at(n), 0.0))}, target)
    left = {p.name for p in (tmp_path / "target").iterdir() if not p.name.startswith(".")}
    assert left == {f"{kind}-00000{n}{more}" for n in (4, 5) for kind, more in (("data", ""), ("schema", "-000001"))}
    assert held(RecipeTable(spark, target).read().select("lane")) == {(4,): 1}


def test_a_refresh_forgets_what_was_there(spark, target):
    spec = recipe(output=keyed())
    build(spark, spec, {"gate": passes(spark, ("A", 1, at(9), 1.0))}, target)
    frame = passes(spark, ("B", 1, at(2), 1.0))
    assert held(build(spark, spec, {"gate": frame}, target).select("plate")) == {("A",): 1}
    assert held(build(spark, spec, {"gate": frame}, target, full_refresh=True).select("plate")) == {("B",): 1}


def test_a_column_of_nothing_is_text(spark, target):
    spec = recipe(steps=[("formula", {"into": "remark", "expression": "null"})],
                  output=keyed(on_schema_change="fail"))
    for hours in (1, 2):
        out = build(spark, spec, {"gate": passes(spark, ("A", 1, at(hours), 1.0))}, target)
    assert out.schema["remark"].dataType.simpleString() == "string" and out.count() == 1


def test_failures_before_and_after_writing(spark, target):
    good = passes(spark, ("A", 1, at(0), 1.0))
    tested = {"materialized": "table", "columns": [{"name": "plate", "tests": ["unique"]}]}
    build(spark, recipe(output=tested), {"gate": good}, target)
    with pytest.raises(DataTestFailure, match="unique"):
        build(spark, recipe(output=tested), {"gate": good.union(good)}, target)
    wrong = recipe(steps=[("change_type", {"column": "plate", "to": "integer"})], output={"materialized": "table"})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        build(spark, wrong, {"gate": good}, target)
    assert held(RecipeTable(spark, target).read()) == held(good)
    tested["columns"][0]["tests"] = [{"name": "unique", "severity": "warn"}]
    assert build(spark, recipe(output=tested), {"gate": good.union(good)}, target).count() == 2


# ------------------------------------------------------------------- other kinds of recipe


def test_touched_groups_are_computed_whole(spark, target):
    """Rows of earlier loads count again, late ones too; the group without a plate is frozen."""
    spec = recipe(
        "group", group_by=["plate"],
        aggregations=[{"fn": "median", "column": "toll", "alias": "middle"},
                      {"fn": "count_distinct", "column": "lane", "alias": "lanes"},
                      {"fn": "max", "column": "seen", "alias": "seen"}],
        output=keyed(),
    )
    source = [("A", 1, at(0), 2.0), ("A", 1, at(1), 4.0), ("B", 1, at(2), 5.0), (None, 1, at(2), 1.0)]
    build(spark, spec, {"gate": passes(spark, *source)}, target)
    source += [("A", 2, at(1), 9.0), ("B", 3, at(2), 7.0), ("A", 2, at(3), 6.0), (None, 2, at(3), 3.0)]
    out = build(spark, spec, {"gate": passes(spark, *source)}, target)
    # B's late row does not touch it, as it is not beyond the bound.
    assert held(out) == {("A", 5.0, 2, at(3)): 1, ("B", 5.0, 1, at(2)): 1, (None, 1.0, 1, at(2)): 1}


def test_joins_load_their_first_input_and_stacks_all(spark, tmp_path):
    lanes = spark.createDataFrame([(1, "car"), (2, "lorry")], "lane int, use string")
    join = recipe(
        "join", ["gate", "lanes"], joins=[{"type": "left", "on": [{"left": "lane", "right": "lane"}]}],
        select=[{"from": "gate", "column": "plate"}, {"from": "gate", "column": "seen"}, {"from": "lanes", "column": "use"}],
        output={"incremental_strategy": "append", "incremental": {"column": "seen"}},
    )
    stack = recipe("stack", ["gate", "other"], output={"incremental_strategy": "append", "incremental": {"column": "seen"}})
    source, other = [("A", 1, at(0), 1.0)], [("Z", 9, at(0), 1.0)]
    for load in range(1, 3):
        gate, side = passes(spark, *source), passes(spark, *other)
        joined = build(spark, join, {"gate": gate, "lanes": lanes}, str(tmp_path / "join"))
        stacked = build(spark, stack, {"gate": gate, "other": side}, str(tmp_path / "stack"))
        assert joined.count() == len(source) and stacked.count() == len(source) + len(other)
        source.append(("B", 2, at(load), 1.0))
        other.append(("Y", 8, at(load), 1.0))
        lanes = lanes.replace("car", "bus")  # does not reach what is written
    assert held(joined.select("use")) == {("car",): 1, ("lorry",): 1}


def test_sql_text_names_the_table_it_adds_to(spark, target):
    later = "{% if is_incremental() %} where seen > (select max(seen) from {this}) {% endif %}"
    spec = recipe("sql", sql="select plate, seen from {gate} " + later, output={"incremental_strategy": "append"})
    source = [("A", 1, at(0), 1.0)]
    build(spark, spec, {"gate": passes(spark, *source)}, target)
    source += [("A", 1, at(0), 1.0), ("B", 1, at(4), 1.0)]
    assert build(spark, spec, {"gate": passes(spark, *source)}, target).count() == 2
    with pytest.raises(RecipeError, match="first build has none"):
        run_recipe(spark, {**spec, "sql": "select * from {this}"}, {"gate": passes(spark, *source)})


def test_a_stream_replaces_by_key(spark, tmp_path):
    source, where, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spec = recipe(steps=[("text_transform", {"column": "plate", "mode": "lower"})], output={"unique_key": ["plate"]})
    deliveries = [[("A", 1, at(0), 1.0), ("B", 1, at(1), 1.0)], [("B", 2, at(2), 5.0), ("C", 2, at(2), 6.0)]]
    for data in deliveries:
        passes(spark, *data).coalesce(1).write.mode("append").parquet(source)
        out = load_arrivals(spark, spec, source, passes(spark, *data).schema, where, state)
    assert held(out.select("plate", "lane")) == {("a", 1): 1, ("b", 2): 1, ("c", 2): 1}
    with pytest.raises(RecipeError, match="remembers what it has read"):
        load_arrivals(spark, recipe(output=keyed()), source, out.schema, where, state)


# --------------------------------------------------------------------------- other columns


@pytest.mark.parametrize("strategy", ["append", "delete+insert", "merge"])
@pytest.mark.parametrize(
    "policy, columns", [("append_new_columns", "plate lane seen toll axles"), ("sync_all_columns", "plate seen axles")]
)
def test_columns_come_and_go(spark, target, strategy, policy, columns):
    spec = recipe(output=keyed(strategy, on_schema_change=policy))
    build(spark, spec, {"gate": passes(spark, ("A", 1, at(0), 1.0), ("B", 2, at(0), 2.0))}, target)
    changed = passes(spark, ("C", at(1), 4), schema="plate string, seen timestamp_ntz, axles int")
    out = build(spark, spec, {"gate": changed}, target)
    assert out.columns == columns.split() and out.count() == 3
    assert {r["plate"]: r["axles"] for r in out.collect()} == {"A": None, "B": None, "C": 4}
    if "toll" in out.columns:
        assert {r["plate"]: r["toll"] for r in out.collect()} == {"A": 1.0, "B": 2.0, "C": None}


def test_a_merge_leaves_columns_it_was_not_given(spark, target):
    spec = recipe(output=keyed("merge"))
    build(spark, spec, {"gate": passes(spark, ("A", 1, at(0), 1.5), ("B", 2, at(0), 2.5))}, target)
    fewer = passes(spark, ("A", at(1)), ("C", at(1)), schema="plate string, seen timestamp_ntz")
    out = build(spark, spec, {"gate": fewer}, target)
    assert {r["plate"]: (r["seen"], r["toll"]) for r in out.collect()} == {
        "A": (at(1), 1.5), "B": (at(0), 2.5), "C": (at(1), None),
    }


def test_columns_that_may_not_change(spark, target):
    def load(policy, frame):
        return build(spark, recipe(output=keyed(on_schema_change=policy)), {"gate": frame}, target)

    load("fail", passes(spark, ("A", 1, at(0), 1.0)))
    wider = passes(spark, ("B", 1, at(1), 1.0, 3), schema=PASSES + ", axles int")
    for frame, change in (
        (wider, "added axles"), (wider.drop("axles", "lane"), "missing lane"),
        (passes(spark, ("B", "x", at(1), 1.0), schema=PASSES.replace("int", "string")), "retyped lane"),
    ):
        with pytest.raises(RecipeError, match=change):
            load("fail", frame)
    assert load("ignore", wider).columns == ["plate", "lane", "seen", "toll"]
    later = passes(spark, ("C", at(2), 1.0), schema="plate string, seen timestamp_ntz, toll double")
    with pytest.raises(RecipeError, match="no longer has lane"):
        load("ignore", later)


# --------------------------------------------------------------------------------- guards


def one_row(keys=("plate",), by=(("seen", True),)):
    order = [{"column": c, "descending": d} for c, d in by]
    return [("dedup_key", {"keys": list(keys), "order_by": order})]


def spread(keys=("plate",), value="toll"):
    return [("pivot", {"key_columns": list(keys), "name_column": "lane", "value_column": value, "values": [1], "prefix": "lane_"})]


def moved(*names):
    pairs = zip(names, names[1:])
    return [("rename", {"renames": [{"from": a, "to": b}]}) for a, b in pairs]


def by_slice(**more):
    settings = {"event_time": "seen", "begin": "2031-03-01", "batch_size": "day", **more}
    return {"incremental_strategy": "microbatch", "microbatch": {k: v for k, v in settings.items() if v is not None}}


_COUNTED = [("window_function", {"fn": "count", "into": "n"})]
_APPEND = {"incremental_strategy": "append"}
# What is refused, by what would go wrong.
GUARDS = {
    "settings nobody knows": [
        ({"output": {"incremental_strategy": "replace"}}, "Unknown incremental strategy"),
        ({"output": keyed(on_schema_change="guess")}, "Unknown on_schema_change"),
    ],
    "rows that could not be found again": [
        ({"output": {}}, "at least one unique key"),
        ({"output": keyed(keys=["driver"])}, "not in the output"),
        ({"output": keyed(), "steps": [("keep_delete", {"columns": ["plate"]})]}, "not in the output"),
    ],
    "bounds that compare unlike things": [
        ({"output": keyed(bound="noted")}, "does not exist"),
        ({"output": keyed(), "steps": [("keep_delete", {"columns": ["seen"]})]}, "not in the output"),
        ({"output": keyed(bound="toll"), "steps": [("round", {"column": "toll"})]}, "'round' recomputes"),
        ({"output": keyed(bound="toll"), "steps": [("fill_empty", {"column": "toll", "value": "0"})]}, "recomputes"),
        ({"output": keyed(), "steps": [("parse_date", {"column": "seen"})]}, "recomputes"),
        ({"output": keyed(bound="lane"), "steps": [("filter_value", {
            "column": "lane", "operator": "gt", "value": 5, "action": "clear"})]}, "recomputes"),
        ({"output": keyed(), "steps": [*moved("seen", "then"), ("formula", {"into": "seen", "expression": "then"})]}, "rebuilds"),
        ({"output": keyed(), "steps": [*moved("seen", "x"), *moved("toll", "seen")]}, "rebuilds"),
    ],
    "windows over arrivals alone": [
        ({"output": keyed(), "steps": _COUNTED}, "window function"),
        ({"output": {"unique_key": ["plate"]}, "steps": _COUNTED}, "window function"),
    ],
    "one row per key, from a part of its rows": [
        ({"output": keyed("append"), "steps": one_row()}, "One row per key"),
        ({"output": keyed(), "steps": one_row(["plate", "lane"])}, "must cover"),
        ({"output": keyed(keys=["plate", "lane"]), "steps": one_row()}, "may only hold"),
        ({"output": keyed(), "steps": one_row(by=[("seen", False)])}, "Sort by 'seen' descending"),
        ({"output": keyed(), "steps": one_row(by=[("toll", True), ("seen", True)])}, "Sort by 'seen' descending"),
        ({"output": by_slice(), "steps": one_row()}, "One row per key"),
    ],
    "cells of a pivot in two loads": [
        ({"output": {"unique_key": ["lane_1"]}, "steps": spread([])}, "without key columns"),
        ({"output": _APPEND, "steps": spread()}, "removes none"),
        ({"output": {"unique_key": ["plate"]}, "steps": spread(["plate", "seen"])}, "must cover"),
        ({"output": keyed(keys=["plate"]), "steps": spread(["plate"], "seen")}, "not in the output|could receive"),
    ],
    "rows read twice": [
        ({"output": keyed("append", bound_by={"operator": "gte"})}, "second time"),
        ({"output": keyed("append", bound_by={"lookback": {"n": 3}})}, "cannot go with 'append'"),
        ({"output": keyed(bound_by={"lookback": {"n": -3}})}, "negative"),
        ({"output": keyed(bound_by={"lookback": {"n": "few"}})}, "whole number"),
        ({"output": keyed(bound_by={"lookback": {"n": 3, "unit": "minute"}})}, "lookback unit"),
    ],
    "slices without an edge": [
        ({"output": by_slice(event_time=None)}, "needs a time column"),
        ({"output": by_slice(begin=None)}, "start date"),
        ({"output": by_slice(begin="soon")}, "Invalid start"),
        ({"output": by_slice(batch_size="decade")}, "slice size"),
        ({"output": by_slice(lookback=-2)}, "negative"),
        ({"output": by_slice(lookback=0.5)}, "whole number"),
        ({"output": by_slice(event_time="noted")}, "time column 'noted' is not in the output"),
    ],
    "bounds that cannot be placed": [
        ({"kind": "sql", "sql": "select * from {gate}", "output": keyed()}, "writes its own bound"),
        ({"kind": "stack", "inputs": ["gate", "lanes"], "output": keyed("append")}, "missing from 'lanes'"),
    ],
    "groups of arrivals": [
        ({"kind": "group", "group_by": [], "aggregations": [{"fn": "max", "column": "seen", "alias": "seen"}],
          "output": keyed(keys=["seen"])}, "at least one key"),
        ({"kind": "group", "group_by": ["plate"], "aggregations": [{"fn": "sum", "column": "toll", "alias": "t"}],
          "output": keyed()}, "is not in the output"),
        ({"kind": "group", "group_by": ["plate"], "aggregations": [{"fn": "min", "column": "seen", "alias": "seen"}],
          "output": keyed()}, "computed measure"),
        ({"kind": "group", "group_by": ["plate"], "output": keyed(), "aggregations": [
            {"fn": "max", "column": "seen", "alias": "seen", "filter": "toll > 0"}]}, "computed measure"),
        ({"kind": "group", "group_by": ["plate"], "aggregations": [{"fn": "max", "column": "seen", "alias": "seen"}],
          "output": keyed("append")}, "beside its previous"),
        ({"kind": "group", "group_by": ["plate", "seen"], "aggregations": [{"fn": "count", "alias": "n"}],
          "output": keyed()}, "must cover"),
        ({"kind": "group", "group_by": ["plate"], "aggregations": [{"fn": "max", "column": "seen", "alias": "seen"}],
          "output": keyed(keys=["plate", "seen"])}, "may only hold"),
    ],
    "rows a join would give back": [
        ({"kind": "join", "inputs": ["gate", "lanes"], "joins": [{"type": kind, "on": [{"left": "lane", "right": "lane"}]}],
          "output": keyed("append")}, "already written would come back")
        for kind in ("right", "full")
    ] + [
        ({"kind": "join", "inputs": ["gate", "lanes"], "joins": [{"on": [{"left": "lane", "right": "lane"}]}],
          "select": chosen, "output": keyed("append", keys=[], bound="lane")}, "must come from 'gate'")
        for chosen in ([{"from": "lanes", "column": "lane"}], [{"from": "gate", "column": "seen", "as": "lane"}])
    ],
}


@pytest.mark.parametrize("why, case", [(why, case) for why, cases in GUARDS.items() for case in cases])
def test_refused_before_anything_is_read(spark, why, case):
    settings, message = case
    data = {
        "gate": passes(spark, ("A", 1, at(0), 1.0)),
        "lanes": spark.createDataFrame([(1, "car")], "lane int, use string"),
    }
    with pytest.raises(RecipeError, match=message):
        run_recipe(spark, recipe(**settings), data)


def test_a_bound_may_travel(spark):
    spec = recipe(steps=moved("seen", "x", "y", "seen"), output=keyed())
    assert run_recipe(spark, spec, {"gate": passes(spark, ("A", 1, at(0), 1.0))}).count() == 1
