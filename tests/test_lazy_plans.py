"""What runs before an action, and what stays behind after one."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline import RecipeTable, build, preview, run_recipe
from plumbline.plans import build as building
from plumbline.operators.joins import equi_join

TANKS = "tank string, hour int, level double"
STEPS = [
    {"type": "window_function", "params": {"fn": fn, "into": f"w_{fn}", "column": "level",
     "partition_by": ["tank"], "order_by": [{"column": "hour"}]}}
    for fn in ("running_sum", "lag")
] + [
    {"type": "window_function", "params": {"fn": "avg", "into": "mean", "column": "level",
     "partition_by": ["tank"]}},
    {"type": "dedup_key", "params": {"keys": ["tank", "hour"], "ties": "all",
     "order_by": [{"column": "level"}]}},
]


@pytest.fixture(scope="module")
def tanks(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(rng.choice("aaaab"), h, float(rng.randint(0, 9))) for h in range(200)]
    where = str(tmp_path_factory.mktemp("tanks") / "tanks")
    spark.createDataFrame(rows, TANKS).write.parquet(where)
    return spark.read.schema(TANKS).parquet(where)


def _jobs(spark, described):
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "described")
    try:
        out = described()
        return out, len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def _shared_folders(spark):
    where = spark.sparkContext.getCheckpointDir()
    if where is None:
        return set()
    return {p.name for p in Path(where.removeprefix("file:")).iterdir() if p.name.startswith("rows-")}


def _recipe(**output):
    return {"name": "levels", "type": "prepare", "inputs": [{"ref": "t"}], "steps": STEPS,
            "output": output}


def test_previews_and_views_run_nothing_before_they_are_read(spark, tanks, small_groups):
    whole = sorted(map(tuple, run_recipe(spark, _recipe(), {"t": tanks}).collect()), key=repr)
    before = _shared_folders(spark)
    with small_groups(20):
        shown, jobs = _jobs(spark, lambda: preview(spark, _recipe(), {"t": tanks}, limit=1_000))
        assert jobs == 0
        view, jobs = _jobs(spark, lambda: build(spark, _recipe(materialized="view"), {"t": tanks}))
        assert jobs == 0
        joined, jobs = _jobs(spark, lambda: equi_join(tanks, tanks.toDF("x", "y", "z"), [("tank", "x")], "full"))
        assert jobs == 0
    assert _shared_folders(spark) == before
    assert sorted(map(tuple, shown.collect()), key=repr) == whole
    assert sorted(map(tuple, view.collect()), key=repr) == whole


def test_a_written_table_leaves_no_settled_rows(spark, tanks, small_groups, target):
    whole = sorted(map(tuple, run_recipe(spark, _recipe(), {"t": tanks}).collect()), key=repr)
    before = _shared_folders(spark)
    with small_groups(20):
        table = build(spark, _recipe(materialized="table"), {"t": tanks}, target)
    assert _shared_folders(spark) == before
    assert sorted(map(tuple, table.collect()), key=repr) == whole


@pytest.mark.parametrize("kind", ["left", "right", "full"])
def test_salted_outer_joins(spark, small_groups, kind):
    rng = random.Random(kind)
    keys = [None, "h", "h", "h", "g", "g", "a", "b", "c"]
    a = [(rng.choice([*keys, "only a"]), rng.choice([1, 2]), i) for i in range(140)]
    b = [(rng.choice([*keys, "only b", "only b"]), rng.choice([1, 2]), i) for i in range(160)]
    a += [("left hot", 1, 900 + i) for i in range(40)] + [("one", 1, 990)]
    b += [("right hot", 2, 900 + i) for i in range(40)] + [("left hot", 1, 980), ("one", 1, 990)]
    left = spark.createDataFrame(a, "k string, m int, x int").repartition(3)
    right = spark.createDataFrame(b, "l string, n int, y int").repartition(3)
    pairs = [("k", "l"), ("m", "n")]
    plain = left.join(right, (F.col("k") == F.col("l")) & (F.col("m") == F.col("n")), kind)
    expected = Counter(map(tuple, plain.collect()))
    for limit in (5, 12, 10_000):
        with small_groups(limit):
            assert Counter(map(tuple, equi_join(left, right, pairs, kind).collect())) == expected


def test_salts_split_a_hot_key(spark, small_groups):
    left = spark.createDataFrame([("h", 0)], "k string, x int")
    right = spark.range(400).select(F.lit("h").alias("l"), "id").repartition(4)
    with small_groups(50):
        plan = equi_join(left, right, [("k", "l")], "left")
        assert plan.count() == 400 and plan.filter("l is null").count() == 0


def _slices(concurrent):
    return {
        "name": "ticks", "type": "sql", "sql": "select *, count(*) over () as n from {t}",
        "inputs": [{"ref": "t", "event_time": "at"}],
        "output": {"materialized": "incremental", "incremental_strategy": "microbatch",
                   "microbatch": {"event_time": "at", "begin": "2031-05-01", "batch_size": "day",
                                  "concurrent_batches": concurrent}},
    }


def test_slices_run_beside_each_other(spark, tmp_path, monkeypatch):
    from datetime import datetime, timedelta

    start = datetime(2031, 5, 1, 3)
    rows = [(i, start + timedelta(hours=7 * i)) for i in range(30)]
    ticks = spark.createDataFrame(rows, "id int, at timestamp_ntz")
    running, most, tried, lock = 0, 0, Counter(), threading.Lock()
    write = building._write_slices

    def watched(table, made, out, plan, low, high):
        nonlocal running, most
        with lock:
            running, most = running + 1, max(most, running + 1)
            tried[low] += 1
        try:
            time.sleep(0.3)
            if low.day == 4 and tried[low] == 1:
                raise OSError("lost")
            write(table, made, out, plan, low, high)
        finally:
            with lock:
                running -= 1

    monkeypatch.setattr(building, "_write_slices", watched)
    found = {}
    for concurrent in (True, False):
        where, most = str(tmp_path / str(concurrent)), 0
        if not concurrent:
            tried[datetime(2031, 5, 4)] = 1
        build(spark, _slices(concurrent), {"t": ticks}, where, now=datetime(2031, 5, 9, 23))
        found[concurrent] = sorted(map(tuple, RecipeTable(spark, where).read().collect()))
        assert (most > 1) == concurrent
    assert found[True] == found[False] and len(found[True]) == 30
    assert tried[datetime(2031, 5, 4)] == 2
