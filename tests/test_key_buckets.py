"""Loads into tables stored in buckets of their key, against a model kept in Python."""

from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline import RecipeError, RecipeTable, build, load_arrivals
from plumbline.sources import tables
from tests.helpers import rows

METERS = "meter string, zone int, day int, reading double"


def _loading(output, **more):
    return {
        "name": "meters",
        "type": "prepare",
        "inputs": [{"ref": "m"}],
        "steps": [],
        "output": {"materialized": "incremental", **output},
        **more,
    }


@pytest.fixture
def small_buckets(spark):
    spark.conf.set("spark.plumbline.bucketBytes", "4000")
    yield
    spark.conf.unset("spark.plumbline.bucketBytes")


def _delivery(rng, day, count, keys):
    chosen = rng.sample(range(keys), count)
    return [
        (f"m{k}" if k % 17 else None, k % 3, day, float(rng.randint(0, 50))) for k in chosen
    ]


@pytest.mark.parametrize("strategy", ["merge", "delete+insert"])
def test_loads_leave_what_the_model_has(spark, target, small_buckets, strategy):
    rng = random.Random(len(strategy))
    spec = _loading({
        "incremental_strategy": strategy, "unique_key": ["meter", "zone"],
        "incremental": {"column": "day"},
    })
    known, unkeyed, seen, counts = {}, [], [], []
    for day in range(1, 6):
        fresh = _delivery(rng, day, 200 + 300 * day, 5_000)
        seen += fresh
        build(spark, spec, {"m": spark.createDataFrame(seen, METERS)}, target)
        for r in fresh:
            if r[0] is None:
                unkeyed.append(r)
            else:
                known[r[:2]] = r
        table = RecipeTable(spark, target)
        found = Counter(map(tuple, table.read().collect()))
        assert found == Counter([*known.values(), *unkeyed])
        counts.append(len(table.layout().buckets))
    assert counts[-1] > counts[0] >= 1 and counts == sorted(counts)


def test_a_load_reads_and_writes_the_buckets_of_its_keys(spark, target):
    spec = _loading({
        "incremental_strategy": "merge", "unique_key": ["meter"], "incremental": {"column": "day"},
    })
    first = [(f"m{k}", 1, 1, 1.0) for k in range(3_000)]
    spark.conf.set("spark.plumbline.bucketBytes", "2500")
    try:
        frame = spark.createDataFrame(first[:2_999], METERS)
        build(spark, spec, {"m": frame}, target)
        build(spark, spec, {"m": frame.union(spark.createDataFrame([("m2999", 1, 2, 1.0)], METERS))}, target)
    finally:
        spark.conf.unset("spark.plumbline.bucketBytes")
    table = RecipeTable(spark, target)
    before = table.layout()
    assert len(before.buckets) >= 4
    more = first + [("m7", 1, 3, 9.0)]
    build(spark, spec, {"m": spark.createDataFrame(more, METERS)}, target)
    after = table.layout()
    changed = [b for b in range(len(after.buckets)) if after.buckets[b] != before.buckets[b]]
    assert len(changed) == 1
    place = spark.createDataFrame([("m7",)], "meter string").select(
        tables.bucket_of(["meter"], table.schema(), len(after.buckets)).alias("b")
    )
    assert changed == [place.first()["b"]]
    read = table.read_stored(changed).inputFiles()
    assert all(f"{tables.BUCKET}={changed[0]}/" in f for f in read)
    assert table.read().filter("meter = 'm7'").collect() == [("m7", 1, 3, 9.0)]
    assert table.read().count() == 3_000


def test_every_row_has_one_bucket_however_many_there_are(spark):
    frame = spark.range(3_000).select(F.col("id").cast("double").alias("k"))
    places = [
        [r[0] for r in frame.select(tables.bucket_of(["k"], frame.schema, n)).collect()]
        for n in range(1, 14)
    ]
    for n, (fewer, more) in enumerate(zip(places, places[1:]), 1):
        assert set(more) == set(range(n + 1))
        moved = {(a, b) for a, b in zip(fewer, more) if a != b}
        assert moved == {(tables.parent_bucket(n), n)}
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "k double")
    assert zeros.select(tables.bucket_of(["k"], zeros.schema, 13)).distinct().count() == 1


def test_a_failed_load_shows_nothing(spark, target):
    spec = _loading({"unique_key": ["meter"], "incremental": {"column": "day"}})
    build(spark, spec, {"m": spark.createDataFrame([("a", 1, 1, 1.0)], METERS)}, target)
    table = RecipeTable(spark, target)
    frame = spark.createDataFrame([("a", 1, 2, 2.0), ("b", 1, 2, 3.0)], METERS)
    broken = frame.withColumn(
        "reading", F.when(F.col("meter") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("reading"))
    )
    with pytest.raises(Exception, match="lost"):
        build(spark, spec, {"m": broken}, target)
    assert rows(table.read()) == [("a", 1, 1, 1.0)]
    append = _loading({"incremental_strategy": "append", "incremental": {"column": "day"}})
    with pytest.raises(Exception, match="lost"):
        build(spark, append, {"m": broken}, target)
    assert rows(table.read()) == [("a", 1, 1, 1.0)]
    build(spark, append, {"m": frame}, target)
    assert rows(table.read()) == [("a", 1, 1, 1.0), ("a", 1, 2, 2.0), ("b", 1, 2, 3.0)]


def test_readers_of_the_version_before_are_not_disturbed(spark, target):
    spec = _loading({"unique_key": ["meter"], "incremental": {"column": "day"}})
    data = [("a", 1, 1, 1.0), ("b", 1, 1, 2.0)]
    build(spark, spec, {"m": spark.createDataFrame(data, METERS)}, target)
    held = RecipeTable(spark, target).read()
    build(spark, spec, {"m": spark.createDataFrame([*data, ("a", 1, 2, 7.0)], METERS)}, target)
    assert rows(held) == data


def test_another_key_builds_the_buckets_anew(spark, target, small_buckets):
    data = [(f"m{k}", k % 5, 1, 0.0) for k in range(300)]
    one = _loading({"unique_key": ["meter"], "incremental": {"column": "day"}})
    build(spark, one, {"m": spark.createDataFrame(data, METERS)}, target)
    two = _loading({"unique_key": ["zone"], "incremental": {"column": "day"}})
    fresh = [("x", 2, 2, 5.0)]
    build(spark, two, {"m": spark.createDataFrame(data + fresh, METERS)}, target)
    table = RecipeTable(spark, target)
    assert table.layout().keys == ("zone",)
    assert rows(table.read()) == sorted([r for r in data if r[1] != 2] + fresh)


# -- groups from stored parts

FLOW = "pipe int, day int, amount decimal(8,2), count int, note string"
MEASURES = [
    {"fn": "count", "column": "*", "alias": "n"},
    {"fn": "count", "column": "note", "alias": "noted"},
    {"fn": "sum", "column": "amount", "alias": "total"},
    {"fn": "avg", "column": "amount", "alias": "mean"},
    {"fn": "avg", "column": "count", "alias": "mean_count", "filter": "count > 2"},
    {"fn": "min", "column": "note", "alias": "first_note"},
    {"fn": "max", "column": "day", "alias": "day"},
]


def _flows(append_only=True, measures=MEASURES, **more):
    return {
        "name": "flows", "type": "group", "inputs": [{"ref": "f"}], "group_by": ["pipe"],
        "aggregations": measures,
        "output": {
            "materialized": "incremental", "unique_key": ["pipe"],
            "incremental": {"column": "day", "append_only": append_only, **more},
        },
    }


def _flow_rows(rng, day, count):
    return [
        (
            rng.choice([None, *range(12)]) if rng.random() < 0.9 else 100 + day,
            day,
            None if rng.random() < 0.2 else Decimal(rng.randint(-999, 9999)) / 100,
            None if rng.random() < 0.2 else rng.randint(0, 9),
            None if rng.random() < 0.5 else f"n{rng.randint(0, 30)}",
        )
        for _ in range(count)
    ]


def _by_key(df):
    return sorted(map(repr, df.collect()))


def test_groups_merge_to_what_all_rows_give(spark, target, small_buckets):
    rng = random.Random(2)
    data = _flow_rows(rng, 1, 80)
    whole = _flows(append_only=False)
    for day in range(2, 6):
        frame = spark.createDataFrame(data, FLOW)
        got = build(spark, _flows(), {"f": frame}, target)
        expected = build(spark, whole, {"f": frame}, target + "-whole")
        assert got.columns == expected.columns
        assert _by_key(got) == _by_key(expected)
        data += _flow_rows(rng, day, 40)


def test_merging_reads_no_old_row(spark, target):
    frame = spark.createDataFrame(_flow_rows(random.Random(3), 1, 50), FLOW)
    before = build(spark, _flows(), {"f": frame}, target).filter("pipe = 3").first()
    # Old rows that would fail if they were read, and one new row.
    old = frame.filter("day < 0")
    new = spark.createDataFrame([(3, 9, Decimal("1.25"), 5, "zz")], FLOW)
    after = build(spark, _flows(), {"f": old.union(new)}, target).filter("pipe = 3").first()
    assert after["n"] == before["n"] + 1 and after["total"] == before["total"] + Decimal("1.25")
    assert after["day"] == 9


def test_measures_without_parts_read_their_groups(spark, target):
    rng = random.Random(4)
    measures = [*MEASURES, {"fn": "median", "column": "count", "alias": "middle"}]
    data = _flow_rows(rng, 1, 60)
    build(spark, _flows(measures=measures), {"f": spark.createDataFrame(data, FLOW)}, target)
    data += _flow_rows(rng, 2, 30)
    frame = spark.createDataFrame(data, FLOW)
    got = build(spark, _flows(measures=measures), {"f": frame}, target)
    fresh = build(spark, _flows(measures=measures), {"f": frame}, target + "-new")
    touched = {r[0] for r in data[60:]}
    pick = lambda df: [r for r in _by_key(df.filter(F.col("pipe").isin([t for t in touched if t])))]
    assert pick(got) == pick(fresh)


def test_a_new_measure_is_computed_from_all_rows_of_its_groups(spark, target):
    rng = random.Random(6)
    data = _flow_rows(rng, 1, 60)
    build(spark, _flows(measures=MEASURES[2:]), {"f": spark.createDataFrame(data, FLOW)}, target)
    data += [(p, 2, Decimal("1.00"), 1, "x") for p in range(12)]
    frame = spark.createDataFrame(data, FLOW)
    got = build(spark, _flows(), {"f": frame}, target)
    fresh = build(spark, _flows(), {"f": frame}, target + "-new")
    columns = sorted(got.columns)
    known = "pipe between 0 and 11"
    assert _by_key(got.filter(known).select(columns)) == _by_key(fresh.filter(known).select(columns))
    # And the groups merge again from then on.
    data += [(p, 3, Decimal("2.50"), 4, "a") for p in range(12)]
    frame = spark.createDataFrame(data, FLOW)
    got = build(spark, _flows(), {"f": frame}, target)
    fresh = build(spark, _flows(), {"f": frame}, target + "-newer")
    assert _by_key(got.filter(known).select(columns)) == _by_key(fresh.filter(known).select(columns))


@pytest.mark.parametrize("more", [{"operator": "gte"}, {"lookback": {"n": 2, "unit": "day"}}])
def test_rows_read_again_would_count_twice(spark, target, more):
    frame = spark.createDataFrame(_flow_rows(random.Random(5), 1, 5), FLOW)
    with pytest.raises(RecipeError, match="count twice"):
        build(spark, _flows(**more), {"f": frame}, target)


# -- streams

VISITS = "page string, at int"


def test_a_batch_delivered_twice_lands_once(spark, tmp_path):
    source, where, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    spec = {
        "name": "visits", "type": "prepare", "inputs": [{"ref": "v"}], "steps": [],
        "output": {"materialized": "incremental", "incremental_strategy": "append"},
    }
    visits = [("home", 1), ("help", 2), ("home", 1)]
    spark.createDataFrame(visits, VISITS).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    assert rows(load_arrivals(spark, spec, source, schema, where, state)) == sorted(visits)
    # The stream lost what it knew of its last batch, and delivers it a second time.
    for commit in (tmp_path / "state" / "commits").iterdir():
        if commit.name == "0":
            commit.rename(tmp_path / "forgotten")
        elif commit.name == ".0.crc":
            commit.rename(tmp_path / "forgotten.crc")
    assert rows(load_arrivals(spark, spec, source, schema, where, state)) == sorted(visits)
    assert RecipeTable(spark, where).mark(state) == 0
    spark.createDataFrame([("faq", 3)], VISITS).coalesce(1).write.mode("append").parquet(source)
    assert rows(load_arrivals(spark, spec, source, schema, where, state)) == sorted([*visits, ("faq", 3)])
    spec["output"]["partition_by"] = ["page"]
    with pytest.raises(RecipeError, match="without 'partition_by'"):
        load_arrivals(spark, spec, source, schema, where, state)


@pytest.mark.parametrize(
    "old, new, kept",
    [
        ("int", "bigint", True), ("float", "double", True), ("int", "double", True),
        ("decimal(6,2)", "decimal(9,3)", True), ("date", "timestamp_ntz", True),
        ("bigint", "int", False), ("decimal(9,3)", "decimal(6,2)", False),
        ("bigint", "double", False), ("int", "string", False),
    ],
)
def test_widened_types_write_no_old_row(spark, target, old, new, kept):
    spec = _loading({
        "unique_key": ["meter"], "incremental": {"column": "day"},
        "on_schema_change": "sync_all_columns",
    })
    value = "date'2030-01-02'" if old == "date" else "7"
    first = spark.sql(f"select 'a' as meter, 1 as day, cast({value} as {old}) as v")
    build(spark, spec, {"m": first.union(first.replace("a", "b"))}, target)
    table = RecipeTable(spark, target)
    loads = {n for b in table.layout().buckets for n in b}
    later = spark.sql(f"select 'c' as meter, 2 as day, cast({value} as {new}) as v")
    strategy = {**spec, "output": {**spec["output"], "incremental_strategy": "append"}}
    build(spark, strategy, {"m": later}, target)
    found = table.read()
    assert found.schema["v"].dataType.simpleString() == new
    assert found.count() == 3 and found.select("v").distinct().count() == 1
    assert (loads <= {n for b in table.layout().buckets for n in b}) == kept


def test_a_key_of_another_type_moves_its_rows(spark, target, small_buckets):
    spec = _loading({
        "unique_key": ["zone"], "incremental": {"column": "day"},
        "on_schema_change": "sync_all_columns",
    })
    data = [(f"m{k}", k, 1, 1.0) for k in range(600)]
    build(spark, spec, {"m": spark.createDataFrame(data, METERS)}, target)
    wide = METERS.replace("zone int", "zone long")
    data += [("new", k, 2, 2.0) for k in range(0, 600, 7)]
    build(spark, spec, {"m": spark.createDataFrame(data, wide)}, target)
    data += [("newer", k, 3, 3.0) for k in range(0, 600, 5)]
    out = build(spark, spec, {"m": spark.createDataFrame(data, wide)}, target)
    latest = {r[1]: r for r in data}
    assert Counter(map(tuple, out.collect())) == Counter(latest.values())
