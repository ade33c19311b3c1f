from __future__ import annotations

import random
from datetime import date, datetime

import pytest

from plumbline import (
    DataTestFailure,
    RecipeError,
    declared_tests,
    diagnose_join,
    enforce,
    failing_rows,
    freshness,
    full_profile,
    join_findings,
    profile_delta,
    profile_of_change,
    quality_profile,
    read_csv,
    run_recipe,
    run_tests,
    sample_failing_rows,
)
from plumbline.functions.patterns import looks_like
from plumbline.quality.profiles import profiled_columns
from tests.helpers import column, rows, steps

# ------------------------------------------------------------------------- data tests


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "a"), (1, "b"), (None, "b"), (3, None)], "id int, kind string")


TESTS = [
    ({"name": "not_null", "column": "id"}, [(None, "b")], 1),
    ({"name": "unique", "column": "id"}, [(1, 2)], 1),
    ({"name": "accepted_values", "column": "kind", "values": ["a"]}, [("b", 2)], 1),
    ({"name": "accepted_values", "column": "id", "values": ["1", "3"]}, [], 0),
    ({"name": "relationships", "column": "id", "to": "parents"}, [(1,), (1,)], 2),
    ({"name": "relationships", "column": "id", "to": "parents", "field": "other"}, [(3,)], 1),
]


@pytest.mark.parametrize("test, expected, n", TESTS)
def test_failing_rows(spark, people, test, expected, n):
    parents = spark.createDataFrame([(3, 1), (3, 1), (None, None)], "id int, other int")
    assert rows(failing_rows(people, test, {"parents": parents})) == expected
    (result,) = run_tests(people, [test], {"parents": parents}).collect()
    assert (result["failures"], result["status"]) == (n, "fail" if n else "pass")


def test_suite_and_severity(spark, people):
    suite = [
        {"name": "not_null", "column": "id", "severity": "warn"},
        {"name": "not_null", "column": "kind", "severity": "warn"},
        {"name": "unique", "column": "kind", "severity": "warn"},
        {"name": "accepted_values", "column": "kind", "values": ["a", "b"]},
    ]
    results = run_tests(people, suite)
    assert rows(results) == sorted(
        [
            ("not_null", "id", "warn", 1, "warn"),
            ("not_null", "kind", "warn", 1, "warn"),
            ("unique", "kind", "warn", 1, "warn"),
            ("accepted_values", "kind", "error", 0, "pass"),
        ]
    )
    assert enforce(results) is results
    with pytest.raises(DataTestFailure, match=r"unique\(kind\): 1"):
        enforce(run_tests(people, [{"name": "unique", "column": "kind"}]))


def test_tests_declared_on_output_columns(spark, people):
    columns = [
        {"name": "id", "tests": ["not_null", {"name": "unique", "severity": "warn"}]},
        {"name": "kind", "description": "free text"},
    ]
    found = declared_tests({"output": {"columns": columns}})
    assert column(run_tests(people, found), "status") == ["fail", "warn"]
    with pytest.raises(RecipeError, match="lists no value"):
        declared_tests({"output": {"columns": [{"name": "id", "tests": ["accepted_values"]}]}})


def test_samples_are_limited(people):
    test = {"name": "not_null", "column": "id"}
    assert sample_failing_rows(people, test, limit=1).count() == 1
    with pytest.raises(RecipeError, match="1 to 5000"):
        sample_failing_rows(people, test, limit=0)


@pytest.mark.parametrize(
    "test, message",
    [
        ({"name": "accepted_values", "column": "id", "values": [" "]}, "lists no value"),
        ({"name": "relationships", "column": "id"}, "what to point to"),
        ({"name": "relationships", "column": "id", "to": "x"}, "not available"),
        ({"name": "positive", "column": "id"}, "Unknown test"),
        ({"name": "unique", "column": "zip"}, "does not exist"),
        ({"name": "unique", "column": "id", "severity": "info"}, "Unknown severity"),
    ],
)
def test_test_refusals(people, test, message):
    with pytest.raises(RecipeError, match=message):
        failing_rows(people, test, {})


# -------------------------------------------------------------------------- freshness


@pytest.mark.parametrize(
    "settings, status",
    [
        ({}, "pass"),
        ({"warn_after": {"count": 12, "period": "hour"}}, "warn"),
        ({"warn_after": {"count": 2, "period": "day"}}, "pass"),
        ({"warn_after": {"count": 1, "period": "minute"}, "error_after": {"count": 1, "period": "day"}}, "error"),
    ],
)
def test_freshness(spark, settings, status):
    df = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 2),)], "d date")
    now = datetime(2024, 1, 3, 0, 0, 1)
    settings = {"loaded_at_field": "cast(d as timestamp_ntz)", **settings}
    (row,) = freshness(df, settings, now).collect()
    assert tuple(row) == (datetime(2024, 1, 2), now, 86_401, status)


def test_freshness_refusals_and_no_rows(spark):
    df = spark.createDataFrame([], "d timestamp_ntz")
    (row,) = freshness(df, {"loaded_at_field": "d", "warn_after": {"count": 1}}).collect()
    assert row["status"] == "error"
    for settings, message in [
        ({"warn_after": {"count": 1}}, "loaded_at_field"),
        ({"loaded_at_field": "d", "warn_after": {"count": 0}}, "positive"),
        ({"loaded_at_field": "d", "warn_after": {"count": "x"}}, "whole number"),
        ({"loaded_at_field": "d", "error_after": {"count": 1, "period": "week"}}, "unknown period"),
    ]:
        with pytest.raises(RecipeError, match=message):
            freshness(df, settings)


# --------------------------------------------------------------------------- profiles

SAMPLES = {
    "email": ["a@b.fr", "Jean.D@Ex-ample.COM"],
    "url": ["http://a.b", "HTTPS://x"],
    "ip": ["10.0.0.1", "::1", "2001:db8::8a2e:370:7334"],
    "date": ["2024-01-02", "2024-01-02 03:04"],
    "country": ["FR", "ES"],
    "integer": ["1", "-22"],
    "decimal": ["1.5", "2,5", "1e3"],
    "boolean": ["true", "non", "1"],
    "text": ["bob", "ada lovelace"],
}


def test_meanings_of_text(spark):
    n = max(map(len, SAMPLES.values()))
    data = list(zip(*[(v * n)[:n] for v in SAMPLES.values()], strict=True))
    df = spark.createDataFrame(data, ", ".join(f"`{k}` string" for k in SAMPLES))
    found = {r["column"]: r["meaning"] for r in quality_profile(df).collect()}
    assert found == {k: k for k in SAMPLES}


def test_quality_bar(spark):
    df = spark.createDataFrame([(f"a{i}@b.fr",) for i in range(9)] + [("nope",), (None,), (" \t",)], "x string")
    (r,) = quality_profile(df).collect()
    assert (r["meaning"], r["n_ok"], r["n_nok"], r["n_empty"]) == ("email", 9, 1, 2)
    assert (r["ok"], r["empty"], r["nok"]) == (75.0, 16.7, 8.3)


def test_a_minority_is_text(spark):
    df = spark.createDataFrame([("a@b.fr",), *[(n,) for n in "abcde"]], "x string")
    assert quality_profile(df).first()["meaning"] == "text"


def test_typed_columns_and_no_rows(spark):
    schema = "i int, b bigint, d decimal(5,2), f double, t timestamp_ntz, j date, o boolean, s string"
    df = spark.createDataFrame([], schema)
    got = [(r["column"], r["storage"], r["meaning"], r["n_ok"]) for r in quality_profile(df).orderBy("position").collect()]
    assert got == [
        ("i", "int", "integer", 0),
        ("b", "bigint", "integer", 0),
        ("d", "decimal", "decimal", 0),
        ("f", "double", "decimal", 0),
        ("t", "date", "datetime", 0),
        ("j", "date", "date", 0),
        ("o", "boolean", "boolean", 0),
        ("s", "string", "text", 0),
    ]
    one = spark.createDataFrame([(1, 2, None, float("nan"), datetime(2024, 1, 1), date(2024, 1, 1), True, "x")], schema)
    assert [r["n_ok"] for r in quality_profile(one).orderBy("position").collect()] == [1, 1, 0, 0, 1, 1, 1, 1]
    assert quality_profile(one, sample=200).count() == 8


VALID = {
    "date": [
        "2024-02-29", "2024-01-02 03:04", "2024-01-02T03:04:05", "2024-01-02T03:04:05.123456789",
        "2024-01-02T03:04:05Z", "2024-01-02 03:04:05+0200", "2024-01-02 03:04:05.5-05:00",
    ],
    "ip": ["1.2.3.4", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "fe80::1%eth0", "1:2:3:4:5:6:1.2.3.4"],
}
INVALID = {
    "date": ["2026-02-30", "2026-99-99", "20260913", "2024-01-02 25:00", "2024-1-2", "2024-01-02Z", "0000-01-01", "2024-01-02 03:04+99:00"],
    "ip": ["999.999.999.999", "1.2.3", "01.2.3.4", "1:2:3:4:5:6:7", "1::2::3", "1:2:3:4:5:6:7:8:9", "12345::", ":::", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%"],
}


@pytest.mark.parametrize("meaning", ["date", "ip"])
def test_dates_and_addresses(spark, meaning):
    from pyspark.sql import functions as F

    for values, expected in ((VALID[meaning], True), (INVALID[meaning], False)):
        df = spark.createDataFrame([(v,) for v in values], "x string")
        got = {r["x"]: r["ok"] for r in df.select("x", looks_like(meaning, F.col("x")).alias("ok")).collect()}
        assert got == dict.fromkeys(values, expected)


def test_full_profile(spark):
    data = [(9, "oak", -0.0, True), (7, " ", 0.0, None), (7, None, None, None), (-2, "ash", 1.5, True), (9, "", 0.5, True)]
    frame = spark.createDataFrame(data, "age int, tree string, girth double, felled boolean")
    found = {r["column"]: r for r in full_profile(frame).collect()}
    for place, name in enumerate(frame.columns):
        values = [r[place] for r in data]
        blank = [v for v in values if v is None or isinstance(v, str) and not v.strip(" ")]
        got = found[name]
        assert (got["filled"], got["empty"]) == (len(values) - len(blank), len(blank))
        known = {v for v in values if v is not None}
        assert got["distinct"] == len(known)
        if name != "girth":
            ends = [str(v).lower() if isinstance(v, bool) else str(v) for v in (min(known), max(known))]
            assert [got["min"], got["max"]] == ends


def test_full_profile_covers_every_column(spark):
    schema = ", ".join([*(f"c{i} int" for i in range(70)), "a array<int>", "m map<string,int>"])
    df = spark.createDataFrame([], schema)
    kept, left = profiled_columns(df)
    assert len(kept) == 70 and left == ["a", "m"]
    assert [r["position"] for r in full_profile(df).sort("position").collect()] == [*range(70)]


def test_long_texts_are_told_apart(spark):
    long = "x" * 500
    values = [long + "a", long + "b", long + "a", "short", None, "f" * 64, "f" * 63]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    (found,) = full_profile(df).collect()
    assert (found["distinct"], found["filled"]) == (5, 6)


@pytest.mark.parametrize("before, after", [(40, 31), (31, 40), (40, 40), (0, 6), (8, 0)])
def test_profile_delta(spark, before, after):
    """Rows that came or went, or, of as many rows, the values that became empty."""

    def profile(total, empty):
        data = [(c, total, total - min(n, total), min(n, total)) for c, n in empty.items()]
        return spark.createDataFrame(data, "column string, total bigint, filled bigint, empty bigint")

    found = rows(profile_delta(profile(before, {"a": 3, "b": 5, "c": 4}), profile(after, {"a": 7, "b": 5, "c": 1, "d": 9})))
    if before == after:
        assert found == [("emptied", "a", 3, 7, None)]
    elif not before:
        assert found == []
    else:
        kind = "rows_removed" if after < before else "rows_added"
        share = round(100 * abs(after - before) / before, 1)
        assert found == [(kind, None, before, after, share)]


SEEDS = {
    "raw_customers": "customer_id,first_name,country\n1,Ada,fr\n2,Alan,uk\n3,Grace,us\n",
    "raw_orders": "order_id,customer_id,status,amount_eur\n1,1,completed,10.5\n2,1,pending,5\n"
    "3,2,completed,7\n4,2,completed,1.25\n5,9,cancelled,3\n",
}


@pytest.fixture
def seeds(spark, tmp_path):
    found = {}
    for name, text in SEEDS.items():
        (tmp_path / f"{name}.csv").write_text(text)
        found[name] = read_csv(spark, str(tmp_path / f"{name}.csv"))
    return found


def test_seeds_to_mart(spark, seeds):
    typed = seeds["raw_orders"]
    assert typed.schema["amount_eur"].dataType.simpleString() == "double"
    joined = run_recipe(
        spark,
        {"type": "join", "inputs": [{"ref": "raw_customers", "alias": "c"}, {"ref": "raw_orders", "alias": "o"}],
         "joins": [{"on": [{"left": "customer_id", "right": "customer_id"}]}]},
        seeds,
    )
    out = run_recipe(
        spark,
        {"type": "group", "inputs": [{"ref": "j"}], "group_by": ["customer_id"],
         "aggregations": [{"fn": "count", "column": "order_id", "alias": "n"},
                          {"fn": "sum", "column": "amount_eur", "alias": "done", "filter": "status = 'completed'"}]},
        {"j": joined},
    )
    assert rows(out) == [(1, 2, 10.5), (2, 2, 8.25), (3, 0, None)]


def test_profile_of_a_recipe(spark, seeds):
    orders = seeds["raw_orders"]
    keep = {"column": "status", "value": "completed"}
    kept = steps(spark, orders, ("filter_value", {**keep, "action": "keep"}))
    assert rows(profile_of_change(orders, kept)) == [("rows_removed", None, 5, 3, 40.0)]
    cleared = steps(spark, orders, ("filter_value", {**keep, "action": "clear"}))
    assert rows(profile_of_change(orders, cleared)) == [("emptied", "status", 0, 3, None)]
    status = full_profile(orders).filter("column = 'status'").first()
    assert (status["distinct"], status["min"], status["max"]) == (3, "cancelled", "pending")


# ---------------------------------------------------------------------- join diagnosis


def diagnosis(spark, a, b, kind="left"):
    datasets = {
        "commandes": spark.createDataFrame(a, "id int, k int"),
        "clients": spark.createDataFrame([(k,) for k in b], "k int"),
    }
    spec = {
        "type": "join",
        "inputs": [{"ref": "commandes"}, {"ref": "clients"}],
        "joins": [{"type": kind, "on": [] if kind == "cross" else [{"left": "k", "right": "k"}]}],
    }
    real = run_recipe(spark, spec, datasets).count()
    (row,) = diagnose_join(spark, spec, datasets).collect()
    assert row["output_rows"] == real
    return row, {(f["level"], f["kind"]) for f in join_findings(spark, spec, datasets)}


def test_fan_out(spark):
    row, found = diagnosis(spark, [(1, 10), (2, 11)], [10, 10, 10, 11])
    assert (row["driver_rows"], row["output_rows"]) == (2, 4)
    assert found == {("bad", "fan_out"), ("bad", "1-N")}


def test_one_to_one(spark):
    assert diagnosis(spark, [(1, 10)], [10])[1] == {("ok", "same"), ("ok", "1-1")}


@pytest.mark.parametrize(
    "kind, fates",
    [
        ("left", {("warn", "orphans_kept"), ("bad", "orphans_dropped")}),
        ("inner", {("bad", "orphans_dropped")}),
        ("right", {("warn", "orphans_kept"), ("bad", "orphans_dropped")}),
        ("full", {("warn", "orphans_kept")}),
    ],
)
def test_orphans_and_null_keys(spark, kind, fates):
    row, found = diagnosis(spark, [(1, 10), (2, 99), (3, None)], [10, 55, None], kind)
    assert (row["driver_orphans"], row["joined_orphans"]) == (2, 2)
    assert (row["driver_nulls"], row["joined_nulls"]) == (1, 1)
    assert (row["driver_keys"], row["driver_max"]) == (2, 1)
    assert fates <= found and ("warn", "null_keys") in found


def test_many_to_many_cross_and_empty(spark):
    assert ("bad", "N-N") in diagnosis(spark, [(1, 10), (2, 10)], [10, 10])[1]
    assert diagnosis(spark, [(1, 1), (2, 1)], [1])[1] == {("ok", "same"), ("ok", "N-1")}
    assert ("bad", "cross") in diagnosis(spark, [(1, 10)], [1, 2], "cross")[1]
    assert ("warn", "empty") in diagnosis(spark, [], [1])[1]


def test_lost_rows_count_nulls_once_each(spark):
    row, found = diagnosis(spark, [(1, None)] * 3, [None] * 4, "full")
    assert row["output_rows"] == 7 and row["driver_max"] == 0 and ("ok", "1-1") in found


@pytest.mark.parametrize("seed", range(6))
def test_rows_of_a_chain_without_running_it(spark, seed):
    rng = random.Random(seed)
    kinds = ["inner", "left", "right", "full", "cross"]

    def some(n):
        return [(rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2])) for _ in range(n)]

    datasets = {n: spark.createDataFrame(some(rng.randint(3, 8)), "x int, y int") for n in "abcd"}
    joins = []
    for _ in range(3):
        kind = rng.choice(kinds)
        on = [{"left": c, "right": c} for c in rng.choice([["x"], ["y"], ["x", "y"]])]
        joins.append({"type": kind, "on": [] if kind == "cross" else on})
    spec = {"type": "join", "inputs": [{"ref": n} for n in "abcd"], "joins": joins}
    real = run_recipe(spark, spec, datasets).count()
    found = diagnose_join(spark, spec, datasets)
    assert column(found, "output_rows") == [real] * 3, joins


def test_diagnosis_refusals(spark, parcels):
    with pytest.raises(RecipeError, match="at least two"):
        diagnose_join(spark, {"type": "prepare", "inputs": [{"ref": "o"}]}, {"o": parcels})
