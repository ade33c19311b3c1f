"""Data tests: which rows break a rule, and a whole suite as one small result.

The meaning of each test follows the public documentation of the build tool they come from.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import DataTestFailure, RecipeError
from ..functions.names import col, require
from ..functions.types import literal

# Fixed values.
TESTS = ("not_null", "unique", "accepted_values", "relationships")
SEVERITIES = ("error", "warn")
SAMPLE_ROWS = 200
SAMPLE_MAX_ROWS = 5_000


def check_test(test: dict) -> dict:
    """A test that can run: known, and with the values or target it needs."""
    name, where = test.get("name"), f" on column '{test.get('column')}'"
    if name not in TESTS:
        raise RecipeError(f"Unknown test: {name}. Choose among {', '.join(TESTS)}.")
    severity = str(test.get("severity") or "error").lower()
    if severity not in SEVERITIES:
        raise RecipeError(f"Unknown severity{where}: {severity}.")
    if name == "accepted_values" and not _accepted(test):
        raise RecipeError(f"The accepted_values test{where} lists no value.")
    if name == "relationships" and not str(test.get("to") or "").strip():
        raise RecipeError(f"The relationships test{where} does not say what to point to.")
    return test


def declared_tests(spec: dict) -> list[dict]:
    """The tests a recipe declares on its output columns, ready for ``run_tests``."""
    found = []
    for column in (spec.get("output") or {}).get("columns") or []:
        for test in column.get("tests") or []:
            test = {"name": test} if isinstance(test, str) else dict(test)
            found.append(check_test({**test, "column": column.get("name")}))
    return found


def _accepted(test: dict) -> list:
    return [v for v in test.get("values") or [] if str(v).strip() != ""]


def _parent(test: dict, datasets: Mapping[str, DataFrame]) -> tuple[DataFrame, str]:
    to, field = str(test["to"]).strip(), str(test.get("field") or "id")
    if to not in datasets:
        raise RecipeError(f"The relationships test points to '{to}', which is not available.")
    require(datasets[to], field, f"Relationships to '{to}'")
    return datasets[to], field


def failing_rows(
    df: DataFrame, test: dict, datasets: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Every row (or repeated or refused value, with its count) that breaks the test."""
    check_test(test)
    name = require(df, test.get("column"), f"Test {test['name']}")
    if test["name"] == "not_null":
        return df.filter(col(name).isNull())
    if test["name"] == "relationships":
        parent, field = _parent(test, datasets or {})
        known = parent.select(col(field).alias("to_field")).distinct()
        child = df.filter(col(name).isNotNull()).select(col(name).alias("from_field"))
        return child.join(known, col("from_field") == col("to_field"), "left_anti")
    held = "unique_field" if test["name"] == "unique" else "value_field"
    counts = df.groupBy(col(name).alias(held)).agg(F.count(F.lit(1)).alias("n_records"))
    if test["name"] == "unique":
        return counts.filter(col(held).isNotNull() & (F.col("n_records") > 1))
    # NULL is neither in the list nor out of it: it passes.
    return counts.filter(~_in_list(df, test, col(held)))


def _in_list(df: DataFrame, test: dict, c: Column) -> Column:
    dtype = df.schema[test["column"]].dataType
    return c.isin(*[literal(v, dtype) for v in _accepted(test)])


def sample_failing_rows(
    df: DataFrame,
    test: dict,
    datasets: Mapping[str, DataFrame] | None = None,
    limit: int = SAMPLE_ROWS,
) -> DataFrame:
    if not 1 <= limit <= SAMPLE_MAX_ROWS:
        raise RecipeError(f"A sample shows 1 to {SAMPLE_MAX_ROWS} rows, not {limit}.")
    return failing_rows(df, test, datasets).limit(limit)


def run_tests(
    df: DataFrame, tests: list[dict], datasets: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """One row per test: test, column, severity, failures, status (pass, warn or fail).

    not_null tests share one pass. unique and accepted_values tests of one column share one
    count per value. A relationship counts its child keys before looking for them.
    """
    if not tests:
        raise RecipeError("No test to run.")
    for test in tests:
        check_test(test)
        require(df, test.get("column"), f"Test {test['name']}")
    parts = []
    absent = [t for t in tests if t["name"] == "not_null"]
    if absent:
        nulls = _named(absent, lambda t: F.count_if(col(t["column"]).isNull()))
        parts.append(_rows(df.agg(*nulls), absent))
    by_column: dict[str, list[dict]] = {}
    for t in tests:
        if t["name"] in ("unique", "accepted_values"):
            by_column.setdefault(t["column"], []).append(t)
    for name, group in by_column.items():
        counts = df.groupBy(col(name)).agg(F.count(F.lit(1)).alias("__n"))

        def broken(t: dict) -> Column:
            if t["name"] == "unique":
                return F.count_if(col(t["column"]).isNotNull() & (col("__n") > 1))
            return F.count_if(~_in_list(df, t, col(t["column"])))

        parts.append(_rows(counts.agg(*_named(group, broken)), group))
    for t in tests:
        if t["name"] == "relationships":
            parent, field = _parent(t, datasets or {})
            counts = (
                df.filter(col(t["column"]).isNotNull())
                .groupBy(col(t["column"]).alias("from_field"))
                .agg(F.count(F.lit(1)).alias("__n"))
            )
            known = parent.select(col(field).alias("to_field")).distinct()
            orphans = counts.join(known, col("from_field") == col("to_field"), "left_anti")
            total = F.coalesce(F.sum("__n"), F.lit(0))
            parts.append(_rows(orphans.agg(*_named([t], lambda _: total)), [t]))
    out = reduce(DataFrame.union, parts)
    failed = F.when(F.col("severity") == "warn", "warn").otherwise("fail")
    return out.withColumn("status", F.when(F.col("failures") > 0, failed).otherwise("pass"))


def _named(tests: list[dict], measure) -> list[Column]:
    return [measure(t).cast("bigint").alias(f"f{i}") for i, t in enumerate(tests)]


def _rows(one_row: DataFrame, tests: list[dict]) -> DataFrame:
    """The measures of one aggregate row, one output row per test."""
    entries = [
        F.struct(
            F.lit(t["name"]).alias("test"),
            F.lit(t["column"]).alias("column"),
            F.lit(str(t.get("severity") or "error").lower()).alias("severity"),
            F.col(f"f{i}").alias("failures"),
        )
        for i, t in enumerate(tests)
    ]
    return one_row.select(F.inline(F.array(*entries)))


def enforce(results: DataFrame) -> DataFrame:
    """Stops a run when a test of severity 'error' fails; warnings only report."""
    broken = results.filter(F.col("status") == "fail").collect()  # one row per test
    if broken:
        names = ", ".join(f"{r['test']}({r['column']}): {r['failures']}" for r in broken)
        raise DataTestFailure(f"Data tests failed: {names}.")
    return results
