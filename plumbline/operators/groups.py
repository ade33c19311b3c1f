"""Grouped and global measures, each optionally restricted by a condition."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import RecipeError
from ..functions.names import (
    col,
    cols,
    filled_names,
    new_name,
    refuse_case_twins,
    require,
    spare_name,
)
from .skew import hot_groups, same_keys, settled
from .steps import sql_expression
from .windows import Order, WindowCall, evaluate

AGGREGATIONS: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "count_distinct": F.count_distinct,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "median": F.median,
}

# Spark's exact median holds the distinct values of a group in memory: up to this many rows
# of a group it is left to do so, beyond that the median is found by counting positions.
MEDIAN_ROWS = 500_000


def output_names(spec: dict) -> list[str]:
    keys = filled_names(spec.get("group_by"))
    names = keys + [
        new_name(a.get("alias"), "measure") for a in spec.get("aggregations") or []
    ]
    refuse_case_twins(names, "Group")
    return names


def group(spec: dict, df: DataFrame) -> DataFrame:
    keys = [require(df, k, "Group") for k in filled_names(spec.get("group_by"))]
    measures = spec.get("aggregations") or []
    if not measures:
        raise RecipeError("Group: add at least one measure.")
    names = output_names(spec)
    try:
        return _measured(df, keys, measures, names)
    except AnalysisException as exc:
        raise RecipeError(f"Group is refused by Spark: {exc}") from None


def _measured(
    df: DataFrame, keys: list[str], measures: list[dict], names: list[str]
) -> DataFrame:
    plain: list[Column] = []
    distinct: dict[str, Column] = {}
    wide: dict[str, Column] = {}
    medians: list[Column] = []
    # A distinct count groups by (key, value) first, which would carry every median's values
    # through one more shuffle in many small groups: next to one, medians are apart. Several
    # of them in one aggregate would multiply the rows, so each then groups for itself.
    counted = sum(a.get("fn") == "count_distinct" for a in measures)
    for a, name in zip(measures, names[len(keys) :], strict=True):
        fn, argument = _argument(df, a)
        if fn == "median" and _too_wide(df, keys, argument):
            wide[name] = argument
        elif fn == "count_distinct" and counted > 1:
            distinct[name] = argument
        elif fn == "median" and counted:
            medians.append(F.median(argument).alias(name))
        else:
            plain.append(AGGREGATIONS[fn](argument).alias(name))
    parts = [_aggregated(df, keys, p) for p in (plain, medians) if p]
    parts += [_distinct_count(df, keys, argument, name) for name, argument in distinct.items()]
    parts += [_positional_median(df, keys, argument, name) for name, argument in wide.items()]
    if not parts[1:] and not wide and not distinct:
        return parts[0].select(*cols(names))
    # Every group, so that one without any value to take the median of stays in the result.
    if not plain:
        one_row = df.sparkSession.range(1).select(F.lit(True).alias(spare_name("one", names)))
        parts.insert(0, df.select(*cols(keys)).distinct() if keys else one_row)
    return reduce(lambda out, part: _beside(out, part, keys), parts).select(*cols(names))


def _aggregated(df: DataFrame, keys: list[str], measures: list[Column]) -> DataFrame:
    return df.groupBy(*cols(keys)).agg(*measures) if keys else df.agg(*measures)


def _distinct_count(df: DataFrame, keys: list[str], argument: Column, name: str) -> DataFrame:
    """Distinct pairs of group and value first, combined in the map tasks, then their number."""
    pairs = df.select(*cols(keys), argument.alias("__value")).distinct()
    return _aggregated(pairs, keys, [F.count("__value").alias(name)])


def _beside(out: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """The measures of a part next to those already there, group by group."""
    names = {k: spare_name(f"key{i}", out.columns) for i, k in enumerate(keys)}
    made = [c for c in part.columns if c not in keys]
    part = part.select(*[col(k).alias(n) for k, n in names.items()], *cols(made))
    joined = out.join(part, same_keys(out, part, list(names.items())), "left")
    return joined.select(*cols([*out.columns, *made]))


def _argument(df: DataFrame, a: dict) -> tuple[str, Column]:
    """What is measured: a column, or 1 for rows; NULL where the condition does not hold."""
    fn, name = a.get("fn", "count"), a.get("column") or "*"
    if fn not in AGGREGATIONS:
        raise RecipeError(
            f"Unknown aggregation: {fn}. Choose among {', '.join(AGGREGATIONS)}."
        )
    if name == "*" and fn != "count":
        raise RecipeError(f"'{fn}' measures a column: '*' only counts rows, with 'count'.")
    what = F.lit(1) if name == "*" else col(require(df, name, "Group"))
    condition = str(a.get("filter") or "").strip()
    if condition:
        what = F.when(sql_expression(condition, "Measure filter"), what)
    return fn, what


def _too_wide(df: DataFrame, keys: list[str], argument: Column) -> bool:
    held = df.select(*cols(keys), argument.alias("__value")).filter(col("__value").isNotNull())
    return bool(hot_groups(held, keys, MEDIAN_ROWS))


def _positional_median(
    df: DataFrame, keys: list[str], argument: Column, name: str
) -> DataFrame:
    """Exact median by position: count each distinct value, then walk the running counts.

    The values are counted before anything is ordered, and the running count is the
    skew-safe window function, so no task holds a whole group.
    """
    counts = settled(
        df.select(*cols(keys), argument.alias("__value"))
        .filter(col("__value").isNotNull())
        .groupBy(*cols([*keys, "__value"]))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    hot = hot_groups(counts, keys)
    by_value = (Order("__value", descending=False),)
    upto = WindowCall("running_sum", "__n", tuple(keys), by_value, 0, "__upto")
    total = WindowCall("sum", "__n", tuple(keys), (), 0, "__total")
    walked = evaluate(evaluate(counts, upto, hot), total, hot)

    def at(place: Column) -> Column:
        here = (col("__upto") >= place) & (col("__upto") - col("__n") < place)
        return F.max(F.when(here, col("__value").cast("double")))

    low, high = (F.floor((col("__total") + F.lit(n)) / 2) for n in (1, 2))
    middle = ((at(low) + at(high)) / 2).alias(name)
    return walked.groupBy(*cols(keys)).agg(middle)
