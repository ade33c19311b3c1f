"""Predicates on a value, and what to do with the rows they select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import RecipeError
from ..functions.names import col, put, require
from ..functions.types import empty, filled, literal

_COMPARE = {
    "eq": Column.__eq__,
    "ne": Column.__ne__,
    "gt": Column.__gt__,
    "gte": Column.__ge__,
    "lt": Column.__lt__,
    "lte": Column.__le__,
}
_TEXT_SEARCH = {
    "contains": Column.contains,
    "starts_with": Column.startswith,
    "ends_with": Column.endswith,
}
OPERATORS = (*_COMPARE, "in", "not_in", *_TEXT_SEARCH, "empty", "not_empty")


def predicate(df: DataFrame, params: dict) -> Column:
    label = "Filter"
    name = require(df, params.get("column"), label)
    op = params.get("operator", "eq")
    if op not in OPERATORS:
        raise RecipeError(f"{label}: unknown operator '{op}'.")
    c, dtype = col(name), df.schema[name].dataType
    if op == "empty":
        return empty(c, dtype)
    if op == "not_empty":
        return filled(c, dtype)
    values = params.get("values") or (
        [params["value"]] if params.get("value") is not None else []
    )
    if not values:
        raise RecipeError(f"{label}: no value given.")
    if op in ("in", "not_in"):
        member = c.isin(*[literal(v, dtype) for v in values])
        return member if op == "in" else ~member
    if len(values) > 1:
        raise RecipeError(
            f"{label}: '{op}' compares one value and {len(values)} were given. "
            "Use 'in' to accept several."
        )
    if op in _TEXT_SEARCH:
        # Plain substring search: no character is a wildcard.
        return _TEXT_SEARCH[op](c.cast("string"), F.lit(str(values[0])))
    return _COMPARE[op](c, literal(values[0], dtype))


def keep_or_remove(df: DataFrame, test: Column, action: str) -> DataFrame:
    """Removing keeps the rows where the test is unknown: they do not have the value."""
    if action == "remove":
        return df.filter(F.coalesce(~test, F.lit(True)))
    return df.filter(test)


def filter_value(df: DataFrame, params: dict) -> DataFrame:
    test = predicate(df, params)
    action, name = params.get("action", "remove"), params["column"]
    if action == "clear":
        nothing = F.lit(None).cast(df.schema[name].dataType)
        return put(df, name, F.when(test, nothing).otherwise(col(name)))
    compares = params.get("operator", "eq") not in ("empty", "not_empty")
    if action == "remove" and compares and None not in (params.get("values") or []):
        # Unknown only where the column is NULL: said this way, it reaches the file scan.
        return df.filter(~test | col(name).isNull())
    return keep_or_remove(df, test, action)
