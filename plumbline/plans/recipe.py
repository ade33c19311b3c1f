"""Running a recipe: from its description and datasets to a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession

from ..errors import RecipeError
from ..operators import groups, joins, sql, stacks
from ..operators.skew import described_only
from ..operators.steps import apply_step
from . import guards
from .output import check_output
from .spec import check_shape, known_names, recipe_type, resolve_inputs

# Rows of a preview.
PREVIEW_ROWS = 200
PREVIEW_MAX_ROWS = 5_000


def run_recipe(
    spark: SparkSession,
    spec: dict,
    datasets: Mapping[str, DataFrame] | None = None,
    upto: int | None = None,
) -> DataFrame:
    """The whole result, lazily. ``upto`` stops after that many enabled steps."""
    check_shape(spec)
    recipe_type(spec)
    if upto is None:
        check_output(spec.get("output") or {})
    return compute(spark, spec, resolve_inputs(spark, spec, datasets or {}), upto)


def compute(
    spark: SparkSession,
    spec: dict,
    inputs: dict[str, DataFrame],
    upto: int | None = None,
    this: DataFrame | None = None,
    within: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The recipe over resolved inputs; incremental guards apply to the whole recipe.

    ``this`` is the table SQL text of a later load may name, ``within`` labels joined rows.
    """
    kind, out = recipe_type(spec), spec.get("output") or {}
    alias, first = next(iter(inputs.items()))
    if kind == "prepare":
        return _prepare(spec, out, alias, first, upto)
    if kind == "join":
        names = joins.output_names(spec, {a: df.columns for a, df in inputs.items()})
        guards.check_join(spec, inputs, names)
        guards.check_produced(out, [n for _, _, n in names])
        return joins.join(spec, inputs, within)
    if kind == "group":
        guards.check_group(spec, alias, first.columns)
        guards.check_produced(out, groups.output_names(spec))
        return groups.group(spec, first)
    if kind == "stack":
        guards.check_stack(out, inputs)
        guards.check_produced(out, stacks.output_names(inputs))
        return stacks.stack(spec, inputs)
    guards.check_sql(out)
    df = sql.run_sql(spark, spec, inputs, known_names(spec), this)
    guards.check_produced(out, df.columns)
    return df


def _prepare(
    spec: dict, out: dict, alias: str, df: DataFrame, upto: int | None
) -> DataFrame:
    steps = [s for s in spec.get("steps") or [] if s.get("enabled", True)]
    if upto is None:
        guards.check_steps(out, steps)
        guards.check_prepare_input(out, alias, df.columns)
    trail: list[tuple[dict, list[str], list[str]]] = []
    wanted = steps if upto is None else steps[: max(0, upto)]
    for step, following in zip(wanted, [*wanted[1:], None]):
        after = apply_step(df, step, following)
        trail.append((step, df.columns, after.columns))
        df = after
    if upto is None:
        guards.check_produced(out, df.columns)
        guards.check_prepare(out, alias, trail)
    return df


def preview(
    spark: SparkSession,
    spec: dict,
    datasets: Mapping[str, DataFrame] | None = None,
    upto: int | None = None,
    limit: int = PREVIEW_ROWS,
) -> DataFrame:
    """A few rows of the result, to look at. Nothing runs before they are asked for."""
    if not 1 <= limit <= PREVIEW_MAX_ROWS:
        raise RecipeError(f"A preview shows 1 to {PREVIEW_MAX_ROWS} rows, not {limit}.")
    with described_only():
        return run_recipe(spark, spec, datasets, upto).limit(limit)
