"""Stacking inputs on top of each other by column name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..errors import RecipeError
from ..functions.names import refuse_case_twins
from ..functions.types import family


def output_names(inputs: dict[str, DataFrame]) -> list[str]:
    """Every name, in the order first seen."""
    return list(dict.fromkeys(c for df in inputs.values() for c in df.columns))


def stack(spec: dict, inputs: dict[str, DataFrame]) -> DataFrame:
    names = output_names(inputs)
    # The engine ignores case, so "id" and "ID" cannot both be output columns.
    refuse_case_twins(names, "Stack")
    _refuse_mixed_families(names, inputs)
    stacked = reduce(
        lambda top, bottom: top.unionByName(bottom, allowMissingColumns=True), inputs.values()
    )
    return stacked if spec.get("mode", "all") == "all" else stacked.distinct()


def _refuse_mixed_families(names: list[str], inputs: dict[str, DataFrame]) -> None:
    for name in names:
        kinds: dict[str, list[str]] = {}
        for alias, df in inputs.items():
            if name in df.columns:
                kinds.setdefault(family(df.schema[name].dataType), []).append(alias)
        if len(kinds) > 1:
            detail = "; ".join(f"{k} in {', '.join(a)}" for k, a in sorted(kinds.items()))
            raise RecipeError(
                f"Stack: column '{name}' holds different kinds of values ({detail}). "
                "Align the types with 'change_type' first, or rename one of them."
            )
