"""Free SQL over the inputs of a recipe."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..errors import RecipeError

# {{ ref('orders') }} and {{ source('raw', 'orders') }} name an input, like {orders}.
_REFERENCE = re.compile(
    r"\{\{\s*(?:ref|source)\(\s*(?:['\"][^'\"]+['\"]\s*,\s*)?['\"]([^'\"]+)['\"][^)]*\)\s*\}\}"
)

# Text for later loads only, and the table they add to: {{ this }} or {this}.
_LATER_ONLY = re.compile(
    r"\{%-?\s*if\s+is_incremental\(\)\s*-?%\}(.*?)\{%-?\s*endif\s*-?%\}", re.DOTALL
)
_THIS = re.compile(r"\{\{\s*this\s*\}\}|\{this\}")


def run_sql(
    spark: SparkSession,
    spec: dict,
    inputs: dict[str, DataFrame],
    known: dict[str, str],
    this: DataFrame | None = None,
) -> DataFrame:
    """The text as written. Inputs appear as ``{alias}``, or as a ref or source call.

    ``known`` maps the dataset names inputs were declared under to their aliases. ``this``
    is the table written so far, on a later load: what stands between
    ``{% if is_incremental() %}`` and ``{% endif %}`` is read then only.
    """
    text = str(spec.get("sql") or "").strip().rstrip("; \n\t")
    if not text:
        raise RecipeError("The SQL recipe is empty.")

    def placeholder(match: re.Match) -> str:
        name = match.group(1)
        alias = known.get(name, name)
        if alias not in inputs:
            raise RecipeError(f"SQL: '{name}' is not an input of this recipe.")
        return "{" + alias + "}"

    text = _LATER_ONLY.sub(lambda m: m.group(1) if this is not None else "", text)
    text = _REFERENCE.sub(placeholder, text)
    if "this" not in inputs and _THIS.search(text):
        if this is None:
            raise RecipeError(
                "SQL: 'this' is the table already written and a first build has none. Put it "
                "between {% if is_incremental() %} and {% endif %}."
            )
        text, inputs = _THIS.sub("{this}", text), {**inputs, "this": this}
    used = {a: df for a, df in inputs.items() if "{" + a + "}" in text}
    return spark.sql(text, **used)
