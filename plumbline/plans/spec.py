"""The recipe as plain data: its shape, its inputs and the names they are known by."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..errors import RecipeError
from ..functions.names import NAME_RE, RESERVED_ALIASES, refuse_case_twins

# Recipe types and how many inputs each takes (None = no upper limit).
RECIPE_TYPES = {
    "prepare": (1, 1),
    "join": (2, None),
    "group": (1, 1),
    "stack": (2, None),
    "sql": (1, None),
}
# A shortcut that stands for a prepare recipe with this step.
SHORTCUTS = {"distinct": ("prepare", "distinct_rows")}

_KINDS = {dict: "an object", list: "a list", str: "text"}

# Where each kind of value is expected: path -> kind. An empty value counts as absent.
_SHAPE = {
    "name": str,
    "sql": str,
    "inputs": list,
    "steps": list,
    "joins": list,
    "select": list,
    "aggregations": list,
    "group_by": list,
    "output": dict,
    "microbatch": dict,
    "output.incremental": dict,
    "output.microbatch": dict,
    "output.unique_key": list,
    "output.partition_by": list,
    "output.tags": list,
    "output.columns": list,
}
_LISTS_OF_OBJECTS = ("inputs", "steps", "joins", "select", "aggregations")


def _expect(value: object, kind: type, where: str) -> None:
    if value and not isinstance(value, kind):
        raise RecipeError(f"'{where}' must be {_KINDS[kind]}, not {type(value).__name__}.")


def _expect_objects(values: object, where: str) -> None:
    _expect(values, list, where)
    for n, item in enumerate(values or [], start=1):
        if not isinstance(item, dict):
            raise RecipeError(
                f"Item {n} of '{where}' must be an object, not {type(item).__name__}."
            )


def check_shape(spec: object) -> dict:
    """Objects, lists and text where they are expected; meaning is checked later."""
    if not isinstance(spec, dict):
        raise RecipeError(f"A recipe must be an object, not {type(spec).__name__}.")
    kind = spec.get("type")
    if kind is not None and not isinstance(kind, str):
        raise RecipeError(f"'type' must be text, not {type(kind).__name__}.")
    for path, expected in _SHAPE.items():
        head, _, tail = path.partition(".")
        holder = spec.get(head)
        _expect((holder or {}).get(tail) if tail else holder, expected, path)
    for field in _LISTS_OF_OBJECTS:
        _expect_objects(spec.get(field), field)
    for n, join in enumerate(spec.get("joins") or [], start=1):
        _expect_objects(join.get("on"), f"joins[{n}].on")
    for n, step in enumerate(spec.get("steps") or [], start=1):
        if step.get("type") is not None and not isinstance(step["type"], str):
            raise RecipeError(f"The type of step {n} must be text.")
        params = step.get("params")
        if params is not None and not isinstance(params, dict):
            raise RecipeError(
                f"The params of step {n} must be an object, not {type(params).__name__}."
            )
        for field in ("renames", "order_by"):
            _expect_objects((params or {}).get(field), f"steps[{n}].params.{field}")
    lookback = ((spec.get("output") or {}).get("incremental") or {}).get("lookback")
    _expect(lookback, dict, "output.incremental.lookback")
    return spec


def recipe_type(spec: dict) -> str:
    kind = spec.get("type", "prepare")
    if kind in SHORTCUTS:
        stands_for, step = SHORTCUTS[kind]
        raise RecipeError(
            f"'{kind}' is a shortcut, not a recipe type: use '{stands_for}' with a "
            f"'{step}' step."
        )
    if kind not in RECIPE_TYPES:
        raise RecipeError(
            f"Unknown recipe type: {kind}. Choose among {', '.join(RECIPE_TYPES)}."
        )
    return kind


def check_input_count(spec: dict) -> None:
    kind = recipe_type(spec)
    least, most = RECIPE_TYPES[kind]
    n = len(spec.get("inputs") or [])
    if most is not None and n != most:
        raise RecipeError(f"A '{kind}' recipe takes exactly {most} input, and has {n}.")
    if n < least:
        raise RecipeError(f"A '{kind}' recipe takes at least {least} input(s), and has {n}.")


def input_label(item: dict) -> str:
    if item.get("source_name"):
        return f"{item['source_name']}.{item.get('table')}"
    details = [str(item[k]) for k in ("package",) if item.get(k)]
    if item.get("version"):
        details.append(f"v{item['version']}")
    return str(item.get("ref") or "") + (f" ({', '.join(details)})" if details else "")


def input_alias(item: dict, index: int) -> str:
    """An identifier whatever the dataset is called."""
    given = item.get("alias") or item.get("ref") or item.get("table") or f"input_{index}"
    text = re.sub(r"[^a-zA-Z0-9_]", "_", str(given).strip()) or f"input_{index}"
    if not NAME_RE.match(text) or text.lower() in RESERVED_ALIASES:
        return "_" + text
    return text


def input_aliases(spec: dict) -> list[str]:
    items = spec.get("inputs") or []
    aliases = [input_alias(item, n) for n, item in enumerate(items)]
    refuse_case_twins(aliases, "Inputs")
    return aliases


def known_names(spec: dict) -> dict[str, str]:
    """Dataset names as declared -> alias, for SQL text that refers to them."""
    names: dict[str, str] = {}
    for n, item in enumerate(spec.get("inputs") or []):
        alias = input_alias(item, n)
        for name in (item.get("ref"), item.get("table"), item.get("alias"), alias):
            if name:
                names.setdefault(str(name), alias)
    return names


def resolve_inputs(
    spark: SparkSession, spec: dict, datasets: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    """alias -> DataFrame. A dataset not handed in is looked up in the catalog."""
    check_input_count(spec)
    found: dict[str, DataFrame] = {}
    for n, (alias, item) in enumerate(
        zip(input_aliases(spec), spec.get("inputs") or [], strict=True)
    ):
        label = input_label(item)
        names = [item.get("alias"), item.get("ref"), label, item.get("table"), alias]
        names = [str(x) for x in names if x]
        name = next((x for x in names if x in datasets), None)
        if name is not None:
            df = datasets[name]
        else:
            table = next((x for x in (label, item.get("ref")) if x and _exists(spark, x)), None)
            if table is None:
                raise RecipeError(f"Input {n + 1} ('{label or alias}') is not available.")
            df = spark.table(table)
        refuse_case_twins(df.columns, f"Input '{alias}'")
        found[alias] = df
    return found


def _exists(spark: SparkSession, name: str) -> bool:
    try:
        return spark.catalog.tableExists(name)
    except Exception:  # not a name the catalog can parse
        return False
