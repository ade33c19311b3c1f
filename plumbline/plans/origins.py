"""Which input column the values of an output column are, if they are any one's.

A recipe of any kind is read as a list of moves. A move says for each column it leaves where
the values come from: a column before the move, or nowhere, where the move makes them. Moves
are composed, and every guard about a column of the input asks the one answer.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from ..functions.names import filled_names

# (alias of the input, its column)
Source = tuple[str, str]

# Steps that write their result over the column that a setting names.
_WRITES = {
    "formula": ("into",),
    "if_then_else": ("into",),
    "fill_empty": ("column",),
    "find_replace": ("column",),
    "text_transform": ("column",),
    "change_type": ("column",),
    "round": ("column",),
    "parse_date": ("into", "column"),
}


@dataclass(frozen=True)
class Origins:
    """Columns by name with their source (None: made by the recipe), and what overwrote a source."""

    columns: dict[str, Source | None]
    overwritten: dict[Source, str]

    @classmethod
    def of_input(cls, alias: str, columns: Iterable[str]) -> Origins:
        return cls({c: (alias, c) for c in columns}, {})

    def after(self, move: dict[str, str | None], by: str) -> Origins:
        """Composed with a move: column left -> column before, or None for a new value."""
        columns = {c: self.columns.get(was) if was else None for c, was in move.items()}
        lost = dict(self.overwritten)
        for name, was in move.items():
            source = self.columns.get(name)
            if was is None and source and source not in columns.values():
                lost.setdefault(source, by)
        return Origins(columns, lost)

    def keeps(self, alias: str, column: str) -> bool:
        """Whether the column is in the output under its own name, with its own values."""
        return self.columns.get(column) == (alias, column)


def of_steps(alias: str, trail: list[tuple[dict, list[str], list[str]]], columns) -> Origins:
    """``trail`` holds every step with the columns before and after it."""
    found = Origins.of_input(alias, trail[0][1] if trail else columns)
    for step, before, after in trail:
        found = found.after(_move(step, before, after), str(step.get("type")))
    return found


def _move(step: dict, before: list[str], after: list[str]) -> dict[str, str | None]:
    kind, params = step.get("type"), step.get("params") or {}
    stays = {c: c if c in before else None for c in after}
    if kind == "rename":
        came = {r.get("to"): r.get("from") for r in params.get("renames") or []}
        return {c: came.get(c, was) for c, was in stays.items()}
    made: set[str | None] = set()
    if kind == "filter_value" and params.get("action", "remove") == "clear":
        made = {params.get("column")}
    elif kind in _WRITES:
        made = {next((params[s] for s in _WRITES[kind] if params.get(s)), None)}
    elif kind == "unpivot":
        made = {params.get("name_into") or "variable", params.get("value_into") or "valeur"}
    elif kind == "pivot":
        made = set(after) - set(filled_names(params.get("key_columns")))
    return {c: None if c in made else was for c, was in stays.items()}


def of_join(names: list[tuple[str, str, str]]) -> Origins:
    """``names``: input, column and output name of every column."""
    return Origins({name: (alias, column) for alias, column, name in reversed(names)}, {})


def of_group(spec: dict, alias: str) -> Origins:
    """Keys are their columns. A plain maximum under its column's name is one of its values."""
    columns: dict[str, Source | None] = {
        k: (alias, k) for k in filled_names(spec.get("group_by"))
    }
    for measure in spec.get("aggregations") or []:
        name, source, condition = (
            str(measure.get(k) or "").strip() for k in ("alias", "column", "filter")
        )
        plain = measure.get("fn") == "max" and source == name and not condition
        columns[name] = (alias, source) if plain else None
    return Origins(columns, {})
