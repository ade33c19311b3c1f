"""Column names: which ones may be created, and how to reference any of them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import RecipeError

# Fixed value: the shape of a name a recipe may create.
NAME_RE = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")

# Words no unquoted SQL alias may carry; an alias that is one gets a leading "_".
RESERVED_ALIASES = frozenset(
    """
    all analyze and any array as asc between both by case cast check collate column
    constraint create cross cube current_date current_time current_timestamp current_user
    default delete desc describe distinct do drop else end escape except exists extract false fetch
    filter following for foreign from full grant group grouping having if ilike in inner
    insert intersect interval into is join lateral leading left like limit minus natural
    new not null nulls of offset on only or order outer over overlaps partition placing preceding
    primary qualify range references right rlike rollup row rows select session_user set
    some start table tablesample then to trailing true unbounded union unique unnest update user
    using values view when where window with within
    """.split()
)


def quoted(name: str) -> str:
    """The name as Spark SQL reads it literally, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def new_name(name: object, what: str = "column") -> str:
    text = str(name or "").strip()
    if not NAME_RE.match(text):
        raise RecipeError(
            f"Invalid {what} name: '{text}'. Use letters, digits and underscores, "
            "starting with a letter or an underscore."
        )
    return text


def require(df: DataFrame, name: object, label: str) -> str:
    """The column, which must exist under exactly this name."""
    if name not in df.columns:
        raise RecipeError(
            f"{label}: column '{name}' does not exist at this point. "
            f"Available columns: {', '.join(df.columns) or '(none)'}."
        )
    return str(name)


def filled_names(names: Iterable[object] | None) -> list[str]:
    return [str(n) for n in (names or []) if str(n).strip()]


def refuse_case_twins(names: Sequence[str], label: str) -> None:
    """Two names that differ only by case are one name for the engine."""
    seen: dict[str, str] = {}
    for name in names:
        twin = seen.setdefault(name.casefold(), name)
        if Counter(names)[name] > 1 or twin != name:
            raise RecipeError(
                f"{label}: two columns are called '{twin}' and '{name}' "
                "(case is ignored). Rename or remove one of them."
            )


def spare_name(base: str, taken: Iterable[str]) -> str:
    """A technical column name that hides no existing column: where it is taken, it is made
    longer than all of them."""
    held, name = {t.casefold() for t in taken}, f"__{base}"
    return name.ljust(1 + max(map(len, held)), "_") if name.casefold() in held else name


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace the column in place when it exists, append it otherwise: one projection."""
    if name in df.columns:
        return df.select([(value.alias(c) if c == name else col(c)) for c in df.columns])
    return df.select(*cols(df.columns), value.alias(name))
