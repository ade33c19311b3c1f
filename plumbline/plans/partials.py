"""Incremental groups kept up to date from the aggregates already stored.

An incremental group normally computes the groups that received a row anew, from all of their
rows. Where the input only ever grows at its end (``incremental.append_only``), that is not
needed: counts, sums, minima, maxima and averages of a group follow from what the table holds
and from the same measures over the arrivals alone. An average is kept as a hidden sum and
count. Medians and distinct counts have no such parts; a recipe with one reads the touched
groups again, as does a load whose columns differ from the table's.

Groups with a NULL key stay as first written, as in any load that replaces by key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import RecipeError
from ..functions.names import col, cols, filled_names, spare_name
from ..operators import groups
from ..sources.tables import RecipeTable
from .output import bound_column, bound_is_inclusive, lookback, unique_key
from .spec import recipe_type

# The measures that follow from those of two parts.
MERGEABLE = ("count", "sum", "min", "max", "avg")


def is_append_only(out: dict) -> bool:
    """Whether the input is declared to grow only beyond the bound."""
    config = out.get("incremental") or {}
    if not config.get("append_only"):
        return False
    if not bound_column(out):
        raise RecipeError("'append_only' speaks of an incremental column: name one.")
    if bound_is_inclusive(out) or lookback(out):
        raise RecipeError(
            "'append_only' adds what arrives to what is stored: a '>=' bound or a lookback "
            "reads rows again, which would count twice."
        )
    return True


@dataclass(frozen=True)
class Partials:
    """How the groups of a recipe merge: measure by measure, averages by hidden parts."""

    spec: dict
    keys: tuple[str, ...]
    measures: tuple[tuple[str, str], ...]  # name and function
    parts: tuple[tuple[str, str, str], ...]  # average, its sum, its count

    @property
    def hidden(self) -> list[str]:
        return [name for _, *both in self.parts for name in both]

    def compute(self, df: DataFrame) -> DataFrame:
        """The recipe's groups, with the hidden parts of its averages."""
        extra, wide = [], df
        for name, total, rows in self.parts:
            measure = next(a for a in self.spec["aggregations"] if a.get("alias") == name)
            source = measure["column"]
            # Averages of whole numbers are averages of doubles, which cannot overflow.
            if not isinstance(df.schema[source].dataType, T.DecimalType):
                source = spare_name(f"double of {source}", wide.columns)
                wide = wide.withColumn(source, col(measure["column"]).cast("double"))
            same = {k: v for k, v in measure.items() if k == "filter"}
            extra += [
                {**same, "fn": "sum", "column": source, "alias": total},
                {**same, "fn": "count", "column": source, "alias": rows},
            ]
        spec = {**self.spec, "aggregations": [*self.spec["aggregations"], *extra]}
        return groups.group(spec, wide)

    def arrivals(self, df: DataFrame, test: Column) -> DataFrame:
        """The groups of the rows beyond the bound alone."""
        known = reduce(Column.__and__, [col(k).isNotNull() for k in self.keys])
        return self.compute(df.filter(test).filter(known))

    def fit(self, made: T.StructType, table: RecipeTable, out: dict) -> bool:
        """Whether the table holds exactly these columns and parts, in buckets of the key."""
        layout = table.layout()
        if layout is None or [k.casefold() for k in layout.keys] != [
            k.casefold() for k in unique_key(out)
        ]:
            return False
        held = {f.name: f.dataType for f in table.schema()}
        return set(self.hidden) == set(layout.hidden) and held == {
            f.name: f.dataType for f in made
        }

    def merged(self, held: DataFrame, rows: DataFrame) -> DataFrame:
        """The arriving groups with what the table already has of them."""
        old = {c: spare_name(f"old{i}", held.columns) for i, c in enumerate(held.columns)}
        past = held.select(*[col(c).alias(n) for c, n in old.items()])
        on = reduce(Column.__and__, [col(k) == col(old[k]) for k in self.keys])
        functions = dict(self.measures)
        for _, total, count in self.parts:
            functions |= {total: "sum", count: "count"}

        def together(name: str) -> Column:
            a, b, fn = col(old[name]), col(name), functions[name]
            if fn == "count":
                return F.coalesce(a, F.lit(0)) + b
            if fn == "sum":
                return F.coalesce(a + b, a, b)
            return F.least(a, b) if fn == "min" else F.greatest(a, b)

        made = {c: together(c) for c, fn in functions.items() if fn != "avg"}
        for name, total, count in self.parts:
            rows_of = made[count]
            if isinstance(rows.schema[total].dataType, T.DecimalType):
                rows_of = rows_of.cast("decimal(20,0)")
            made[name] = F.when(made[count] > 0, made[total] / rows_of)
        joined = rows.join(past, on, "left")
        return joined.select(
            *[
                made.get(f.name, col(f.name)).cast(f.dataType).alias(f.name)
                for f in rows.schema.fields
            ]
        )


def partials_of(spec: dict, df: DataFrame) -> Partials | None:
    """How an incremental group merges, or None where it has to read its groups again."""
    out = spec.get("output") or {}
    if recipe_type(spec) != "group" or not is_append_only(out) or out.get("partition_by"):
        return None
    measures = [(a.get("alias"), a.get("fn", "count")) for a in spec.get("aggregations") or []]
    if not measures or any(fn not in MERGEABLE for _, fn in measures):
        return None
    keys = filled_names(spec.get("group_by"))
    taken = [*keys, *[str(name) for name, _ in measures]]
    parts = []
    for name, fn in measures:
        if fn == "avg":
            both = []
            for what in ("sum", "rows"):
                both.append(spare_name(f"{what}_of_{name}", taken))
                taken.append(both[-1])
            parts.append((name, *both))
    return Partials(spec, tuple(keys), tuple(measures), tuple(parts))
