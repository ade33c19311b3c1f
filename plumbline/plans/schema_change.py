"""Fitting arrivals to a table whose columns differ from theirs."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from ..errors import RecipeError
from ..functions.names import col


@dataclass(frozen=True)
class Fit:
    """The columns the table will have, and what has to happen to the rows it holds."""

    schema: T.StructType
    widened: bool  # columns added: old rows read NULL, nothing is rewritten
    rewritten: bool  # columns dropped or narrowed: old rows are written again


_WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def promoted(old: T.DataType, new: T.DataType) -> bool:
    """Whether Parquet files of the old type are read as the new one without loss."""
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    if type(old) in _WHOLE and type(new) in _WHOLE:
        return _WHOLE.index(type(old)) <= _WHOLE.index(type(new))
    if isinstance(new, T.DoubleType):
        return type(old) in (*_WHOLE[:3], T.FloatType)
    return isinstance(old, T.DateType) and isinstance(new, T.TimestampNTZType)


def fit(
    arrivals: T.StructType, table: T.StructType, policy: str, fixed: Collection[str] = ()
) -> Fit:
    """``fixed`` columns say where a row is stored: another type moves it."""
    fresh = {f.name.casefold(): f for f in arrivals}
    held = {f.name.casefold(): f for f in table}
    added = [f for k, f in fresh.items() if k not in held]
    dropped = [f.name for k, f in held.items() if k not in fresh]
    retyped = [
        f.name for k, f in held.items() if k in fresh and fresh[k].dataType != f.dataType
    ]
    if policy == "fail" and (added or dropped or retyped):
        changes = [f"added {f.name}" for f in added]
        changes += [f"missing {n}" for n in dropped] + [f"retyped {n}" for n in retyped]
        raise RecipeError(f"The columns have changed ({', '.join(changes)}).")
    if policy == "ignore":
        if dropped:
            raise RecipeError(
                f"The output no longer has {', '.join(dropped)}, which the table expects. "
                "Use 'append_new_columns' or 'sync_all_columns'."
            )
        return Fit(table, False, False)
    if policy == "sync_all_columns":
        kept = [fresh[k] for k in held if k in fresh]
        schema = T.StructType([*kept, *added])
        moved = [
            n for n in retyped
            if n in fixed or not promoted(table[n].dataType, fresh[n.casefold()].dataType)
        ]
        return Fit(schema, bool(added or retyped), bool(dropped or moved))
    return Fit(T.StructType([*table.fields, *added]), bool(added), False)


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows with exactly these columns: cast where the type differs, NULL where absent."""
    names = {f.name.casefold(): f for f in df.schema}
    out = []
    for f in schema:
        mine = names.get(f.name.casefold())
        value = F.lit(None) if mine is None else col(mine.name)
        if mine is None or mine.dataType != f.dataType:
            value = value.cast(f.dataType)
        out.append(value.alias(f.name))
    return df.select(*out)
