"""Type families, literals, and the single definition of an empty cell."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from ..errors import RecipeError

TEXT, BOOLEAN, DATE, NUMBER, COMPOSITE = "text", "boolean", "date", "number", "composite"

_FAMILIES = (
    (TEXT, (T.StringType, T.CharType, T.VarcharType)),
    (BOOLEAN, (T.BooleanType,)),
    (DATE, (T.DateType, T.TimestampType, T.TimestampNTZType)),
    (NUMBER, (T.NumericType,)),
    (COMPOSITE, (T.ArrayType, T.StructType, T.MapType, T.VariantType)),
)

# How values are stored, and what they mean where the type alone tells.
_STORAGE = (
    ("boolean", "boolean", (T.BooleanType,)),
    ("date", "date", (T.DateType,)),
    ("date", "datetime", (T.TimestampType, T.TimestampNTZType)),
    ("decimal", "decimal", (T.DecimalType,)),
    ("double", "decimal", (T.DoubleType, T.FloatType)),
    ("bigint", "integer", (T.LongType,)),
    ("int", "integer", (T.IntegerType, T.ShortType, T.ByteType)),
    ("string", None, (T.StringType, T.CharType, T.VarcharType)),
    (COMPOSITE, None, (T.ArrayType, T.StructType, T.MapType, T.VariantType)),
)

# Fixed value: text that may stand as a bare number (no inf, nan or 1_000).
NUMERIC_TEXT = re.compile(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")

# Fixed value: the shape of a type name "change type" accepts.
TYPE_TEXT = re.compile(r"^[A-Za-z][A-Za-z0-9_ (),]*$")

# The types offered by "change type".
OFFERED_TYPES = (
    "varchar",
    "integer",
    "bigint",
    "double",
    "decimal(18,2)",
    "date",
    "timestamp",
    "boolean",
)

# Names other engines use for types Spark spells differently.
_SPARK_SPELLING = {
    "varchar": "string",
    "char": "string",
    "text": "string",
    "nvarchar": "string",
    "int4": "int",
    "int8": "bigint",
    "int64": "bigint",
    "int2": "smallint",
    "float4": "float",
    "float8": "double",
    "float64": "double",
    "double precision": "double",
    "bool": "boolean",
    # Wall-clock time, like the timestamps in the tables this runs on.
    "timestamp": "timestamp_ntz",
    "datetime": "timestamp_ntz",
    "timestamptz": "timestamp_ltz",
    "timestamp with time zone": "timestamp_ltz",
}


def family(dtype: T.DataType) -> str:
    for name, classes in _FAMILIES:
        if isinstance(dtype, classes):
            return name
    return dtype.typeName()


def storage(dtype: T.DataType) -> str:
    return _stored(dtype)[0]


def meaning(dtype: T.DataType) -> str | None:
    """What every value of the type means; None where only the values can tell."""
    return _stored(dtype)[1]


def _stored(dtype: T.DataType) -> tuple[str, str | None]:
    found = (row[:2] for row in _STORAGE if isinstance(dtype, row[2]))
    return next(found, (dtype.typeName(), None))


def spark_type(text: object) -> str:
    name = str(text or "").strip()
    if not TYPE_TEXT.match(name):
        raise RecipeError(f"Invalid type: '{name}'.")
    base = name.split("(")[0].strip().lower()
    spelled = _SPARK_SPELLING.get(base)
    if spelled is None:
        return re.sub(r"^(?i:numeric|number)\b", "decimal", name)
    return spelled


def literal(value: object, dtype: T.DataType) -> Column:
    """A typed value as typed in a form: a bare number or boolean where the column is one."""
    text = str(value).strip()
    kind = family(dtype)
    if kind == NUMBER and NUMERIC_TEXT.match(text):
        return F.expr(text)
    if kind == BOOLEAN and text.lower() in ("true", "false"):
        return F.lit(text.lower() == "true")
    return F.lit(value)


def empty(c: Column, dtype: T.DataType) -> Column:
    """NULL, or for text a cell holding nothing but spaces. Every step uses this one rule."""
    if family(dtype) != TEXT:
        return c.isNull()
    return c.isNull() | (F.trim(c) == F.lit(""))


def filled(c: Column, dtype: T.DataType) -> Column:
    if family(dtype) != TEXT:
        return c.isNotNull()
    return c.isNotNull() & (F.trim(c) != F.lit(""))


def whole_number(
    value: object, default: int, label: str, what: str, least: int | None = None
) -> int:
    """An integer setting; 2.0 is one, 1.9, true and text are not."""
    if value is None or value == "":
        number = default
    elif isinstance(value, bool):
        raise RecipeError(f"{label}: {what} must be a whole number.")
    elif isinstance(value, float):
        if value != int(value):
            raise RecipeError(f"{label}: {what} must be a whole number, not {value}.")
        number = int(value)
    else:
        try:
            number = int(str(value).strip())
        except ValueError:
            raise RecipeError(f"{label}: {what} must be a whole number.") from None
    if least is not None and number < least:
        raise RecipeError(f"{label}: {what} must be at least {least}.")
    return number
