"""Date formats, date parts and time slices."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..errors import RecipeError

# Strptime directive -> datetime pattern. The first form reads one or more
# digits; the second has a fixed width, for fields that touch each other (%Y%m%d).
_DIRECTIVES = {
    "Y": ("yyyy", "yyyy"),
    "m": ("M", "MM"),
    "d": ("d", "dd"),
    "H": ("H", "HH"),
    "I": ("h", "hh"),
    "M": ("m", "mm"),
    "S": ("s", "ss"),
    "f": ("SSSSSS", "SSSSSS"),
    "j": ("D", "DDD"),
    "b": ("MMM", "MMM"),
    "B": ("MMMM", "MMMM"),
    "p": ("a", "a"),
    "y": ("yy", "yy"),
}
_NUMERIC = set("YymdHIMSfj")
# What Spark's patterns cannot read, so it is taken out of the text first.
_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
_TAKEN_OUT = {
    "a": "(?i:" + "|".join(d[:3] for d in _DAYS) + ")",
    "A": "(?i:" + "|".join(_DAYS) + ")",
    "z": r"[+-]\d{2}(?::?\d{2})?",
}
# Two-digit years from here on belong to the 1900s.
_PIVOT = 69


def datetime_pattern(fmt: str) -> str:
    """A strptime format such as %d/%m/%Y, as a Spark datetime pattern."""
    pieces, fields = _fields(fmt)
    out = []
    for i, piece in enumerate(pieces):
        directive = fields[i]
        if directive in _TAKEN_OUT:
            continue
        if directive is None:
            text = "%" if piece == "%%" else piece
            out.append(re.sub(r"[A-Za-z%\[\]{}#']+", _quoted_text, text))
            continue
        if directive == "F":
            out.append("yyyy-M-d")
            continue
        if directive == "T":
            out.append("H:m:s")
            continue
        if directive not in _DIRECTIVES:
            raise RecipeError(
                f"Date format: directive '%{directive}' is not supported. "
                f"Supported: {', '.join('%' + d for d in [*_DIRECTIVES, *_TAKEN_OUT, 'F', 'T'])}."
            )
        neighbours = fields[max(0, i - 1) : i] + fields[i + 1 : i + 2]
        touching = any(n in _NUMERIC for n in neighbours if n) and directive in _NUMERIC
        out.append(_DIRECTIVES[directive][1 if touching else 0])
    return "".join(out)


def _fields(fmt: str) -> tuple[list[str], list[str | None]]:
    """The directives and literal texts of a format, and which of them are directives."""
    pieces = re.findall(r"%.|[^%]+|%$", fmt)
    return pieces, [
        p[1] if len(p) == 2 and p[0] == "%" and p != "%%" else None for p in pieces
    ]


def _quoted_text(match: re.Match) -> str:
    return "'" + match.group(0).replace("'", "''") + "'"


def parsed_timestamp(text: Column, fmt: str) -> Column:
    """Unreadable text gives NULL. A weekday's name must be one, and says nothing more; a time
    with an offset is given in UTC; two-digit years are those from 1969 to 2068."""
    pattern, (_, fields) = datetime_pattern(fmt), _fields(fmt)
    if "y" in fields and ("Y" in fields or "F" in fields):
        raise RecipeError("Date format: a year is read from '%y' or from '%Y', not from both.")
    if fields.count("z") > 1:
        raise RecipeError("Date format: '%z' can be there once.")
    offset = None
    if _TAKEN_OUT.keys() & set(fields):
        shape, rest, place = _taken_apart(fmt)
        if place:
            offset = F.regexp_extract(text, shape, place)
        text = F.when(text.rlike(shape), F.regexp_replace(text, shape, rest))
    moment = F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    if "y" in fields:
        before = moment - F.expr("INTERVAL 100 YEARS")
        moment = F.when(F.year(moment) >= 2000 + _PIVOT, before).otherwise(moment)
    if offset is not None:
        digits = F.regexp_replace(offset, "[^0-9]", "")
        hours = F.when(digits != "", F.substring(digits, 1, 2).cast("int")).otherwise(0)
        minutes = F.when(F.length(digits) == 4, F.substring(digits, 3, 2).cast("int")).otherwise(0)
        sign = F.when(offset.startswith("-"), -1).otherwise(1)
        ahead = F.make_dt_interval(F.lit(0), sign * hours, sign * minutes)
        moment = moment - ahead
    return moment


def _taken_apart(fmt: str) -> tuple[str, str, int]:
    """A regular expression of the whole text, what replaces a match so that only what Spark's
    pattern reads is left, and the group of the offset (0 without one)."""
    shape, rest, groups, place = [], [], 0, 0
    for piece, directive in zip(*_fields(fmt)):
        if directive is None:
            literal = "%" if piece == "%%" else piece
            shape.append(re.escape(literal))
            # Also digits, which would be read as part of the group before them.
            rest.append(re.sub(r"([\\$0-9])", r"\\\1", literal))
            continue
        groups += 1
        shape.append(f"({_TAKEN_OUT.get(directive, '.+?')})")
        if directive not in _TAKEN_OUT:
            rest.append(f"${groups}")
        if directive == "z":
            place = groups
    return "^" + "".join(shape) + "$", "".join(rest), place


# The parts "extract date parts" offers.
DATE_PARTS = ("year", "month", "day", "quarter", "week", "dow")


def date_part(part: str, c: Column) -> Column:
    """ISO week; day of week counts from 0 = Sunday. Always BIGINT."""
    makers = {
        "year": lambda: F.year(c),
        "month": lambda: F.month(c),
        "day": lambda: F.dayofmonth(c),
        "quarter": lambda: F.quarter(c),
        "week": lambda: F.weekofyear(c),
        "dow": lambda: F.dayofweek(c) - F.lit(1),
    }
    if part not in makers:
        raise RecipeError(
            f"Unknown date part: {part}. Choose among {', '.join(DATE_PARTS)}."
        )
    return makers[part]().cast("bigint")
