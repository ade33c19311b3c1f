"""What a text value looks like: the tests behind meanings and quality counts.

All of them are JVM regular expressions and safe casts, so a whole-table profile stays
inside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The shapes that define each meaning. (?U) gives \d and \s their Unicode reach.
EMAIL = r"(?iU)^[^@\s]+@[^@\s]+\.[a-z]{2,}$"
URL = r"(?iU)^https?://\S+$"
COUNTRY = r"^[A-Z]{2}$"
INTEGER = r"(?U)^-?\d+$"
DECIMAL = r"(?U)^-?\d*[.,]?\d+([eE][-+]?\d+)?$"
BOOLEAN_WORDS = ("true", "false", "0", "1", "yes", "no", "oui", "non", "t", "f")

# The characters that count as white space around a value.
BLANKS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A date, or a date and time to the minute, second or fraction with an optional zone offset.
_DAY = r"(?!0000)\d{4}-\d{2}-\d{2}"
_OFFSET = r"(?:[Zz]|[+-](?:[01]\d|2[0-3]):?[0-5]\d)"
_ISO = rf"^(?:({_DAY})|({_DAY}[ T]\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?){_OFFSET}?)$"


def _ipv4() -> str:
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return rf"{octet}(?:\.{octet}){{3}}"


def _ipv6() -> str:
    """Eight groups, or fewer around one '::', the last two optionally written as IPv4."""
    group = r"[0-9A-Fa-f]{1,4}"
    v4 = _ipv4()
    forms = [rf"{group}(?::{group}){{7}}", rf"{group}(?::{group}){{5}}:{v4}"]
    for left in range(8):
        head = rf"{group}(?::{group}){{{left - 1}}}" if left else ""
        room = 7 - left
        tails = [""]
        if room >= 1:
            tails.append(rf"{group}(?::{group}){{0,{room - 1}}}")
        if room >= 2:
            tails.append(rf"(?:{group}:){{0,{room - 2}}}{v4}")
        forms.append(rf"{head}::(?:{'|'.join(tails)})")
    return rf"(?:{'|'.join(forms)})(?:%[^%/]+)?"


IP = rf"^(?:{_ipv4()}|{_ipv6()})$"


def written(text: Column) -> Column:
    """The text without white space around it; NULL when nothing else is there."""
    return F.nullif(F.btrim(text, F.lit(BLANKS)), F.lit(""))


def temporal(text: Column) -> Column:
    """ISO shape, and a day and hour that exist."""
    instant = F.concat(F.regexp_extract(text, _ISO, 1), F.regexp_extract(text, _ISO, 2))
    return (instant != F.lit("")) & instant.try_cast("timestamp_ntz").isNotNull()


# Order matters: the first meaning that nine values in ten satisfy wins.
MAJORITY_MEANINGS = ("email", "url", "ip", "date", "country")
# Then the first that every value satisfies.
UNANIMOUS_MEANINGS = ("integer", "decimal", "boolean")


def looks_like(meaning: str, text: Column) -> Column:
    """Whether the whole text has the shape of the meaning.

    Only a date and an address with a zone may hold a space, so a text with a space
    elsewhere is settled by its first words and never reaches a regular expression.
    """
    space = F.instr(text, " ")
    if meaning in ("date", "datetime"):
        return F.when(space.isin(0, 11), temporal(text)).otherwise(F.lit(False))
    if meaning == "ip":
        return F.when((space == 0) | text.contains("%"), text.rlike(IP)).otherwise(F.lit(False))
    if meaning == "boolean":
        # No longer text can be one of the words, so long texts are not lowered.
        short = F.octet_length(text) <= F.lit(max(map(len, BOOLEAN_WORDS)))
        return F.when(short, F.lower(text).isin(*BOOLEAN_WORDS)).otherwise(F.lit(False))
    shape = {
        "email": EMAIL,
        "url": URL,
        "country": COUNTRY,
        "integer": INTEGER,
        "decimal": DECIMAL,
    }.get(meaning)
    if shape is None:
        return F.lit(True)
    return F.when(space == 0, text.rlike(shape)).otherwise(F.lit(False))
