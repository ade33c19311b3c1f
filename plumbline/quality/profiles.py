"""Whole-table profiles: what columns hold, how clean they are, what a recipe changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import RecipeError
from ..functions import patterns
from ..functions.names import col
from ..functions.types import BOOLEAN, DATE, NUMBER, TEXT, family, filled, meaning, storage

# Columns measured by one aggregate: a wider dataset takes several.
_COLUMNS_PER_PASS = 50
# Bytes of a text from which its SHA-256, in as many digits, stands for it.
_DIGEST = 64
# The families a full profile can measure.
PROFILED = (TEXT, NUMBER, DATE, BOOLEAN)

# The share of filled values that settles a meaning, in percent.
_MAJORITY = 90


def quality_profile(df: DataFrame, sample: int | None = None) -> DataFrame:
    """Per column: storage, meaning, and how many values are fine, empty or off.

    Columns whose type says what they mean are counted in one aggregate. The others are
    tested against every meaning they could have in one more, and the meaning is chosen from
    the counts. ``sample`` restricts the profile to that many rows, for a quick look.
    """
    if sample is not None:
        df = df.limit(sample)
    fields = list(enumerate(df.schema.fields))
    typed = [(i, f) for i, f in fields if meaning(f.dataType)]
    others = [(i, f) for i, f in fields if not meaning(f.dataType)]
    parts = []
    if typed:
        parts.append(_typed_counts(df, typed))
    if others:
        parts.append(_text_counts(df, others))
    counts = reduce(DataFrame.union, parts)
    storages = [storage(f.dataType) for _, f in fields]
    n, filled_, ok = F.col("n"), F.col("n_filled"), F.col("n_ok")
    return counts.select(
        "position",
        _label_at(df.columns).alias("column"),
        _label_at(storages).alias("storage"),
        "meaning",
        "n_ok",
        (n - filled_).alias("n_empty"),
        (filled_ - ok).alias("n_nok"),
        _percent(ok).alias("ok"),
        _percent(n - filled_).alias("empty"),
        _percent(filled_ - ok).alias("nok"),
    )


def _label_at(labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("position") + F.lit(1))


def _percent(part: Column) -> Column:
    return F.bround(F.lit(100.0) * part / F.greatest(F.col("n"), F.lit(1)), 1)


def _typed_counts(df: DataFrame, columns: list[tuple[int, T.StructField]]) -> DataFrame:
    """A value of the right type is fine, except a number that is not one."""
    measures, entries = [F.count(F.lit(1)).alias("n")], []
    for i, f in columns:
        c = col(f.name)
        fine = c
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            fine = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
        measures += [F.count(c).alias(f"filled{i}"), F.count(fine).alias(f"ok{i}")]
        entries.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(meaning(f.dataType)).alias("meaning"),
                F.col("n"),
                F.col(f"filled{i}").alias("n_filled"),
                F.col(f"ok{i}").alias("n_ok"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*entries)))


def _text_counts(df: DataFrame, columns: list[tuple[int, T.StructField]]) -> DataFrame:
    """One pass over (column, value) pairs; the whole text of every value is tested."""
    meanings = (*patterns.MAJORITY_MEANINGS, *patterns.UNANIMOUS_MEANINGS)
    texts = df.select(*[col(f.name).cast("string").alias(str(i)) for i, f in columns])
    cells = texts.unpivot([], texts.columns, "place", "cell").select(
        F.col("place").cast("int").alias("position"),
        patterns.written(F.col("cell")).alias("value"),
    )
    tested = cells.select(
        "position", "value", *[patterns.looks_like(m, F.col("value")).alias(m) for m in meanings]
    )
    counted = tested.groupBy("position").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("n_filled"),
        *[F.count_if(m).alias(m) for m in meanings],
    )
    # A dataset without rows still has columns: they count nothing.
    every = df.sparkSession.createDataFrame([(i,) for i, _ in columns], "position int")
    whole = every.join(counted, "position", "left").na.fill(0)
    return whole.select("*", _chosen_meaning().alias("meaning")).select(
        "position", "meaning", "n", "n_filled", _valid(meanings).alias("n_ok")
    )


def _chosen_meaning() -> Column:
    chosen = F.lit("text")
    for m in reversed(patterns.UNANIMOUS_MEANINGS):
        chosen = F.when(F.col(m) == F.col("n_filled"), m).otherwise(chosen)
    for m in reversed(patterns.MAJORITY_MEANINGS):
        enough = F.col(m) * 100 >= F.col("n_filled") * _MAJORITY
        chosen = F.when(enough, m).otherwise(chosen)
    return F.when(F.col("n_filled") == 0, "text").otherwise(chosen)


def _valid(meanings: tuple[str, ...]) -> Column:
    """Values that fit the meaning; any text fits "text"."""
    fits = F.col("n_filled")
    for m in meanings:
        fits = F.when(F.col("meaning") == m, F.col(m)).otherwise(fits)
    return fits


# ------------------------------------------------------------------------- full profile


def profiled_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """The columns a full profile covers, and those whose type it cannot measure."""
    fit = [f.name for f in df.schema.fields if family(f.dataType) in PROFILED]
    return fit, [n for n in df.columns if n not in fit]


def _profilable(df: DataFrame) -> list[str]:
    names, _ = profiled_columns(df)
    if not names:
        raise RecipeError("No column of this dataset can be profiled.")
    return names


def full_profile(df: DataFrame) -> DataFrame:
    """Per column: total rows, filled, empty, exact distinct values, min and max as text.

    Rows, filled cells, minimum and maximum are plain aggregates of one pass. Distinct values
    are counted on (column, value) pairs, one pass per stored type over its columns only;
    pairs are combined in the map tasks before they travel.
    """
    names = _profilable(df)
    numbered = list(enumerate(names))
    passes = [
        _measured(df, numbered[at : at + _COLUMNS_PER_PASS])
        for at in range(0, len(names), _COLUMNS_PER_PASS)
    ]
    return (
        reduce(DataFrame.union, passes)
        .join(_distinct_counts(df, names), "position", "left")
        .select(
            "position",
            "column",
            "total",
            "filled",
            "empty",
            F.coalesce("distinct", F.lit(0)).alias("distinct"),
            "min",
            "max",
        )
    )


def _measured(df: DataFrame, numbered: list[tuple[int, str]]) -> DataFrame:
    """Everything but the distinct values of some columns, in one aggregate."""
    measures = [F.count(F.lit(1)).alias("total")]
    for i, n in numbered:
        c = col(n)
        measures += [
            F.count_if(filled(c, df.schema[n].dataType)).alias(f"filled{i}"),
            F.min(c).cast("string").alias(f"min{i}"),
            F.max(c).cast("string").alias(f"max{i}"),
        ]
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(n).alias("column"),
            F.col("total"),
            F.col(f"filled{i}").alias("filled"),
            (F.col("total") - F.col(f"filled{i}")).alias("empty"),
            F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"),
        )
        for i, n in numbered
    ]
    return df.agg(*measures).select(F.inline(F.array(*entries)))


def _distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns of one stored type share a pass and keep their type: no value becomes text."""
    by_type: dict[str, list[Column]] = {}
    for i, n in enumerate(names):
        kind, value = _comparable(col(n), df.schema[n].dataType)
        by_type.setdefault(kind, []).append(value.alias(str(i)))
    parts = []
    for values in by_type.values():
        slim = df.select(*values)
        pairs = slim.unpivot([], slim.columns, "place", "value")
        parts.append(
            pairs.filter(F.col("value").isNotNull())
            .distinct()
            .groupBy(F.col("place").cast("int").alias("position"))
            .agg(F.count(F.lit(1)).alias("distinct"))
        )
    return reduce(DataFrame.union, parts)


def _comparable(c: Column, dtype: T.DataType) -> tuple[str, Column]:
    """A type the values can be compared in, and the values in that type, one to one."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return "bigint", c.cast("bigint")
    if isinstance(dtype, T.DateType):
        return "bigint", F.unix_date(c).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return "bigint", F.unix_micros(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double", c.cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return "timestamp_ntz", c
    # Long texts are told apart by their digest, which is as long as the shortest of them.
    text = c.cast("string")
    long = F.octet_length(text) >= _DIGEST
    return "string", F.when(long, F.sha2(text.cast("binary"), 256)).otherwise(text)


def profile_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two full profiles: rows gained or lost, or values emptied.

    Emptied values are compared only at equal row counts: a filter that drops rows also
    drops empty cells without damaging any value.
    """
    a, b = before.alias("a"), after.alias("b")
    same = F.col("a.total") == F.col("b.total")
    pairs = b.join(a, F.col("a.column") == F.col("b.column"), "left")
    emptied = pairs.filter(same & (F.col("b.empty") > F.col("a.empty"))).select(
        F.lit("emptied").alias("kind"),
        F.col("b.column").alias("column"),
        F.col("a.empty").alias("before"),
        F.col("b.empty").alias("after"),
        F.lit(None).cast("double").alias("pct"),
    )
    totals = before.agg(F.max("total").alias("before")).crossJoin(
        after.agg(F.max("total").alias("after"))
    )
    gap = F.abs(F.col("before") - F.col("after"))
    rows = totals.filter((F.col("before") > 0) & (F.col("before") != F.col("after"))).select(
        F.when(F.col("before") > F.col("after"), "rows_removed")
        .otherwise("rows_added")
        .alias("kind"),
        F.lit(None).cast("string").alias("column"),
        "before",
        "after",
        F.bround(gap * F.lit(100.0) / F.col("before"), 1).alias("pct"),
    )
    return rows.union(emptied)


def profile_of_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """The delta between a recipe's input and its output, from one narrow aggregate of each."""
    return profile_delta(_fill_counts(before), _fill_counts(after))


def _fill_counts(df: DataFrame) -> DataFrame:
    """``column``, ``total`` and ``empty`` of a full profile."""
    names = _profilable(df)
    counts = [F.count_if(filled(col(n), df.schema[n].dataType)) for n in names]
    one = df.agg(F.count(F.lit(1)).alias("total"), F.array(*counts).alias("filled"))
    listed = F.array(*map(F.lit, names))
    return one.select("total", "filled", F.posexplode(listed).alias("at", "column")).select(
        "column", "total", (F.col("total") - F.col("filled")[F.col("at")]).alias("empty")
    )
