"""What a join does to rows, measured on whole tables without running the join.

Each side is counted per key first, which also makes keys unique; one full outer join of
those counts then tells keys, repeats, orphans and empty keys of both sides. The number of
output rows follows from the same counts: a driver row comes out once per match, so rows are
products of counts and even a many-to-many join is measured without being materialized.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import RecipeError
from ..functions.names import col, require
from ..operators.joins import join_settings
from ..plans.spec import check_shape, resolve_inputs

_WEIGHT = "decimal(38,0)"


def diagnose_join(
    spark: SparkSession, spec: dict, datasets: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """One row per joined input: rows in and out, and per side keys, repeats, orphans, NULLs.

    ``driver_rows`` and ``output_rows`` concern the whole recipe and repeat on every row. No
    incremental bound applies: this counts what the tables hold.
    """
    check_shape(spec)
    if len(spec.get("inputs") or []) < 2 or spec.get("type") != "join":
        raise RecipeError("The diagnosis is for a join recipe, with at least two inputs.")
    inputs = resolve_inputs(spark, spec, datasets or {})
    aliases = list(inputs)
    checks = []
    for n, alias in enumerate(aliases[1:], start=1):
        kind, pairs = join_settings(spec, n, alias)
        for left, right in pairs:
            require(inputs[aliases[0]], left, f"Join on '{alias}'")
            require(inputs[alias], right, f"Join on '{alias}'")
        checks.append((n, alias, kind, pairs))
    driver = inputs[aliases[0]]
    totals = driver.agg(F.count(F.lit(1)).alias("driver_rows")).crossJoin(
        _output_rows(driver, inputs, checks)
    )
    sides = [_measured(driver, inputs[a], n, a, kind, pairs) for n, a, kind, pairs in checks]
    return totals.crossJoin(reduce(DataFrame.union, sides))


def _counted(df: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """Rows per key, under names of their own, and whether a part of the key is NULL."""
    keys = [col(c).alias(f"{prefix}{i}") for i, c in enumerate(names)]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}n"))
    absent = reduce(Column.__or__, [F.col(f"{prefix}{i}").isNull() for i in range(len(names))])
    return counts.withColumn(f"{prefix}null", absent)


def _measured(
    driver: DataFrame, joined: DataFrame, n: int, alias: str, kind: str, pairs: list
) -> DataFrame:
    label = ", ".join(f"{a} = {b}" for a, b in pairs)
    head = [
        F.lit(n).alias("position"),
        F.lit(alias).alias("alias"),
        F.lit(kind).alias("type"),
        F.lit(label).alias("keys"),
    ]
    names = ("driver_keys", "driver_max", "driver_nulls", "joined_keys", "joined_max")
    names += ("joined_nulls", "driver_orphans", "joined_orphans")
    if kind == "cross":
        none = [F.lit(None).cast("bigint").alias(x) for x in names]
        return joined.agg(F.count(F.lit(1)).alias("joined_rows")).select(*head, "joined_rows", *none)
    left = _counted(driver, [a for a, _ in pairs], "l")
    right = _counted(joined, [b for _, b in pairs], "r")
    on = reduce(Column.__and__, [F.col(f"l{i}") == F.col(f"r{i}") for i in range(len(pairs))])
    both = left.join(right, on, "full")

    def total(side: str, where: Column | None = None) -> Column:
        c = F.col(f"{side}n")
        return F.coalesce(F.sum(c if where is None else F.when(where, c)), F.lit(0))

    def keyed(side: str) -> Column:
        return F.when(~F.col(f"{side}null"), F.col(f"{side}n"))

    return both.agg(
        total("r").alias("joined_rows"),
        F.count(keyed("l")).alias("driver_keys"),
        F.coalesce(F.max(keyed("l")), F.lit(0)).alias("driver_max"),
        total("l", F.col("lnull")).alias("driver_nulls"),
        F.count(keyed("r")).alias("joined_keys"),
        F.coalesce(F.max(keyed("r")), F.lit(0)).alias("joined_max"),
        total("r", F.col("rnull")).alias("joined_nulls"),
        total("l", F.col("rn").isNull()).alias("driver_orphans"),
        total("r", F.col("ln").isNull()).alias("joined_orphans"),
    ).select(*head, "joined_rows", *names)


def _output_rows(driver: DataFrame, inputs: dict[str, DataFrame], checks: list) -> DataFrame:
    """Output rows of the whole chain, from counts alone.

    ``state`` weighs each combination of driver keys by the output rows it stands for.
    ``apart`` counts the output rows without a driver row, which right and full joins keep;
    their keys are NULL, so later joins can only keep, drop or cross them.
    """
    used = list(dict.fromkeys(a for _, _, _, pairs in checks for a, _ in pairs))
    place = {c: f"d{i}" for i, c in enumerate(used)}
    keys = [col(c).alias(n) for c, n in place.items()]
    rows = F.count(F.lit(1)).cast(_WEIGHT).alias("w")
    state = driver.groupBy(*keys).agg(rows) if keys else driver.agg(rows)
    nothing = F.lit(0).cast(_WEIGHT)
    apart = driver.sparkSession.range(1).select(nothing.alias("apart"))
    for n, alias, kind, pairs in checks:
        joined = inputs[alias]
        if kind == "cross":
            times = joined.agg(F.count(F.lit(1)).cast(_WEIGHT).alias("times"))
            state = state.crossJoin(times).select(
                *place.values(), (F.col("w") * F.col("times")).cast(_WEIGHT).alias("w")
            )
            apart = apart.crossJoin(times).select(
                (F.col("apart") * F.col("times")).cast(_WEIGHT).alias("apart")
            )
            continue
        right = _counted(joined, [b for _, b in pairs], "r")
        on = reduce(
            Column.__and__,
            [F.col(place[a]) == F.col(f"r{i}") for i, (a, _) in enumerate(pairs)],
        )
        if kind in ("right", "full"):
            present = state.filter("w > 0").select(*{place[a] for a, _ in pairs}).distinct()
            alone = right.join(present, on, "left_anti").agg(
                F.coalesce(F.sum("rn"), F.lit(0)).cast(_WEIGHT).alias("alone")
            )
            kept = F.col("apart") if kind == "full" else nothing
            apart = apart.crossJoin(alone).select(
                (kept + F.col("alone")).cast(_WEIGHT).alias("apart")
            )
        if kind == "inner":
            apart = apart.select(nothing.alias("apart"))
        least = 1 if kind in ("left", "full") else 0
        matches = F.coalesce(F.col("rn"), F.lit(least)).cast(_WEIGHT)
        state = state.join(right, on, "left").select(
            *place.values(), (F.col("w") * matches).cast(_WEIGHT).alias("w")
        )
    total = state.agg(F.coalesce(F.sum("w"), F.lit(0)).cast(_WEIGHT).alias("matched"))
    return total.crossJoin(apart).select(
        (F.col("matched") + F.col("apart")).cast("bigint").alias("output_rows")
    )


# ----------------------------------------------------------------------------- findings


class Rule(NamedTuple):
    """A finding on a row of the diagnosis: when it holds, and what it says of which input.

    ``when``, ``side``, ``n`` and ``values`` are SQL over the diagnosis and ``driver``.
    """

    when: str
    level: str
    kind: str
    side: str
    n: str
    title: str
    values: str


_KEYED = "type <> 'cross' and "
_RULES = [
    Rule("position = 1 and driver_rows = 0", "warn", "empty", "driver", "driver_rows",
         "No rows in %s, so there is nothing to judge.", "driver"),
    Rule("position = 1 and driver_rows > 0 and output_rows > driver_rows", "bad", "fan_out",
         "driver", "output_rows", "%s has %d rows and the join gives %d: sums are overstated.",
         "driver, driver_rows, output_rows"),
    Rule("position = 1 and output_rows < driver_rows", "warn", "lost", "driver", "output_rows",
         "%s has %d rows and only %d come out.", "driver, driver_rows, output_rows"),
    Rule("position = 1 and driver_rows > 0 and output_rows = driver_rows", "ok", "same", "driver",
         "output_rows", "%s has %d rows and as many come out; repeats and losses may cancel out.",
         "driver, output_rows"),
    Rule("type = 'cross' and joined_rows > 1", "bad", "cross", "alias", "joined_rows",
         "Every row meets all %2$d rows of %1$s, as no key is compared.", "alias, joined_rows"),
    Rule("type = 'cross' and joined_rows <= 1", "ok", "cross", "alias", "joined_rows",
         "No key is compared with %s, which has %d rows.", "alias, joined_rows"),
    Rule(_KEYED + "joined_max <= 1 and driver_max <= 1", "ok", "1-1", "alias", "joined_max",
         "One row on either side of %s.", "keys"),
    Rule(_KEYED + "joined_max <= 1 and driver_max > 1", "ok", "N-1", "alias", "joined_max",
         "Each key of %s has one row in %s.", "keys, alias"),
    Rule(_KEYED + "joined_max > 1 and driver_max <= 1", "bad", "1-N", "alias", "joined_max",
         "A key of %s has up to %d rows in %s: group that input first.",
         "keys, joined_max, alias"),
    Rule(_KEYED + "joined_max > 1 and driver_max > 1", "bad", "N-N", "alias", "joined_max",
         "A key of %s has up to %d rows in %s and %d in %s: it may lack a column.",
         "keys, driver_max, driver, joined_max, alias"),
]
# What holds for either side: its column in front of the counts, and the joins that keep it.
for _side, _counts, _keeps in (
    ("driver", "driver", "('left', 'full')"),
    ("alias", "joined", "('right', 'full')"),
):
    _alone = f"{_KEYED}{_counts}_orphans > 0 and type "
    _values = f"{_counts}_orphans, {_side}, type"
    _RULES += [
        Rule(f"{_alone} in {_keeps}", "warn", "orphans_kept", _side, f"{_counts}_orphans",
             "%d rows of %s match nothing and stay half empty after a %s join.", _values),
        Rule(f"{_alone} not in {_keeps}", "bad", "orphans_dropped", _side, f"{_counts}_orphans",
             "%d rows of %s match nothing and do not survive a %s join.", _values),
        Rule(f"{_KEYED}{_counts}_nulls > 0", "warn", "null_keys", _side, f"{_counts}_nulls",
             "%d rows of %s have no key, which equals no other key.", f"{_counts}_nulls, {_side}"),
    ]


def finding_rows(diagnosis: DataFrame, driver: str) -> DataFrame:
    """position, level, kind, alias, n, title: one row per rule that holds for a joined input."""
    found = [
        F.when(
            F.expr(r.when),
            F.struct(
                F.lit(r.level).alias("level"),
                F.lit(r.kind).alias("kind"),
                F.expr(r.side).alias("alias"),
                F.expr(r.n).cast("bigint").alias("n"),
                F.expr(f"format_string('{r.title}', {r.values})").alias("title"),
            ),
        )
        for r in _RULES
    ]
    named = diagnosis.withColumn("driver", F.lit(driver))
    held = F.array_compact(F.array(*found))
    return named.select("position", F.inline(held))


def join_findings(
    spark: SparkSession, spec: dict, datasets: Mapping[str, DataFrame] | None = None
) -> list[dict]:
    """What the counts mean, as {level, kind, alias, n, title}: a few for each input."""
    driver = next(iter(resolve_inputs(spark, spec, datasets or {})))
    rows = finding_rows(diagnose_join(spark, spec, datasets), driver).orderBy("position")
    return [r.asDict() for r in rows.drop("position").collect()]
