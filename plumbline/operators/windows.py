"""Window functions and one-row-per-key, safe when one group holds most of the rows.

Measures of whole groups are aggregated, with a map-side combine, and joined back: a join
whose one side has a row per key, which adaptive execution broadcasts or splits where a key is
hot. Ordered functions use Spark's own Window operator: one shuffle on the partition keys.
Groups found hot (see ``skew``) are handled apart:

* ordered functions range-partition the rows by key *and* order, so a hot group spans many
  tasks; each row then gets its exact position from its place in its piece plus the sizes of
  the pieces before it, and the function is evaluated over slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import RecipeError
from ..functions.names import (
    col,
    cols,
    filled_names,
    new_name,
    put,
    require,
    spare_name,
)
from ..functions.types import whole_number
from .skew import HotGroups, hot_groups, same_keys, settled

# The functions offered, and what each one needs.
FUNCTIONS = (
    "row_number",
    "rank",
    "dense_rank",
    "lag",
    "lead",
    "running_sum",
    "moving_avg",
    "sum",
    "avg",
    "min",
    "max",
    "count",
)
NEEDS_COLUMN = ("lag", "lead", "running_sum", "moving_avg", "sum", "avg", "min", "max")
NEEDS_ORDER = ("row_number", "rank", "dense_rank", "lag", "lead", "running_sum", "moving_avg")

_WHOLE_GROUP: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
}


@dataclass(frozen=True)
class Order:
    column: str
    descending: bool

    def term(self) -> Column:
        """NULLs always last: a row without a date is never the most recent one."""
        c = col(self.column)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()


def read_order(df: DataFrame, params: dict, label: str) -> list[Order]:
    return [
        Order(require(df, (o or {}).get("column"), label), bool((o or {}).get("descending")))
        for o in params.get("order_by") or []
    ]


@dataclass(frozen=True)
class WindowCall:
    fn: str
    column: str
    keys: tuple[str, ...]
    order: tuple[Order, ...]
    reach: int  # offset of lag/lead, width of moving_avg
    into: str

    def value(self) -> Column:
        """The function over Spark's own window, for groups one task can hold."""
        spec = Window.partitionBy(*cols(self.keys)) if self.keys else Window.partitionBy()
        if self.order:
            spec = spec.orderBy(*[o.term() for o in self.order])
        return self.over(spec)

    def over(self, spec) -> Column:
        fn, c = self.fn, col(self.column) if self.column else None
        if fn in ("row_number", "rank", "dense_rank"):
            return getattr(F, fn)().over(spec).cast("bigint")
        if fn in ("lag", "lead"):
            return getattr(F, fn)(c, self.reach).over(spec)
        if fn == "running_sum":
            return F.sum(c).over(spec.rowsBetween(Window.unboundedPreceding, 0))
        if fn == "moving_avg":
            return F.avg(c).over(spec.rowsBetween(1 - self.reach, 0))
        return self.measure().over(spec)

    def measure(self) -> Column:
        if self.fn == "count":
            return F.count(F.lit(1))
        return _WHOLE_GROUP[self.fn](col(self.column))


def window_function(df: DataFrame, params: dict) -> DataFrame:
    call = read_call(df, params)
    if call.fn not in NEEDS_ORDER:
        return _whole_group(df, call)
    return evaluate(df, call, hot_groups(df, list(call.keys)))


def evaluate(df: DataFrame, call: WindowCall, hot: HotGroups) -> DataFrame:
    """Adds the column of the call, given the groups of its keys that are hot."""
    if not hot:
        return put(df, call.into, call.value())
    large = _large_groups(hot.inside(df), call, hot)
    if not call.keys:
        return large
    return put(hot.outside(df), call.into, call.value()).union(large)


def read_call(df: DataFrame, params: dict) -> WindowCall:
    label = "Window function"
    fn = params.get("fn") or "row_number"
    if fn not in FUNCTIONS:
        raise RecipeError(f"{label}: unknown function '{fn}'.")
    into = new_name(params.get("into"))
    column = require(df, params.get("column"), label) if fn in NEEDS_COLUMN else ""
    keys = [require(df, k, label) for k in params.get("partition_by") or []]
    order = read_order(df, params, label)
    if fn in NEEDS_ORDER and not order:
        raise RecipeError(f"{label}: '{fn}' needs an order. Add a sort column.")
    if order and fn not in NEEDS_ORDER:
        raise RecipeError(
            f"{label}: '{fn}' covers the whole window and takes no order; with one it would "
            "become a running value. Remove the sort, or use 'running_sum'."
        )
    reach = 0
    if fn in ("lag", "lead"):
        reach = whole_number(params.get("offset"), 1, label, "the offset", least=1)
    if fn == "moving_avg":
        reach = whole_number(params.get("window_rows"), 3, label, "the width", least=2)
    if into in df.columns and into in {column, *keys, *(o.column for o in order)}:
        raise RecipeError(
            f"{label}: '{into}' is used by this window; writing the result over it would "
            "erase the data it comes from. Choose another output name."
        )
    return WindowCall(fn, column, tuple(keys), tuple(order), reach, into)


def without_unread(df: DataFrame, params: dict, kept: list) -> DataFrame:
    """The rows without what neither the function reads nor a keep step behind it lets
    through: rows of hot groups are written once, from which no later plan can drop columns."""
    call = read_call(df, params)
    if any(c != call.into and c not in df.columns for c in kept):
        return df  # that step will say which
    read = {call.column, *call.keys, *(o.column for o in call.order), *kept}
    # A column of the result's name keeps its place, or is refused if only its case differs.
    left = [c for c in df.columns if c in read or c.lower() == call.into.lower()]
    return df.select(*cols(left)) if left else df


# ------------------------------------------------------------------------ hot groups


def _large_groups(df: DataFrame, call: WindowCall, hot: HotGroups) -> DataFrame:
    if call.fn not in NEEDS_ORDER:
        return _whole_group(df, call, hot)
    columns = df.columns
    out = put(df, call.into, F.lit(None)).columns
    if call.fn in ("rank", "dense_rank"):
        return _ranked(df, call, hot).select(*cols(out))
    place = spare_name("place", [*columns, call.into])
    placed = _placed(df, call.keys, call.order, hot, place)
    if call.fn == "row_number":
        return put(placed, call.into, col(place)).select(*cols(out))
    if call.fn == "running_sum":
        return _running_sum(placed, call, place, hot).select(*cols(out))
    return _neighbours(placed, call, place, hot.limit).select(*cols(out))


def _whole_group(df: DataFrame, call: WindowCall, hot: HotGroups | None = None) -> DataFrame:
    """One row per key joins back, or one row to all; Spark chooses how from measured sizes."""
    value = spare_name("value", [*df.columns, call.into])
    names = {k: spare_name(f"key{i}", df.columns) for i, k in enumerate(call.keys)}
    totals = df.groupBy(*[col(k).alias(n) for k, n in names.items()]).agg(
        call.measure().alias(value)
    )
    if call.keys:
        totals = hot.beside(totals) if hot else totals
        joined = df.join(totals, same_keys(df, totals, list(names.items())), "left")
    else:
        joined = df.crossJoin(F.broadcast(totals))  # one row
    return put(joined.select(*cols(df.columns), col(value)), call.into, col(value)).select(
        *cols(put(df, call.into, F.lit(None)).columns)
    )


def _placed(
    df: DataFrame,
    keys: tuple[str, ...],
    order: tuple[Order, ...],
    hot: HotGroups,
    place: str,
) -> DataFrame:
    """Adds the exact position (1, 2, ...) of each row in its group.

    Rows are range-partitioned by key and order; the map task number breaks ties, so equal
    rows spread too and a retried task sends every row where it went before. The sorted
    pieces are written once, which fixes the order among ties for everything that follows.
    """
    piece, serial = spare_name("piece", df.columns), spare_name("serial", df.columns)
    by = [col(k).asc_nulls_first() for k in keys] + [o.term() for o in order]
    pieces = settled(
        df.repartitionByRange(hot.pieces, *by, F.spark_partition_id())
        .sortWithinPartitions(*by)
        .select(
            "*",
            F.spark_partition_id().alias(piece),
            F.monotonically_increasing_id().alias(serial),
        )
    )
    names = {k: spare_name(f"key{i}", df.columns) for i, k in enumerate(keys)}
    at, first, size, before = (
        spare_name(n, [*df.columns, place]) for n in ("at", "first", "size", "before")
    )
    # One row per (group, piece): at most the hot keys plus the pieces.
    sizes = pieces.groupBy(
        *[col(k).alias(n) for k, n in names.items()], col(piece).alias(at)
    ).agg(F.min(col(serial)).alias(first), F.count(F.lit(1)).alias(size))
    earlier = (
        Window.partitionBy(*cols(names.values()))
        .orderBy(col(at))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        "*", F.coalesce(F.sum(col(size)).over(earlier), F.lit(0)).alias(before)
    )
    on = same_keys(pieces, offsets, [*names.items()]) & (col(piece) == col(at))
    return pieces.join(hot.beside(offsets), on, "inner").select(
        *cols(df.columns),
        (col(before) + col(serial) - col(first) + F.lit(1)).alias(place),
    )


def _running_sum(
    placed: DataFrame, call: WindowCall, place: str, hot: HotGroups
) -> DataFrame:
    """Sum inside slices of bounded size, plus what the slices before hold."""
    taken = [*placed.columns, call.into]
    part, total, at, base = (spare_name(n, taken) for n in ("slice", "total", "at", "base"))
    names = {k: spare_name(f"key{i}", taken) for i, k in enumerate(call.keys)}
    sliced = placed.select("*", _slice(place, hot.slice_rows).alias(part))
    totals = sliced.groupBy(
        *[col(k).alias(n) for k, n in names.items()], col(part).alias(at)
    ).agg(F.sum(col(call.column)).alias(total))
    earlier = (
        Window.partitionBy(*cols(names.values()))
        .orderBy(col(at))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = totals.select("*", F.sum(col(total)).over(earlier).alias(base))
    inside = Window.partitionBy(*cols([*call.keys, part])).orderBy(col(place))
    local = F.sum(col(call.column)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    here = spare_name("here", taken)
    summed = sliced.select("*", local.alias(here))
    on = same_keys(summed, bases, [*names.items()]) & (col(part) == col(at))
    joined = summed.join(hot.beside(bases), on, "inner")
    # A sum of nothing but NULLs is NULL, on either side.
    value = F.when(col(here).isNull(), col(base)).otherwise(
        F.coalesce(col(base) + col(here), col(here))
    )
    # The type that one window over the whole group gives: adding sums widens decimals.
    plain = placed.select(F.sum(col(call.column))).schema[0].dataType
    return put(joined, call.into, value.cast(plain))


def _neighbours(placed: DataFrame, call: WindowCall, place: str, limit: int) -> DataFrame:
    """lag, lead and moving average: slices that also see the rows just outside them."""
    width = max(limit, call.reach)
    taken = [*placed.columns, call.into]
    home, part = spare_name("home", taken), spare_name("slice", taken)
    own = _slice(place, width)
    if call.fn == "lead":
        shared = (own > 0) & ((col(place) - F.lit(1)) % F.lit(width) < F.lit(call.reach))
        other = own - F.lit(1)
    else:
        reach = call.reach if call.fn == "lag" else call.reach - 1
        shared = (col(place) - F.lit(1)) % F.lit(width) >= F.lit(width - reach)
        other = own + F.lit(1)
    seen = placed.select("*", own.alias(home)).select(
        "*",
        F.explode(F.when(shared, F.array(own, other)).otherwise(F.array(own))).alias(part),
    )
    spec = Window.partitionBy(*cols([*call.keys, part])).orderBy(col(place))
    return put(seen, call.into, call.over(spec)).filter(col(part) == col(home))


def _ranked(df: DataFrame, call: WindowCall, hot: HotGroups) -> DataFrame:
    """Rank of a tie = number of rows before it; dense rank = number of ties before it.

    Ties are aggregated first, so the numbering runs over distinct (group, order) values.
    """
    by = list(dict.fromkeys([*call.keys, *(o.column for o in call.order)]))
    taken = [*df.columns, call.into]
    size, place, value = (spare_name(n, taken) for n in ("size", "place", "value"))
    ties = df.groupBy(*cols(by)).agg(F.count(F.lit(1)).alias(size))
    numbered = _placed(ties, call.keys, call.order, hot, place)
    if call.fn == "dense_rank":
        ranks = numbered.select(*cols(by), col(place).alias(value))
    else:
        total = WindowCall("running_sum", size, call.keys, call.order, 0, value)
        ranks = _running_sum(numbered, total, place, hot).select(
            *cols(by), (col(value) - col(size) + F.lit(1)).alias(value)
        )
    names = {c: spare_name(f"by{i}", taken) for i, c in enumerate(by)}
    ranks = ranks.select(*[col(c).alias(n) for c, n in names.items()], col(value))
    joined = df.join(ranks, same_keys(df, ranks, list(names.items())), "inner")
    return put(joined.select(*cols(df.columns), col(value)), call.into, col(value))


def _slice(place: str, width: int) -> Column:
    return F.floor((col(place) - F.lit(1)) / F.lit(width)).cast("bigint")


# ------------------------------------------------------------------------ one row per key


def dedup_key(df: DataFrame, params: dict) -> DataFrame:
    """First row per key, or every row tied for first.

    ``row_number() = 1`` is cut down inside each map task before the shuffle, so a hot key
    sends at most one row per task. Ties are then the rows equal to that winner.
    """
    label = "One row per key"
    keys = filled_names(params.get("keys"))
    if not keys:
        raise RecipeError(f"{label}: choose at least one key column.")
    for k in keys:
        require(df, k, label)
    order = read_order(df, params, label)
    if not order:
        raise RecipeError(f"{label}: say what to sort on, so the row to keep is known.")
    ties = params.get("ties") or "one"
    if ties not in ("one", "all"):
        raise RecipeError(f"{label}: unknown tie rule '{ties}'.")
    if ties == "one":
        return _first_rows(df, keys, order)
    by = list(dict.fromkeys([*keys, *(o.column for o in order)]))
    hot = hot_groups(df, by)
    if not hot:
        return _first_rows(df, keys, order, F.rank)
    names = {c: spare_name(f"by{i}", df.columns) for i, c in enumerate(by)}
    first = _first_rows(df.select(*cols(by)), keys, order).select(
        *[col(c).alias(n) for c, n in names.items()]
    )
    return df.join(first, same_keys(df, first, list(names.items())), "left_semi")


def _first_rows(df: DataFrame, keys: list[str], order: list[Order], rank=F.row_number):
    place = spare_name("place", df.columns)
    spec = Window.partitionBy(*cols(keys)).orderBy(*[o.term() for o in order])
    return df.select("*", rank().over(spec).alias(place)).filter(col(place) == 1).select(
        *cols(df.columns)
    )
