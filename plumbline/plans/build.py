"""Building a recipe into its output, the first time and every time after.

A later build of an incremental output reads the bound from the table it wrote, filters the
*input* with it as a literal (so the filter reaches the file scan), computes the recipe on
what is left, and applies the strategy. The strategies follow the public documentation of
the build tool whose vocabulary the settings use.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import RecipeError
from ..functions.names import col, cols, filled_names, require, spare_name
from ..functions.types import DATE, TEXT, family
from ..operators import groups, joins
from ..operators.skew import described_only, same_keys, settled_rows_removed, settled_while
from ..quality.checks import declared_tests, enforce, run_tests
from ..sources.tables import SLICE, RecipeTable, bucket_of
from . import guards
from .output import (
    REPLACING,
    SCHEMA_CHANGES,
    Slices,
    bound_column,
    bound_is_inclusive,
    check_output,
    is_incremental,
    lookback,
    slices,
    strategy_of,
    unique_key,
)
from .partials import partials_of
from .recipe import compute
from .schema_change import Fit, fit, shaped
from .spec import check_shape, recipe_type, resolve_inputs

log = logging.getLogger(__name__)


def build(
    spark: SparkSession,
    spec: dict,
    datasets: Mapping[str, DataFrame] | None = None,
    target: str | None = None,
    now: datetime | None = None,
    full_refresh: bool = False,
) -> DataFrame:
    """Runs the recipe and writes its output; returns the dataset readers will see.

    ``target`` is a folder, needed by ``table`` and ``incremental`` outputs. ``now`` ends the
    last slice of a microbatch load and defaults to the current UTC time.

    The tests declared on the output's columns run on what was written, and a failing one of
    severity 'error' raises. A version written whole is not shown to readers before it has
    passed; rows added to the current version are there already.
    """
    check_shape(spec)
    out = spec.get("output") or {}
    check_output(out)
    inputs = resolve_inputs(spark, spec, datasets or {})
    kind = out.get("materialized") or "view"
    if kind == "ephemeral":
        return compute(spark, spec, inputs)
    if kind == "view":
        # Every reading of a view sees its inputs as they are then, all of them.
        with described_only():
            df = compute(spark, spec, inputs)
        if spec.get("name"):
            df.createOrReplaceTempView(str(spec["name"]))
        return df
    if not target:
        raise RecipeError(f"A '{kind}' output needs a target folder.")
    tests = declared_tests(spec)

    def passed(rows: DataFrame) -> None:
        enforce(run_tests(rows, tests, datasets))

    table = RecipeTable(spark, target, passed if tests else None)
    partition_by = filled_names(out.get("partition_by"))
    with settled_rows_removed(spark):
        if kind == "table":
            df = storable(compute(spark, spec, inputs))
            table.replace(df, _layout(partition_by, df.columns))
        elif strategy_of(out) == "microbatch":
            moment = now or datetime.now(timezone.utc).replace(tzinfo=None)
            _build_slices(spark, spec, inputs, table, moment, full_refresh)
        else:
            _build_incremental(spark, spec, inputs, table, partition_by, full_refresh)
    if tests and not table.checked:
        passed(table.read())
    return table.read()


def _build_incremental(
    spark: SparkSession,
    spec: dict,
    inputs: dict[str, DataFrame],
    table: RecipeTable,
    partition_by: list[str],
    full_refresh: bool,
) -> None:
    out, partials = spec.get("output") or {}, None
    first = full_refresh or not table.exists()
    if recipe_type(spec) == "group":
        ((driver, df),) = inputs.items()
        guards.check_group(spec, driver, df.columns)
        guards.check_produced(out, groups.output_names(spec))
        partials = partials_of(spec, df)
    if partials and not first and (test := bound_test(out, table)) is not None:
        fresh = partials.arrivals(df, test)
        if partials.fit(fresh.schema, table, out):
            load(table, fresh, out, merged=partials.merged)
            return
    seen = inputs if first else arrivals_only(spec, inputs, table)
    if partials:
        made = storable(partials.compute(seen[driver]))
    else:
        made = storable(compute(spark, spec, seen, this=None if first else table.read()))
    hidden = partials.hidden if partials else []
    if first:
        layout = _layout(partition_by, made.columns)
        table.replace(made, layout, bucket_keys(out, made.schema), hidden)
    else:
        load(table, made, out, hidden=hidden)


def storable(df: DataFrame) -> DataFrame:
    """A column that is NULL by construction has no type a file can hold: text stands in."""
    return df.select(
        *[
            (col(f.name).cast("string").alias(f.name) if f.dataType == T.NullType() else col(f.name))
            for f in df.schema.fields
        ]
    )


def _layout(partition_by: list[str], columns: list[str]) -> list[str]:
    missing = [c for c in partition_by if c not in columns]
    if missing:
        raise RecipeError(f"'partition_by' names {', '.join(missing)}, not in the output.")
    if partition_by and len(partition_by) == len(columns):
        raise RecipeError("'partition_by' cannot name every column.")
    return partition_by


# -------------------------------------------------------------------------------- bound


def arrivals_only(
    spec: dict, inputs: dict[str, DataFrame], table: RecipeTable
) -> dict[str, DataFrame]:
    """The inputs restricted to what the next build must read."""
    out = spec.get("output") or {}
    bound = bound_column(out)
    if not bound:
        return inputs
    kind = recipe_type(spec)
    driver = next(iter(inputs))
    if kind == "join":
        names = joins.output_names(spec, {a: df.columns for a, df in inputs.items()})
        guards.check_join(spec, inputs, names)
    if kind == "group":
        df = inputs[driver]
        guards.check_group(spec, driver, df.columns)
        test = bound_test(out, table)
        if test is None:
            return inputs
        return {driver: _touched_groups(df, test, filled_names(spec.get("group_by")))}
    bounded = inputs if kind == "stack" else {driver: inputs[driver]}
    for alias, df in bounded.items():
        guards.check_prepare_input(out, alias, df.columns)
    test = bound_test(out, table)
    if test is None:
        return inputs
    return inputs | {alias: df.filter(test) for alias, df in bounded.items()}


def bound_test(out: dict, table: RecipeTable) -> Column | None:
    """``column > bound`` with the bound as a literal; None when the table holds none."""
    name = bound_column(out)
    written = table.read()
    if name not in written.columns:
        raise RecipeError(f"The table has no column '{name}' to read the bound from.")
    bound = _maximum(written, name)
    if bound is None:
        return None
    window = lookback(out)
    if window:
        bound = _moved_back(bound, written.schema[name].dataType, *window)
    return col(name) >= bound if bound_is_inclusive(out) else col(name) > bound


def _maximum(df: DataFrame, name: str) -> Column | None:
    """The largest value, read once, as a foldable literal of the same type."""
    dtype = df.schema[name].dataType
    top = F.max(col(name))
    if isinstance(dtype, T.TimestampType):
        micros = df.agg(F.unix_micros(top)).first()[0]
        return None if micros is None else F.timestamp_micros(F.lit(micros))
    text = df.agg(top.cast("string")).first()[0]
    return None if text is None else F.lit(text).cast(dtype)


def _moved_back(bound: Column, dtype: T.DataType, n: int, unit: str) -> Column:
    if family(dtype) != DATE:
        raise RecipeError(
            f"A lookback of {n} {unit}s needs a date or timestamp column, "
            f"not {dtype.simpleString()}."
        )
    if isinstance(dtype, T.DateType) and unit == "hour":
        bound = bound.cast("timestamp_ntz")
    return bound - F.expr(f"INTERVAL '{n}' {unit.upper()}")


def _touched_groups(df: DataFrame, test: Column, keys: list[str]) -> DataFrame:
    """Every row of the groups that received one: a group is recomputed whole.

    Keys match by plain equality, so a group with a NULL key stays as first written.
    """
    names = {k: spare_name(f"key{i}", df.columns) for i, k in enumerate(keys)}
    touched = df.filter(test).select(*[col(k).alias(n) for k, n in names.items()]).distinct()
    on = reduce(Column.__and__, [col(k) == col(n) for k, n in names.items()])
    return df.join(touched, on, "left_semi")


# --------------------------------------------------------------------------- strategies


def bucket_keys(out: dict, schema: T.StructType) -> list[str]:
    """The columns by whose hash a table with a replacing strategy is stored."""
    if not is_incremental(out) or strategy_of(out) not in REPLACING:
        return []
    fields = {f.name.casefold(): f.name for f in schema}
    return [fields[k.casefold()] for k in unique_key(out) if k.casefold() in fields]


def load(
    table: RecipeTable,
    arrivals: DataFrame,
    out: dict,
    mark: tuple[str, int] | None = None,
    hidden: Sequence[str] = (),
    merged: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> None:
    """Applies the strategy of the output to the rows of one load.

    ``mark`` names the stream and batch they came in; it is shown together with the rows.
    ``hidden`` columns are stored and not seen by readers; ``merged`` adds to the arrivals what
    the table holds under their keys.
    """
    arrivals = storable(arrivals)
    policy = out.get("on_schema_change") or SCHEMA_CHANGES[0]
    held = table.layout()
    lost = set(held.hidden if held else ()) - set(hidden) if merged is None else set()
    stored = T.StructType([f for f in table.schema() if f.name not in lost])
    change = fit(arrivals.schema, stored, policy, held.keys if held else ())
    if lost:  # hidden columns that this load does not fill would be wrong from now on
        change = replace(change, rewritten=True)
    partition_by = _layout(filled_names(out.get("partition_by")), change.schema.names)
    if strategy_of(out) == "append":
        _append(table, arrivals, change, partition_by, mark)
    else:
        _replace_keys(table, arrivals, change, partition_by, out, mark, list(hidden), merged)


def _append(
    table: RecipeTable,
    arrivals: DataFrame,
    change: Fit,
    partition_by: list[str],
    mark: tuple[str, int] | None,
) -> None:
    rows = shaped(arrivals, change.schema)
    if change.rewritten:
        held = shaped(table.read_stored(), change.schema)
        table.replace(held.union(rows), partition_by, mark=mark)
        return
    if change.widened and table.layout() is None:
        table.widen(change.schema)
    table.append(rows, partition_by, mark)


def _replace_keys(
    table: RecipeTable,
    arrivals: DataFrame,
    change: Fit,
    partition_by: list[str],
    out: dict,
    mark: tuple[str, int] | None,
    hidden: list[str],
    merged: Callable[[DataFrame, DataFrame], DataFrame] | None,
) -> None:
    """delete+insert and merge: rows of the table whose key arrives again are replaced.

    Arrivals are written once first: their keys decide what is removed and their rows are
    what is added, and both must be the same rows. Only the buckets of arriving keys are read
    and written again, and those that make room for a growing table.
    """
    fields = {f.name.casefold(): f.name for f in change.schema}
    keys = [fields[k.casefold()] for k in unique_key(out)]
    merging = strategy_of(out) == "merge"
    absent = {f.casefold() for f in change.schema.names} - {
        c.casefold() for c in arrivals.columns
    }
    lacking = [c for c in change.schema.names if c.casefold() in absent] if merging else []
    layout = table.layout()
    by_bucket = layout is not None and list(layout.keys) == keys and not change.rewritten
    with settled_while(shaped(arrivals, change.schema)) as rows:
        known = rows.filter(reduce(Column.__and__, [col(k).isNotNull() for k in keys]))
        if merging:
            _refuse_repeated_keys(known, keys)
        touched: list[int] = []
        if by_bucket and not partition_by:
            layout, giving = table.split(layout)
            touched = _touched_buckets(rows, keys, len(layout.buckets), giving)
            if not touched and not change.widened and not mark:
                return
            held = shaped(table.read_stored(touched), change.schema)
        else:
            held = shaped(table.read_stored(), change.schema)
        if merged:
            rows = merged(held, rows)
        names = {k: spare_name(f"key{i}", held.columns) for i, k in enumerate(keys)}
        gone = known.select(*[col(k).alias(n) for k, n in names.items()]).distinct()
        on = reduce(Column.__and__, [col(k) == col(n) for k, n in names.items()])
        if partition_by and layout is None and not change.rewritten and not lacking:
            if change.widened:
                table.widen(change.schema)
                held = shaped(table.read(), change.schema)
            _replace_in_partitions(table, held, rows, gone, on, partition_by)
            return
        kept = held.join(gone, on, "left_anti")
        if lacking:
            rows = _with_old_values(held, rows, keys, lacking)
        if by_bucket and not partition_by:
            table.load(kept.union(rows), layout, touched, mark=mark)
        else:
            table.replace(kept.union(rows), partition_by, keys, hidden, mark)


def _touched_buckets(
    rows: DataFrame, keys: list[str], count: int, giving: list[int]
) -> list[int]:
    """The buckets these rows belong to: at most as many numbers as the table has buckets."""
    if count == 1:
        return [] if rows.isEmpty() and not giving else [0]
    found = rows.select(bucket_of(keys, rows.schema, count).alias("bucket")).distinct()
    return sorted({r["bucket"] for r in found.collect()} | set(giving))


def _refuse_repeated_keys(rows: DataFrame, keys: list[str]) -> None:
    twice = rows.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    example = twice.select(*cols(keys)).first()
    if example is not None:
        raise RecipeError(
            f"'merge' received several rows for the same key, such as {example.asDict()}. "
            "Deduplicate the arrivals by their key first."
        )


def _with_old_values(
    held: DataFrame, rows: DataFrame, keys: list[str], absent: list[str]
) -> DataFrame:
    """A merge leaves the columns the arrivals do not have as they were."""
    old = {c: spare_name(f"old{i}", held.columns) for i, c in enumerate([*keys, *absent])}
    past = held.select(*[col(c).alias(n) for c, n in old.items()])
    on = reduce(Column.__and__, [col(k) == col(old[k]) for k in keys])
    return rows.join(past, on, "left").select(
        *[(col(old[c]).alias(c) if c in absent else col(c)) for c in rows.columns]
    )


def _replace_in_partitions(
    table: RecipeTable,
    held: DataFrame,
    rows: DataFrame,
    gone: DataFrame,
    on: Column,
    partition_by: list[str],
) -> None:
    """Rewrites only the partitions that hold or receive an arriving key."""
    places = {p: spare_name(f"part{i}", held.columns) for i, p in enumerate(partition_by)}
    as_places = [col(p).alias(n) for p, n in places.items()]
    holding = held.join(gone, on, "left_semi").select(*as_places)
    receiving = rows.select(*as_places)
    with settled_while(holding.union(receiving).distinct()) as touched:
        inside = held.join(touched, same_keys(held, touched, list(places.items())), "left_semi")
        # Settled before it is written: a failed write never loses the rows it was replacing.
        with settled_while(inside.join(gone, on, "left_anti").union(rows)) as result:
            table.overwrite_partitions(result, partition_by)
            # A partition whose rows all moved elsewhere got no new file: emptied by name.
            table.drop_emptied(touched, result.select(*cols(partition_by)).distinct(), places)


# -------------------------------------------------------------------------- microbatch


def _build_slices(
    spark: SparkSession,
    spec: dict,
    inputs: dict[str, DataFrame],
    table: RecipeTable,
    now: datetime,
    full_refresh: bool,
) -> None:
    """Rewrites whole time slices, all in one job: a slice is a partition of the table.

    Row-wise, grouped and stacked recipes treat every slice alike, so the range is computed
    at once. In a join, timed inputs only match rows of their own slice: where the output's
    time comes from the first input, the slice is part of the join key. What is left, SQL and
    joins whose time comes from elsewhere, could pair rows of different slices and runs slice
    by slice, several at once where ``concurrent_batches`` says so.
    """
    out = spec.get("output") or {}
    plan = slices(out)
    for message in guards.slice_warnings(spec):
        log.warning(message)
    first_build = full_refresh or not table.exists()
    if not first_build and table.layout() is not None:
        raise RecipeError("The table was not built in slices: build it anew (full refresh).")
    start = _start(plan, None if first_build else table, now)
    end = _next(_floor(now, plan.size), plan.size)
    timed = {
        alias: item["event_time"]
        for alias, item in zip(inputs, spec.get("inputs") or [], strict=True)
        if item.get("event_time")
    }
    apart, labels = recipe_type(spec) == "sql", {}
    if recipe_type(spec) == "join":
        apart, labels = _slices_of_join(spec, inputs, timed, plan)
    bounds = [(start, end)]
    if apart and timed:
        bounds = []
        while start < end:
            bounds.append((start, _next(start, plan.size)))
            start = bounds[-1][1]

    def slice_rows(low: datetime, high: datetime) -> DataFrame:
        seen = {
            a: (_between(df, timed[a], low, high) if a in timed else df)
            for a, df in inputs.items()
        }
        made = storable(compute(spark, spec, seen, within=labels))
        return _labelled(_between(made, plan.column, low, high), plan)

    def write(low: datetime, high: datetime) -> None:
        _write_slices(table, slice_rows(low, high), out, plan, low, high)

    if not bounds:
        return
    # The first slice makes the table, or settles its columns, before others run beside each
    # other: from then on every slice writes a partition of its own.
    if first_build:
        table.replace(slice_rows(*bounds[0]), [SLICE])
    else:
        write(*bounds[0])
    if plan.concurrent:
        _write_side_by_side(spark, write, bounds[1:], plan)
    else:
        for low, high in bounds[1:]:
            write(low, high)


# Slices that run at the same time, and how often one is tried.
SLICES_AT_ONCE = 4
_TRIES = 2


def _write_side_by_side(
    spark: SparkSession,
    write: Callable[[datetime, datetime], None],
    bounds: list[tuple[datetime, datetime]],
    plan: Slices,
) -> None:
    """Each slice in a job group of its own (and a fair scheduler's pool, where the session has
    one); one that fails is tried again, since writing it replaces whatever it left."""
    context = spark.sparkContext

    def run(low: datetime, high: datetime) -> None:
        label = _label(low, plan.size)
        context.setJobGroup(f"slice {label} {uuid.uuid4().hex}", f"slice {label}")
        context.setLocalProperty("spark.scheduler.pool", "slices")
        for attempt in range(_TRIES):
            try:
                return write(low, high)
            except RecipeError:
                raise
            except Exception:
                if attempt + 1 == _TRIES:
                    raise
                log.warning("Slice %s failed and is tried again", label, exc_info=True)

    with ThreadPoolExecutor(SLICES_AT_ONCE) as pool:
        tasks = [
            pool.submit(copy_context().run, inheritable_thread_target(spark)(run), low, high)
            for low, high in bounds
        ]
    for task in tasks:
        task.result()


def _slices_of_join(
    spec: dict, inputs: dict[str, DataFrame], timed: dict[str, str], plan: Slices
) -> tuple[bool, dict[str, Column]]:
    """Whether the join must run slice by slice, and else the slice labels its rows match by.

    A row of the output lies in the slice of its time column. Rows that no row of the input
    holding that column went into have no time and are in no slice.
    """
    names = joins.output_names(spec, {a: df.columns for a, df in inputs.items()})
    origin, column = next(((a, c) for a, c, n in names if n == plan.column), (None, None))
    if timed.get(origin, column) != column:
        return True, {}
    others = [a for a in timed if a != origin]
    if not others:
        return False, {}
    if origin != next(iter(inputs)):
        return True, {}
    times = {origin: column} | timed
    for alias, name in times.items():
        require(inputs[alias], name, f"Time of '{alias}'")
    return False, {a: _slice_label(name, plan) for a, name in times.items()}


def _write_slices(
    table: RecipeTable, rows: DataFrame, out: dict, plan: Slices, low: datetime, high: datetime
) -> None:
    change = fit(
        rows.schema, table.schema(), out.get("on_schema_change") or SCHEMA_CHANGES[0]
    )
    rows = shaped(rows, change.schema)
    if change.rewritten:
        table.replace(shaped(table.read_stored(), change.schema), [SLICE])
    elif change.widened:
        table.widen(change.schema)
    first, last = _label(low, plan.size), _label(high, plan.size)

    def files() -> dict[str, list[str]]:
        values = [v for v in table.partition_values(SLICE) if first <= v < last]
        return {v: table.partition_files(SLICE, v) for v in values}

    held = files()
    table.overwrite_partitions(rows, [SLICE])
    # A slice that has become empty gets no new file: its old ones are removed by name.
    for value, names in files().items():
        if names == held.get(value):
            table.drop_partition(SLICE, value)


def _labelled(df: DataFrame, plan: Slices) -> DataFrame:
    return df.select(*cols(df.columns), _slice_label(plan.column, plan).alias(SLICE))


def _slice_label(column: str, plan: Slices) -> Column:
    text = col(column).cast("timestamp_ntz").cast("string")
    return F.translate(F.substring(text, 1, _LABEL[plan.size]), " ", "T")


# Characters of 'YYYY-MM-DD HH:MM:SS' that tell slices of a size apart.
_LABEL = {"year": 4, "month": 7, "day": 10, "hour": 13}


def _label(moment: datetime, size: str) -> str:
    return moment.isoformat()[: _LABEL[size]]


def _between(df: DataFrame, column: str, low: datetime, high: datetime) -> DataFrame:
    if column not in df.columns:
        raise RecipeError(f"The time column '{column}' is not among {', '.join(df.columns)}.")
    dtype = df.schema[column].dataType
    if family(dtype) not in (DATE, TEXT):
        raise RecipeError(f"The time column '{column}' is not a date or timestamp.")
    at = [F.lit(m.isoformat(sep=" ")).cast("timestamp_ntz") for m in (low, high)]
    if family(dtype) == TEXT:
        moment = col(column).cast("timestamp_ntz")
    elif isinstance(dtype, T.DateType) and not (low.hour or high.hour):
        moment, at = col(column), [a.cast("date") for a in at]
    else:
        moment = col(column)
        at = [a if isinstance(dtype, T.DateType) else a.cast(dtype) for a in at]
    return df.filter((moment >= at[0]) & (moment < at[1]))


def _start(plan: Slices, table: RecipeTable | None, now: datetime) -> datetime:
    begin = _floor(plan.begin, plan.size)
    written = table.partition_values(SLICE) if table else []
    if not written:
        return begin
    last = min(_parsed(written[-1]), _floor(now, plan.size))
    for _ in range(plan.lookback):
        last = _floor(last - timedelta(microseconds=1), plan.size)
    return max(begin, last)


def _parsed(label: str) -> datetime:
    return datetime.fromisoformat(label + "0000-01-01T00"[len(label) :] + ":00")


def _floor(moment: datetime, size: str) -> datetime:
    moment = moment.replace(minute=0, second=0, microsecond=0)
    if size != "hour":
        moment = moment.replace(hour=0)
    if size in ("month", "year"):
        moment = moment.replace(day=1)
    return moment.replace(month=1) if size == "year" else moment


def _next(moment: datetime, size: str) -> datetime:
    if size == "hour":
        return moment + timedelta(hours=1)
    if size == "day":
        return moment + timedelta(days=1)
    return _floor(moment + timedelta(days=32 if size == "month" else 367), size)
