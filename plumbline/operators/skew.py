"""Finding and splitting the groups that are too big for one task.

Ordered windows and medians put all the rows of a key together. Where one key may hold a third
of a table that is one task doing a third of the work, so those operators first ask which keys
are hot: rows are counted per key hash, combined in the map tasks, and only keys above the
limit are kept, at most rows / limit of them. Keys are compared by their 64-bit hash, so NULL
is a key like any other and a collision only sends a small group down the path for large ones,
which is exact as well. Outer joins count the same way as part of their own plan.

Asking runs a job while a recipe is being described. Under ``described_only`` (previews and
views, which promise to run nothing) nothing is asked and Spark's own operators are used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import RecipeError
from ..functions.names import cols, quoted
from ..sources.files import Folder

# A group up to this many rows is left to one task.
GROUP_ROWS = 4_000_000
_SETTING = "spark.plumbline.groupRows"

# Hot keys up to this number are compared in an expression, more of them by a join.
_LISTED = 1_000

# Rows of hot groups that a sorting task gets, and the pieces that a low limit may still ask
# for: Spark sends some 300 sampled rows a piece to the driver.
PIECE_ROWS = 1_000_000
_MORE_PIECES = 32

# Rows known to be at most this many are broadcast without waiting for their measured size,
# as the large side would be shuffled by then.
_FEW = 100_000


_describing: ContextVar[bool] = ContextVar("describing", default=False)
_kept: ContextVar[list[str] | None] = ContextVar("kept", default=None)


@contextmanager
def described_only() -> Iterator[None]:
    """No job runs and nothing is written while a recipe is described inside."""
    token = _describing.set(True)
    try:
        yield
    finally:
        _describing.reset(token)


@contextmanager
def settled_rows_removed(spark: SparkSession) -> Iterator[None]:
    """Removes the rows settled inside when it ends: everything made from them is written."""
    token = _kept.set([])
    try:
        yield
    finally:
        folders = _kept.get() or []
        _kept.reset(token)
        for where in folders:
            Folder(spark).remove(where)


def group_rows(spark: SparkSession, default: int = GROUP_ROWS) -> int:
    return int(spark.conf.get(_SETTING, str(default)))


@dataclass(frozen=True)
class HotGroups:
    """The groups of ``keys`` above the limit: their key hashes and how many rows they hold."""

    keys: tuple[str, ...]
    hashes: tuple[int, ...]
    rows: int
    limit: int

    def __bool__(self) -> bool:
        return bool(self.rows)

    def _part(self, df: DataFrame, hot: bool) -> DataFrame:
        if not self.keys:
            return df if hot else df.filter(F.lit(False))
        key = F.xxhash64(*cols(self.keys))
        if len(self.hashes) <= _LISTED:
            listed = key.isin(list(self.hashes))
            return df.filter(listed if hot else ~listed)
        known = df.sparkSession.createDataFrame([(h,) for h in self.hashes], "__hot bigint")
        return df.join(known, key == known["__hot"], "left_semi" if hot else "left_anti")

    def inside(self, df: DataFrame) -> DataFrame:
        return self._part(df, True)

    def outside(self, df: DataFrame) -> DataFrame:
        return self._part(df, False)

    @property
    def pieces(self) -> int:
        """Range partitions of the rows. Pieces are sorted on disk if need be and only cut into
        slices afterwards, so that a low limit does not ask for ever more of them."""
        return max(
            self.rows // PIECE_ROWS + 2, min(self.rows // self.limit + 2, _MORE_PIECES)
        )

    @property
    def slice_rows(self) -> int:
        """Rows of a slice, in which a function is evaluated by one task."""
        return min(self.limit, PIECE_ROWS)

    def beside(self, small: DataFrame) -> DataFrame:
        """The side of a join that holds a row for each piece, slice or hot group at most."""
        groups = 2 * len(self.hashes) + self.pieces + self.rows // self.slice_rows
        return F.broadcast(small) if groups <= _FEW else small


def hot_groups(df: DataFrame, keys: list[str], default: int = GROUP_ROWS) -> HotGroups:
    limit = group_rows(df.sparkSession, default)
    if _describing.get():
        return HotGroups(tuple(keys), (), 0, limit)
    if not keys:
        rows = df.count()
        return HotGroups((), (), rows if rows > limit else 0, limit)
    counts = df.groupBy(F.xxhash64(*cols(keys)).alias("key")).agg(F.count("*").alias("rows"))
    hot = counts.filter(F.col("rows") > limit).collect()
    return HotGroups(
        tuple(keys), tuple(r["key"] for r in hot), sum(r["rows"] for r in hot), limit
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder the cluster names; a local one only when none is set (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RecipeError("Set spark.checkpoint.dir to a folder that all executors share.")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and written to the shared folder: later plans and retried
    tasks read them back, only the columns they need, with the size known to the optimizer."""
    ensure_checkpoint_dir(df.sparkSession)
    if any(isinstance(f.dataType, _NOT_IN_PARQUET) for f in df.schema.fields):
        return df.checkpoint(eager=True)
    where, kept = _new_folder(df.sparkSession), _kept.get()
    if kept is not None:
        kept.append(where)
    return _written(df, where)


_NOT_IN_PARQUET = (T.NullType, T.CalendarIntervalType)


@contextmanager
def settled_while(df: DataFrame) -> Iterator[DataFrame]:
    """Settled rows that are only needed inside a block: their folder goes when it ends."""
    ensure_checkpoint_dir(df.sparkSession)
    where = _new_folder(df.sparkSession)
    try:
        yield _written(df, where)
    finally:
        Folder(df.sparkSession).remove(where)


def _new_folder(spark: SparkSession) -> str:
    return f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"


def _written(df: DataFrame, where: str) -> DataFrame:
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def same_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """NULL-safe equality of key columns: NULL is one group, as in GROUP BY."""
    tests = [left[quoted(a)].eqNullSafe(right[quoted(b)]) for a, b in pairs]
    return reduce(Column.__and__, tests, F.lit(True))
