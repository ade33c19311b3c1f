"""The table a recipe writes: Parquet files in a folder, new ones for every load.

``<path>/data-000001/``           rows that load 1 wrote
``<path>/schema-000001-000001``   columns of version 1 and where its rows are, as JSON

The newest schema file names the current version, so a load becomes visible at once and only
when complete, and readers of the previous version are not disturbed. Adding a column writes
a new schema file and no data. Reading passes the schema explicitly: no footers are merged,
and dropped columns are never read.

A table with a unique key lies in buckets by the hash of the key, a folder each
(``data-000001/_key_bucket=5``). A load writes the buckets of its keys anew; the new version lists
for every bucket the loads that hold its rows. Buckets are added as the table grows, one
bucket giving about half of its keys to a new one (linear hashing), so that a load never
moves more than it touches and what it adds. A table without a key is one bucket, to which an
append adds a load. Tables in partitions of the user's columns or of time slices are changed
inside their current version instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace as changed

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from ..functions.names import col, cols
from ..operators.skew import same_keys
from .files import Folder

SLICE = "_slice"
BUCKET = "_key_bucket"
# Bytes of a bucket beyond which the table gets more of them.
BUCKET_BYTES = 128 << 20
_BUCKET_SETTING = "spark.plumbline.bucketBytes"
_MOST_FIRST_BUCKETS = 1 << 16
# What Spark takes an input for whose size it does not know is larger than this.
_UNKNOWN_BYTES = 1 << 60
_SCHEMA_FILE = re.compile(r"schema-(\d{6})-(\d{6})$")


@dataclass(frozen=True)
class Version:
    number: int
    revision: int


@dataclass(frozen=True)
class Layout:
    """Where the rows of a version are.

    ``buckets`` lists for each bucket the loads that hold its rows, ``sizes`` their bytes.
    ``hidden`` are stored columns that readers do not see; ``marks`` remember the last batch
    of each stream that was loaded.
    """

    keys: tuple[str, ...] = ()
    buckets: tuple[tuple[int, ...], ...] = ()
    sizes: tuple[int, ...] = ()
    hidden: tuple[str, ...] = ()
    marks: dict[str, int] = field(default_factory=dict)

    @property
    def loads(self) -> set[tuple[int, int]]:
        """Every folder: the bucket and the load that wrote it."""
        return {(b, n) for b, numbers in enumerate(self.buckets) for n in numbers}

    def as_json(self) -> dict:
        return {
            "keys": list(self.keys), "buckets": [list(b) for b in self.buckets],
            "sizes": list(self.sizes), "hidden": list(self.hidden), "marks": self.marks,
        }

    @classmethod
    def from_json(cls, text: dict) -> Layout:
        return cls(
            tuple(text["keys"]), tuple(tuple(b) for b in text["buckets"]), tuple(text["sizes"]),
            tuple(text["hidden"]), dict(text["marks"]),
        )


def bucket_of(keys: list[str], schema: T.StructType, count: int) -> Column:
    """The bucket of a row among ``count``, by linear hashing.

    With more buckets, a row stays or goes to the one that its bucket was split into. Floating
    keys that are equal hash alike, whatever the sign of their zero.
    """
    if count == 1:
        return F.lit(0)
    parts = []
    for name in keys:
        floating = isinstance(schema[name].dataType, (T.FloatType, T.DoubleType))
        parts.append(F.when(col(name) == 0, F.lit(0.0)).otherwise(col(name)) if floating else col(name))
    level = 1 << (count - 1).bit_length()
    place = F.pmod(F.xxhash64(*parts), F.lit(level)).cast("int")
    return F.when(place < count, place).otherwise(place - level // 2)


def parent_bucket(bucket: int) -> int:
    """The bucket that was split to make this one."""
    return bucket - (1 << (bucket.bit_length() - 1))


def _giving(bucket: int, count: int) -> int:
    """The bucket that held its rows when there were ``count``."""
    while bucket >= count:
        bucket = parent_bucket(bucket)
    return bucket


class RecipeTable:
    """A target in a folder every executor can reach (a shared file system or object store).

    ``check`` sees the rows of a full rewrite before anyone else does, and may raise.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        check: Callable[[DataFrame], object] | None = None,
    ):
        self.spark, self.path, self._check = spark, path.rstrip("/"), check
        self.checked = False
        self._folder = Folder(spark)
        self._known: dict[Version, tuple[T.StructType, Layout | None]] = {}

    # -- what is there

    def version(self) -> Version | None:
        found = [
            Version(int(m.group(1)), int(m.group(2)))
            for name in self._folder.children(self.path)
            if (m := _SCHEMA_FILE.match(name))
        ]
        return max(found, key=lambda v: (v.number, v.revision), default=None)

    def exists(self) -> bool:
        return self.version() is not None

    def schema(self) -> T.StructType:
        """Every stored column, the hidden ones included."""
        return self._described(self._current())[0]

    def layout(self) -> Layout | None:
        """Where the rows are, or None for a table in partitions."""
        return self._described(self._current())[1]

    def read_stored(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows with their hidden columns, of all buckets or of some."""
        version = self._current()
        schema, layout = self._described(version)
        if layout is None:
            return self.spark.read.schema(schema).parquet(self._data_path(version.number))
        return self._read(schema, layout, buckets)

    def _read(
        self, schema: T.StructType, layout: Layout, buckets: list[int] | None = None
    ) -> DataFrame:
        count = len(layout.buckets)
        chosen = range(count) if buckets is None else [b for b in buckets if b < count]
        paths = [self._bucket_path(b, n) for b in chosen for n in layout.buckets[b]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self) -> DataFrame:
        return self._seen(self.read_stored(), self.layout())

    @staticmethod
    def _seen(rows: DataFrame, layout: Layout | None) -> DataFrame:
        hidden = {SLICE, *(layout.hidden if layout else ())}
        return rows.select(*cols(c for c in rows.columns if c not in hidden))

    # -- loads that make a new version

    def replace(
        self,
        df: DataFrame,
        partition_by: list[str] | None = None,
        keys: list[str] | None = None,
        hidden: list[str] | None = None,
        mark: tuple[str, int] | None = None,
    ) -> None:
        """A new version with exactly these rows, visible once completely written.

        The version before it stays for those still reading it; older ones are removed.
        """
        marks = dict(self._marks(), **dict([mark] if mark else []))
        if partition_by:
            number = self._next_number()
            where = self._data_path(number)
            self._write(df, "overwrite", partition_by).parquet(where)
            if self._check:
                self._pass(self.spark.read.schema(df.schema).parquet(where), [where])
            self._publish(df.schema, Version(number, 1), None)
            return
        hashable = keys if keys and _hashable(df.schema, keys) else []
        count = self._first_buckets(df) if hashable else 1
        empty = Layout(tuple(hashable), ((),) * count, (0,) * count, tuple(hidden or ()), marks)
        self.load(df, empty, list(range(count)))

    def load(
        self,
        rows: DataFrame,
        layout: Layout,
        touched: list[int],
        add: bool = False,
        mark: tuple[str, int] | None = None,
    ) -> None:
        """A new version in which the ``touched`` buckets hold these rows, or these as well."""
        number = self._next_number()
        where = self._data_path(number)
        schema, count = rows.schema, len(layout.buckets)
        if count == 1:
            rows.write.parquet(f"{where}/{BUCKET}=0")
        else:
            placed = rows.withColumn(BUCKET, bucket_of(list(layout.keys), schema, count))
            placed = placed.hint("rebalance", col(BUCKET))
            placed.write.partitionBy(BUCKET).parquet(where)
        written = {
            int(name.split("=")[1]): self._folder.size(f"{where}/{name}")
            for name in self._folder.children(where)
            if name.startswith(f"{BUCKET}=")
        }
        buckets, sizes = list(layout.buckets), list(layout.sizes)
        for b in touched:
            mine = (number,) if b in written else ()
            buckets[b] = (*buckets[b], *mine) if add else mine
            sizes[b] = written.get(b, 0) + (sizes[b] if add else 0)
        marks = dict(layout.marks, **dict([mark] if mark else []))
        layout = changed(layout, buckets=tuple(buckets), sizes=tuple(sizes), marks=marks)
        if self._check:
            self._pass(self._seen(self._read(schema, layout), layout), [where])
        self._publish(schema, Version(number, 1), layout)

    def split(self, layout: Layout) -> tuple[Layout, list[int]]:
        """The layout with the buckets its size asks for, and those that are new or give rows
        to new ones: they have to be written."""
        count, most = len(layout.buckets), self._bucket_bytes()
        wanted = -(-sum(layout.sizes) // most) if layout.keys else count
        if wanted <= count:
            return layout, []
        more = wanted - count
        new = range(count, wanted)
        grown = changed(
            layout, buckets=layout.buckets + ((),) * more, sizes=layout.sizes + (0,) * more
        )
        return grown, sorted({*new, *(_giving(b, count) for b in new)})

    def mark(self, stream: str) -> int | None:
        """The last batch of a stream that is in the table."""
        return self._marks().get(stream)

    def _marks(self) -> dict[str, int]:
        layout = self.layout() if self.exists() else None
        return dict(layout.marks) if layout else {}

    def _first_buckets(self, df: DataFrame) -> int:
        """Buckets for a first load, by the bytes that its inputs are known to have. Where they
        are not known, the next load deals the table out by its size."""
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        size = sum(s for s in sizes if s < _UNKNOWN_BYTES)
        return max(1, min(_MOST_FIRST_BUCKETS, -(-size // self._bucket_bytes())))

    def _bucket_bytes(self) -> int:
        return max(1, int(self.spark.conf.get(_BUCKET_SETTING, str(BUCKET_BYTES))))

    def _next_number(self) -> int:
        names = self._folder.children(self.path)
        found = [int(m.group(1)) for n in names if (m := re.match(r"(?:data|schema)-(\d{6})", n))]
        return max(found, default=0) + 1

    def _publish(self, schema: T.StructType, version: Version, layout: Layout | None) -> None:
        """Shows a version, and removes what neither it nor the one before it needs."""
        before = self.version()
        self._write_schema(schema, version, layout)
        needed: dict[int, set[int] | None] = {}
        for v in [x for x in (before, version) if x]:
            known = self._described(v)[1]
            if known is None:
                needed[v.number] = None
            else:
                for bucket, number in known.loads:
                    held = needed.setdefault(number, set())
                    if held is not None:
                        held.add(bucket)
        for name in self._folder.children(self.path):
            if m := _SCHEMA_FILE.match(name):
                if before is None or (int(m[1]), int(m[2])) < (before.number, before.revision):
                    if int(m[1]) != version.number:
                        self._folder.remove(f"{self.path}/{name}")
            elif m := re.match(r"data-(\d{6})$", name):
                self._clear(int(m[1]), needed.get(int(m[1]), set()))

    def _clear(self, number: int, needed: set[int] | None) -> None:
        where = self._data_path(number)
        if needed is None:
            return
        if not needed:
            self._folder.remove(where)
            return
        for name in self._folder.children(where):
            if name.startswith(f"{BUCKET}=") and int(name.split("=")[1]) not in needed:
                self._folder.remove(f"{where}/{name}")

    def _pass(self, rows: DataFrame, folders: list[str]) -> None:
        try:
            self._check(rows.select(*cols(c for c in rows.columns if c != SLICE)))
        except Exception:
            for where in folders:
                self._folder.remove(where)
            raise
        self.checked = True

    # -- changes inside the current version

    def widen(self, schema: T.StructType) -> None:
        """Adds columns; rows already written read NULL there."""
        version = self._current()
        layout = self._described(version)[1]
        self._write_schema(schema, Version(version.number, version.revision + 1), layout)

    def append(
        self,
        df: DataFrame,
        partition_by: list[str] | None = None,
        mark: tuple[str, int] | None = None,
    ) -> None:
        """Rows beside those that are there: a new version, but for a table in partitions."""
        layout = self.layout()
        if layout is not None:
            self.load(df, layout, list(range(len(layout.buckets))), add=True, mark=mark)
            return
        writer = self._write(df, "append", partition_by)
        writer.parquet(self._data_path(self._current().number))

    def overwrite_partitions(self, df: DataFrame, partition_by: list[str]) -> None:
        """Replaces the partitions these rows belong to and leaves the others alone."""
        writer = self._write(df, "overwrite", partition_by)
        writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(self._data_path(self._current().number))

    def _write(
        self, df: DataFrame, mode: str, partition_by: list[str] | None
    ) -> DataFrameWriter:
        """Partitioned rows are gathered first: few files per partition instead of one per
        task and partition. Spark splits a partition that is too big for one task."""
        if not partition_by:
            return df.write.mode(mode)
        gathered = df.hint("rebalance", *cols(partition_by))
        return gathered.write.mode(mode).partitionBy(*partition_by)

    def partition_values(self, column: str) -> list[str]:
        """Values of the first partition column, from the folder names."""
        prefix = f"{column}="
        names = self._folder.children(self._data_path(self._current().number))
        return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))

    def partition_files(self, column: str, value: str) -> list[str]:
        where = f"{self._data_path(self._current().number)}/{column}={value}"
        return sorted(self._folder.children(where))

    def drop_partition(self, column: str, value: str) -> None:
        self._folder.remove(f"{self._data_path(self._current().number)}/{column}={value}")

    def drop_emptied(self, touched: DataFrame, filled: DataFrame, names: dict[str, str]) -> None:
        """Empties the touched partitions that hold no row any more.

        Their folders are read from the files themselves, one entry per partition.
        """
        stored = self.read_stored()
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1)
        pruned = stored.select(*cols(names), folder.alias("__folder"))
        again = filled.select(*[col(p).alias(f"{n}_filled") for p, n in names.items()])
        on = [(p, n) for p, n in names.items()]
        gone = touched.join(
            again, same_keys(touched, again, [(n, f"{n}_filled") for n in names.values()]), "left_anti"
        )
        left = pruned.join(gone, same_keys(pruned, gone, on), "left_semi")
        for row in left.select("__folder").distinct().collect():  # one row per partition
            self._folder.remove_uri(row["__folder"])

    # -- files

    def _current(self) -> Version:
        version = self.version()
        if version is None:
            raise FileNotFoundError(f"No table has been written in {self.path}.")
        return version

    def _data_path(self, number: int) -> str:
        return f"{self.path}/data-{number:06d}"

    def _schema_path(self, version: Version) -> str:
        return f"{self.path}/schema-{version.number:06d}-{version.revision:06d}"

    def _bucket_path(self, bucket: int, number: int) -> str:
        return f"{self._data_path(number)}/{BUCKET}={bucket}"

    def _described(self, version: Version) -> tuple[T.StructType, Layout | None]:
        """A schema file never changes once written, so it is read once."""
        if version not in self._known:
            text = json.loads(self._folder.read_text(self._schema_path(version)))
            layout = Layout.from_json(text["layout"]) if text.get("layout") else None
            self._known[version] = T.StructType.fromJson(text), layout
        return self._known[version]

    def _write_schema(
        self, schema: T.StructType, version: Version, layout: Layout | None
    ) -> None:
        columns = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        text = columns.jsonValue() | {"layout": layout.as_json() if layout else None}
        self._folder.write_text(self._schema_path(version), json.dumps(text))


def _hashable(schema: T.StructType, keys: list[str]) -> bool:
    if any(name.casefold() == BUCKET for name in schema.names):
        return False
    return not any("map<" in schema[k].dataType.simpleString() for k in keys)
