"""What the operators of this package share: stored intermediate tables, ranks, row picking."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Ids that may be broadcast: 2 million longs are a few dozen MB as a hash table.
BROADCAST_IDS = 2_000_000
# Dropped rows of which a list may be broadcast: some 100 bytes each.
BROADCAST_DROPPED = 500_000

_local_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    A folder of this machine is made only where the setting is missing and the master is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="llm-")
    return _local_folders[context.applicationId]


def stored(df: DataFrame, label: str, partition_rows: int | None = None) -> DataFrame:
    """The same rows written once to the shared folder and read back.

    Later plans start from files that survive the loss of executors, read only the columns
    they need, and know the size. ``release`` removes the folders.
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_rows:
        writer = writer.option("maxRecordsPerFile", partition_rows)
    writer.parquet(where)
    _written.setdefault(spark.sparkContext.applicationId, []).append(where)
    return spark.read.schema(df.schema).parquet(where)


def release(spark: SparkSession) -> None:
    """Removes the tables this session stored. Only call it once all results that were made
    from them are written."""
    for where in _written.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns what a Python worker has freed to the system. Workers outlive their tasks, and an
    idle one would hold the most that any of its batches took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # only in the GNU library
        trim(0)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def named(df: DataFrame, column: str) -> Column:
    """A column by its plain name, dots and all."""
    return df["`" + column.replace("`", "``") + "`"]


def with_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in the stored one-column table ``ids``.

    A list of at most ``BROADCAST_IDS`` is sent to the tasks that scan ``docs``; a longer one
    is joined by shuffling both sides. A null key equals a null key.
    """
    ids = ids.toDF("__wanted")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, named(docs, key).eqNullSafe(ids["__wanted"]), "left_semi")


def without_dropped(docs: DataFrame, found: DataFrame, key: str, digest: Column) -> DataFrame:
    """The rows of ``docs`` that ``found`` keeps.

    ``found`` has a row for each of ``docs``: ``doc_id`` (its ``key``), ``digest`` and
    ``kept``. Of rows with equal key and digest of which some are kept, one is taken.
    """
    found = found.select("doc_id", "digest", "kept")
    gone = stored(found.filter(~F.col("kept")).drop("kept"), "dropped")
    again = stored(found.filter("kept").drop("kept").intersect(gone), "repeated")
    if gone.limit(BROADCAST_DROPPED + 1).count() <= BROADCAST_DROPPED:
        gone, again = F.broadcast(gone), F.broadcast(again)
    mark = free_name(docs, "__digest")
    rows = docs.withColumn(mark, digest)

    def same(other: DataFrame) -> Column:
        return named(rows, key).eqNullSafe(other["doc_id"]) & (rows[mark] == other["digest"])

    others = rows.join(gone, same(gone), "left_anti")
    repeated = rows.join(again, same(again), "left_semi").dropDuplicates([key, mark])
    return others.unionByName(repeated).drop(mark)


def with_positions(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Stores the rows in the global order of ``order`` and adds their ``position`` from 0.

    The rows are range-partitioned and sorted; a position is the number of rows of earlier
    partitions, of which there is one figure each, plus the place in the own one.
    """
    placed = stored(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        label,
    )
    starts = running_starts(placed.groupBy("__part").agg(F.count("*").alias("__rows")), "__rows")
    return (
        placed.join(starts, "__part")
        .withColumn("position", F.col("__start") + F.col("__place"))
        .drop("__part", "__place", "__start")
    )


def running_starts(parts: DataFrame, amount: str) -> DataFrame:
    """``__part`` and ``__start``: the sum of ``amount`` over the parts before it.

    One row per partition of a table, a few thousand of them; they go through the driver.
    """
    rows = sorted((r["__part"], r[amount]) for r in parts.collect())
    starts, total = [], 0
    for part, size in rows:
        starts.append((part, total))
        total += size
    # Sent to every task: as many rows as were just summed here.
    return F.broadcast(parts.sparkSession.createDataFrame(starts, "__part int, __start long"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on nothing but the parts."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def fold(column: Column, parts: int) -> Column:
    """crc32 of a column as text, modulo ``parts``: the fold of a row."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application: a session that was started
    without it on its path can then run the Python stages too."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
