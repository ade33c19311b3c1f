"""A row-wise incremental recipe fed by the new files of a folder.

The checkpoint of the stream remembers which files were read, so it plays the part of the
bound: each run processes what arrived since the last one and stops. Every micro-batch goes
through the same recipe and the same strategy as a batch build.

A micro-batch may be delivered twice after a failure. The table remembers the last batch of
each stream, in the version that first shows its rows, and a batch that is in the table is
passed over: rows land once whatever the strategy. A table in partitions of the user's columns
is changed inside its version, so there only replacing strategies are accepted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from ..errors import RecipeError
from ..functions.names import filled_names
from ..plans.build import bucket_keys, load, storable
from ..plans.output import REPLACING, bound_column, check_output, is_incremental, strategy_of
from ..plans.recipe import compute
from ..plans.spec import check_shape, input_aliases, recipe_type
from ..sources.tables import RecipeTable


def load_arrivals(
    spark: SparkSession,
    spec: dict,
    folder: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Applies the recipe to the files that arrived in ``folder``; returns the table."""
    check_shape(spec)
    out = spec.get("output") or {}
    check_output(out)
    if recipe_type(spec) != "prepare" or not is_incremental(out):
        raise RecipeError("Only an incremental 'prepare' recipe can be fed by a stream.")
    replacing, partitioned = strategy_of(out) in REPLACING, filled_names(out.get("partition_by"))
    if not replacing and (strategy_of(out) != "append" or partitioned):
        raise RecipeError(
            f"A stream needs one of {', '.join(REPLACING)}, with a unique key, or 'append' "
            "without 'partition_by'."
        )
    if bound_column(out):
        raise RecipeError("A stream remembers what it has read: remove the incremental column.")
    (alias,) = input_aliases(spec)
    table = RecipeTable(spark, target)
    stream = checkpoint.rstrip("/")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def take(batch: DataFrame, number: int) -> None:
        rows = compute(batch.sparkSession, spec, {alias: batch})
        if not table.exists():
            # The first batch goes through the same strategy, over an empty table.
            first = storable(rows.limit(0))
            table.replace(first, partitioned, bucket_keys(out, first.schema))
        done = table.mark(stream)
        if done is None or number > done:
            load(table, rows, out, None if partitioned else (stream, number))

    query = (
        reader.parquet(folder)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(take)
        .start()
    )
    query.awaitTermination()
    return table.read()
