"""Short ways to write a query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline import read_parquet, run_recipe
from plumbline.operators.skew import ensure_checkpoint_dir

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Tables(Mapping[str, DataFrame]):
    """The Parquet tables of a folder, opened when first named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet")

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


Step = tuple[str, dict]


def prepared(table: str, *steps: Step) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: through(spark, Tables(spark, folder)[table], *steps)


def through(spark: SparkSession, df: DataFrame, *steps: Step) -> DataFrame:
    """The dataset after these preparation steps."""
    spec = {
        "type": "prepare",
        "inputs": [{"ref": "input"}],
        "steps": [{"type": t, "params": p} for t, p in steps],
    }
    return run_recipe(spark, spec, {"input": df})


def keep(*columns: str) -> Step:
    return "keep_delete", {"columns": list(columns), "action": "keep"}


def formula(into: str, expression: str) -> Step:
    return "formula", {"into": into, "expression": expression}


def rounded(column: str, decimals: int = 2) -> Step:
    return "round", {"column": column, "decimals": decimals}


def new_target(spark: SparkSession) -> str:
    """A folder of its own for one run, where the session keeps its shared files."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/target-{uuid.uuid4().hex}"
