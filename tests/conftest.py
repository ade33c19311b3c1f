from __future__ import annotations

import tempfile
from contextlib import contextmanager

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("plumbline-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="plumbline-test-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def target(tmp_path):
    return str(tmp_path / "target")


@pytest.fixture
def small_groups(spark):
    """Treats any group above a few rows as too big for one task."""

    @contextmanager
    def limit(rows: int):
        spark.conf.set("spark.plumbline.groupRows", str(rows))
        try:
            yield
        finally:
            spark.conf.unset("spark.plumbline.groupRows")

    return limit


PARCELS = [
    (7, 3, "lost", 0.25, "2023-11-30", "PT"),
    (8, 5, "sent", 12.5, "2023-12-01", "  "),
    (9, 3, "Sent", 2.0, "2023-12-01", "PT"),
    (11, None, "in transit", None, None, "se"),
    (12, 5, None, 31.75, "2023-12-24", "SE"),
    (12, 5, None, 31.75, "2023-12-24", "SE"),
    (13, 9, "", 2.0, "2024-01-02", None),
]


@pytest.fixture
def parcels(spark):
    """One row twice, a hub that is unknown and one that does not exist, empty and null states."""
    return spark.createDataFrame(
        PARCELS,
        "parcel_id int, hub int, state string, weight double, sent string, country string",
    )


@pytest.fixture
def hubs(spark):
    towns = [(3, "Porto"), (5, "Malmö"), (6, "Turku"), (None, "nowhere")]
    return spark.createDataFrame(towns, "hub int, town string")
