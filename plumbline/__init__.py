"""Declarative data recipes on Spark.

``run_recipe``, ``preview``      a recipe over named datasets, as a lazy DataFrame
``build``                        the same, written to its output, incrementally if asked
``run_tests``, ``failing_rows``  data tests
``freshness``                    age of the newest row
``quality_profile``, ``full_profile``, ``profile_delta``
``diagnose_join``, ``join_findings``
"""

from .errors import DataTestFailure, RecipeError
from .plans.build import build
from .plans.recipe import preview, run_recipe
from .quality.checks import declared_tests, enforce, failing_rows, run_tests, sample_failing_rows
from .quality.freshness import freshness
from .quality.joincheck import diagnose_join, join_findings
from .quality.profiles import full_profile, profile_delta, profile_of_change, quality_profile
from .sources.readers import read_csv, read_folder, read_parquet, row_count
from .sources.tables import RecipeTable
from .streaming.arrivals import load_arrivals

__all__ = [
    "DataTestFailure",
    "RecipeError",
    "RecipeTable",
    "build",
    "declared_tests",
    "diagnose_join",
    "enforce",
    "failing_rows",
    "freshness",
    "full_profile",
    "join_findings",
    "load_arrivals",
    "preview",
    "profile_delta",
    "profile_of_change",
    "quality_profile",
    "read_csv",
    "read_folder",
    "read_parquet",
    "row_count",
    "run_recipe",
    "run_tests",
    "sample_failing_rows",
]
