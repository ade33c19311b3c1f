"""The one error a user sees when a request cannot be honoured."""

from __future__ import annotations


class RecipeError(ValueError):
    """A recipe, a test or a setting that is refused before any data is read."""


class DataTestFailure(RuntimeError):
    """At least one data test of severity ``error`` found failing rows."""
