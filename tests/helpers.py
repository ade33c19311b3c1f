"""Short ways to run a recipe in a test."""

from __future__ import annotations

from plumbline import run_recipe


def steps(spark, df, *parts, output=None):
    """Runs a prepare recipe made of (type, params) pairs."""
    spec = {
        "name": "r",
        "type": "prepare",
        "inputs": [{"ref": "src"}],
        "steps": [{"type": t, "params": p} for t, p in parts],
        "output": output or {},
    }
    return run_recipe(spark, spec, {"src": df})


def rows(df):
    """Rows as tuples, in a stable order whatever the partitions."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def column(df, name):
    return sorted((r[name] for r in df.select(f"`{name}`").collect()), key=repr)
