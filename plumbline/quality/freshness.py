"""How old the newest row of a source is."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from ..errors import RecipeError
from ..operators.steps import sql_expression

# The periods of a threshold, in seconds.
PERIODS = {"minute": 60, "hour": 3_600, "day": 86_400}


def threshold_seconds(settings: dict, key: str) -> int | None:
    raw = settings.get(key)
    if not raw:
        return None
    try:
        count = int(raw.get("count"))
    except (TypeError, ValueError, AttributeError):
        raise RecipeError(f"Freshness '{key}': the count must be a whole number.") from None
    if count <= 0:
        raise RecipeError(f"Freshness '{key}': the count must be positive.")
    period = str(raw.get("period") or "hour").strip().lower()
    if period not in PERIODS:
        raise RecipeError(
            f"Freshness '{key}': unknown period '{period}'. Choose among {', '.join(PERIODS)}."
        )
    return count * PERIODS[period]


def freshness(df: DataFrame, settings: dict, now: datetime | None = None) -> DataFrame:
    """One row: max_loaded_at, snapshotted_at, age_seconds, status (pass, warn or error).

    ``loaded_at_field`` is a column or an SQL expression. A source without rows is an error
    as soon as it has a threshold.
    """
    warn, error = (threshold_seconds(settings, k) for k in ("warn_after", "error_after"))
    field = str(settings.get("loaded_at_field") or "").strip()
    if not field:
        raise RecipeError("Freshness needs 'loaded_at_field', the time a row arrived.")
    moment = now or datetime.now(timezone.utc).replace(tzinfo=None)
    at = F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
    newest = df.agg(
        F.max(sql_expression(field, "Freshness")).cast("timestamp_ntz").alias("max_loaded_at")
    )
    age = F.timestamp_diff("SECOND", F.col("max_loaded_at"), at)
    out = newest.select("max_loaded_at", at.alias("snapshotted_at"), age.alias("age_seconds"))
    late = F.lit("pass")
    if warn is not None:
        late = F.when(F.col("age_seconds") > warn, "warn").otherwise(late)
    if error is not None:
        late = F.when(F.col("age_seconds") > error, "error").otherwise(late)
    if warn is not None or error is not None:
        late = F.when(F.col("age_seconds").isNull(), "error").otherwise(late)
    return out.withColumn("status", late)
