"""Risk flags and triage of places (R1, R2). Both follow from prose, not from code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.operators.quantiles import column_quantiles

# Alert thresholds.
CONDUCTANCE_LIMIT = 800.0
PHOSPHORUS_LIMIT = 100.0


def with_alert(
    df: DataFrame, conductance: str, phosphorus: str,
    limits: tuple[float, float] = (CONDUCTANCE_LIMIT, PHOSPHORUS_LIMIT),
) -> DataFrame:
    """True where either value is above its limit; a missing value raises no alert."""
    over = [
        F.coalesce(F.col(c) > F.lit(limit), F.lit(False))
        for c, limit in zip((conductance, phosphorus), limits)
    ]
    return df.withColumn("alert", over[0] | over[1])


def highest_risk_places(
    df: DataFrame, place: Sequence[str], score: str, share: float = 0.25
) -> DataFrame:
    """Places whose mean score is at or above the (1 - share) quantile of all places."""
    places = df.groupBy(*place).agg(F.round(F.avg(score), 6).alias("risk"))
    limit = column_quantiles(places, ["risk"], [1 - share])["risk"][0]
    return places.filter(F.col("risk") >= F.lit(limit).cast("double"))
