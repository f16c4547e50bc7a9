"""Train and score one target under a split, and the forecasting frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.operators.joins import append_frames
from rillspark.operators.metrics import regression_metrics
from rillspark.operators.models import fit_targets, prepare_targets
from rillspark.operators.prep import one_hot
from rillspark.operators.series import fill_forward_back, interpolate, resample_mean, sequences
from rillspark.operators.split import target_splits


def evaluate_targets(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    estimator,
    place: Sequence[str] = ("lat", "lon"),
    row_key: Sequence[str] | None = None,
    test_fraction: float = 0.2,
    categorical: Sequence[str] = (),
) -> DataFrame:
    """Holdout metrics per target: whole places are held out, or rows when ``row_key`` is given.

    Each target has its own split over the rows it has a value for. Only the loop over targets
    runs on the driver.
    """
    encoded = one_hot(df, categorical)
    flags = [c for c in encoded.columns if c not in df.columns]
    marked, splits = target_splits(encoded, targets, place, row_key, test_fraction)
    matrices = prepare_targets(marked, dict.fromkeys(targets, [*features, *flags]), splits)
    fitted = fit_targets(matrices, lambda _: estimator)
    tables = []
    for target, matrix in matrices.items():
        scored = fitted[target].transform(matrix.side("test"))
        tables.append(
            regression_metrics(scored, [], len(matrix.features)).select(
                F.lit(target).alias("target"), "n", "r2", "adj_r2", "rmse"
            )
        )
    return append_frames(tables)


def monthly_sequences(
    df: DataFrame, series: Sequence[str], time: str, features: Sequence[str], target: str,
    length: int = 3, step: str = "month",
) -> DataFrame:
    """Resample, fill gaps by interpolation, and cut into histories with the next target."""
    values = [target, *(f for f in features if f != target)]
    regular = resample_mean(df, series, time, values, step)
    return sequences(interpolate(regular, series, time, values), series, time, values, target, length)


def forecasting_frame(
    df: DataFrame, series: str, time: str, target: str, row_id: str, exogenous: Sequence[str],
    chunks: int | None = None,
) -> DataFrame:
    """Long frame (unique_id, ds, y, exogenous...) without gaps inside a series."""
    filled = fill_forward_back(df, [series], [time, row_id], [target, *exogenous], chunks)
    return filled.select(
        F.col(series).cast("string").alias("unique_id"),
        F.col(time).alias("ds"),
        F.col(target).alias("y"),
        *exogenous,
    )
