"""Regression metrics and the tables made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.functions.numeric import absolute_residual


def regression_metrics(
    scored: DataFrame,
    by: Sequence[str],
    features: int | None = None,
    actual: str = "y",
    predicted: str = "prediction",
) -> DataFrame:
    """R2, RMSE and, for a number of features, adjusted R2; one aggregation.

    Rows that miss either value are skipped. R2 is 1 - SSres / SStot, and NULL when the actual
    values do not vary; adjusted R2 is NULL without spare degrees of freedom.
    """
    y, p = F.col(actual), F.col(predicted)
    both = scored.filter(y.isNotNull() & p.isNotNull())
    n = F.col("n")
    sums = both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((y - p) * (y - p)).alias("_mse"),
        F.var_pop(y).alias("_var"),
    )
    r2 = F.lit(1.0) - F.try_divide(F.col("_mse"), F.col("_var"))
    made = sums.withColumns({"r2": r2, "rmse": F.sqrt("_mse")}).drop("_mse", "_var")
    if features is None:
        return made
    spare = n - features - 1
    return made.withColumn(
        "adj_r2",
        F.when(spare > 0, F.lit(1.0) - (F.lit(1.0) - F.col("r2")) * (n - 1) / spare),
    )


def best_per_group(table: DataFrame, by: Sequence[str], score: str, largest: bool = True) -> DataFrame:
    """The row with the best score of each group."""
    rest = [c for c in table.columns if c not in by]
    pick = F.max_by if largest else F.min_by
    return (
        table.groupBy(*by)
        .agg(pick(F.struct(*rest), F.col(score)).alias("_best"))
        .select(*by, "_best.*")
    )


def top_k(table: DataFrame, by: Sequence[str], score: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The k highest scores of each group with their rank.

    Spark keeps k rows per group in each map task before the shuffle.
    """
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), *ties)
    return table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_of(
    table: DataFrame, by: Sequence[str], score: str, name: str, wanted: Sequence[str]
) -> DataFrame:
    """Rank of the named entries in each group, best score first.

    A group is a list of features, so it has no more rows than a table has columns.
    """
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), name)
    return table.withColumn("rank", F.row_number().over(order)).filter(
        F.col(name).isin(list(wanted))
    )


def leaderboard(table: DataFrame, by: Sequence[str], score: str = "r2") -> DataFrame:
    return table.orderBy(*by, F.col(score).desc())


def extent(
    scored: DataFrame, by: Sequence[str], actual: str = "y", predicted: str = "prediction"
) -> DataFrame:
    """Common range of actual and predicted values."""
    return scored.groupBy(*by).agg(
        F.least(F.min(actual), F.min(predicted)).alias("low"),
        F.greatest(F.max(actual), F.max(predicted)).alias("high"),
    )


def residuals(
    scored: DataFrame, keep: Sequence[str | Column], actual: str = "y", predicted: str = "prediction"
) -> DataFrame:
    """Predictions with their absolute residual and the columns that place them."""
    return scored.select(
        *keep,
        actual,
        predicted,
        absolute_residual(F.col(actual), F.col(predicted)).alias("residual"),
    )
