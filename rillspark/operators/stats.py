"""Descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.functions.numeric import shifted_log
from rillspark.operators.quantiles import column_quantiles

QUARTILES = (0.25, 0.5, 0.75)


def region_mean(cube: DataFrame, time: str, variables: Sequence[str]) -> DataFrame:
    """Mean over all cells for each time step."""
    return cube.groupBy(time).agg(*(F.avg(v).alias(v) for v in variables))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows and distinct values per column.

    Several count-distincts in one aggregation spread over tasks by (column, value), so a
    frequent value is combined before the shuffle.
    """
    return df.agg(
        F.count("*").alias("rows"), *(F.countDistinct(c).alias(f"distinct_{c}") for c in cols)
    )


def _one_row_per_column(df: DataFrame, cols: Sequence[str], **stats) -> DataFrame:
    """One aggregation over all columns, turned into a row per column."""
    row = df.agg(
        F.array(
            *(
                F.struct(
                    F.lit(c).alias("column"), *(f(c).alias(name) for name, f in stats.items())
                )
                for c in cols
            )
        ).alias("_rows")
    )
    return row.select(F.inline("_rows"))


def column_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact median per column."""
    medians = {c: q[0] for c, q in column_quantiles(df, cols, [0.5]).items()}
    return _one_row_per_column(
        df, cols, count=F.count, median=lambda c: F.lit(medians[c]).cast("double")
    )


def column_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per column."""
    return _one_row_per_column(df, cols, mean=F.avg, std=F.stddev_pop)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max, one row per column."""
    cuts = column_quantiles(df, cols, QUARTILES)

    def cut(i: int):
        return lambda c: F.lit(cuts[c][i]).cast("double")

    return _one_row_per_column(
        df, cols, count=F.count, mean=F.avg, std=F.stddev_samp, min=F.min,
        q25=cut(0), q50=cut(1), q75=cut(2), max=F.max,
    )


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of the given columns that exist.

    Each pair uses the rows where both are present. All pairs come from one aggregation.
    """
    present = [c for c in cols if c in df.columns]
    pairs = list(combinations_with_replacement(present, 2))
    both = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"),
            F.corr(a, b).alias("r"),
        )
        for a, b in pairs
    ]
    upper = df.agg(F.array(*both).alias("_rows")).select(F.inline("_rows"))
    mirrored = F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"),
                                                        F.col("a").alias("b"), "r"))
    return upper.select(
        F.inline(F.when(F.col("a") == F.col("b"), F.slice(mirrored, 1, 1)).otherwise(mirrored))
    )


def log_distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lowest value, and mean and quartiles of log1p(x - min + 1), one row per column."""
    low = df.agg(*(F.min(c).alias(c) for c in cols)).first().asDict()
    logs = df.select(
        *(shifted_log(F.col(c), F.lit(low[c]).cast("double")).alias(c) for c in cols)
    )
    cuts = column_quantiles(logs, cols, QUARTILES)

    def cut(i: int):
        return lambda c: F.lit(cuts[c][i]).cast("double")

    return _one_row_per_column(
        logs, cols, lowest=lambda c: F.lit(low[c]).cast("double"), count=F.count, mean=F.avg,
        q25=cut(0), q50=cut(1), q75=cut(2),
    )


def run_counts(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """Rows per split and number of features."""
    return df.groupBy(split).agg(
        F.count("*").alias("rows"), F.lit(len(features)).cast("long").alias("features")
    )
