"""Numbering the rows of a table from 0 in a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.session import durable

ONE_TASK_ROWS = 100_000


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add the position of each row.

    A table that is small by count is numbered in one task. A larger one is sorted over many
    tasks and written down; each row then gets its place in its part plus the rows of the parts
    before.
    """
    if df.count() <= ONE_TASK_ROWS:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    ordered = durable(df.orderBy(*order).withColumn("_serial", F.monotonically_increasing_id()))
    part = F.shiftright("_serial", 33)
    within = F.col("_serial") - F.shiftleft(part, 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the sort.
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        ordered.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + within)
        .drop("_serial", "_part", "_offset")
    )
