"""Box against box joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.functions.places import Box, boxes_overlap
from rillspark.session import durable

PAIRS_PER_TASK = 50_000_000


@dataclass(frozen=True)
class During:
    """A span of the left rows that an instant of the right rows has to lie in, ends included.

    All in one whole unit; ``bucket`` is the length of a join bucket, about that of the spans.
    """

    start: Column
    end: Column
    instant: Column
    bucket: int


def _cell(edge: Column, size: float) -> Column:
    return F.floor(edge / F.lit(size))


def _covered(df: DataFrame, box: Box, size: float, prefix: str) -> DataFrame:
    """One row per grid cell that the box touches."""
    return (
        df.withColumns(
            {
                f"{prefix}south": box.min_lat,
                f"{prefix}north": box.max_lat,
                f"{prefix}west": box.min_lon,
                f"{prefix}east": box.max_lon,
            }
        )
        .withColumn(
            "_cy", F.explode(F.sequence(_cell(box.min_lat, size), _cell(box.max_lat, size)))
        )
        .withColumn(
            "_cx", F.explode(F.sequence(_cell(box.min_lon, size), _cell(box.max_lon, size)))
        )
    )


def overlap_join(
    left: DataFrame,
    left_box: Box,
    right: DataFrame,
    right_box: Box,
    cell_size: float,
    pairs_per_task: int = PAIRS_PER_TASK,
    during: During | None = None,
) -> DataFrame:
    """All pairs of rows whose boxes overlap, edges included.

    Both sides are spread over the grid cells they touch and joined on the cell. A pair that
    shares several cells is kept in one of them only, the one with the south-west corner of the
    shared area, so nothing has to be made distinct afterwards. Give ``cell_size`` about the
    size of the larger boxes. Rows of both sides are counted per cell first: where their product
    is above ``pairs_per_task`` the right rows of the cell are dealt over as many tasks as it
    takes, and the left rows are copied to each.

    With ``during`` only pairs whose times meet as well are made: time buckets are part of the
    join key, several for a left row and one for a right row.
    """
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    a = _covered(left, left_box, cell_size, "_l_")
    b = _covered(right, right_box, cell_size, "_r_")
    cell = ["_cy", "_cx"]
    if during:
        cell.append("_ct")
        bucket = lambda us: F.floor(us / F.lit(during.bucket))
        a = a.withColumns({"_l_start": during.start, "_l_end": during.end}).withColumn(
            "_ct", F.explode(F.sequence(bucket(F.col("_l_start")), bucket(F.col("_l_end"))))
        )
        b = b.withColumn("_r_at", during.instant).withColumn("_ct", bucket(F.col("_r_at")))
    counted = a.groupBy(*cell).agg(F.count("*").alias("_l")).join(
        b.groupBy(*cell).agg(F.count("*").alias("_r")), cell
    )
    salts = F.least(F.ceil(F.col("_l").cast("double") * F.col("_r") / pairs_per_task), F.col("_r"))
    crowded = durable(
        counted.filter(F.col("_l").cast("double") * F.col("_r") > pairs_per_task).select(
            *cell, salts.cast("int").alias("_salts")
        )
    )
    keys = [*cell, "_salt"]
    times = F.coalesce("_salts", F.lit(1))
    a = a.join(crowded, cell, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), times - 1))
    )
    b = b.join(crowded, cell, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*right.columns), times).cast("int")
    )
    l_box = Box(*(F.col(f"_l_{s}") for s in ("south", "north", "west", "east")))
    r_box = Box(*(F.col(f"_r_{s}") for s in ("south", "north", "west", "east")))
    first_shared = (
        F.col("_cy") == F.greatest(_cell(l_box.min_lat, cell_size), _cell(r_box.min_lat, cell_size))
    ) & (
        F.col("_cx") == F.greatest(_cell(l_box.min_lon, cell_size), _cell(r_box.min_lon, cell_size))
    )
    meet = boxes_overlap(l_box, r_box) & first_shared
    if during:
        meet &= F.col("_r_at").between(F.col("_l_start"), F.col("_l_end"))
    return (
        a.join(b, keys)
        .filter(meet)
        .select(*left.columns, *right.columns)
    )
