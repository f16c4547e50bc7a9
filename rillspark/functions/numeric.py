"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Land-cover legend codes.
LEGEND = {
    10: "tree cover",
    20: "shrubland",
    30: "grassland",
    40: "cropland",
    50: "built-up",
    60: "bare or sparse",
    70: "snow and ice",
    80: "water",
    90: "wetland",
    95: "mangroves",
    100: "moss and lichen",
}


def clip_at_zero(x: Column) -> Column:
    """Negative to 0; missing stays missing."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def shifted_log(x: Column, lowest: Column | float) -> Column:
    """log1p(x - min + 1)."""
    low = lowest if isinstance(lowest, Column) else F.lit(lowest)
    return F.log1p(x - low + F.lit(1.0))


def absolute_residual(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def slope_degrees(gx: Column, gy: Column, resolution: float = 30.0) -> Column:
    """Steepness of a surface from its two gradients per pixel."""
    return F.degrees(F.atan(F.sqrt(gx * gx + gy * gy) / F.lit(resolution)))


def legend_name(code: Column) -> Column:
    """Land-cover name of a class code; NULL for a code outside the legend."""
    pairs = [F.lit(x) for item in LEGEND.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))


def zero_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def share(hits: Column, total: Column) -> Column:
    """Percentage, with an empty total giving 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(hits * F.lit(100.0) / total)
