"""Aggregates over raster patches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspark.functions.indices import ndci
from rillspark.functions.numeric import share, slope_degrees, zero_to_null
from rillspark.operators.quantiles import named_medians

# The class codes reported as shares.
LAND_COVER_CLASSES = {"perc_agri": 40, "perc_urban": 50, "perc_grass": 30, "perc_forest": 10}
BARREN_CLASS = {"perc_barren": 60}


def band_medians(
    pixels: DataFrame,
    keys: Sequence[str],
    bands: Sequence[str],
    band: str = "band",
    value: str = "value",
) -> DataFrame:
    """Exact median per band of each patch, one column per band; a median of 0 is missing."""
    medians = named_medians(pixels, keys, band, value, bands)
    return medians.select(*keys, *(zero_to_null(F.col(b)).alias(b) for b in bands))


def class_shares(
    pixels: DataFrame,
    keys: Sequence[str],
    classes: Mapping[str, int] = LAND_COVER_CLASSES,
    code: str = "class",
) -> DataFrame:
    """Percentage of each class among the valid pixels of a patch; all nodata gives 0."""
    valid = F.count_if(F.col(code) > 0)
    return pixels.groupBy(*keys).agg(
        *(share(F.count_if(F.col(code) == k), valid).alias(name) for name, k in classes.items())
    )


def attach_patches(
    places: DataFrame, patches: DataFrame, keys: Sequence[str], default: float | None = None
) -> DataFrame:
    """Left join patch results to places; a place without a patch gets ``default``."""
    joined = places.join(patches, list(keys), "left")
    if default is None:
        return joined
    return joined.fillna(default, subset=[c for c in patches.columns if c not in set(keys)])


def band_ratio(
    pixels: DataFrame, keys: Sequence[str], upper: str, lower: str,
    band: str = "band", value: str = "value",
) -> DataFrame:
    """Mean of two bands per patch and their normalised difference."""
    mean_of = {
        name: F.avg(F.when(F.col(band) == name, F.col(value))) for name in (upper, lower)
    }
    return (
        pixels.groupBy(*keys)
        .agg(*(mean.alias(name) for name, mean in mean_of.items()))
        .withColumn("ndci", ndci(F.col(upper), F.col(lower)))
    )


def class_counts(pixels: DataFrame, keys: Sequence[str], code: str = "class") -> DataFrame:
    return pixels.groupBy(*keys, code).agg(F.count("*").alias("pixels"))


def _gradient(value: str, window, step: str):
    """Central difference, one-sided at the edges of the line; NULL for a single pixel.

    Where a pixel inside the line is absent its neighbours have no gradient, as if it were there
    without a value.
    """
    here, at = F.col(value), F.col(step)
    beside = {
        side: F.when(of(step).over(window) == at + way, of(value).over(window))
        for side, of, way in (("before", F.lag, -1), ("after", F.lead, 1))
    }
    first, last = F.lag(step).over(window).isNull(), F.lead(step).over(window).isNull()
    return (
        F.when(first & last, None)
        .when(first, beside["after"] - here)
        .when(last, here - beside["before"])
        .otherwise((beside["after"] - beside["before"]) / 2.0)
    )


def gradients(
    pixels: DataFrame, patch: str = "patch", row: str = "r", col: str = "c", value: str = "value"
) -> DataFrame:
    """Gradient along rows (gy) and columns (gx) of each pixel.

    The windows run along one line of a patch at a time, so a patch spreads over as many tasks
    as it has lines.
    """
    across = Window.partitionBy(patch, row).orderBy(col)
    down = Window.partitionBy(patch, col).orderBy(row)
    return pixels.withColumn("gx", _gradient(value, across, col)).withColumn(
        "gy", _gradient(value, down, row)
    )


def mean_slope(
    pixels: DataFrame, patch: str = "patch", row: str = "r", col: str = "c",
    value: str = "value", resolution: float = 30.0,
) -> DataFrame:
    """Mean steepness of each patch in degrees, skipping pixels without a gradient."""
    steep = slope_degrees(F.col("gx"), F.col("gy"), resolution)
    return (
        gradients(pixels, patch, row, col, value)
        .groupBy(patch)
        .agg(F.avg(steep).alias("topographic_slope"))
    )
