"""Samples with antecedent climate, spectral indices and calendar columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.functions.dates import micros, with_calendar
from rillspark.functions.indices import with_interactions, with_spectral_indices
from rillspark.functions.places import BAND_BOX_WIDTH, MONTHLY_INDEX_HALF, Box, box_around, box_of_width
from rillspark.operators.columns import clear_scenes
from rillspark.operators.joins import enrich
from rillspark.operators.nearest import Axis, nearest_grid_cell, nearest_in_time
from rillspark.operators.ranges import During, overlap_join
from rillspark.operators.series import rolling
from rillspark.operators.zonal import BARREN_CLASS, LAND_COVER_CLASSES, band_ratio, class_shares, mean_slope
from rillspark.session import durable
from rillspark.sources.io import remaining

MICROS_PER_DAY = 86_400_000_000

ANTECEDENT = {
    "ppt_3mo": ("ppt", "sum", 3),
    "ppt_6mo": ("ppt", "sum", 6),
    "tmax_3mo": ("tmax", "mean", 3),
}


def climate_features(
    samples: DataFrame, cube: DataFrame, variables: Sequence[str], lat_axis: Axis, lon_axis: Axis,
    months: tuple[str, str],
) -> DataFrame:
    """Climate and antecedent climate at the nearest cell and month of each sample."""
    rolled = rolling(cube, ["lat", "lon"], "t", ANTECEDENT)
    return nearest_grid_cell(
        samples, rolled, [*variables, *ANTECEDENT], lat_axis, lon_axis, months
    )


def feature_table(
    samples: DataFrame, bands: DataFrame, cube: DataFrame, variables: Sequence[str],
    key: Sequence[str], lat_axis: Axis, lon_axis: Axis, months: tuple[str, str],
    training: bool = True,
) -> DataFrame:
    """One row per sample (and band row) with all derived features."""
    spectral = with_spectral_indices(bands, training)
    climate = climate_features(samples, cube, variables, lat_axis, lon_axis, months)
    return with_calendar(with_interactions(enrich(climate, [spectral], key)), "d")


def scene_per_sample(
    samples: DataFrame, scenes: DataFrame, date: str, max_cloud: float = 10.0,
    width: float = BAND_BOX_WIDTH, cell_size: float = 1.0, chunks: int | None = None,
    period: tuple[str, str] | None = None,
) -> DataFrame:
    """For each sample the clear scene over its place that is nearest in time.

    Places are looked up once each, however many samples they have. ``period`` keeps the scenes of its first
    to its last day; the scan leaves out the others.
    """
    clear = clear_scenes(scenes, max_cloud, period)
    footprint = Box(*(F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")))
    places = samples.select("lat", "lon").distinct()
    covering = overlap_join(
        places, box_of_width(F.col("lat"), F.col("lon"), width), clear, footprint, cell_size
    ).select("lat", "lon", "scene_id", F.col("ts").alias("scene_ts"))
    return nearest_in_time(
        samples, covering, ["lat", "lon"], date, "scene_ts", "scene_id", chunks
    )


def scene_within_days(
    samples: DataFrame, scenes: DataFrame, date: str, days: int, max_cloud: float = 10.0,
    width: float = BAND_BOX_WIDTH, cell_size: float = 1.0,
) -> DataFrame:
    """For each sample the clear scene over its place that is nearest, at most ``days`` away.

    Adds scene_id and scene_ts, missing where there is none; of two equal distances the earlier scene and
    then the smaller id. Only pairs within the days are made: place and time are joined at once.
    """
    clear = clear_scenes(scenes, max_cloud)
    footprint = Box(*(F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")))
    span = days * MICROS_PER_DAY
    asked = samples.select("lat", "lon", date).distinct().withColumn("_us", micros(F.col(date)))
    pairs = overlap_join(
        asked.filter("_us is not null"), box_of_width(F.col("lat"), F.col("lon"), width), clear, footprint, cell_size,
        during=During(F.col("_us") - span, F.col("_us") + span, micros(F.col("ts")), max(span, 1)),
    )
    us = micros(F.col("ts"))
    nearest = pairs.groupBy("lat", "lon", date).agg(
        F.min(F.struct(F.abs(us - F.col("_us")).alias("gap"), F.col("ts").alias("scene_ts"), "scene_id")).alias("_hit")
    )
    hits = nearest.select("lat", "lon", date, "_hit.scene_id", "_hit.scene_ts")
    return samples.join(hits, ["lat", "lon", date], "left")


def monthly_ndci(
    samples: DataFrame, scenes: DataFrame, values: DataFrame, date: str, done: DataFrame | None = None,
    max_cloud: float = 30.0, half: float = MONTHLY_INDEX_HALF, cell_size: float = 1.0,
    bands: tuple[str, str] = ("B05", "B04"),
) -> DataFrame:
    """lat, lon, month and ndci of every place and month that is not in ``done``, keyed alike.

    Of the scenes of the month over the place with little cloud the first counts (by time, then id); the ratio
    is that of the means of its bands. A place and month without a scene, or a ratio without a
    denominator, gives a missing ndci, and is done all the same. ``values`` has scene_id, band and value.
    """
    month = F.trunc(date, "month").cast("date")
    asked = samples.select("lat", "lon", month.alias("month")).filter("month is not null").distinct()
    if done is not None:
        asked = remaining(asked, done, ["lat", "lon", "month"])
    asked = durable(asked)
    footprint = Box(*(F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")))
    first, last = (micros(F.col("month") if k == 0 else F.add_months("month", k)) for k in (0, 1))
    pairs = overlap_join(
        asked, box_around(F.col("lat"), F.col("lon"), half), clear_scenes(scenes, max_cloud), footprint, cell_size,
        during=During(first, last - 1, micros(F.col("ts")), 28 * MICROS_PER_DAY),
    )
    key = ["lat", "lon", "month"]
    chosen = pairs.groupBy(*key).agg(F.min_by("scene_id", F.struct("ts", "scene_id")).alias("scene_id"))
    ratios = band_ratio(values, ["scene_id"], *bands)
    found = chosen.join(ratios, "scene_id").select(*key, "ndci")
    return asked.join(found, key, "left")


def with_monthly(samples: DataFrame, monthly: DataFrame, date: str, name: str) -> DataFrame:
    """The samples with the value of their place and month; a column of theirs named month is left alone."""
    keyed = samples.withColumn("_month", F.trunc(date, "month").cast("date"))
    values = monthly.select("lat", "lon", F.col("month").alias("_month"), name)
    return keyed.join(values, ["lat", "lon", "_month"], "left").select(*samples.columns, name)


def landscape(cover: DataFrame, terrain: DataFrame, patch: str = "patch") -> DataFrame:
    """One row per patch: shares of land cover and of barren land, and the mean slope.

    A patch that only one of the two tables has misses the features of the other, but for perc_barren, which is 0 there.
    """
    shares = class_shares(cover, [patch], {**LAND_COVER_CLASSES, **BARREN_CLASS})
    both = shares.join(mean_slope(terrain, patch), patch, "full")
    return both.fillna(0.0, list(BARREN_CLASS))


def training_table(
    features: DataFrame, places: DataFrame, monthly: DataFrame, date: str, key: Sequence[str]
) -> DataFrame:
    """The sample features with those of their place (one row per ``key``) and the ndci of its month.

    No row is lost or doubled: what a place or a month does not have is missing, perc_barren is 0. The
    interactions whose inputs are complete only now are added; precipitation and evapotranspiration are the
    climate columns under the names the models of a single target use.
    """
    named = {"precipitation": "ppt", "evapotranspiration": "pet"}
    joined = features.join(places, list(key), "left").fillna(0.0, list(BARREN_CLASS))
    known = with_monthly(joined, monthly, date, "ndci")
    return with_interactions(
        known.withColumns({n: F.col(c) for n, c in named.items() if c in known.columns} | {"year": F.year("d")})
    )
