"""Coordinate expressions (F21, F22, F28) and boxes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Half widths in degrees, but for the band box, which gives its total width.
LAND_COVER_HALF = 2000 / 111000.0
SLOPE_HALF = 0.018
MONTHLY_INDEX_HALF = 0.0001
BAND_BOX_WIDTH = 0.00089831
COORDINATE_DIGITS = 6


class Box(NamedTuple):
    min_lat: Column
    max_lat: Column
    min_lon: Column
    max_lon: Column


def box_around(lat: Column, lon: Column, half: float) -> Box:
    """Square box, ``half`` degrees to each side."""
    h = F.lit(float(half))
    return Box(lat - h, lat + h, lon - h, lon + h)


def box_of_width(lat: Column, lon: Column, width: float) -> Box:
    """Square box with a total side length in degrees."""
    return box_around(lat, lon, width / 2)


def strictly_inside(lat: Column, lon: Column, south, north, west, east) -> Column:
    return (lat > south) & (lat < north) & (lon > west) & (lon < east)


def inside(lat: Column, lon: Column, box: Box) -> Column:
    """Inclusive on all four sides."""
    return lat.between(box.min_lat, box.max_lat) & lon.between(box.min_lon, box.max_lon)


def boxes_overlap(a: Box, b: Box) -> Column:
    return (
        (a.min_lat <= b.max_lat)
        & (b.min_lat <= a.max_lat)
        & (a.min_lon <= b.max_lon)
        & (b.min_lon <= a.max_lon)
    )


def rounded(coordinate: Column) -> Column:
    return F.round(coordinate, COORDINATE_DIGITS)


def place_id(lat: Column, lon: Column) -> Column:
    """Readable place label. Group and join on the two doubles, not on this text."""
    return F.concat_ws("_", lat.cast("string"), lon.cast("string"))


def place_coordinates(label: Column) -> tuple[Column, Column]:
    parts = F.split(label, "_")
    return parts[0].cast("double"), parts[1].cast("double")
