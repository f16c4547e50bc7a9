"""Declared schemas of the CSV files; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ("Latitude", "Longitude", "Sample Date")
PLACE = ("Latitude", "Longitude")
TARGETS = ("Total Alkalinity", "Electrical Conductance", "Dissolved Reactive Phosphorus")
BANDS = ("red", "blue", "green", "nir", "swir16", "swir22")
CLIMATE = ("ppt", "tmax", "tmin", "pet", "soil", "def", "ppt_3mo", "ppt_6mo", "tmax_3mo")
LAND_COVER = ("perc_agri", "perc_urban", "perc_grass", "perc_forest")
TERRAIN = ("perc_barren", "topographic_slope")


def _doubles(names) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType(), True) for n in names]


def _keyed(names) -> T.StructType:
    date = T.StructField("Sample Date", T.StringType(), True)
    return T.StructType([*_doubles(PLACE), date, *_doubles(names)])


SAMPLES = _keyed(TARGETS)
BAND_FEATURES = _keyed(BANDS)
CLIMATE_FEATURES = _keyed(CLIMATE)
LAND_COVER_FEATURES = T.StructType(_doubles((*PLACE, *LAND_COVER)))
TERRAIN_FEATURES = T.StructType(_doubles((*PLACE, *TERRAIN)))
MONTHLY_INDEX = T.StructType(
    [*_doubles(PLACE), T.StructField("YearMonth", T.StringType(), True), *_doubles(("ndci",))]
)
EXTRACTED_FEATURES = {
    "bands": BAND_FEATURES,
    "climate": CLIMATE_FEATURES,
    "land_cover": LAND_COVER_FEATURES,
    "terrain": TERRAIN_FEATURES,
    "monthly_index": MONTHLY_INDEX,
}
