"""Projections and row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTEFACT_COLUMNS = ("Unnamed: 0",)
# Columns that identify, locate or label a row and so are no features.
NON_FEATURES = (
    "Total Alkalinity",
    "Electrical Conductance",
    "Dissolved Reactive Phosphorus",
    "Latitude",
    "Longitude",
    "Sample Date",
    "spatial_cluster",
    "lat_bin",
    "lon_bin",
    "spatial_group",
)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def drop_artefacts(df: DataFrame, names: Sequence[str] = ARTEFACT_COLUMNS) -> DataFrame:
    return df.drop(*names)


def feature_names(df: DataFrame, exclude: Sequence[str] = NON_FEATURES) -> list[str]:
    """Every column that is not excluded, in the order of the table."""
    return [c for c in df.columns if c not in set(exclude)]


def pick_features(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """The wanted features that exist, and those that are missing."""
    present = set(df.columns)
    return [c for c in wanted if c in present], [c for c in wanted if c not in present]


def null_columns(df: DataFrame) -> list[str]:
    """Columns without any value, found in one pass."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")) for c in df.columns)).first()
    return [c for c, n in zip(df.columns, counts, strict=True) if n == 0]


def drop_null_columns(df: DataFrame) -> DataFrame:
    return df.drop(*null_columns(df))


def require(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop rows that miss one of the named values."""
    return df.dropna(subset=list(names))


def clear_scenes(
    scenes: DataFrame, max_cloud: float, window: tuple[str, str] | None = None,
    cloud: str = "cloud_cover", ts: str = "ts",
) -> DataFrame:
    """Scenes below a cloud cover, inside a window of whole days (both ends included)."""
    kept = scenes.filter(F.col(cloud) < max_cloud)
    if window is None:
        return kept
    first = F.lit(window[0]).cast("date").cast("timestamp_ntz")
    after = F.date_add(F.lit(window[1]).cast("date"), 1).cast("timestamp_ntz")
    return kept.filter((F.col(ts) >= first) & (F.col(ts) < after))


def valid_pixels(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Nodata is 0; keep what is above it."""
    return pixels.filter(F.col(value) > 0)


def contract(df: DataFrame, names: Sequence[str | Column]) -> DataFrame:
    """The output columns, in their agreed order."""
    return df.select(*names)


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def without_shared(
    right: DataFrame, left: DataFrame, keys: Sequence[str], also: Sequence[str] = ()
) -> DataFrame:
    """Drop from ``right`` what ``left`` has already, but for the join keys."""
    shared = (set(left.columns) | set(also)) - set(keys)
    return right.drop(*[c for c in right.columns if c in shared])
