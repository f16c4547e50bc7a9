"""Spectral indices and interaction features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The guards that keep a ratio finite.
EPS = 1e-10
EPS_COARSE = 1e-6


def not_nan(x: Column) -> Column:
    """Missing is NULL everywhere, so a NaN made by arithmetic becomes NULL."""
    return F.nanvl(x, F.lit(None).cast("double"))


def normalized_difference(a: Column, b: Column, eps: float = EPS) -> Column:
    """(a - b) / (a + b + eps); NULL where the denominator is 0."""
    total = a + b + F.lit(eps) if eps else a + b
    return F.try_divide(a - b, total)


def root(x: Column) -> Column:
    return not_nan(F.sqrt(x))


def square(x: Column) -> Column:
    return x * x


# name -> (columns it needs, expression over them)
SPECTRAL: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "NDMI": (("nir", "swir16"), normalized_difference),
    "MNDWI": (("green", "swir16"), normalized_difference),
    "NDVI": (("nir", "red"), normalized_difference),
    "NDTI": (("red", "green"), normalized_difference),
    "SI": (("blue", "red"), lambda blue, red: root(blue * red)),
    "SI1": (("blue", "red"), lambda blue, red: root(square(blue) + square(red))),
    "SI2": (
        ("blue", "green", "red"),
        lambda blue, green, red: root(square(blue) + square(green) + square(red)),
    ),
    "SWIR_Ratio": (
        ("swir16", "swir22"),
        lambda swir16, swir22: F.try_divide(swir16, swir22 + F.lit(EPS)),
    ),
}
# The salinity pair exists in the training feature set only.
TRAINING_ONLY = ("SI", "SI1")

INTERACTIONS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "carbonate_index": (
        ("swir22", "swir16"),
        lambda swir22, swir16: F.try_divide(swir22, swir16 + F.lit(EPS_COARSE)),
    ),
    "NDSI": (("red", "nir"), lambda red, nir: normalized_difference(red, nir, EPS_COARSE)),
    "T_range": (("tmax", "tmin"), lambda tmax, tmin: tmax - tmin),
    "hydro_soil_interaction": (("NDTI", "soil_clay"), lambda a, b: a * b),
    "ndci_turbidity_interaction": (("ndci", "NDTI"), lambda a, b: a * b),
    "post_2008": (("year",), lambda year: F.coalesce((year > 2008).cast("int"), F.lit(0))),
    "urban_precip_interaction": (("perc_urban", "precipitation"), lambda a, b: a * b),
}


def ndci(b5: Column, b4: Column) -> Column:
    """Chlorophyll index of two band means; missing where their sum is 0."""
    return normalized_difference(b5, b4, 0)


def _add(df: DataFrame, recipes: dict, names) -> DataFrame:
    present = set(df.columns)
    made = {
        name: recipes[name][1](*(F.col(c) for c in recipes[name][0]))
        for name in names
        if present.issuperset(recipes[name][0])
    }
    return df.withColumns(made) if made else df


def with_spectral_indices(df: DataFrame, training: bool = True) -> DataFrame:
    """Add each spectral index whose bands are present; skip the others."""
    return _add(df, SPECTRAL, [n for n in SPECTRAL if training or n not in TRAINING_ONLY])


def with_interactions(df: DataFrame) -> DataFrame:
    """Add each interaction feature whose inputs are present."""
    return _add(df, INTERACTIONS, INTERACTIONS)
