"""Key joins (J1-J5, J10) and unions.

No join hints: Spark broadcasts a side only when its measured size is below the threshold, and
adaptive execution splits the partition of a hot key. The feature side has one row per key, so a
split of the sample side costs no more than a second read of that one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.functions.dates import iso_text, month_start
from rillspark.functions.places import rounded
from rillspark.operators.columns import without_shared


def enrich(samples: DataFrame, features: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left join feature tables to the samples. Duplicate feature rows multiply the sample."""
    return reduce(lambda left, right: left.join(right, list(keys), "left"), features, samples)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty when a join on them cannot fan out."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def normalize_keys(df: DataFrame, lat: str, lon: str, date: str) -> DataFrame:
    """ISO date text and coordinates at 6 decimals, so that equal keys compare equal."""
    return df.withColumns(
        {lat: rounded(F.col(lat)), lon: rounded(F.col(lon)), date: iso_text(F.col(date))}
    )


def fuse(
    left: DataFrame, right: DataFrame, keys: tuple[str, str, str], targets: Sequence[str] = ()
) -> DataFrame:
    """Inner join of two feature tables on normalised (lat, lon, date).

    Columns both tables carry, and the targets, come from the left one.
    """
    a, b = normalize_keys(left, *keys), normalize_keys(right, *keys)
    return a.join(without_shared(b, a, keys, targets), list(keys))


def join_places(
    samples: DataFrame, places: DataFrame, lat: str = "lat", lon: str = "lon", digits: bool = True
) -> DataFrame:
    """Left join a table of places on coordinates, rounded to 6 decimals unless told otherwise."""
    keys = [lat, lon]
    if digits:
        samples, places = (
            df.withColumns({k: rounded(F.col(k)) for k in keys}) for df in (samples, places)
        )
    return samples.join(places, keys, "left")


def map_month_value(
    samples: DataFrame, monthly: DataFrame, date: str, keys: Sequence[str], month: str = "month"
) -> DataFrame:
    """Attach a (place, month) value to every sample of that month; none found gives NULL."""
    keyed = samples.withColumn(month, month_start(F.col(date)))
    return keyed.join(monthly, [*keys, month], "left").drop(month)


def unprocessed_months(
    samples: DataFrame, processed: DataFrame, date: str, lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Distinct (place, month) pairs with coordinates at 6 decimals that are not processed yet."""
    keys = [rounded(F.col(lat)).alias(lat), rounded(F.col(lon)).alias(lon), "month"]
    wanted = samples.withColumn("month", month_start(F.col(date))).select(*keys).distinct()
    return null_safe_anti(wanted, processed.select(*keys), [lat, lon, "month"])


def null_safe_anti(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``done``; a missing part of a key equals a missing part."""
    other = done.select(*(F.col(f"`{k}`").alias(f"_done_{i}") for i, k in enumerate(keys)))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_done_{i}")) for i, k in enumerate(keys)]
    return df.join(other, same, "left_anti")


def lookup_unique(
    df: DataFrame, keys: Sequence[str], lookup: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run a costly lookup once per distinct key and join its outcome back to every row."""
    return df.join(lookup(df.select(*keys).distinct()), list(keys), "left")


def append_frames(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()
