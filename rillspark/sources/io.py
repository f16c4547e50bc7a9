"""Scans and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillspark.operators.joins import null_safe_anti


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Headered CSV under a declared schema, matched by the order of its columns."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error"
) -> None:
    """Parquet sink, optionally laid out by partition columns (year, coarse cell).

    Rows are brought together by those columns before they are written. Adaptive execution sizes
    the writing tasks by their bytes, so a busy year gets many of them and quiet ones share one.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_bucketed(
    df: DataFrame, table: str, keys: Sequence[str], buckets: int, mode: str = "error"
) -> None:
    """Catalog table bucketed by a join key.

    Tables with the same keys and number of buckets join, and group by those keys, without a
    shuffle: worth it for samples and feature tables that are joined again and again. A bucket is
    one task's work, so the keys must be unique or spread evenly (a sample id, not a place).
    """
    keys = list(keys)
    by_bucket = df.repartition(buckets, *keys)
    by_bucket.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def cube_subset(
    cube: DataFrame,
    variables: Sequence[str],
    time: tuple[str, str],
    lat: tuple[float, float],
    lon: tuple[float, float],
    axes: tuple[str, str, str] = ("t", "lat", "lon"),
) -> DataFrame:
    """Variables, time slice and region slice of a cube; all bounds inclusive.

    The latitude bounds may come north first or south first.
    """
    t, y, x = (F.col(a) for a in axes)
    first, last = (F.lit(v).cast("date") for v in time)
    return cube.filter(
        t.between(first, last) & y.between(*sorted(lat)) & x.between(*sorted(lon))
    ).select(*axes, *variables)


def cube_to_records(
    cube: DataFrame, variable: str, axes: tuple[str, str, str] = ("t", "lat", "lon")
) -> DataFrame:
    """One variable of a cube as keyed records with the date as ISO text."""
    t, y, x = axes
    return cube.select(
        F.date_format(t, "yyyy-MM-dd").alias("Sample Date"),
        F.col(y).alias("Latitude"),
        F.col(x).alias("Longitude"),
        F.col(variable),
    )


def remaining(source: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` whose key has not been processed yet; missing keys are keys as well."""
    return null_safe_anti(source, done, keys)


MANIFEST = "manifest"


def publish_batch(rows: DataFrame, path: str) -> str:
    """Write rows as a batch of a table of results; returns the name of the batch.

    The files go to a folder of the batch, which nobody reads until the manifest names it. That is one
    row in one file, moved into place at once after the last of the rows is there. So a run that is cut short, or loses
    the commit of some of its tasks, leaves files behind but no rows.
    """
    spark, batch = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/batch-{batch}")
    row = spark.range(1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("published"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return batch


def published(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all published batches; none where the table was not begun."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    # A row per run.
    batches = [r["batch"] for r in spark.read.schema("batch string").parquet(f"{path}/{MANIFEST}").collect()]
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/batch-{b}" for b in sorted(batches)))


def resume_append(
    source: DataFrame, path: str, keys: Sequence[str], extract: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run ``extract`` over the rows of ``source`` whose key has no results yet, and publish what it returns.

    ``extract`` keeps the key columns and may return several rows per key, which come into the table
    together or not at all. A run after one that failed begins with all keys that have nothing published. Returns
    the table. Rows in the folder that came there in another way do not count; ``publish_batch`` takes them in.
    """
    spark = source.sparkSession
    schema = extract(source).schema
    rows = extract(remaining(source, published(spark, path, schema), keys))
    publish_batch(rows, path)
    return published(spark, path, schema)


def write_sequences(sequences: DataFrame, path: str, mode: str = "error") -> None:
    """Sequences keep their steps as an array of structs, so nulls stay in place."""
    sequences.write.mode(mode).parquet(path)
