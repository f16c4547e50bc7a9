"""Resumable extraction over a folder that keeps growing (the incremental form of S6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    sink: str,
    progress: str,
    transform: Callable[[DataFrame], DataFrame],
    files_per_batch: int | None = None,
) -> None:
    """Apply a row-wise ``transform`` to the parquet files not seen before and append the outcome.

    The progress folder records which files are done and the sink which batches are committed,
    so a run that is cut short goes on where it stopped and writes nothing twice.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    (
        transform(reader.parquet(source))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
