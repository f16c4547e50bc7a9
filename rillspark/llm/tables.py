"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillspark.session import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python tasks a few megabytes at a time; a worker holds several such batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def packed(docs: DataFrame, *needed: str | Column) -> DataFrame:
    """The whole row as ``_doc`` beside the columns that are worked on, so that no name clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *needed)


def digest_number(*parts: Column, digits: int = 13) -> Column:
    """A number below 16**digits from the md5 of the parts; a missing part counts as ``~``.

    The same in any engine that has md5, and independent of partitions and of reruns.
    """
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def digest_fraction(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    return digest_number(*parts) / F.lit(float(16**13))


def one_row_per_copy(df: DataFrame, copies: str, copy: str, block: int = 4096) -> DataFrame:
    """As many rows as the column ``copies`` says, told apart by ``copy`` from 0.

    More than a block of copies are first cut into blocks, which then spread over tasks.
    """

    def rows(few: DataFrame, first: Column, behind: Column) -> DataFrame:
        return few.withColumn(copy, F.explode(F.sequence(first, behind - 1))).drop(copies)

    n, zero = F.col(copies), F.lit(0).cast("long")
    start = f"{copy}_block"
    many = df.filter(n > block).withColumn(start, F.explode(F.sequence(zero, n - 1, F.lit(block).cast("long"))))
    many = rows(many.repartition(*df.columns, start), F.col(start), F.least(F.col(start) + block, n)).drop(start)
    return rows(df.filter((n > 0) & (n <= block)), zero, n).unionByName(many)


def told_apart(df: DataFrame, columns: Sequence[str], copy: str) -> DataFrame:
    """The given columns of each row, with equal rows numbered from 0 in ``copy``.

    Equal rows combine before the shuffle, so that a row repeated without end stays cheap.
    """
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    # Written down, as crowded and other records are read apart.
    return one_row_per_copy(durable(counted), "_copies", copy)


def mapped(
    docs: DataFrame,
    work: Callable[[pa.StructArray, pa.RecordBatch], list[pa.Array]],
    added: StructType,
    **extras: Column,
) -> DataFrame:
    """The rows with columns that ``work`` makes of an Arrow batch of them, whatever their names.

    ``work`` gets the rows as one struct array, and the batch with the ``extras`` that it asks for;
    it returns an array per field of ``added``. Existing columns of those names are replaced.
    """
    small_batches(docs.sparkSession)
    names = added.names
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    rows = packed(kept, *[c.alias(n) for n, c in extras.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch["_doc"], batch)
            yield pa.RecordBatch.from_arrays([batch["_doc"], *made], names=["_doc", *names])

    schema = StructType([rows.schema["_doc"], *added.fields])
    return rows.mapInArrow(run, schema).select("_doc.*", *names)


def text_slices(texts: pa.Array, most_bytes: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes of text; a longer text makes a range of its own."""
    start = size = 0
    for row, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if row > start and size + (n or 0) > most_bytes:
            yield start, row
            start, size = row, 0
        size += n or 0
    if start < len(texts):
        yield start, len(texts)
