"""Cutting series into chunks of about equal size.

A window over a whole series puts all its rows into one task. Operators on raw observations therefore
window over (series, chunk) and carry what crosses a border in a summary with one row per series and chunk.
Borders are those of a sort over ranges of (series, order): a dense series, or a dense second of one, is cut as
often as it has tasks' worth of rows, a sparse one lies within a task and is cut at most where the task ends. So there
are no more summaries than series and tasks together, and no series has more than there are tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.session import durable


def in_chunks(
    df: DataFrame, order: Sequence[Column | str], chunks: int | None = None, name: str = "_chunk"
) -> DataFrame:
    """The rows, written down, with the number of their chunk; numbers rise along ``order``.

    ``order`` starts with the series and should be total, as equal rows stay together. Without ``chunks`` there
    are as many as the session has shuffle partitions, less what adaptive execution merges.
    """
    number = () if chunks is None else (chunks,)
    ranged = df.repartitionByRange(*number, *order)
    # Written once: borders come from a sample and would not be the same in another run.
    return durable(ranged.withColumn(name, F.spark_partition_id()))
