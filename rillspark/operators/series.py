"""Time-series operators.

Two kinds of series occur. Resampled or gridded ones hold one row per step, so a group is bounded
by the calendar and a plain window per series is enough. Raw observations have no such bound:
there, windows run over (series, chunk) and what crosses a chunk border is carried in a
summary with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.operators.chunks import in_chunks

# step name -> (truncation unit, interval between steps)
STEPS = {
    "day": ("day", "interval 1 day"),
    "week": ("week", "interval 7 days"),
    "month": ("month", "interval 1 month"),
    "year": ("year", "interval 1 year"),
}


def rolling(
    df: DataFrame,
    series: Sequence[str],
    order: str,
    recipes: Mapping[str, tuple[str, str, int]],
) -> DataFrame:
    """Trailing windows over a gridded series: name -> (column, "sum" or "mean", length).

    NULL until the window is full, and wherever a value inside it is missing. All recipes share
    one shuffle and one sort.
    """
    by_series = Window.partitionBy(*series).orderBy(order)
    functions = {"sum": F.sum, "mean": F.avg}
    made = {}
    for name, (column, how, length) in recipes.items():
        frame = by_series.rowsBetween(1 - length, 0)
        made[name] = F.when(F.count(column).over(frame) == length, functions[how](column).over(frame))
    return df.withColumns(made)


def resample_mean(
    df: DataFrame, series: Sequence[str], time: str, values: Sequence[str], step: str = "month"
) -> DataFrame:
    """Mean per step from the first to the last step of each series; empty steps are NULL."""
    unit, interval = STEPS[step]
    at = F.date_trunc(unit, F.col(time)).cast("date")
    means = df.groupBy(*series, at.alias(time)).agg(*(F.avg(v).alias(v) for v in values))
    spine = (
        means.groupBy(*series)
        .agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
        .select(*series, F.explode(F.sequence("_from", "_to", F.expr(interval))).alias(time))
    )
    return spine.join(means, [*series, time], "left")


def interpolate(
    df: DataFrame, series: Sequence[str], time: str, values: Sequence[str], fill: bool = True
) -> DataFrame:
    """Linear interpolation by position in a resampled series.

    After the last value it is carried on. Before the first one nothing is filled, unless ``fill``
    carries it back.
    """
    asc = Window.partitionBy(*series).orderBy(F.col(time).asc())
    desc = Window.partitionBy(*series).orderBy(F.col(time).desc())
    so_far = (Window.unboundedPreceding, Window.currentRow)
    placed = df.withColumn("_pos", F.row_number().over(asc))
    known = {
        v: F.when(F.col(v).isNotNull(), F.struct(F.col("_pos").alias("at"), F.col(v).alias("x")))
        for v in values
    }
    before = {f"_b_{v}": F.last(known[v], True).over(asc.rowsBetween(*so_far)) for v in values}
    after = {f"_a_{v}": F.last(known[v], True).over(desc.rowsBetween(*so_far)) for v in values}
    ends = placed.withColumns(before).withColumns(after)

    def value(v: str) -> Column:
        b, a = F.col(f"_b_{v}"), F.col(f"_a_{v}")
        part = (F.col("_pos") - b["at"]).cast("double") / F.nullif(a["at"] - b["at"], F.lit(0))
        between = b["x"] + (a["x"] - b["x"]) * part
        ordered = [F.col(v), between, b["x"]] + ([a["x"]] if fill else [])
        return F.coalesce(*ordered)

    return ends.select(*(value(c).alias(c) if c in values else F.col(c) for c in df.columns))


def fill_forward_back(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    chunks: int | None = None,
) -> DataFrame:
    """Fill gaps of raw observations with the last value before, else the first one after.

    ``order`` must be a total order within a series. Rows are cut into chunks of about equal size
    (``chunks`` says how many), so that a long series spreads over many tasks, however dense it is.
    """
    series, order, values = list(series), list(order), list(values)
    cut = in_chunks(df, [*series, *order], chunks)
    part = Window.partitionBy(*series, "_chunk")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    asc = part.orderBy(*(F.col(o).asc() for o in order)).rowsBetween(*so_far)
    desc = part.orderBy(*(F.col(o).desc() for o in order)).rowsBetween(*so_far)
    position = F.struct(*order)
    ends = {}
    for v in values:
        known = F.when(F.col(v).isNotNull(), position)
        ends[f"_first_{v}"] = F.min_by(v, known)
        ends[f"_last_{v}"] = F.max_by(v, known)
    borders = cut.groupBy(*series, "_chunk").agg(*(x.alias(name) for name, x in ends.items()))
    earlier = Window.partitionBy(*series).orderBy(F.col("_chunk").asc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    later = Window.partitionBy(*series).orderBy(F.col("_chunk").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = borders.select(
        *series,
        "_chunk",
        *(F.last(f"_last_{v}", True).over(earlier).alias(f"_prev_{v}") for v in values),
        *(F.last(f"_first_{v}", True).over(later).alias(f"_next_{v}") for v in values),
    )
    local = cut.withColumns(
        {f"_fwd_{v}": F.last(v, True).over(asc) for v in values}
    ).withColumns({f"_back_{v}": F.last(v, True).over(desc) for v in values})
    # A missing series or time is a key like any other.
    keys = [*series, "_chunk"]
    renamed = carried.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    filled = local.join(renamed, same, "left")
    return filled.select(
        *(
            F.coalesce(f"_fwd_{c}", f"_prev_{c}", f"_back_{c}", f"_next_{c}").alias(c)
            if c in values
            else F.col(c)
            for c in df.columns
        )
    )


def sequences(
    df: DataFrame, series: Sequence[str], time: str, features: Sequence[str], target: str, length: int
) -> DataFrame:
    """For each step of a resampled series: the ``length`` steps before it, and its target.

    Steps without enough history are left out, and so are series of at most ``length`` steps. The
    history is an array of structs with the target first, so nulls keep their place.
    """
    columns = [target, *(f for f in features if f != target)]
    history = Window.partitionBy(*series).orderBy(time).rowsBetween(-length, -1)
    return (
        df.select(
            *series, time,
            F.collect_list(F.struct(*columns)).over(history).alias("x"),
            F.col(target).alias("y"),
        )
        .filter(F.size("x") == length)
    )


def hold_out_last(
    df: DataFrame, series: Sequence[str], order: Sequence[str], h: int
) -> DataFrame:
    """Mark the last h observations of each series as "test", all others as "train".

    Spark keeps at most h rows per series in each map task before the shuffle; their earliest
    one is the cut of the series.
    """
    position = F.struct(*order)
    newest = Window.partitionBy(*series).orderBy(*(F.col(o).desc() for o in order))
    cuts = (
        df.select(*series, *order)
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= h)
        .groupBy(*series)
        .agg(F.min(position).alias("_cut"))
    )
    return (
        df.join(cuts, list(series), "left")
        .withColumn("split", F.when(position >= F.col("_cut"), "test").otherwise("train"))
        .drop("_cut")
    )


def sort_series(df: DataFrame, series: Sequence[str], time: Sequence[str]) -> DataFrame:
    """Sort by series and time. The range shuffle also cuts a long series between tasks."""
    return df.orderBy(*series, *time)
