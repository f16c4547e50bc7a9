"""Nearest-in-time, nearest-cell and nearest-point lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.functions.dates import micros, month_start
from rillspark.operators.chunks import in_chunks
from rillspark.session import durable

TIES = ("earlier", "later")


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_id: str,
    chunks: int | None = None,
    tie: str = "earlier",
) -> DataFrame:
    """For each left row, the right row of the same key that is closest in time.

    ``tie`` says which of two equally distant rows wins; among right rows of one instant the
    smallest ``right_id`` does, which is unique there. A left row without any partner gets NULLs.

    The search itself sees only distinct (key, instant) pairs of both sides, cut into chunks of about
    equal size (``chunks`` says how many): windows run over (key, chunk), and the closest instants
    of other chunks come from a summary with one row per key and chunk. So a key that holds a large share of the
    data spreads over many tasks.
    """
    if tie not in TIES:
        raise ValueError(f"tie must be one of {TIES}")
    keys = list(keys)
    payload = [c for c in right.columns if c not in keys]
    clash = set(payload) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")

    def instants(df: DataFrame, ts: str, wanted: bool, found) -> DataFrame:
        return df.filter(F.col(ts).isNotNull()).select(
            *keys, micros(F.col(ts)).alias("_us"), F.lit(wanted).alias("_wanted"),
            F.lit(not wanted).alias("_seen"), found.alias("_id"),
        )

    id_type = right.schema[right_id].dataType
    both = (
        instants(left, left_ts, True, F.lit(None).cast(id_type))
        .unionByName(instants(right, right_ts, False, F.col(right_id)))
        .dropna(subset=keys)
        .groupBy(*keys, "_us")
        .agg(
            F.bool_or("_wanted").alias("_wanted"),
            F.bool_or("_seen").alias("_seen"),
            F.min("_id").alias("_id"),
        )
    )
    cut = in_chunks(both, [*keys, "_us"], chunks)
    seen_us = F.when(F.col("_seen"), F.col("_us"))
    seen = F.when(F.col("_seen"), F.struct("_us", "_id"))
    part = Window.partitionBy(*keys, "_chunk")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    asc = part.orderBy(F.col("_us").asc()).rowsBetween(*so_far)
    desc = part.orderBy(F.col("_us").desc()).rowsBetween(*so_far)
    local = cut.select(
        *keys, "_chunk", "_us", "_wanted",
        F.last(seen, ignorenulls=True).over(asc).alias("_before"),
        F.last(seen, ignorenulls=True).over(desc).alias("_after"),
    ).filter("_wanted")

    borders = cut.groupBy(*keys, "_chunk").agg(
        F.bool_or("_wanted").alias("_wanted"),
        F.min(seen_us).alias("_first_us"), F.min_by("_id", seen_us).alias("_first_id"),
        F.max(seen_us).alias("_last_us"), F.max_by("_id", seen_us).alias("_last_id"),
    )
    series = Window.partitionBy(*keys)
    earlier = series.orderBy(F.col("_chunk").asc()).rowsBetween(Window.unboundedPreceding, -1)
    later = series.orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)

    def end(side: str):
        us, rid = F.col(f"_{side}_us"), F.col(f"_{side}_id")
        return F.when(us.isNotNull(), F.struct(us.alias("_us"), rid.alias("_id")))

    carried = borders.select(
        *keys, "_chunk", "_wanted",
        F.last(end("last"), ignorenulls=True).over(earlier).alias("_carry_before"),
        F.last(end("first"), ignorenulls=True).over(later).alias("_carry_after"),
    ).filter("_wanted").drop("_wanted")
    before = F.coalesce("_before", "_carry_before")
    after = F.coalesce("_after", "_carry_after")
    to_before, to_after = F.col("_us") - before["_us"], after["_us"] - F.col("_us")
    closer = to_before <= to_after if tie == "earlier" else to_before < to_after
    found = local.join(carried, [*keys, "_chunk"]).select(
        *keys, "_us", F.when(after.isNull() | closer, before).otherwise(after).alias("_hit")
    )
    hits = found.select(*keys, "_us", F.col("_hit._us").alias("_hit_us"),
                        F.col("_hit._id").alias("_hit_id")).dropna(subset=["_hit_us"])
    if set(payload) <= {right_ts, right_id}:
        instant = F.timestamp_micros("_hit_us").cast(right.schema[right_ts].dataType)
        known = {right_ts: instant, right_id: F.col("_hit_id")}
        matched = hits.select(*keys, "_us", *(known[c].alias(c) for c in payload))
    else:
        matched = hits.join(
            right.withColumns({"_hit_us": micros(F.col(right_ts)), "_hit_id": F.col(right_id)}),
            [*keys, "_hit_us", "_hit_id"],
        ).select(*keys, "_us", *payload)
    return (
        left.withColumn("_us", micros(F.col(left_ts)))
        .join(matched, [*keys, "_us"], "left")
        .select(*left.columns, *payload)
    )


@dataclass(frozen=True)
class Axis:
    """A regular axis: value of index 0, step (negative for a falling axis), number of cells."""

    origin: float
    step: float
    size: int

    def index(self, x: Column) -> Column:
        """Nearest index; halfway goes to the larger one; beyond the ends, the end."""
        at = F.floor((x - F.lit(self.origin)) / F.lit(self.step) + F.lit(0.5))
        return F.greatest(F.lit(0), F.least(at, F.lit(self.size - 1))).cast("int")


def nearest_month(d: Column, first: str, last: str) -> Column:
    """Closest month start; halfway goes to the later one; beyond the ends, the end."""
    this = month_start(d)
    following = F.add_months(this, 1)
    nearest = F.when(F.datediff(d, this) < F.datediff(following, d), this).otherwise(following)
    low, high = (F.lit(v).cast("date") for v in (first, last))
    return F.when(d.isNotNull(), F.greatest(low, F.least(nearest, high)))


def nearest_grid_cell(
    samples: DataFrame,
    cube: DataFrame,
    variables: Sequence[str],
    lat_axis: Axis,
    lon_axis: Axis,
    months: tuple[str, str],
    date: str = "d",
    coords: tuple[str, str] = ("lat", "lon"),
    cube_axes: tuple[str, str, str] = ("t", "lat", "lon"),
) -> DataFrame:
    """Value of a regular monthly cube at the nearest cell and the nearest month.

    The position on each axis is arithmetic, so the lookup is an equality join on three small
    integers and a date.
    """
    t, y, x = cube_axes
    cells = cube.select(
        lat_axis.index(F.col(y)).alias("_i"),
        lon_axis.index(F.col(x)).alias("_j"),
        F.col(t).alias("_t"),
        *variables,
    )
    placed = samples.withColumns(
        {
            "_i": lat_axis.index(F.col(coords[0])),
            "_j": lon_axis.index(F.col(coords[1])),
            "_t": nearest_month(F.col(date), *months),
        }
    )
    return placed.join(cells, ["_i", "_j", "_t"], "left").select(*samples.columns, *variables)


# --- nearest of arbitrary points -------------------------------------------------------------

START_LEVEL = 3  # 8 x 8 cells: at most 64 of them travel with every place
LEVELS_PER_STEP = 2
DEEPEST_LEVEL = 24


def _square(x: Column) -> Column:
    return x * x


def _gap(x: Column, low: Column, high: Column) -> Column:
    """Distance along one axis from x to an interval; 0 inside."""
    return F.greatest(low - x, x - high, F.lit(0.0))


def _reach(x: Column, low: Column, high: Column) -> Column:
    """Distance along one axis from x to the far end of an interval."""
    return F.greatest(F.abs(x - low), F.abs(high - x))


def _nearest_possible(y: Column, x: Column, box: Column) -> Column:
    return _square(_gap(y, box["s"], box["n"])) + _square(_gap(x, box["w"], box["e"]))


def _farthest_possible(y: Column, x: Column, box: Column) -> Column:
    return _square(_reach(y, box["s"], box["n"])) + _square(_reach(x, box["w"], box["e"]))


def nearest_point(
    places: DataFrame,
    points: DataFrame,
    place_cols: tuple[str, str] = ("lat", "lon"),
    point_cols: tuple[str, str] = ("plat", "plon"),
    leaf_rows: int = 32,
) -> DataFrame:
    """For each place the closest point, by Euclidean distance of coordinates in radians.

    The points are arranged in a pyramid of halving cells, each with the tight box of its points,
    deep enough that a leaf cell holds at most ``leaf_rows`` distinct points. Every place starts
    from the occupied cells of a coarse level (64 at most) and goes down two levels at a
    time, keeping only the cells that may still hold its nearest point: those whose closest corner
    is no farther than the farthest corner of the best one. Dense areas therefore get deep cells
    and no place meets all points of a crowded neighbourhood. Ties go to the smaller coordinates.

    Adds the two point columns and ``distance``.
    """
    lat, lon = place_cols
    plat, plon = point_cols
    unique = durable(
        points.select(plat, plon)
        .filter(F.col(plat).isNotNull() & F.col(plon).isNotNull())
        .distinct()
        .withColumns({"_py": F.radians(plat), "_px": F.radians(plon)})
    )
    edge = unique.agg(
        F.min("_py").alias("y0"), F.min("_px").alias("x0"),
        F.greatest(F.max("_py") - F.min("_py"), F.max("_px") - F.min("_px")).alias("side"),
    ).first()
    side = edge["side"] or 1.0  # no points, or all in one spot

    def at_level(level: int) -> tuple[Column, Column]:
        cells = 2**level
        return tuple(
            F.least(F.floor((F.col(c) - F.lit(o)) / F.lit(side) * cells), F.lit(cells - 1))
            for c, o in (("_py", edge["y0"]), ("_px", edge["x0"]))
        ) if edge["side"] is not None else (F.lit(0), F.lit(0))

    candidates = list(range(START_LEVEL, DEEPEST_LEVEL + 1, LEVELS_PER_STEP))
    cells = F.array(
        *(
            F.struct(F.lit(n).alias("level"), iy.alias("iy"), ix.alias("ix"))
            for n, (iy, ix) in ((n, at_level(n)) for n in candidates)
        )
    )
    fullest = dict(
        unique.select(F.inline(cells)).groupBy("level", "iy", "ix").count()
        .groupBy("level").agg(F.max("count")).collect()
    )
    deep_enough = [n for n in candidates if fullest.get(n, 0) <= leaf_rows]
    deepest = deep_enough[0] if deep_enough else DEEPEST_LEVEL
    levels = [n for n in candidates if n <= deepest]

    def cells_of(level: int) -> DataFrame:
        iy, ix = at_level(level)
        return unique.groupBy(iy.alias("_iy"), ix.alias("_ix")).agg(
            F.struct(
                F.min("_py").alias("s"), F.max("_py").alias("n"),
                F.min("_px").alias("w"), F.max("_px").alias("e"),
            ).alias("_box")
        )

    asked = (
        places.select(lat, lon)
        .filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .distinct()
        .withColumns({"_y": F.radians(lat), "_x": F.radians(lon)})
    )
    y, x = F.col("_y"), F.col("_x")
    start = cells_of(levels[0]).agg(F.collect_list(F.struct("_iy", "_ix", "_box"))).scalar()
    found = (
        asked.withColumn("_start", start)
        .withColumn(
            "_best",
            F.array_min(F.transform("_start", lambda c: _farthest_possible(y, x, c["_box"]))),
        )
        .withColumn(
            "_cell",
            F.explode(
                F.filter(
                    "_start", lambda c: _nearest_possible(y, x, c["_box"]) <= F.col("_best")
                )
            ),
        )
        .select(lat, lon, "_y", "_x", "_cell._iy", "_cell._ix")
    )
    of_place = Window.partitionBy(lat, lon)
    for level in levels[1:]:
        shrink = 2**LEVELS_PER_STEP
        children = cells_of(level).select(
            F.floor(F.col("_iy") / shrink).alias("_iy"),
            F.floor(F.col("_ix") / shrink).alias("_ix"),
            F.col("_iy").alias("_ciy"), F.col("_ix").alias("_cix"), "_box",
        )
        box = F.col("_box")
        found = (
            found.join(children, ["_iy", "_ix"])
            .withColumn("_best", F.min(_farthest_possible(y, x, box)).over(of_place))
            .filter(_nearest_possible(y, x, box) <= F.col("_best"))
            .select(lat, lon, "_y", "_x", F.col("_ciy").alias("_iy"), F.col("_cix").alias("_ix"))
        )
    iy, ix = at_level(levels[-1])
    leaves = unique.select(plat, plon, "_py", "_px", iy.alias("_iy"), ix.alias("_ix"))
    squared = _square(y - F.col("_py")) + _square(x - F.col("_px"))
    winners = (
        found.join(leaves, ["_iy", "_ix"])
        .groupBy(lat, lon)
        .agg(F.min(F.struct(squared.alias("d2"), F.col(plat), F.col(plon))).alias("_win"))
        .select(lat, lon, f"_win.{plat}", f"_win.{plon}", F.sqrt("_win.d2").alias("distance"))
    )
    return places.join(durable(winners), [lat, lon], "left").select(
        *places.columns, plat, plon, "distance"
    )


def nearest_point_and_time(
    samples: DataFrame,
    climate: DataFrame,
    variables: Sequence[str],
    date: str,
    climate_date: str,
    place_cols: tuple[str, str] = ("lat", "lon"),
    point_cols: tuple[str, str] = ("plat", "plon"),
    chunks: int | None = None,
) -> DataFrame:
    """Value of the nearest point at its nearest time; of two equal times the earlier.

    Of several climate rows of one point and time the one with the smallest values, compared in
    the order of ``variables``, counts. Rows without a time are no match.
    """
    placed = nearest_point(samples, climate, place_cols, point_cols)
    series = (
        climate.filter(F.col(climate_date).isNotNull())
        .groupBy(*point_cols, climate_date)
        .agg(F.min(F.struct(*variables)).alias("_one"))
        .select(*point_cols, climate_date, *(F.col(f"_one.{v}").alias(v) for v in variables))
    )
    return nearest_in_time(
        placed, series, point_cols, date, climate_date, right_id=climate_date, chunks=chunks
    )
