"""Rolling-origin forecasts of the last observations of each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators.series import hold_out_last, resample_mean

# Weights of the newest error in level and season that are tried for each series.
LEVEL_WEIGHTS = (0.1, 0.3, 0.5, 0.8)
SEASON_WEIGHTS = (0.0, 0.1, 0.3)


def last_value_forecast(
    df: DataFrame, series: Sequence[str], order: Sequence[str], target: str, h: int = 1
) -> DataFrame:
    """Hold out the last h observations of each series and forecast them by the last value known
    before. A series without earlier values gets no forecast."""
    marked = hold_out_last(df, series, order, h)
    known = F.when(
        (F.col("split") == "train") & F.col(target).isNotNull(), F.struct(*order)
    )
    last = marked.groupBy(*series).agg(F.max_by(target, known).alias("prediction"))
    return (
        marked.filter(F.col("split") == "test")
        .join(last, list(series), "left")
        .withColumnRenamed(target, "y")
        .drop("split")
    )


def seasonal_forecast(
    df: DataFrame, series: Sequence[str], order: Sequence[str], target: str, season: Column, h: int = 1
) -> DataFrame:
    """Hold out the last h observations of each series and forecast each by the last value known before
    in the same season (a weekday, a month), else by the last value known at all.

    ``season`` is an expression over the columns; a missing season is one of its own. Adds prediction and
    whether it is ``seasonal``. Both lookups come from one aggregate with a row per series and season,
    which combines before the shuffle, so a long series stays in no single task.
    """
    marked = hold_out_last(df, series, order, h).withColumn("_season", season)
    position = F.when((F.col("split") == "train") & F.col(target).isNotNull(), F.struct(*order))
    seasons = marked.groupBy(*series, "_season").agg(
        F.max_by(target, position).alias("_own"), F.max(position).alias("_at")
    )
    last = seasons.groupBy(*series).agg(
        F.max_by("_own", "_at").alias("_last"),
        F.collect_list(F.when(F.col("_own").isNotNull(), F.struct("_season", "_own"))).alias("_seasons"),
    )
    hit = F.filter("_seasons", lambda s: s["_season"].eqNullSafe(F.col("_season")))
    own = F.get(hit, F.lit(0))["_own"]
    return (
        marked.filter("split = 'test'")
        .join(last, list(series), "left")
        .withColumn("prediction", F.coalesce(own, "_last"))
        .withColumn("seasonal", own.isNotNull())
        .withColumnRenamed(target, "y")
        .drop("split", "_season", "_last", "_seasons")
    )


def _smoothed(values: Column, season: int, alpha: Column, gamma: Column) -> Column:
    """State of additive exponential smoothing after an array of values.

    (lost: squared one-step errors, at: next position, level, seasons). The first known value sets
    the level; missing values change nothing.
    """
    start = F.struct(
        F.lit(0.0).alias("lost"), F.lit(0).alias("at"), F.lit(None).cast("double").alias("level"),
        F.array_repeat(F.lit(0.0), season).alias("seasons"),
    )

    def step(state: Column, value: Column) -> Column:
        phase, level, seasons = state["at"] % season, state["level"], state["seasons"]
        error = value - (level + F.get(seasons, phase))
        learns = value.isNotNull() & level.isNotNull()
        turned = F.transform(
            seasons, lambda s, j: F.when(j == phase, s + gamma * error).otherwise(s)
        )
        return F.struct(
            F.when(learns, state["lost"] + error * error).otherwise(state["lost"]).alias("lost"),
            (state["at"] + 1).alias("at"),
            F.when(learns, level + alpha * error).otherwise(F.coalesce(level, value)).alias("level"),
            F.when(learns, turned).otherwise(seasons).alias("seasons"),
        )

    return F.aggregate(values, start, step)


def rolling_forecasts(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    target: str,
    step: str = "day",
    season: int = 7,
    h: int = 1,
    origins: int = 1,
    level_weights: Sequence[float] = LEVEL_WEIGHTS,
    season_weights: Sequence[float] = SEASON_WEIGHTS,
) -> DataFrame:
    """Forecasts of the next h steps from each of the last origins of every resampled series.

    Origin o ends the training part h + o steps before the end of the series; series too short for
    an origin have none. Three forecasts stand side by side: ``last`` known value; ``seasonal``, the
    last known one a whole number of seasons before, else ``last``; and ``smoothed``, exponential
    smoothing with an additive season, whose two weights are those of the tried ones with the least
    squared one-step errors on the training part (of equal ones the smaller). NaN counts as
    missing; without a known value the forecasts are NULL.

    A series is one array with an element per step of the calendar, whatever its number of
    observations; origins and weights are worked out inside its row.
    """
    value = F.when(~F.isnan(target), F.col(target).cast("double"))
    regular = resample_mean(df.withColumn(target, value), series, time, [target], step)
    arrays = regular.groupBy(*series).agg(
        F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(target).alias("v")))).alias("_s")
    )
    cut = F.size("_s") - h - F.col("origin")
    at_origin = (
        arrays.withColumn("origin", F.explode(F.sequence(F.lit(0), F.lit(origins - 1))))
        .withColumn("_cut", cut)
        .filter("_cut >= 1")
        .withColumn("_v", F.transform(F.slice("_s", F.lit(1), F.col("_cut")), lambda x: x["v"]))
    )
    tried = F.array(*(
        F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(g)).alias("gamma"))
        for a in sorted(level_weights) for g in sorted(season_weights)
    ))

    def fitted(weights: Column) -> Column:
        state = _smoothed(F.col("_v"), season, weights["alpha"], weights["gamma"])
        return F.struct(
            state["lost"].alias("lost"), weights["alpha"].alias("alpha"), weights["gamma"].alias("gamma"),
            state["level"].alias("level"), state["seasons"].alias("seasons"),
        )

    known = F.filter(
        F.transform("_v", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda x: x["v"].isNotNull()
    )
    fits = at_origin.withColumns(
        {"_fit": F.array_min(F.transform(tried, fitted)), "_known": known}
    ).drop("_v")
    place = F.col("_cut") + F.col("step") - 1
    ahead = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h)))).withColumns({
        "_now": F.get("_s", place),
        "_alike": F.filter("_known", lambda x: (place - x["i"]) % season == 0),
    })
    last = F.element_at(F.col("_known"), -1)["v"]
    return ahead.select(
        *series, "origin", "step", F.col("_now.t").alias(time), F.col("_now.v").alias("y"),
        F.when(F.size("_known") > 0, last).alias("last"),
        F.when(F.size("_alike") > 0, F.element_at("_alike", -1)["v"])
        .when(F.size("_known") > 0, last).alias("seasonal"),
        (F.col("_fit.level") + F.get("_fit.seasons", place % season)).alias("smoothed"),
        F.col("_fit.alpha").alias("alpha"), F.col("_fit.gamma").alias("gamma"),
    )


def compare_forecasts(made: dict[str, DataFrame], metrics) -> DataFrame:
    """Metrics of several forecasts of the same observations, one row per name."""
    rows = [metrics(df).withColumn("forecast", F.lit(name)) for name, df in made.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out
