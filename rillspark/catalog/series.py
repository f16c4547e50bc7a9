"""Time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.catalog import query
from rillspark.catalog.joins import ROLLED_SQL
from rillspark.operators import forecast, metrics, series
from rillspark.plans import evaluation, enrichment

DAILY_SQL = """
    means as (select loc, cast(date_trunc('day', ts) as date) as ts, avg(value) as value,
                     avg(flow) as flow from obs group by 1, 2),
    spine as (select loc, cast(unnest(generate_series(cast(min(ts) as timestamp),
                     cast(max(ts) as timestamp), interval 1 day)) as date) as ts
              from means group by loc),
    daily as (select s.loc, s.ts, m.value, m.flow from spine s
              left join means m on m.loc = s.loc and m.ts = s.ts)"""


def _filled(c: str) -> str:
    return f"""coalesce({c}, b_{c} + (a_{c} - b_{c}) * (pos - bp_{c}) / nullif(ap_{c} - bp_{c}, 0), b_{c})"""


def _ends(c: str) -> str:
    return f"""
        last_value({c} ignore nulls) over up as b_{c},
        last_value(case when {c} is not null then pos end ignore nulls) over up as bp_{c},
        first_value({c} ignore nulls) over down as a_{c},
        first_value(case when {c} is not null then pos end ignore nulls) over down as ap_{c}"""


INTERPOLATED_SQL = f"""{DAILY_SQL},
    placed as (select *, row_number() over (partition by loc order by ts) as pos from daily),
    ended as (select *, {_ends('value')}, {_ends('flow')} from placed
              window up as (partition by loc order by ts rows between unbounded preceding and current row),
                     down as (partition by loc order by ts rows between current row and unbounded following)),
    interpolated as (select loc, ts, pos, {_filled('value')} as value, {_filled('flow')} as flow,
                            a_value, a_flow from ended),
    regular as (select loc, ts, pos, coalesce(value, a_value) as value, coalesce(flow, a_flow) as flow
                from interpolated)"""


def _daily(v):
    return series.resample_mean(v.obs(), ["loc"], "ts", ["value", "flow"], "day")


def _rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "w1_rolling_sum",
    f"with {ROLLED_SQL} select cell, t, ppt_3mo, ppt_6mo from rolled",
)
def w1(v):
    rolled = series.rolling(v.grid(), ["cell"], "t", enrichment.ANTECEDENT)
    return rolled.select("cell", "t", "ppt_3mo", "ppt_6mo")


@query(
    "w2_rolling_mean", f"with {ROLLED_SQL} select cell, t, round(tmax_3mo, 6) as tmax_3mo from rolled"
)
def w2(v):
    rolled = series.rolling(v.grid(), ["cell"], "t", enrichment.ANTECEDENT)
    return _rounded(rolled.select("cell", "t", "tmax_3mo"), ["tmax_3mo"])


@query(
    "a5_resample_day",
    f"with {DAILY_SQL} select loc, ts, round(value, 9) as value, round(flow, 9) as flow from daily",
)
def a5(v):
    return _rounded(_daily(v), ["value", "flow"], 9)


@query(
    "a5_resample_month",
    """with means as (select site, cast(date_trunc('month', d) as date) as d, avg(ta) as ta,
                             avg(ec) as ec from samples group by 1, 2),
       spine as (select site, cast(unnest(generate_series(cast(min(d) as timestamp),
                        cast(max(d) as timestamp), interval 1 month)) as date) as d
                 from means group by site)
       select s.site, s.d, round(m.ta, 6) as ta, round(m.ec, 6) as ec from spine s
       left join means m on m.site = s.site and m.d = s.d""",
)
def a5_month(v):
    monthly = series.resample_mean(v.samples(), ["site"], "d", ["ta", "ec"], "month")
    return _rounded(monthly, ["ta", "ec"])


@query(
    "w3_interpolate",
    f"""with {INTERPOLATED_SQL} select loc, ts, round(value, 9) as value, round(flow, 9) as flow
        from interpolated""",
)
def w3(v):
    regular = series.interpolate(_daily(v), ["loc"], "ts", ["value", "flow"], fill=False)
    return _rounded(regular, ["value", "flow"], 9)


@query(
    "w3_w4_interpolate_and_fill",
    f"""with {INTERPOLATED_SQL} select loc, ts, round(value, 9) as value, round(flow, 9) as flow
        from regular""",
)
def w3_w4(v):
    regular = series.interpolate(_daily(v), ["loc"], "ts", ["value", "flow"])
    return _rounded(regular, ["value", "flow"], 9)


@query(
    "w4_fill_forward_back",
    """select obs_id, loc, ts,
          coalesce(last_value(value ignore nulls) over up, first_value(value ignore nulls) over down) as value,
          coalesce(last_value(flow ignore nulls) over up, first_value(flow ignore nulls) over down) as flow
       from obs
       window up as (partition by loc order by ts, obs_id rows between unbounded preceding and current row),
              down as (partition by loc order by ts, obs_id rows between current row and unbounded following)""",
)
def w4(v):
    obs = v.obs().select("obs_id", "loc", "ts", "value", "flow")
    return series.fill_forward_back(obs, ["loc"], ["ts", "obs_id"], ["value", "flow"])


@query(
    "forecasting_frame",
    """select cast(loc as varchar) as unique_id, ts as ds,
          coalesce(last_value(value ignore nulls) over up, first_value(value ignore nulls) over down) as y,
          coalesce(last_value(flow ignore nulls) over up, first_value(flow ignore nulls) over down) as flow
       from obs
       window up as (partition by loc order by ts, obs_id rows between unbounded preceding and current row),
              down as (partition by loc order by ts, obs_id rows between current row and unbounded following)""",
)
def forecasting(v):
    return evaluation.forecasting_frame(v.obs(), "loc", "ts", "value", "obs_id", ["flow"])


@query(
    "w5_sequences",
    f"""with {INTERPOLATED_SQL}
        select * from (
          select loc, ts, round(lag(value, 3) over w, 9) as value_lag3,
                 round(lag(value, 2) over w, 9) as value_lag2, round(lag(value, 1) over w, 9) as value_lag1,
                 round(lag(flow, 3) over w, 9) as flow_lag3, round(lag(flow, 1) over w, 9) as flow_lag1,
                 round(value, 9) as y, pos
          from regular window w as (partition by loc order by ts))
        where pos > 3""",
)
def w5(v):
    seq = evaluation.monthly_sequences(v.obs(), ["loc"], "ts", ["flow"], "value", 3, "day")
    from pyspark.sql import Window

    x = F.col("x")
    return seq.select(
        "loc", "ts",
        F.round(x[0]["value"], 9).alias("value_lag3"),
        F.round(x[1]["value"], 9).alias("value_lag2"),
        F.round(x[2]["value"], 9).alias("value_lag1"),
        F.round(x[0]["flow"], 9).alias("flow_lag3"),
        F.round(x[2]["flow"], 9).alias("flow_lag1"),
        F.round("y", 9).alias("y"),
        (F.row_number().over(Window.partitionBy("loc").orderBy("ts")) + 3).cast("long").alias("pos"),
    )


@query(
    "w8_hold_out_last",
    """select obs_id, loc, ts, case when row_number() over (partition by loc order by ts desc, obs_id desc) <= 3
              then 'test' else 'train' end as split from obs""",
)
def w8(v):
    return series.hold_out_last(v.obs().select("obs_id", "loc", "ts"), ["loc"], ["ts", "obs_id"], 3)


FORECAST_SQL = """
    ranked as (select *, row_number() over (partition by loc order by ts desc, obs_id desc) as back from obs),
    train as (select loc, last(value order by ts, obs_id) as prediction from ranked
              where back > 1 and value is not null group by loc),
    forecast as (select r.loc, r.obs_id, r.ts, r.value as y, t.prediction from ranked r
                 left join train t on t.loc = r.loc where r.back = 1)"""


def _forecast(v):
    obs = v.obs().select("obs_id", "loc", "ts", "value")
    return forecast.last_value_forecast(obs, ["loc"], ["ts", "obs_id"], "value", 1)


@query("m13_forecast", f"with {FORECAST_SQL} select loc, obs_id, ts, y, prediction from forecast")
def m13(v):
    return _forecast(v)


@query(
    "m13_forecast_metrics",
    f"""with {FORECAST_SQL}
        select count(*) as n,
               round(1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)), 9) as r2,
               round(sqrt(avg((y - prediction) * (y - prediction))), 6) as rmse
        from forecast where y is not null and prediction is not null""",
)
def m13_metrics(v):
    return _rounded(
        metrics.regression_metrics(_forecast(v), []).withColumn("r2", F.round("r2", 9)), ["rmse"]
    )


SEASONAL_SQL = FORECAST_SQL + """,
    weekday as (select loc, dayofweek(ts) as season, last(value order by ts, obs_id) as own from ranked
                where back > 3 and value is not null group by 1, 2),
    level as (select loc, last(value order by ts, obs_id) as last_value from ranked
              where back > 3 and value is not null group by loc),
    seasonal as (select r.loc, r.obs_id, r.ts, r.value as y, coalesce(w.own, t.last_value) as prediction,
                        w.own is not null as seasonal, t.last_value
                 from ranked r left join level t on t.loc = r.loc
                 left join weekday w on w.loc = r.loc and w.season = dayofweek(r.ts) where r.back <= 3)"""


def _by_weekday(v):
    obs = v.obs().select("obs_id", "loc", "ts", "value")
    return forecast.seasonal_forecast(obs, ["loc"], ["ts", "obs_id"], "value", F.dayofweek("ts"), 3)


@query(
    "m13_seasonal_forecast",
    f"with {SEASONAL_SQL} select loc, obs_id, ts, y, prediction, seasonal from seasonal",
)
def m13_seasonal(v):
    return _by_weekday(v)


def _scores_sql(name: str, column: str) -> str:
    error = f"(y - {column}) * (y - {column})"
    return f"""select '{name}' as forecast, count(*) as n,
                      round(1 - sum({error}) / (var_pop(y) * count(*)), 9) as r2, round(sqrt(avg({error})), 6) as rmse
               from seasonal where y is not null and {column} is not null"""


@query(
    "m13_forecast_comparison",
    f"with {SEASONAL_SQL} {_scores_sql('last value', 'last_value')} union all {_scores_sql('weekday', 'prediction')}",
)
def m13_comparison(v):
    obs = v.obs().select("obs_id", "loc", "ts", "value")
    made = {
        "last value": forecast.last_value_forecast(obs, ["loc"], ["ts", "obs_id"], "value", 3),
        "weekday": _by_weekday(v),
    }
    scores = forecast.compare_forecasts(made, lambda df: metrics.regression_metrics(df, []).select("n", "r2", "rmse"))
    return _rounded(scores.withColumn("r2", F.round("r2", 9)), ["rmse"])


ROLLING_SQL = f"""{DAILY_SQL},
    placed as (select *, row_number() over (partition by loc order by ts) as pos from daily),
    origins as (select loc, o, n - 3 - o as cut from (select loc, count(*) as n from daily group by loc),
                (select unnest([0, 1, 2]) as o) where n - 3 - o >= 1),
    known as (select c.loc, c.o, q.pos, q.value from origins c
              join placed q on q.loc = c.loc and q.pos <= c.cut and q.value is not null),
    latest as (select loc, o, last(value order by pos) as last from known group by 1, 2),
    phases as (select loc, o, pos % 7 as phase, last(value order by pos) as own from known group by 1, 2, 3),
    baselines as (select c.loc, c.o as origin, p.pos - c.cut as step, p.ts, p.value as y, l.last,
                         coalesce(f.own, l.last) as seasonal
                  from origins c join placed p on p.loc = c.loc and p.pos between c.cut + 1 and c.cut + 3
                  left join latest l on l.loc = c.loc and l.o = c.o
                  left join phases f on f.loc = c.loc and f.o = c.o and f.phase = p.pos % 7)"""


def _rolling_forecasts(v):
    return v.once(
        "rolling_forecasts",
        lambda: forecast.rolling_forecasts(v.obs(), ["loc"], "ts", "value", h=3, origins=3),
    )


@query(
    "m13_rolling_baselines",
    f"""with {ROLLING_SQL} select loc, origin, step, ts, round(y, 6) as y, round(last, 6) as last,
                                  round(seasonal, 6) as seasonal from baselines""",
)
def m13_baselines(v):
    made = _rolling_forecasts(v).select("loc", "origin", "step", "ts", "y", "last", "seasonal")
    return _rounded(made, ["y", "last", "seasonal"])


@query("m13_smoothed_forecast")
def m13_smoothed(v):
    return _rolling_forecasts(v)


@query("m13_rolling_comparison")
def m13_rolling_comparison(v):
    """Scores by steps ahead of the three forecasts over all origins."""
    made = _rolling_forecasts(v)
    named = {n: made.withColumn("prediction", F.col(n)) for n in ("last", "seasonal", "smoothed")}
    return forecast.compare_forecasts(named, lambda df: metrics.regression_metrics(df, ["step"]))
