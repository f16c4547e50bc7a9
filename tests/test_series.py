import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from rillspark.operators import forecast, series
from rillspark.plans import evaluation


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def frame(spark, values, name="x"):
    return spark.createDataFrame(
        [("a", day(i), v) for i, v in enumerate(values)], f"s string, t date, {name} double"
    )


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_rolling_starts_missing(spark):
    out = series.rolling(
        frame(spark, [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0]), ["s"], "t",
        {"sum3": ("x", "sum", 3), "mean2": ("x", "mean", 2)},
    )
    assert column(out, "sum3") == [None, None, 6.0, None, None, None, 18.0]
    assert column(out, "mean2") == [None, 1.5, 2.5, None, None, 5.5, 6.5]


def test_interpolation_edges(spark):
    gaps = frame(spark, [None, 1.0, None, None, 4.0, None])
    assert column(series.interpolate(gaps, ["s"], "t", ["x"], fill=False), "x") == [
        None, 1.0, 2.0, 3.0, 4.0, 4.0
    ]
    assert column(series.interpolate(gaps, ["s"], "t", ["x"]), "x") == [
        1.0, 1.0, 2.0, 3.0, 4.0, 4.0
    ]


def test_series_without_values_stays_missing(spark):
    assert column(series.interpolate(frame(spark, [None, None]), ["s"], "t", ["x"]), "x") == [
        None, None
    ]


def test_resample_keeps_empty_months(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2020, 1, 5), 1.0), ("a", dt.date(2020, 1, 9), 3.0),
         ("a", dt.date(2020, 3, 1), None), ("a", dt.date(2020, 4, 2), 8.0)],
        "s string, t date, x double",
    )
    out = series.resample_mean(df, ["s"], "t", ["x"])
    assert column(out, "x") == [2.0, None, None, 8.0]
    assert str(column(out, "t")[1]) == "2020-02-01"


@pytest.mark.parametrize("chunk", [None, 1, 4, 50])
def test_fill_matches_pandas(spark, chunk):
    rng = random.Random(2)
    start = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(400):
        s = 0 if i % 3 == 0 else rng.randint(1, 5)
        x = rng.random() if rng.random() < 0.3 else None
        rows.append((i, s, start + dt.timedelta(minutes=20 * rng.randint(0, 300)), x, None if s == 2 else x))
    df = spark.createDataFrame(rows, "id long, s int, t timestamp_ntz, x double, y double")
    got = series.fill_forward_back(df, ["s"], ["t", "id"], ["x", "y"], chunk).toPandas()
    want = pd.DataFrame(rows, columns=["id", "s", "t", "x", "y"]).sort_values(["s", "t", "id"])
    want[["x", "y"]] = want.groupby("s")[["x", "y"]].transform(lambda v: v.ffill().bfill())
    merged = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(got) == len(rows)
    for c in "xy":
        assert merged[c].astype(float).equals(merged[f"{c}_w"].astype(float))


def test_monthly_sequences(spark):
    rows = [("long", dt.date(2020, m, 3), float(m), m * 10.0) for m in (1, 2, 4, 5)]
    rows += [("short", dt.date(2020, m, 3), 1.0, 1.0) for m in (1, 2, 3)]
    df = spark.createDataFrame(rows, "s string, t date, y double, f double")
    out = evaluation.monthly_sequences(df, ["s"], "t", ["f"], "y", 3).orderBy("t").collect()
    assert [r["s"] for r in out] == ["long", "long"]
    assert [list(map(tuple, r["x"])) for r in out][0] == [(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)]
    assert [r["y"] for r in out] == [4.0, 5.0]


def test_sequences_keep_missing_steps(spark):
    df = frame(spark, [1.0, None, 3.0])
    out = series.sequences(df, ["s"], "t", [], "x", 2).collect()
    assert [tuple(step) for step in out[0]["x"]] == [(1.0,), (None,)]


def test_hold_out_last(spark):
    df = frame(spark, [1.0, 2.0, 3.0]).unionByName(
        spark.createDataFrame([("b", day(9), 5.0)], "s string, t date, x double")
    )
    marked = series.hold_out_last(df, ["s"], ["t"], 2)
    assert {(r["s"], str(r["t"])[-2:]): r["split"] for r in marked.collect()} == {
        ("a", "01"): "train", ("a", "02"): "test", ("a", "03"): "test", ("b", "10"): "test",
    }


def test_hold_out_limits_rows_before_the_shuffle(spark):
    plan = series.hold_out_last(frame(spark, [1.0]), ["s"], ["t"], 2)._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    assert "WindowGroupLimit" in text


def test_forecast_uses_the_last_known_value(spark):
    out = forecast.last_value_forecast(frame(spark, [1.0, 2.0, None, 4.0]), ["s"], ["t"], "x")
    row = out.first()
    assert (row["y"], row["prediction"]) == (4.0, 2.0)


def test_seasonal_forecast_falls_back_to_the_last_value(spark):
    rows = [("a", t, v) for t, v in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0])] + [("b", 0, 7.0), (None, 0, 1.0), (None, 2, 3.0)]
    df = spark.createDataFrame(rows, "s string, t int, x double")
    made = forecast.seasonal_forecast(df, ["s"], ["t"], "x", F.col("t") % 4, 3)
    got = {(r.s, r.t): (r.y, r.prediction, r.seasonal) for r in made.filter("s = 'a' or s = 'b'").collect()}
    assert got == {
        ("a", 3): (4.0, 2.0, False), ("a", 4): (5.0, 1.0, True), ("a", 5): (6.0, 2.0, True), ("b", 0): (7.0, None, False),
    }
    assert made.columns == ["s", "t", "y", "prediction", "seasonal"]


def smooth_by_hand(values, season, alpha, gamma):
    lost, level, seasons = 0.0, None, [0.0] * season
    for i, v in enumerate(values):
        if v is None:
            continue
        if level is None:
            level = v
            continue
        error = v - level - seasons[i % season]
        lost += error**2
        level += alpha * error
        seasons[i % season] += gamma * error
    return lost, level, seasons


def test_rolling_forecasts_equal_a_loop(spark):
    draw = np.random.default_rng(5)
    data = {
        "wave": [10 + 5 * (i % 4 == 0) + 0.1 * i + draw.normal() * 0.2 for i in range(40)],
        "gaps": [None if i % 5 == 2 else float(i % 3) for i in range(17)],
        "late": [None, None, None, 2.0, float("nan"), 4.0, 4.0, 8.0],
        "two": [1.0, 3.0], "none": [None] * 6,
    }
    rows = [(s, day(i), v) for s, values in data.items() for i, v in enumerate(values)]
    rows += [("wave", day(39), data["wave"][39])] * 3  # repeated rows of one step
    df = spark.createDataFrame(rows, "s string, t date, x double")
    made = forecast.rolling_forecasts(
        df, ["s"], "t", "x", season=4, h=2, origins=3, level_weights=[0.2, 0.6], season_weights=[0.0, 0.4]
    )
    got = {(r.s, r.origin, r.step): r for r in made.collect()}
    want = 0
    for s, values in data.items():
        values = [None if v is None or v != v else v for v in values]
        for origin in range(3):
            cut = len(values) - 2 - origin
            if cut < 1:
                continue
            part = values[:cut]
            fits = [(*smooth_by_hand(part, 4, a, g), a, g) for a in (0.2, 0.6) for g in (0.0, 0.4)]
            _, level, seasons, alpha, gamma = min(fits, key=lambda f: (f[0], f[3], f[4]))
            known = [(i, v) for i, v in enumerate(part) if v is not None]
            for step in (1, 2):
                want += 1
                r, at = got[s, origin, step], cut + step - 1
                assert r.t == day(at) and (r.alpha, r.gamma) == (alpha, gamma)
                assert r.y == (None if values[at] is None else pytest.approx(values[at]))
                last = known[-1][1] if known else None
                alike = [v for i, v in known if (at - i) % 4 == 0]
                assert r.last == (last if last is None else pytest.approx(last))
                assert r.seasonal == (alike[-1] if alike else last)
                assert r.smoothed == (
                    None if level is None else pytest.approx(level + seasons[at % 4])
                )
    assert len(got) == want
    wave = made.filter("s = 'wave'").agg(
        F.avg(F.abs(F.col("y") - F.col("smoothed"))), F.avg(F.abs(F.col("y") - F.col("last")))
    ).first()
    assert wave[0] < wave[1]
    assert forecast.rolling_forecasts(df.limit(0), ["s"], "t", "x").count() == 0


def test_forecasting_frame_columns(spark):
    df = spark.createDataFrame(
        [(1, 7, dt.datetime(2020, 1, 1), None, 2.0), (2, 7, dt.datetime(2020, 1, 2), 5.0, None)],
        "id int, s int, t timestamp_ntz, v double, f double",
    )
    out = evaluation.forecasting_frame(df, "s", "t", "v", "id", ["f"])
    assert out.columns == ["unique_id", "ds", "y", "f"]
    assert sorted((r["unique_id"], r["y"], r["f"]) for r in out.collect()) == [
        ("7", 5.0, 2.0), ("7", 5.0, 2.0)
    ]


def test_sort_series(spark):
    df = frame(spark, [3.0, 1.0]).orderBy("x")
    assert [r["x"] for r in series.sort_series(df, ["s"], ["t"]).collect()] == [3.0, 1.0]
