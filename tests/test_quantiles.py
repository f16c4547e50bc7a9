import random
import statistics

import pytest
from pyspark.sql import functions as F

from rillspark.operators import quantiles, stats, triage, zonal


@pytest.fixture(params=[2, 10**6])
def ordered_values(request, monkeypatch):
    """Crowded groups from so many different values on."""
    monkeypatch.setattr(quantiles, "ORDERED_VALUES", request.param)


def values(seed=1, n=900):
    rng = random.Random(seed)
    # A third is one value; the rest spans many orders of magnitude.
    return [
        7.0 if i % 3 == 0 else rng.choice([-1, 1]) * 10 ** rng.uniform(-8, 8) for i in range(n)
    ]


@pytest.fixture(scope="module")
def table(spark):
    xs = values()
    rows = [(i, x, None if i % 5 == 0 else float(i % 17), None) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "i int, x double, y double, z double").cache()


def test_order_statistics(table, ordered_values):
    xs = sorted(values())
    wanted = [0, 1, 299, 450, 899]
    got = quantiles.order_statistics(table, {"x": wanted})
    assert got == {("x", k): xs[k] for k in wanted}


def test_column_quantiles_match_percentile(table, ordered_values):
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = quantiles.column_quantiles(table, ["x", "y", "z"], probs)
    expected = table.agg(
        *(F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in "xy")
    ).first()
    assert got["x"] == pytest.approx(expected["x"], rel=1e-12)
    assert got["y"] == pytest.approx(expected["y"], rel=1e-12)
    assert got["z"] == [None] * 5


def test_rank_out_of_range(table):
    with pytest.raises(ValueError):
        quantiles.order_statistics(table, {"y": [10**6]})


def test_grouped_median_of_a_hot_group(spark, ordered_values):
    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 1e6), 5.0) for _ in range(301)]
    rows += [(f"g{i % 20}", rng.gauss(0, 1), None if i % 2 else float(i)) for i in range(200)]
    rows += [("empty", None, None)] + [("hollow", None, None)] * 40
    rows += [(None, 3.0, None)] * 30
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {
        r["g"]: (r["x"], r["y"])
        for r in quantiles.grouped_median(df, ["g"], ["x", "y"]).collect()
    }

    def median(g, i):
        xs = [r[i] for r in rows if r[0] == g and r[i] is not None]
        return statistics.median(xs) if xs else None

    assert got.keys() == {r[0] for r in rows}
    for g, pair in got.items():
        for i, x in enumerate(pair, 1):
            want = median(g, i)
            assert (x is None) if want is None else x == pytest.approx(want, rel=1e-12)


def test_median_of_even_count_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "x double")
    assert stats.column_medians(df, ["x"]).first()["median"] == 3.0
    moments = stats.column_moments(df, ["x"]).first()
    assert moments["std"] == pytest.approx(3.491060010942235)


def test_patch_without_valid_pixels_and_place_without_patch(spark):
    pixels = spark.createDataFrame([(1, 0), (1, 0), (2, 60), (2, 10)], "patch int, class int")
    places = spark.createDataFrame([(1,), (2,), (3,)], "patch int")
    shares = zonal.attach_patches(places, zonal.class_shares(pixels, ["patch"]), ["patch"])
    assert {r["patch"]: r["perc_forest"] for r in shares.collect()} == {1: 0.0, 2: 50.0, 3: None}
    barren = zonal.class_shares(pixels, ["patch"], zonal.BARREN_CLASS)
    filled = zonal.attach_patches(places, barren, ["patch"], 0.0)
    assert {r["patch"]: r["perc_barren"] for r in filled.collect()} == {1: 0.0, 2: 50.0, 3: 0.0}


def test_slope_of_a_plane(spark):
    rows = [(1, r, c, 30.0 * c) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(rows, "patch int, r int, c int, value double")
    assert zonal.mean_slope(df).first()["topographic_slope"] == pytest.approx(45.0)


def test_gradients_match_numpy(spark):
    import numpy as np

    z = np.random.default_rng(2).normal(size=(5, 4)) * 100
    rows = [(1, r, c, float(z[r, c])) for r in range(5) for c in range(4)]
    df = spark.createDataFrame(rows, "patch int, r int, c int, value double")
    gy, gx = np.gradient(z)
    for row in zonal.gradients(df).collect():
        assert row["gx"] == pytest.approx(gx[row["r"], row["c"]])
        assert row["gy"] == pytest.approx(gy[row["r"], row["c"]])


def test_zero_median_is_missing(spark):
    rows = [(1, "red", 0.0), (1, "red", 0.0), (1, "nir", 5.0)]
    df = spark.createDataFrame(rows, "patch int, band string, value double")
    row = zonal.band_medians(df, ["patch"], ["red", "nir", "blue"]).first()
    assert (row["red"], row["nir"], row["blue"]) == (None, 5.0, None)


def test_triage_keeps_the_top_quarter(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(8)], "site int, score double")
    kept = triage.highest_risk_places(df, ["site"], "score").collect()
    assert sorted(r["site"] for r in kept) == [6, 7]


def test_correlation_skips_absent_columns(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (2.0, 4.0), (None, 9.0), (3.0, 6.0)], "a double, b double"
    )
    got = {(r["a"], r["b"]): r["r"] for r in stats.correlations(df, ["a", "b", "c"]).collect()}
    assert len(got) == 4 and got["a", "b"] == got["b", "a"] == pytest.approx(1.0)


def test_infinities_nan_and_large_whole_numbers(spark, ordered_values):
    inf, nan = float("inf"), float("nan")
    xs = [float(i) for i in range(45)] + [inf, inf, -inf, nan, nan, None]
    rows = [(i, x, 2**53 + i) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "i int, x double, big long")
    kept = sorted(x for x in xs if x is not None and x == x)
    wanted = {"x": [0, 1, 20, 46, 47], "big": [1, 25, 50]}
    got = quantiles.order_statistics(df, wanted)
    assert got == {("x", k): kept[k] for k in wanted["x"]} | {
        ("big", k): 2**53 + k for k in wanted["big"]
    }
    assert quantiles.column_quantiles(df, ["x"], [0.5, 1.0])["x"] == [22.5, inf]
    grouped = df.withColumn("g", F.lit("one"))
    assert quantiles.grouped_median(grouped, ["g"], ["x"]).first()["x"] == 22.5


def test_steps_keep_the_order(spark):
    rng = random.Random(6)
    xs = [s * m * 2.0**e for e in (-1074, -1022, -1, 0, 1, 52, 1023) for m in (1.0, 1.0000001, 1.5) for s in (-1, 1)]
    xs += [0.0, float("inf"), float("-inf"), 5e-324, 1.7976931348623157e308, 0.1, 0.1 + 2**-54]
    xs += [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-30, 30) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in set(xs) if x == x], "x double")
    rows = sorted(quantiles._with_steps(df).collect())
    assert [(r.step, r.finer) for r in rows] == sorted((r.step, r.finer) for r in rows)
    assert len({(r.step, r.finer) for r in rows}) > 530


@pytest.mark.parametrize("deviations", [5.0, -1e6])
def test_medians_counted_by_spans_move_few_values(spark, monkeypatch, deviations):
    """A span that misses its rank changes nothing but the way."""
    monkeypatch.setattr(quantiles, "SPANNED_ROWS", 100)
    monkeypatch.setattr(quantiles, "SPAN_DEVIATIONS", deviations)
    x = F.col("id")
    df = spark.range(20_001, numPartitions=3).select(
        F.when(x % 7 != 0, (x * 7919 % 20_011).cast("double")).alias("a.b"), (x * 104_729 % 19_997).alias("whole"),
        F.when(x % 5 == 0, float("nan")).otherwise(-(x * 31 % 1009).cast("double")).alias("nan"),
        F.lit(None).cast("double").alias("never"), F.lit(4.5).alias("same"),
    )
    known = quantiles.sketches(df, df.columns)
    moved = []
    durable = quantiles.durable
    monkeypatch.setattr(quantiles, "durable", lambda d: moved.append(durable(d)) or moved[-1])
    got = quantiles.column_medians_exact(df, known)
    table = df.toPandas()
    for c in ("a.b", "whole", "nan", "same"):
        assert got[c] == table[c].median()
    assert got["never"] is None
    if deviations > 0:
        assert len(moved) == 1 and moved[0].count() < 0.5 * 20_001


def test_sketches_hold_the_moments(spark):
    df = spark.range(5_000, numPartitions=4).select(
        F.when(F.col("id") % 3 != 0, F.col("id") * 0.5 + 1e9).alias("x"), F.col("id").alias("k"), F.lit(0.1).alias("same")
    )
    want = df.agg(F.count("x"), F.avg("x"), F.stddev_pop("x")).first()
    found = quantiles.sketches(df, ["x", "k", "same"])
    got = found["x"]
    assert (found["same"].mean, found["same"].std) == (0.1, 0.0)
    assert (got.rows, got.n) == (5_000, want[0])
    assert (got.mean, got.std) == (pytest.approx(want[1], rel=1e-12), pytest.approx(want[2], rel=1e-9))
