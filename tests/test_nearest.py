import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rillspark.functions.places import Box
from rillspark.operators import chunks, nearest, ranges
from rillspark.operators.nearest import Axis
from rillspark.plans import enrichment


def at(seconds):
    return dt.datetime(2020, 1, 1) + dt.timedelta(seconds=seconds)


def series_data(seed=3):
    rng = random.Random(seed)
    # Place 0 holds a third of all rows; places 4 and 5 exist on one side only.
    place = lambda: 0 if rng.random() < 0.33 else rng.randint(1, 4)
    left = [(i, place(), at(rng.randint(0, 4000) * 900)) for i in range(300)]
    right = [(i, min(place(), 3), at(rng.randint(0, 4000) * 900)) for i in range(120)]
    right += [(1000 + i, 5, at(i)) for i in range(3)]
    right += [(2000 + i, p, t) for i, (_, p, t) in enumerate(right[:20])]  # same instants again
    return left + [(900, 0, None), (901, 9, at(5))], right


def brute(left, right, tie):
    out = {}
    for i, p, t in left:
        options = [
            (abs((u - t).total_seconds()), u if tie == "earlier" else at(10**9) - u, j)
            for j, q, u in right if q == p and t is not None
        ]
        out[i] = min(options)[2] if options else None
    return out


@pytest.mark.parametrize("tie", ["earlier", "later"])
@pytest.mark.parametrize("chunk", [None, 1, 5, 60])
def test_nearest_in_time_equals_brute_force(spark, tie, chunk):
    left, right = series_data()
    got = nearest.nearest_in_time(
        spark.createDataFrame(left, "id long, place int, t timestamp_ntz"),
        spark.createDataFrame(right, "scene long, place int, u timestamp_ntz"),
        ["place"], "t", "u", "scene", chunks=chunk, tie=tie,
    ).collect()
    assert len(got) == len(left)
    assert {r["id"]: r["scene"] for r in got} == brute(left, right, tie)


def test_nearest_in_time_refuses_shared_columns(spark):
    df = spark.createDataFrame([(1, at(0), 1)], "k int, t timestamp_ntz, id int")
    with pytest.raises(ValueError):
        nearest.nearest_in_time(df, df, ["k"], "t", "t", "id")


def test_chunks_cut_a_dense_second_and_leave_sparse_series(spark):
    rows = [(0, at(0), i) for i in range(2000)] + [(k, at(k), 0) for k in range(1, 50)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, id int").repartition(3)
    made = chunks.in_chunks(df, ["k", "t", "id"], 8)
    sizes = [r["count"] for r in made.groupBy("_chunk").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 600 and len(sizes) == 8
    ordered = made.orderBy("k", "t", "id").collect()
    assert [r["_chunk"] for r in ordered] == sorted(r["_chunk"] for r in ordered)


def test_month_tie_goes_to_the_later_one_and_ends_are_kept(spark):
    days = ["2015-09-16", "2015-09-15", "2009-05-05", "2016-03-03"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date"))
    got = [
        str(r[0])
        for r in df.select(nearest.nearest_month(F.col("d"), "2010-01-01", "2015-12-01")).collect()
    ]
    assert got == ["2015-10-01", "2015-09-01", "2010-01-01", "2015-12-01"]


def test_axis_tie_goes_to_the_larger_index(spark):
    df = spark.createDataFrame([(0.5,), (-0.5,), (1.49,), (99.0,), (-99.0,)], "x double")
    up, down = Axis(0.0, 1.0, 4), Axis(0.0, -1.0, 4)
    got = [tuple(r) for r in df.select(up.index(F.col("x")), down.index(F.col("x"))).collect()]
    assert got == [(1, 0), (0, 1), (1, 0), (3, 0), (0, 3)]


@pytest.mark.parametrize("leaf_rows", [1, 4, 1000])
def test_nearest_point_equals_brute_force(spark, leaf_rows):
    import math

    rng = random.Random(5)
    # A third of all points crowd into one spot, the others are far apart.
    points = [(-30 + rng.random() * 0.01, 20 + rng.random() * 0.01) for _ in range(100)]
    points += [(rng.uniform(-40, -20), rng.uniform(10, 35)) for _ in range(200)]
    points += points[:30]
    places = [(i, rng.uniform(-42, -18), rng.uniform(8, 37)) for i in range(80)]
    places += [(100 + i, -30 + rng.random() * 0.01, 20 + rng.random() * 0.01) for i in range(80)]
    places += [(300, *points[0]), (301, None, 20.0)]
    got = nearest.nearest_point(
        spark.createDataFrame(places, "id int, lat double, lon double"),
        spark.createDataFrame(points, "plat double, plon double"),
        leaf_rows=leaf_rows,
    ).collect()
    assert len(got) == len(places)
    for row in got:
        if row["lat"] is None:
            assert row["plat"] is None
            continue
        best = min(
            math.hypot(math.radians(row["lat"] - y), math.radians(row["lon"] - x))
            for y, x in points
        )
        assert row["distance"] == pytest.approx(best, abs=1e-12)
        assert (row["plat"], row["plon"]) in points


def test_nearest_of_one_point(spark):
    places = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "lat double, lon double")
    points = spark.createDataFrame([(9.0, 9.0)], "plat double, plon double")
    assert [r["plat"] for r in nearest.nearest_point(places, points).collect()] == [9.0, 9.0]


def test_nearest_of_no_point(spark):
    places = spark.createDataFrame([(1.0, 2.0)], "lat double, lon double")
    points = spark.createDataFrame([], "plat double, plon double")
    assert nearest.nearest_point(places, points).first()["plat"] is None


@pytest.mark.parametrize("pairs_per_task", [10**9, 20])
@pytest.mark.parametrize("cell", [0.3, 1.0, 50.0])
def test_overlap_join_equals_brute_force(spark, pairs_per_task, cell):
    rng = random.Random(8)

    def boxes(n, base):
        out = []
        for i in range(n):
            # A third sits around one spot; edges fall on cell borders now and then.
            y, x = (0.0, 0.0) if i % 3 == 0 else (rng.randint(-6, 6) / 2, rng.randint(-6, 6) / 2)
            out.append((base + i, y, y + rng.randint(0, 4) / 2, x, x + rng.randint(0, 4) / 2))
        return out

    a, b = boxes(40, 0), boxes(50, 1000)
    names = lambda p: f"{p}id int, {p}s double, {p}n double, {p}w double, {p}e double"
    box = lambda p: Box(F.col(f"{p}s"), F.col(f"{p}n"), F.col(f"{p}w"), F.col(f"{p}e"))
    got = ranges.overlap_join(
        spark.createDataFrame(a, names("a")), box("a"),
        spark.createDataFrame(b, names("b")), box("b"), cell, pairs_per_task,
    ).select("aid", "bid").collect()
    want = [
        (i[0], j[0]) for i in a for j in b
        if i[1] <= j[2] and j[1] <= i[2] and i[3] <= j[4] and j[3] <= i[4]
    ]
    assert sorted(map(tuple, got)) == sorted(want)


def test_training_table_keeps_every_sample_once(spark):
    pixels = [("p", 0, 0, 60, 10.0), ("p", 0, 1, 40, 40.0), ("p", 1, 0, 0, 10.0), ("p", 1, 1, 50, 40.0)]
    table = spark.createDataFrame(pixels, "site string, r int, c int, class int, value double")
    places = enrichment.landscape(table, table.filter("value > 1e9"), "site")
    got = places.collect()[0].asDict()
    assert round(got["perc_barren"], 6) == round(got["perc_urban"], 6) == 33.333333 and got["perc_forest"] == 0
    assert got["topographic_slope"] is None
    day = dt.datetime(2024, 5, 3)
    rows = [(1, "p", 1.0, 2.0, day, 5.0), (2, "q", 1.0, 2.0, day, 5.0), (2, "q", 1.0, 2.0, day, 5.0), (3, None, None, 2.0, None, None)]
    samples = spark.createDataFrame(rows, "id int, site string, lat double, lon double, d timestamp_ntz, ppt double").withColumn("Month", F.lit(7))
    monthly = spark.createDataFrame([(1.0, 2.0, dt.date(2024, 5, 1), 0.25)], "lat double, lon double, month date, ndci double")
    made = enrichment.training_table(samples, places, monthly, "d", ["site"])
    rows = sorted((r.id, r.perc_barren, r.ndci, r.urban_precip_interaction, r.post_2008) for r in made.collect())
    third = 100 / 3
    assert [(i, round(b, 6), n) for i, b, n, *_ in rows] == [(1, round(third, 6), 0.25), (2, 0, 0.25), (2, 0, 0.25), (3, 0, None)]
    assert [r[3] and round(r[3], 6) for r in rows] == [round(5 * third, 6), None, None, None]
    assert [r[4] for r in rows] == [1, 1, 1, 0] and made.filter("Month = 7").count() == 4
