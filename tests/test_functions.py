import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillspark.functions import dates, indices, numeric, places


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(
        f"{n} {'string' if isinstance(v, str) else 'date' if isinstance(v, dt.date) else 'double'}"
        for n, v in values.items()
    )
    df = spark.createDataFrame([tuple(values.values())], schema) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_indices_skip_absent_bands(spark):
    df = spark.createDataFrame([(3.0, 1.0)], "nir double, red double")
    out = indices.with_spectral_indices(df)
    assert out.columns == ["nir", "red", "NDVI"]
    assert out.first()["NDVI"] == 2.0 / (4.0 + 1e-10)


def test_training_only_indices(spark):
    df = spark.createDataFrame([(4.0, 9.0, 1.0)], "blue double, red double, green double")
    assert {"SI", "SI1"} <= set(indices.with_spectral_indices(df).columns)
    test_side = indices.with_spectral_indices(df, training=False)
    assert "SI" not in test_side.columns and "SI2" in test_side.columns
    assert indices.with_spectral_indices(df).first()["SI"] == 6.0


def test_ratio_of_opposites_is_missing(spark):
    assert one(spark, indices.ndci(F.col("b"), F.col("a")), b=1.0, a=-1.0) is None


def test_root_of_negative_is_missing(spark):
    assert one(spark, indices.root(F.col("a")), a=-1.0) is None


def test_swir_ratio_and_carbonate_are_inverse_with_own_guards(spark):
    df = spark.createDataFrame([(2.0, 4.0)], "swir16 double, swir22 double")
    row = indices.with_interactions(indices.with_spectral_indices(df)).first()
    assert row["SWIR_Ratio"] == 2.0 / (4.0 + 1e-10)
    assert row["carbonate_index"] == 4.0 / (2.0 + 1e-6)


def test_post_2008_of_missing_year_is_0(spark):
    df = spark.createDataFrame([(2008,), (2009,), (None,)], "year int")
    flags = [r["post_2008"] for r in indices.with_interactions(df).collect()]
    assert flags == [0, 1, 0]


def test_bad_date_is_missing_and_row_kept(spark):
    df = spark.createDataFrame([("99-99-2014",), ("01-09-2014",), (None,)], "t string")
    got = [r[0] for r in df.select(dates.parse_day_first(F.col("t"))).collect()]
    assert got == [None, dt.date(2014, 9, 1), None]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "p double")
    got = [r[0] for r in df.select(numeric.clip_at_zero(F.col("p"))).collect()]
    assert got == [0.0, 2.0, None]


def test_place_label_round_trip(spark):
    label = places.place_id(F.col("lat"), F.col("lon"))
    lat, lon = places.place_coordinates(label)
    assert one(spark, lat, lat=-33.1, lon=1e-05) == -33.1
    assert one(spark, lon, lat=-33.1, lon=1e-05) == 1e-05


@pytest.mark.parametrize("x, kept", [(1.0, False), (1.5, True), (2.0, False)])
def test_strict_box(spark, x, kept):
    inside = places.strictly_inside(F.col("lat"), F.col("lon"), 1.0, 2.0, 0.0, 9.0)
    assert one(spark, inside, lat=x, lon=5.0) is kept


def test_inclusive_box_edges(spark):
    box = places.box_of_width(F.lit(0.0), F.lit(0.0), 2.0)
    assert one(spark, places.inside(F.col("lat"), F.col("lon"), box), lat=1.0, lon=-1.0)


def test_legend(spark):
    assert one(spark, numeric.legend_name(F.col("c")), c=50.0) == "built-up"
    assert one(spark, numeric.legend_name(F.col("c")), c=55.0) is None
