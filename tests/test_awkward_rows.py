"""Missing keys, repeated keys and gaps, which the test tables do not hold."""

import pytest
from pyspark.sql import functions as F

from rillspark.operators import joins, nearest, prep, series, split, zonal
from rillspark.sources import io
from rillspark.sources.views import Views


def test_resumed_runs_append_missing_keys_once(spark, tmp_path):
    source = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    path = str(tmp_path / "done")
    for _ in range(3):
        made = io.resume_append(source, path, ["k"], lambda df: df)
    assert sorted(r.x for r in made.collect()) == ["a", "b"]


def test_missing_month_or_place_counts_as_processed(spark):
    samples = spark.createDataFrame(
        [(1.0, 2.0, "2020-01-05"), (None, 2.0, "2020-01-05"), (1.0, 2.0, None)], "lat double, lon double, d string"
    ).withColumn("d", F.col("d").cast("date"))
    first = joins.unprocessed_months(samples, samples.limit(0).select("lat", "lon", F.col("d").alias("month")), "d")
    assert first.count() == 3
    assert joins.unprocessed_months(samples, first, "d").count() == 0


def test_repeated_climate_rows_do_not_multiply_samples(spark):
    samples = spark.createDataFrame([(1, 0.0, 0.0, "2020-01-03")], "id int, lat double, lon double, d string")
    climate = spark.createDataFrame(
        [(0.1, 0.1, "2020-01-01", 5.0), (0.1, 0.1, "2020-01-01", 4.0), (0.1, 0.1, None, 1.0)],
        "plat double, plon double, t string, ppt double",
    )
    found = nearest.nearest_point_and_time(
        samples.withColumn("d", F.col("d").cast("date")), climate.withColumn("t", F.col("t").cast("date")), ["ppt"], "d", "t"
    ).collect()
    assert [(r.id, r.ppt) for r in found] == [(1, 4.0)]


@pytest.mark.parametrize("chunk", [1, 9])
def test_a_series_without_a_name_is_filled_over_chunk_borders(spark, chunk):
    rows = [(None, "2020-06-01", 1, 7.0), (None, "2021-06-01", 2, None), ("s", "2021-06-01", 3, None)]
    df = spark.createDataFrame(rows, "s string, t string, id int, x double").withColumn("t", F.col("t").cast("timestamp"))
    made = series.fill_forward_back(df, ["s"], ["t", "id"], ["x"], chunk)
    assert {r.id: r.x for r in made.collect()} == {1: 7.0, 2: 7.0, 3: None}


def test_no_gradient_beside_an_absent_pixel(spark):
    rows = [("p", r, c, 30.0 * c) for r in range(3) for c in range(5) if c != 1]
    df = spark.createDataFrame(rows, "patch string, r int, c int, value double")
    made = {r.c: r.gx for r in zonal.gradients(df).filter("r = 1").collect()}
    assert made == {0: None, 2: None, 3: 30.0, 4: 30.0}


def test_factorize_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "at int, k string")
    codes = {r.k: r.k_code for r in prep.factorize(df, "k", "at").collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}


def test_sequential_split_of_large_series_numbers(spark):
    rows = [(2**53 + i, "2020-01-01") for i in range(10)]
    df = spark.createDataFrame(rows, "s long, t string").withColumn("t", F.col("t").cast("timestamp"))
    made = split.sequential_split(df, "s", "t").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in made} == {"train": 8, "test": 2}


def test_model_queries_write_only_the_columns_they_take(spark, monkeypatch, tmp_path):
    from rillspark.catalog import models

    wide = spark.range(3).select(
        *(F.lit(1.0).alias(c) for c in ("sample_id", "site", "ec", *models.FEATURES)), F.lit(0).alias("NDSI_unused")
    )
    monkeypatch.setattr(models, "enriched", lambda v: wide)
    written = models._enriched(Views(spark, str(tmp_path)))
    assert set(written.columns) == {"sample_id", "site", "ec", *models.FEATURES}
