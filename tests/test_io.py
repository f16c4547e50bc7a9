import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillspark.session import durable
from rillspark.sources import io, schemas
from rillspark.streaming.incremental import process_new_files


def test_csv_blanks_are_missing(spark, tmp_path):
    path = tmp_path / "bands.csv"
    path.write_text(
        "Latitude,Longitude,Sample Date,red,blue,green,nir,swir16,swir22\n"
        "-30.5,20.25,01-09-2014,1,2,3,,5,6\n"
    )
    row = io.read_csv(spark, str(path), schemas.BAND_FEATURES).first()
    assert row["nir"] is None and row["swir22"] == 6.0 and row["Sample Date"] == "01-09-2014"


def test_partitioned_sink_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(2011, 1.0), (2012, 2.0)], "year int, x double")
    io.write_table(df, str(tmp_path / "t"), ["year"])
    back = io.read_table(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.select("year", "x").collect())) == [(2011, 1.0), (2012, 2.0)]


def test_bucketed_tables_join_without_a_shuffle(spark):
    places = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    for name, value in (("bucketed_samples", "x"), ("bucketed_bands", "y")):
        io.write_bucketed(places.select("k", F.col("x").alias(value)), name, ["k"], 4, "overwrite")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_samples").join(spark.table("bucketed_bands"), ["k"], "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.filter("x = y").count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_busy_partition_is_written_by_many_tasks(spark, tmp_path):
    df = spark.range(200_000).select((F.col("id") * 0).alias("year"), F.rand(1).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        io.write_table(df, str(tmp_path / "t"), ["year"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "year=0").glob("*.parquet"))) > 1


def test_cube_bounds_are_inclusive(spark):
    rows = [(dt.date(2010, m, 1), float(y), 20.0, m) for m in (1, 2, 3) for y in (-21, -30, -36, -37)]
    cube = spark.createDataFrame(rows, "t date, lat double, lon double, ppt int")
    out = io.cube_subset(cube, ["ppt"], ("2010-01-01", "2010-02-01"), (-21, -36), (15, 34))
    assert out.count() == 6
    assert out.columns == ["t", "lat", "lon", "ppt"]


def test_resume_appends_only_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "done")
    source = spark.range(10).withColumnRenamed("id", "k").withColumn("k", F.nullif("k", F.lit(9)))
    for run, rows in ((1, source.filter("k < 4")), (2, source), (3, source)):
        made = io.resume_append(rows, path, ["k"], lambda rows, run=run: rows.withColumn("run", F.lit(run)))
    got = {r["k"]: r["run"] for r in made.collect()}
    assert got == {k: 1 if k < 4 else 2 for k in range(9)} | {None: 2} and made.count() == 10


def test_a_run_that_fails_leaves_no_key_half_done(spark, tmp_path):
    path, fail = str(tmp_path / "done"), tmp_path / "fail"
    source = spark.range(0, 40, numPartitions=8).withColumnRenamed("id", "k")
    three = F.explode(F.array(*(F.lit(i) for i in range(3))))

    def extract(rows):
        # The last task breaks once others have written their rows.
        bad = F.when((F.col("k") == 39) & F.lit(fail.exists()), F.raise_error(F.lit("cut"))).otherwise(F.col("k"))
        return rows.select(bad.cast("long").alias("k"), three.alias("i"))

    first = io.resume_append(source.filter("k < 5"), path, ["k"], extract)
    fail.touch()
    with pytest.raises(Exception, match="cut"):
        io.resume_append(source, path, ["k"], extract)
    assert len(list((tmp_path / "done").glob("batch-*"))) == 2
    assert io.published(spark, path, first.schema).count() == 15
    fail.unlink()
    made = io.resume_append(source, path, ["k"], extract)
    assert sorted(map(tuple, made.collect())) == [(k, i) for k in range(40) for i in range(3)]


def test_a_table_that_was_not_begun_is_empty(spark, tmp_path):
    assert io.published(spark, str(tmp_path / "none"), spark.range(1).schema).collect() == []


def test_new_files_are_processed_once(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = spark.range(1).schema
    for start in (0, 5):
        spark.range(start, start + 5).write.mode("append").parquet(source)
        for _ in range(2):
            process_new_files(
                spark, source, schema, sink, progress,
                lambda rows: rows.select((F.col("id") * 2).alias("twice")), files_per_batch=2,
            )
    got = sorted(r["twice"] for r in spark.read.parquet(sink).collect())
    assert got == [2 * i for i in range(10)]


def test_durable_uses_the_shared_folder(spark):
    df = durable(spark.range(3))
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
    assert df.count() == 3
