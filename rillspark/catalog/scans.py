"""Scans, sinks and resumable extraction."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.catalog import query
from rillspark.catalog.series import INTERPOLATED_SQL
from rillspark.plans.evaluation import monthly_sequences
from rillspark.session import working_folder
from rillspark.sources import io, schemas
from rillspark.streaming.incremental import process_new_files

SAMPLE_COLUMNS_SQL = 'lat as "Latitude", lon as "Longitude", date_text as "Sample Date"'


def _sample_file(v):
    return v.samples().select(
        F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"),
        F.col("date_text").alias("Sample Date"), F.col("ta").alias("Total Alkalinity"),
        F.col("ec").alias("Electrical Conductance"),
        F.col("drp").alias("Dissolved Reactive Phosphorus"),
    )


@query(
    "s1_csv_scan",
    f"""select {SAMPLE_COLUMNS_SQL}, ta as "Total Alkalinity", ec as "Electrical Conductance",
               drp as "Dissolved Reactive Phosphorus" from samples""",
)
def s1(v):
    path = working_folder(v.spark) + "/samples_csv"
    io.write_csv(_sample_file(v), path)
    return io.read_csv(v.spark, path, schemas.SAMPLES)


@query("s2_table_sink", "select sample_id, d, ta, cast(year(d) as int) as year from samples")
def s2(v):
    path = working_folder(v.spark) + "/samples_by_year"
    rows = v.samples().select("sample_id", "d", "ta", F.year("d").alias("year"))
    io.write_table(rows, path, ["year"])
    return io.read_table(v.spark, path)


@query(
    "s3_first_rows", "select sample_id, d, ta from samples order by d, sample_id limit 200"
)
def s3(v):
    return io.first_rows(v.samples().select("sample_id", "d", "ta"), ["d", "sample_id"], 200)


@query(
    "s4_cube_subset",
    """select t, lat, lon, ppt, pet from grid where t between date '1996-01-01' and date '2000-12-31'
       and lat between -31.05 and -25.05 and lon between 19 and 28""",
)
def s4(v):
    return io.cube_subset(
        v.grid(), ["ppt", "pet"], ("1996-01-01", "2000-12-31"), (-25.05, -31.05), (19.0, 28.0)
    )


@query(
    "s5_cube_records",
    """select strftime(t, '%Y-%m-%d') as "Sample Date", lat as "Latitude", lon as "Longitude", pet
       from grid""",
)
def s5(v):
    return io.cube_to_records(v.grid(), "pet")


@query("s6_remaining", "select sample_id, d, ta from samples where status <> 'F'")
def s6(v):
    samples = v.samples()
    done = samples.filter("status = 'F'").select("sample_id")
    return io.remaining(samples.select("sample_id", "d", "ta"), done, ["sample_id"])


@query("s6_resumed_run", "select sample_id, ta / 2 as half from samples")
def s6_resumed(v):
    path = working_folder(v.spark) + "/extracted"
    samples = v.samples()

    def extract(rows):
        return rows.select("sample_id", (F.col("ta") / 2.0).alias("half"))

    io.publish_batch(extract(samples.filter("status = 'F'")), path)
    io.resume_append(samples, path, ["sample_id"], extract)
    return io.resume_append(samples, path, ["sample_id"], extract)  # finds nothing left


@query(
    "s6_resumed_run_of_many_rows",
    """select sample_id, band, value / 2 as half from samples, (
         select 'ta' as band union all select 'ec' union all select 'drp') b,
         lateral (select case band when 'ta' then ta when 'ec' then ec else drp end as value) x""",
)
def s6_many(v):
    path = working_folder(v.spark) + "/extracted"
    samples = v.samples().select("sample_id", "status", "ta", "ec", "drp")

    def extract(rows):
        bands = F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).alias("value")) for b in ("ta", "ec", "drp")))
        return rows.select("sample_id", F.inline(bands)).select(
            "sample_id", "band", (F.col("value") / 2.0).alias("half")
        )

    # A run cut short: its rows are there, but not in the manifest.
    io.write_table(extract(samples.filter("status = 'O'")).filter("band = 'ta'"), path + "/batch-lost")
    io.resume_append(samples.filter("status = 'F'"), path, ["sample_id"], extract)
    return io.resume_append(samples, path, ["sample_id"], extract)


@query("s6_incremental_run", "select sample_id, ta / 2 as half from samples")
def s6_incremental(v):
    folder = working_folder(v.spark)
    samples = v.samples().select("sample_id", "ta", "status")
    schema = T.StructType(samples.schema.fields[:2])
    for done in (True, False):
        part = samples.filter((F.col("status") == "F") == F.lit(done)).drop("status")
        io.write_table(part, f"{folder}/in", mode="append")
        process_new_files(
            v.spark, f"{folder}/in", schema, f"{folder}/out", f"{folder}/progress",
            lambda rows: rows.select("sample_id", (F.col("ta") / 2.0).alias("half")),
        )
    return io.read_table(v.spark, f"{folder}/out")


@query(
    "s8_sequence_table",
    f"""with {INTERPOLATED_SQL}
        select loc, ts, cast(3 as int) as steps, oldest, y from (
          select loc, ts, pos, round(lag(value, 3) over (partition by loc order by ts), 9) as oldest,
                 round(value, 9) as y from regular) where pos > 3""",
)
def s8(v):
    path = working_folder(v.spark) + "/sequences"
    io.write_sequences(monthly_sequences(v.obs(), ["loc"], "ts", ["flow"], "value", 3, "day"), path)
    return io.read_table(v.spark, path).select(
        "loc", "ts", F.size("x").alias("steps"),
        F.round(F.col("x")[0]["value"], 9).alias("oldest"), F.round("y", 9).alias("y"),
    )
