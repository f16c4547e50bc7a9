"""Projections, filters, unions and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.catalog import query
from rillspark.functions import places
from rillspark.functions.numeric import zero_to_null
from rillspark.operators import columns, joins, series

GREEN_BANDS = ("red", "green", "ndre", "nir")


@query(
    "p1_rename",
    "select loc as unique_id, ts as ds, value as y from obs",
)
def p1(v):
    return columns.rename(
        v.obs().select("loc", "ts", "value"), {"loc": "unique_id", "ts": "ds", "value": "y"}
    )


@query("p2_drop_artefact", "select sample_id, red, nir from bands")
def p2(v):
    dirty = v.bands().select("sample_id", "red", "nir").withColumn("Unnamed: 0", F.lit(1))
    return columns.drop_artefacts(columns.drop_artefacts(dirty))


@query("p3_features_by_exclusion", "select green, blue, nir, swir16, swir22 from bands")
def p3(v):
    b = v.bands()
    return b.select(*columns.feature_names(b, ["sample_id", "red", "spatial_group"]))


@query("p3_features_keeping_place", "select lat, lon, ta from samples")
def p3_place(v):
    s = v.samples()
    drop = [c for c in s.columns if c not in ("lat", "lon", "ta")]
    return s.select(*columns.feature_names(s, drop))


@query("p4_features_by_inclusion", "select sample_id, red, green, nir, 'ndre' as missing from bands")
def p4(v):
    b = v.bands()
    present, missing = columns.pick_features(b, GREEN_BANDS)
    return b.select("sample_id", *present, F.lit(",".join(missing)).alias("missing"))


@query("p5_drop_null_columns", "select sample_id, red, swir22 from bands")
def p5(v):
    b = v.bands().select(
        "sample_id", "red", "swir22", F.lit(None).cast("double").alias("never"),
        F.when(F.col("red") < 0, F.col("red")).alias("negative"),
    )
    return columns.drop_null_columns(b)


@query("p6_require_target", "select sample_id, ec, drp from samples where ec is not null and drp is not null")
def p6(v):
    return columns.require(v.samples().select("sample_id", "ec", "drp"), ["ec", "drp"])


# The corners of the box.
@query(
    "p7_strict_box",
    """select site, lat, lon from sites where lat > cast(-35.18 as double) and lat < cast(-21.72 as double)
       and lon > cast(14.97 as double) and lon < cast(30.0 as double)""",
)
def p7(v):
    return v.sites().select("site", "lat", "lon").filter(
        places.strictly_inside(F.col("lat"), F.col("lon"), -35.18, -21.72, 14.97, 30.0)
    )


@query(
    "p8_inclusive_box",
    """select site, lat, lon from sites where lat between -28.0 - 3.0 and -28.0 + 3.0
       and lon between 22.0 - 3.0 and 22.0 + 3.0""",
)
def p8(v):
    box = places.box_of_width(F.lit(-28.0), F.lit(22.0), 6.0)
    return v.sites().select("site", "lat", "lon").filter(
        places.inside(F.col("lat"), F.col("lon"), box)
    )


@query(
    "p9_clear_scenes",
    """select scene_id, ts, cloud_cover from scenes where cloud_cover < 10
       and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-26'""",
)
def p9(v):
    kept = columns.clear_scenes(v.scenes(), 10.0, ("2024-01-05", "2024-01-25"))
    return kept.select("scene_id", "ts", "cloud_cover")


@query(
    "p9_clear_scenes_30", "select scene_id, cloud_cover from scenes where cloud_cover < 30"
)
def p9_30(v):
    return columns.clear_scenes(v.scenes(), 30.0).select("scene_id", "cloud_cover")


@query("p10_valid_pixels", "select patch, r, c, class from pixels where class > 0")
def p10(v):
    return columns.valid_pixels(v.pixels(), "class").select("patch", "r", "c", "class")


@query(
    "p11_zero_to_missing",
    "select patch, r, nullif(cast(min(class) as double), 0) as lowest from pixels group by patch, r",
)
def p11(v):
    return (
        v.pixels().groupBy("patch", "r")
        .agg(zero_to_null(F.min("class").cast("double")).alias("lowest"))
    )


@query(
    "p12_output_contract",
    "select lat as Latitude, lon as Longitude, date_text as \"Sample Date\", ta, ec, drp from samples",
)
def p12(v):
    named = columns.rename(
        v.samples(), {"lat": "Latitude", "lon": "Longitude", "date_text": "Sample Date"}
    )
    return columns.contract(named, ["Latitude", "Longitude", "Sample Date", "ta", "ec", "drp"])


@query("p13_categorical_columns", "select sample_id, date_text, cat, status from samples")
def p13(v):
    s = v.samples()
    return s.select("sample_id", *columns.categorical_columns(s))


@query(
    "p14_right_without_shared",
    """select s.sample_id, s.ta, s.ec, b.red, b.nir from samples s
       join bands b on b.sample_id = s.sample_id""",
)
def p14(v):
    left = v.samples().select("sample_id", "ta", "ec")
    right = v.bands().select(
        "sample_id", "red", "nir", (F.col("red") * 2).alias("ta"), F.col("nir").alias("drp")
    )
    return left.join(columns.without_shared(right, left, ["sample_id"], ["drp"]), "sample_id")


@query(
    "u1_append",
    """select obs_id, value, cast(null as double) as flow from obs where kind = 'view'
       union all select obs_id, cast(null as double), flow from obs where kind <> 'view'""",
)
def u1(v):
    o = v.obs()
    return joins.append_frames(
        [
            o.filter("kind = 'view'").select("obs_id", "value"),
            o.filter("kind <> 'view'").select("flow", "obs_id"),
        ],
        allow_missing=True,
    )


@query("u2_distinct_keys", "select distinct lat, lon from samples")
def u2(v):
    return joins.distinct_keys(v.samples(), ["lat", "lon"])


@query("o1_sort_series", "select loc, ts, obs_id, value from obs order by loc, ts, obs_id")
def o1(v):
    return series.sort_series(
        v.obs().select("loc", "ts", "obs_id", "value"), ["loc"], ["ts", "obs_id"]
    )
