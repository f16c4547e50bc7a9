"""Scalar functions F1-F29."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.catalog import query
from rillspark.functions import dates, indices, numeric, places

SI2_SQL = "sqrt(blue * blue + green * green + red * red)"


def _index(name: str, query_name: str, sql: str):
    @query(query_name, f"select sample_id, {sql} as {name} from bands")
    def run(v, name=name):
        return indices.with_spectral_indices(v.bands()).select("sample_id", name)


_index("NDMI", "f1_ndmi", "(nir - swir16) / (nir + swir16 + 1e-10)")
_index("MNDWI", "f2_mndwi", "(green - swir16) / (green + swir16 + 1e-10)")
_index("NDVI", "f3_ndvi", "(nir - red) / (nir + red + 1e-10)")
_index("NDTI", "f4_ndti", "(red - green) / (red + green + 1e-10)")
_index("SI2", "f6_si2", SI2_SQL)
_index("SWIR_Ratio", "f7_swir_ratio", "swir16 / (swir22 + 1e-10)")


@query("f1_ndmi_plain", "select sample_id, (nir - swir16) / (nir + swir16) as ndmi from bands")
def ndmi_plain(v):
    return v.bands().select(
        "sample_id",
        indices.normalized_difference(F.col("nir"), F.col("swir16"), 0).alias("ndmi"),
    )


@query(
    "f5_salinity",
    "select sample_id, sqrt(blue * red) as SI, sqrt(blue * blue + red * red) as SI1 from bands",
)
def salinity(v):
    return indices.with_spectral_indices(v.bands()).select("sample_id", "SI", "SI1")


@query("f8_carbonate_index", "select sample_id, swir22 / (swir16 + 1e-6) as carbonate_index from bands")
def carbonate(v):
    return indices.with_interactions(v.bands()).select("sample_id", "carbonate_index")


@query("f9_ndsi", "select sample_id, (red - nir) / (red + nir + 1e-6) as NDSI from bands")
def ndsi(v):
    return indices.with_interactions(v.bands()).select("sample_id", "NDSI")


@query(
    "f10_ndci",
    """select patch, r, c, a, b, case when a + b <> 0 then (b - a) / (a + b) end as ndci
       from (select patch, r, c, value as a, lead(value) over (partition by patch, r order by c) as b
             from pixels)""",
)
def ndci_query(v):
    from pyspark.sql import Window

    w = Window.partitionBy("patch", "r").orderBy("c")
    pairs = v.pixels().select(
        "patch", "r", "c", F.col("value").alias("a"), F.lead("value").over(w).alias("b")
    )
    return pairs.withColumn("ndci", indices.ndci(F.col("b"), F.col("a")))


@query("f11_t_range", "select cell, t, tmax - tmin as T_range from grid")
def t_range(v):
    return indices.with_interactions(v.grid()).select("cell", "t", "T_range")


@query(
    "f12_f13_turbidity_interactions",
    """select sample_id, NDTI * soil_clay as hydro_soil_interaction,
              ndci * NDTI as ndci_turbidity_interaction
       from (select sample_id, (red - green) / (red + green + 1e-10) as NDTI,
                    blue / 100 as soil_clay, swir22 / 1000 as ndci from bands)""",
)
def turbidity(v):
    b = indices.with_spectral_indices(v.bands()).withColumns(
        {"soil_clay": F.col("blue") / 100.0, "ndci": F.col("swir22") / 1000.0}
    )
    return indices.with_interactions(b).select(
        "sample_id", "hydro_soil_interaction", "ndci_turbidity_interaction"
    )


@query(
    "f14_post_2008",
    """select sample_id, year, cast(case when year > 2008 then 1 else 0 end as int) as post_2008
       from (select sample_id, case when cat is not null then cast(year(d) + 10 as int) end as year
             from samples)""",
)
def post_2008(v):
    s = v.samples().select(
        "sample_id",
        F.when(F.col("cat").isNotNull(), (F.year("d") + 10).cast("int")).alias("year"),
    )
    return indices.with_interactions(s).select("sample_id", "year", "post_2008")


@query(
    "f15_urban_precipitation",
    "select cell, t, soil * ppt as urban_precip_interaction from grid",
)
def urban_precipitation(v):
    g = v.grid().withColumns({"perc_urban": F.col("soil"), "precipitation": F.col("ppt")})
    return indices.with_interactions(g).select("cell", "t", "urban_precip_interaction")


@query(
    "f16_calendar",
    """select sample_id, cast(month(d) as int) as Month, cast(dayofyear(d) as int) as DayOfYear
       from samples""",
)
def calendar(v):
    return dates.with_calendar(v.samples(), "d").select("sample_id", "Month", "DayOfYear")


@query(
    "f17_date_parts",
    """select sample_id, cast(year(d) as int) as d_year, cast(month(d) as int) as d_month,
              cast(day(d) as int) as d_day from samples""",
)
def date_parts(v):
    return dates.with_date_parts(v.samples(), "d").select("sample_id", "d_year", "d_month", "d_day")


@query(
    "f18_day_first_date",
    """select sample_id, case when status <> 'F' then d end as parsed from samples""",
)
def day_first(v):
    # Every sample with status F gets a date that does not exist.
    text = F.when(F.col("status") == "F", F.concat(F.lit("99-"), F.substring("date_text", 4, 7)))
    return v.samples().select(
        "sample_id",
        dates.parse_day_first(F.coalesce(text, F.col("date_text"))).alias("parsed"),
    )


@query("f19_iso_date", "select sample_id, strftime(d, '%Y-%m-%d') as iso from samples")
def iso(v):
    return v.samples().select("sample_id", dates.iso_text(F.col("d")).alias("iso"))


@query(
    "f20_month_period",
    """select sample_id, cast(date_trunc('month', d) as date) as first_day,
              last_day(d) as final_day from samples""",
)
def month_period(v):
    d = F.col("d")
    return v.samples().select(
        "sample_id", dates.month_start(d).alias("first_day"), dates.month_end(d).alias("final_day")
    )


@query("f21_place_id", "select site, lat as lat_back, lon as lon_back from sites")
def place_label(v):
    labelled = v.sites().select(
        "site", places.place_id(F.col("lat"), F.col("lon")).alias("label")
    )
    lat, lon = places.place_coordinates(F.col("label"))
    return labelled.select("site", lat.alias("lat_back"), lon.alias("lon_back"))


@query(
    "f22_rounded_coordinates",
    "select site, round(lat / 7, 6) as lat6, round(lon / 7, 6) as lon6 from sites",
)
def rounded(v):
    return v.sites().select(
        "site",
        places.rounded(F.col("lat") / 7.0).alias("lat6"),
        places.rounded(F.col("lon") / 7.0).alias("lon6"),
    )


@query(
    "f23_clip_at_zero",
    """select sample_id, case when ec is null then null when ec - 20000 < 0 then 0
              else ec - 20000 end as clipped from samples""",
)
def clip(v):
    return v.samples().select(
        "sample_id", numeric.clip_at_zero(F.col("ec") - 20000.0).alias("clipped")
    )


@query(
    "f24_shifted_log",
    """select sample_id, round(ln(1 + (ec - (select min(ec) from samples) + 1)), 9) as log_ec
       from samples""",
)
def shifted_log(v):
    s = v.samples()
    low = s.agg(F.min("ec")).scalar()
    return s.select(
        "sample_id", F.round(numeric.shifted_log(F.col("ec"), low), 9).alias("log_ec")
    )


@query("f25_absolute_residual", "select sample_id, abs(ec - drp) as residual from samples")
def residual(v):
    return v.samples().select(
        "sample_id", numeric.absolute_residual(F.col("ec"), F.col("drp")).alias("residual")
    )


@query(
    "f26_slope_of_gradient",
    """select patch, r, c, round(degrees(atan(sqrt(value * value + value * value) / 30)), 9) as steep,
              round(radians(value), 9) as rad from pixels""",
)
def slope(v):
    x = F.col("value")
    return v.pixels().select(
        "patch", "r", "c",
        F.round(numeric.slope_degrees(x, x), 9).alias("steep"),
        F.round(F.radians(x), 9).alias("rad"),
    )


@query(
    "f27_time_distance",
    """select obs_id, abs(epoch_us(ts) - epoch_us(timestamp '2024-01-15 12:00:00')) as us from obs""",
)
def time_distance(v):
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return v.obs().select("obs_id", dates.time_distance(F.col("ts"), noon).alias("us"))


@query(
    "f28_buffers",
    """select site, lat - cast(2000 / 111000.0 as double) as cover_south,
              lon + cast(0.018 as double) as slope_east,
              lat + cast(0.0001 as double) as index_north,
              lon - cast(0.00089831 as double) / 2 as band_west from sites""",
)
def buffers(v):
    lat, lon = F.col("lat"), F.col("lon")
    return v.sites().select(
        "site",
        places.box_around(lat, lon, places.LAND_COVER_HALF).min_lat.alias("cover_south"),
        places.box_around(lat, lon, places.SLOPE_HALF).max_lon.alias("slope_east"),
        places.box_around(lat, lon, places.MONTHLY_INDEX_HALF).max_lat.alias("index_north"),
        places.box_of_width(lat, lon, places.BAND_BOX_WIDTH).min_lon.alias("band_west"),
    )


@query(
    "f29_land_cover_name",
    """select patch, r, c, case class when 10 then 'tree cover' when 20 then 'shrubland'
              when 30 then 'grassland' when 40 then 'cropland' when 50 then 'built-up'
              when 60 then 'bare or sparse' when 70 then 'snow and ice' when 80 then 'water'
              when 90 then 'wetland' when 95 then 'mangroves' when 100 then 'moss and lichen'
              end as cover from pixels""",
)
def land_cover(v):
    return v.pixels().select("patch", "r", "c", numeric.legend_name(F.col("class")).alias("cover"))
