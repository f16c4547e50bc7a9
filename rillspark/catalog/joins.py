"""Joins (J1-J10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.catalog import query
from rillspark.functions.places import Box, box_around
from rillspark.operators import columns, joins, nearest, ranges
from rillspark.plans import enrichment
from rillspark.session import durable
from rillspark.sources import views

LAT_AXIS = nearest.Axis(views.GRID_LAT0, views.GRID_LAT_STEP, views.GRID_ROWS)
LON_AXIS = nearest.Axis(views.GRID_LON0, views.GRID_LON_STEP, views.GRID_COLS)
MONTHS = (views.GRID_FIRST, views.GRID_LAST)

# Nearest cell by axis and nearest month, by looking at all of them.
NEAREST_CELL_SQL = """
    places as (select distinct lat, lon from samples),
    near_lat as (select p.lat, g.lat as glat from (select distinct lat from places) p,
                 (select distinct lat from grid) g
                 qualify row_number() over (partition by p.lat order by abs(p.lat - g.lat), g.lat) = 1),
    near_lon as (select p.lon, g.lon as glon from (select distinct lon from places) p,
                 (select distinct lon from grid) g
                 qualify row_number() over (partition by p.lon order by abs(p.lon - g.lon), g.lon desc) = 1),
    near_t as (select s.d, g.t as gt from (select distinct d from samples) s,
               (select distinct t from grid) g
               qualify row_number() over (partition by s.d order by abs(s.d - g.t), g.t desc) = 1)"""

ROLLED_SQL = """
    rolled as (select *, case when count(ppt) over w3 = 3 then sum(ppt) over w3 end as ppt_3mo,
                      case when count(ppt) over w6 = 6 then sum(ppt) over w6 end as ppt_6mo,
                      case when count(tmax) over w3 = 3 then avg(tmax) over w3 end as tmax_3mo
               from grid
               window w3 as (partition by cell order by t rows between 2 preceding and current row),
                      w6 as (partition by cell order by t rows between 5 preceding and current row))"""


@query(
    "j1_enrich",
    """select s.sample_id, s.lat, s.lon, s.d, f.red, f.nir, c.rows_there
       from samples s
       left join (select lat, lon, d, red, nir from samples join bands using (sample_id)) f
         on f.lat = s.lat and f.lon = s.lon and f.d = s.d
       left join (select lat, lon, d, count(*) as rows_there from samples where status = 'F'
                  group by lat, lon, d) c
         on c.lat = s.lat and c.lon = s.lon and c.d = s.d""",
)
def j1(v):
    keys = ["lat", "lon", "d"]
    samples = v.samples()
    bands = samples.select("sample_id", *keys).join(
        v.bands().select("sample_id", "red", "nir"), "sample_id"
    ).drop("sample_id")
    climate = samples.filter("status = 'F'").groupBy(*keys).agg(F.count("*").alias("rows_there"))
    return joins.enrich(samples.select("sample_id", *keys), [bands, climate], keys)


@query(
    "j1_duplicate_keys",
    """select lat, lon, d, count(*) as rows from samples group by lat, lon, d having count(*) > 1""",
)
def j1_duplicates(v):
    return joins.duplicate_keys(v.samples(), ["lat", "lon", "d"])


@query(
    "j2_fuse",
    """select a.sample_id, round(a.lat, 6) as lat, round(a.lon, 6) as lon,
              strftime(a.d, '%Y-%m-%d') as d, a.ta, b.status
       from samples a join samples b on b.lat = a.lat and b.lon = a.lon and b.d = a.d
       where a.cat is not null""",
)
def j2(v):
    left = v.samples().filter("cat is not null").select("sample_id", "lat", "lon", "d", "ta")
    right = v.samples().select("sample_id", "lat", "lon", "d", "ta", "ec", "status")
    return joins.fuse(left, right, ("lat", "lon", "d"), targets=["ec"])


@query(
    "j3_join_places",
    """select s.sample_id, round(s.lat, 6) as lat, round(s.lon, 6) as lon, p.best
       from samples s
       left join (select lat, lon, max(balance) as best from sites where segment <> 'BUILDING'
                  group by lat, lon) p on p.lat = s.lat and p.lon = s.lon""",
)
def j3(v):
    places = (
        v.sites().filter("segment <> 'BUILDING'").groupBy("lat", "lon")
        .agg(F.max("balance").alias("best"))
    )
    return joins.join_places(v.samples().select("sample_id", "lat", "lon"), places)


@query(
    "j4_month_value",
    """select s.sample_id, s.lat, s.lon, s.d, m.ndci from samples s
       left join (select lat, lon, date_trunc('month', d) as month, max(ec) as ndci from samples
                  where status = 'F' group by 1, 2, 3) m
         on m.lat = s.lat and m.lon = s.lon and m.month = date_trunc('month', s.d)""",
)
def j4(v):
    samples = v.samples()
    monthly = (
        samples.filter("status = 'F'")
        .groupBy("lat", "lon", F.trunc("d", "MM").alias("month"))
        .agg(F.max("ec").alias("ndci"))
    )
    return joins.map_month_value(
        samples.select("sample_id", "lat", "lon", "d"), monthly, "d", ["lat", "lon"]
    )


@query(
    "j5_unprocessed_months",
    """select distinct round(lat, 6) as lat, round(lon, 6) as lon,
              cast(date_trunc('month', d) as date) as month from samples
       except
       select round(lat, 6), round(lon, 6), cast(date_trunc('month', d) as date) from samples
       where status = 'F'""",
)
def j5(v):
    samples = v.samples()
    done = samples.filter("status = 'F'").select("lat", "lon", F.trunc("d", "MM").alias("month"))
    return joins.unprocessed_months(samples, done, "d")


@query(
    "j6_nearest_scene",
    """select o.obs_id, o.loc, o.ts, c.scene_id, c.scene_ts from obs o
       left join (select loc, scene_id, ts as scene_ts from scenes where cloud_cover < 10) c
         on c.loc = o.loc
       qualify row_number() over (partition by o.obs_id
               order by abs(epoch_us(o.ts) - epoch_us(c.scene_ts)), c.scene_ts, c.scene_id) = 1""",
)
def j6(v):
    clear = columns.clear_scenes(v.scenes(), 10.0).select(
        "loc", "scene_id", F.col("ts").alias("scene_ts")
    )
    return nearest.nearest_in_time(
        v.obs().select("obs_id", "loc", "ts"), clear, ["loc"], "ts", "scene_ts", "scene_id"
    )


HALF = 0.25


@query(
    "j7_box_overlap",
    f"""select p.lat, p.lon, s.scene_id from (select distinct lat, lon from sites) p
        join scenes s on p.lat - cast({HALF} as double) <= s.max_lat
          and s.min_lat <= p.lat + cast({HALF} as double)
          and p.lon - cast({HALF} as double) <= s.max_lon
          and s.min_lon <= p.lon + cast({HALF} as double)""",
)
def j7(v):
    places = v.sites().select("lat", "lon").distinct()
    scenes = v.scenes()
    footprint = Box(*(F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")))
    pairs = ranges.overlap_join(
        places, box_around(F.col("lat"), F.col("lon"), HALF), scenes, footprint, 1.0
    )
    return pairs.select("lat", "lon", "scene_id")


# Samples moved into the month of the scenes.
SHIFTED_SQL = """
    shifted as (select sample_id, lat, lon, status,
                       cast(date '2024-01-01' + cast(dayofyear(d) % 30 as int) as timestamp) as at
                from samples)"""


def shifted(v):
    return v.samples().select(
        "sample_id", "lat", "lon", "status",
        F.date_add(F.lit("2024-01-01").cast("date"), F.dayofyear("d") % 30)
        .cast("timestamp_ntz").alias("at"),
    )


def _covering_sql(half: str, scenes: str) -> str:
    return f"""p.lat - {half} <= {scenes}.max_lat and {scenes}.min_lat <= p.lat + {half}
          and p.lon - {half} <= {scenes}.max_lon and {scenes}.min_lon <= p.lon + {half}"""


BAND_HALF_SQL = "cast(0.00089831 as double) / 2"


def _scene_sql(scenes: str) -> str:
    return f"""with places as (select distinct lat, lon from samples),
       covering as (select p.lat, p.lon, s.scene_id, s.ts as scene_ts from places p
         join scenes s on s.cloud_cover < 10 and {scenes} and {_covering_sql(BAND_HALF_SQL, 's')}),
       {SHIFTED_SQL}
       select s.sample_id, s.at, c.scene_id from shifted s
       left join covering c on c.lat = s.lat and c.lon = s.lon
       qualify row_number() over (partition by s.sample_id
               order by abs(epoch_us(s.at) - epoch_us(c.scene_ts)), c.scene_ts, c.scene_id) = 1"""


@query("j7_j6_scene_per_sample", _scene_sql("true"))
def scene_per_sample(v):
    found = enrichment.scene_per_sample(shifted(v), v.scenes(), "at")
    return found.select("sample_id", "at", "scene_id")


@query(
    "j7_j6_scene_in_period",
    _scene_sql("s.ts >= timestamp '2024-01-08' and s.ts < timestamp '2024-01-21'"),
)
def scene_in_period(v):
    found = enrichment.scene_per_sample(
        shifted(v), v.scenes(), "at", period=("2024-01-08", "2024-01-20")
    )
    return found.select("sample_id", "at", "scene_id")


@query(
    "j7_j6_scene_within_days",
    f"""with {SHIFTED_SQL},
        asked as (select distinct lat, lon, shifted.at from shifted),
        hit as (
          select p.lat, p.lon, p.at, s.scene_id from asked p
          join scenes s on s.cloud_cover < 10
           and abs(epoch_us(p.at) - epoch_us(s.ts)) <= 2 * 86400000000 and {_covering_sql(BAND_HALF_SQL, 's')}
          qualify row_number() over (partition by p.lat, p.lon, p.at
                  order by abs(epoch_us(p.at) - epoch_us(s.ts)), s.ts, s.scene_id) = 1)
        select s.sample_id, s.at, h.scene_id from shifted s
        left join hit h on h.lat = s.lat and h.lon = s.lon and h.at = s.at""",
)
def scene_within_days(v):
    found = enrichment.scene_within_days(shifted(v), v.scenes(), "at", 2)
    return found.select("sample_id", "at", "scene_id")


@query(
    "j7_monthly_ndci",
    f"""with {SHIFTED_SQL},
        months as (select lat, lon, date_trunc('month', shifted.at)::date as month, bool_or(status = 'F') as done
                   from shifted group by all),
        hit as (
          select p.lat, p.lon, p.month, s.scene_id from months p
          join scenes s on not p.done and s.cloud_cover < 30
           and date_trunc('month', s.ts)::date = p.month and {_covering_sql('cast(0.0001 as double)', 's')}
          qualify row_number() over (partition by p.lat, p.lon, p.month order by s.ts, s.scene_id) = 1),
        means as (
          select patch, avg(value) filter (band = 'nir') as up, avg(value) filter (band = 'red') as low
          from pixels group by patch),
        ratios as (
          select h.lat, h.lon, h.month, round((up - low) / nullif(up + low, 0), 9) as ndci
          from hit h join means m on m.patch = h.scene_id)
        select s.sample_id, m.done, r.ndci from shifted s
        left join months m on m.lat = s.lat and m.lon = s.lon and m.month = date_trunc('month', s.at)::date
        left join ratios r on r.lat = m.lat and r.lon = m.lon and r.month = m.month""",
)
def monthly_ndci(v):
    samples = shifted(v)
    month = F.trunc("at", "month").cast("date").alias("month")
    done = samples.filter("status = 'F'").select("lat", "lon", month).distinct()
    values = v.pixels().withColumnRenamed("patch", "scene_id")
    made = enrichment.monthly_ndci(samples, v.scenes(), values, "at", done, bands=("nir", "red"))
    # The rows of the run before, whose values are not at hand, are marked.
    both = made.withColumn("done", F.lit(False)).unionByName(
        done.select("*", F.lit(None).cast("double").alias("ndci"), F.lit(True).alias("done"))
    )
    out = enrichment.with_monthly(samples, both, "at", "done")
    out = enrichment.with_monthly(out, made, "at", "ndci")
    return out.select("sample_id", "done", F.round("ndci", 9).alias("ndci"))


@query(
    "j8_nearest_grid_cell",
    f"""with {NEAREST_CELL_SQL}
        select s.sample_id, s.lat, s.lon, s.d, g.ppt, g.tmax, g.pet from samples s
        join near_lat a on a.lat = s.lat join near_lon o on o.lon = s.lon join near_t t on t.d = s.d
        left join grid g on g.lat = a.glat and g.lon = o.glon and g.t = t.gt""",
)
def j8(v):
    samples = v.samples().select("sample_id", "lat", "lon", "d")
    return nearest.nearest_grid_cell(
        samples, v.grid(), ["ppt", "tmax", "pet"], LAT_AXIS, LON_AXIS, MONTHS
    )


NEAREST_STATION_SQL = """
    near as (select p.lat, p.lon, s.plat, s.plon,
             sqrt((radians(p.lat) - radians(s.plat)) * (radians(p.lat) - radians(s.plat))
                  + (radians(p.lon) - radians(s.plon)) * (radians(p.lon) - radians(s.plon))) as dist
             from (select distinct lat, lon from sites) p, stations s
             qualify row_number() over (partition by p.lat, p.lon order by
                (radians(p.lat) - radians(s.plat)) * (radians(p.lat) - radians(s.plat))
                + (radians(p.lon) - radians(s.plon)) * (radians(p.lon) - radians(s.plon)),
                s.plat, s.plon) = 1)"""


@query(
    "j9_nearest_point",
    f"""with {NEAREST_STATION_SQL}
        select s.site, n.plat, n.plon, round(n.dist, 9) as distance from sites s
        join near n on n.lat = s.lat and n.lon = s.lon""",
)
def j9(v):
    found = nearest.nearest_point(v.sites().select("site", "lat", "lon"), v.stations())
    return found.select("site", "plat", "plon", F.round("distance", 9).alias("distance"))


@query(
    "j9_nearest_point_and_time",
    f"""with {NEAREST_STATION_SQL}
        select s.sample_id, n.plat, n.plon, c.t, c.pet from samples s
        join near n on n.lat = s.lat and n.lon = s.lon
        left join station_series c on c.plat = n.plat and c.plon = n.plon
        qualify row_number() over (partition by s.sample_id order by abs(s.d - c.t), c.t) = 1""",
)
def j9_time(v):
    series = durable(v.station_series())  # aggregated once, then read several times
    found = nearest.nearest_point_and_time(
        v.samples().select("sample_id", "lat", "lon", "d"), series, ["pet"], "d", "t"
    )
    return found.select("sample_id", "plat", "plon", "t", "pet")


@query(
    "j10_lookup_unique",
    f"""with {NEAREST_STATION_SQL}
        select s.sample_id, n.plat, n.plon from samples s
        join near n on n.lat = s.lat and n.lon = s.lon""",
)
def j10(v):
    stations = v.stations()
    found = joins.lookup_unique(
        v.samples().select("sample_id", "lat", "lon"), ["lat", "lon"],
        lambda keys: nearest.nearest_point(keys, stations),
    )
    return found.select("sample_id", "plat", "plon")


@query(
    "enriched_samples",
    f"""with {ROLLED_SQL}, {NEAREST_CELL_SQL}
        select s.sample_id, s.d, g.ppt, g.ppt_3mo, g.ppt_6mo, round(g.tmax_3mo, 6) as tmax_3mo,
               g.tmax - g.tmin as T_range,
               (b.nir - b.swir16) / (b.nir + b.swir16 + 1e-10) as NDMI,
               (b.nir - b.red) / (b.nir + b.red + 1e-10) as NDVI,
               sqrt(b.blue * b.blue + b.green * b.green + b.red * b.red) as SI2,
               (b.red - b.nir) / (b.red + b.nir + 1e-6) as NDSI,
               cast(month(s.d) as int) as Month, cast(dayofyear(s.d) as int) as DayOfYear
        from samples s
        join near_lat a on a.lat = s.lat join near_lon o on o.lon = s.lon join near_t t on t.d = s.d
        left join rolled g on g.lat = a.glat and g.lon = o.glon and g.t = t.gt
        left join bands b on b.sample_id = s.sample_id""",
)
def enriched_samples(v):
    return enriched(v).select(
        "sample_id", "d", "ppt", "ppt_3mo", "ppt_6mo", F.round("tmax_3mo", 6).alias("tmax_3mo"),
        "T_range", "NDMI", "NDVI", "SI2", "NDSI", "Month", "DayOfYear",
    )


def enriched(v):
    """All features of all samples; the training table of the model queries."""
    samples = v.samples().select("sample_id", "site", "lat", "lon", "d", "ta", "ec", "drp", "cat")
    return enrichment.feature_table(
        samples, v.bands(), v.grid(), ["ppt", "tmax", "tmin", "pet", "soil", "def"],
        ["sample_id"], LAT_AXIS, LON_AXIS, MONTHS,
    )


TERRAIN_SQL = """
    gradient as (select patch,
         case when lag(c) over x is not null and lead(c) over x is not null
              then (lead(value) over x - lag(value) over x) / 2
              when lead(c) over x is not null then lead(value) over x - value
              else value - lag(value) over x end as gx,
         case when lag(r) over y is not null and lead(r) over y is not null
              then (lead(value) over y - lag(value) over y) / 2
              when lead(r) over y is not null then lead(value) over y - value
              else value - lag(value) over y end as gy
       from (select patch, r, c, value * 100 as value from pixels)
       window x as (partition by patch, r order by c), y as (partition by patch, c order by r)),
    slope as (select patch, avg(degrees(atan(sqrt(gx * gx + gy * gy) / 30))) as topographic_slope
              from gradient group by patch)"""


@query(
    "training_table",
    f"""with {SHIFTED_SQL}, {NEAREST_CELL_SQL}, {TERRAIN_SQL},
        cover as (select patch, count(*) filter (class > 0) as n, count(*) filter (class = 40) as agri,
                         count(*) filter (class = 50) as urban, count(*) filter (class = 30) as grass,
                         count(*) filter (class = 10) as forest, count(*) filter (class = 60) as barren
                  from pixels group by patch),
        months as (select distinct lat, lon, date_trunc('month', shifted.at)::date as month from shifted),
        hit as (
          select p.lat, p.lon, p.month, s.scene_id from months p
          join scenes s on s.cloud_cover < 30
           and date_trunc('month', s.ts)::date = p.month and {_covering_sql('cast(0.0001 as double)', 's')}
          qualify row_number() over (partition by p.lat, p.lon, p.month order by s.ts, s.scene_id) = 1),
        means as (select patch, avg(value) filter (band = 'nir') as up, avg(value) filter (band = 'red') as low
                  from pixels group by patch),
        ratios as (select h.lat, h.lon, h.month, (up - low) / nullif(up + low, 0) as ndci
                   from hit h join means m on m.patch = h.scene_id),
        wide as (
          select s.sample_id, s.d, g.ppt, b.red, b.green,
                 case when n = 0 then 0 else 100.0 * agri / n end as perc_agri,
                 case when n = 0 then 0 else 100.0 * urban / n end as perc_urban,
                 case when n = 0 then 0 else 100.0 * grass / n end as perc_grass,
                 case when n = 0 then 0 else 100.0 * forest / n end as perc_forest,
                 coalesce(100.0 * barren / nullif(n, 0), 0) as perc_barren, t.topographic_slope, r.ndci
          from samples s join shifted x on x.sample_id = s.sample_id
          join near_lat a on a.lat = s.lat join near_lon o on o.lon = s.lon join near_t q on q.d = s.d
          left join grid g on g.lat = a.glat and g.lon = o.glon and g.t = q.gt
          left join bands b on b.sample_id = s.sample_id
          left join cover c on c.patch = s.site left join slope t on t.patch = s.site
          left join ratios r on r.lat = s.lat and r.lon = s.lon and r.month = date_trunc('month', x.at)::date)
        select sample_id, round(perc_agri, 9) as perc_agri, round(perc_urban, 9) as perc_urban,
               round(perc_grass, 9) as perc_grass, round(perc_forest, 9) as perc_forest,
               round(perc_barren, 9) as perc_barren, round(topographic_slope, 6) as topographic_slope,
               round(ndci, 9) as ndci, cast(year(d) > 2008 as int) as post_2008,
               round(perc_urban * ppt, 6) as urban_precip_interaction,
               round(ndci * NDTI_OF_BANDS, 6) as ndci_turbidity_interaction
        from wide""".replace("NDTI_OF_BANDS", "((red - green) / (red + green + 1e-10))"),
)
def training(v):
    digits = dict.fromkeys(("perc_agri", "perc_urban", "perc_grass", "perc_forest", "perc_barren", "ndci"), 9)
    digits |= dict.fromkeys(("topographic_slope", "urban_precip_interaction", "ndci_turbidity_interaction"), 6)
    return training_table(v).select(
        "sample_id", "post_2008", *(F.round(c, n).alias(c) for c, n in digits.items())
    )


def training_table(v):
    """All features of all samples, those of the place and of the month too. Site ids stand for patches."""
    samples, pixels = shifted(v), v.pixels()
    places = enrichment.landscape(pixels, pixels.withColumn("value", F.col("value") * 100.0))
    monthly = enrichment.monthly_ndci(
        samples, v.scenes(), pixels.withColumnRenamed("patch", "scene_id"), "at", bands=("nir", "red")
    )
    features = enriched(v).withColumn("at", F.date_add(F.lit("2024-01-01").cast("date"), F.dayofyear("d") % 30))
    return enrichment.training_table(features, places.withColumnRenamed("patch", "site"), monthly, "at", ["site"])
