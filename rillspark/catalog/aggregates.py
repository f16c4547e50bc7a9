"""Aggregations, rankings, metrics, rasters and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.catalog import query
from rillspark.catalog.preparation import LABELLED_SQL, marked, split_sql
from rillspark.operators import metrics, prep, stats, triage, zonal
from rillspark.session import durable

BANDS = ["red", "green", "nir", "swir16"]
COLUMNS = ["red", "green", "blue", "nir", "swir16", "swir22"]


def _rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "a1_band_medians",
    """select patch, """
    + ", ".join(
        f"nullif(round(median(value) filter (band = '{b}'), 9), 0) as {b}" for b in BANDS
    )
    + " from pixels group by patch",
)
def a1(v):
    return _rounded(zonal.band_medians(v.pixels(), ["patch"], BANDS), **dict.fromkeys(BANDS, 9))


@query(
    "a2_class_shares",
    """select patch, round(case when n = 0 then 0 else 100.0 * agri / n end, 9) as perc_agri,
              round(case when n = 0 then 0 else 100.0 * urban / n end, 9) as perc_urban,
              round(case when n = 0 then 0 else 100.0 * grass / n end, 9) as perc_grass,
              round(case when n = 0 then 0 else 100.0 * forest / n end, 9) as perc_forest
       from (select patch, count(*) filter (class > 0) as n, count(*) filter (class = 40) as agri,
                    count(*) filter (class = 50) as urban, count(*) filter (class = 30) as grass,
                    count(*) filter (class = 10) as forest from pixels group by patch)""",
)
def a2(v):
    shares = zonal.class_shares(v.pixels(), ["patch"])
    return _rounded(shares, **dict.fromkeys(zonal.LAND_COVER_CLASSES, 9))


@query(
    "a2_barren_per_site",
    """with b as (select patch, round(100.0 * count(*) filter (class = 60)
                     / nullif(count(*) filter (class > 0), 0), 9) as p from pixels group by patch)
       select site, coalesce(b.p, 0) as perc_barren from sites left join b on b.patch = site""",
)
def a2_barren(v):
    shares = zonal.class_shares(
        v.pixels().withColumnRenamed("patch", "site"), ["site"], zonal.BARREN_CLASS
    )
    return zonal.attach_patches(
        v.sites().select("site"), _rounded(shares, perc_barren=9), ["site"], 0.0
    )


@query(
    "a3_band_ratio",
    """select patch, round(nir, 9) as nir, round(red, 9) as red,
              round(case when nir + red <> 0 then (nir - red) / (nir + red) end, 5) as ndci
       from (select patch, avg(value) filter (band = 'nir') as nir,
                    avg(value) filter (band = 'red') as red from pixels group by patch)""",
)
def a3(v):
    return _rounded(zonal.band_ratio(v.pixels(), ["patch"], "nir", "red"), nir=9, red=9, ndci=5)


@query(
    "a4_region_mean",
    "select t, round(avg(ppt), 6) as ppt, round(avg(pet), 7) as pet from grid group by t",
)
def a4(v):
    return _rounded(stats.region_mean(v.grid(), "t", ["ppt", "pet"]), ppt=6, pet=7)


@query(
    "a6_distinct_counts",
    """select count(*) as rows, count(distinct site) as distinct_site, count(distinct d) as distinct_d,
              count(distinct cat) as distinct_cat from samples""",
)
def a6(v):
    return stats.distinct_counts(v.samples(), ["site", "d", "cat"])


def _per_column(select: str, source: str = "bands", columns=COLUMNS) -> str:
    return " union all ".join(
        f"select '{c}' as \"column\", {select.format(c=c)} from {source.format(c=c)}" for c in columns
    )


@query("a7_column_medians", _per_column("count({c}) as count, median({c}) as median"))
def a7(v):
    return stats.column_medians(durable(v.bands()), COLUMNS)


@query(
    "a8_column_moments",
    _per_column("round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as std"),
)
def a8(v):
    return _rounded(stats.column_moments(v.bands(), COLUMNS), mean=4, std=4)


@query(
    "a9_describe",
    _per_column(
        "count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, "
        "min({c}) as min, round(quantile_cont({c}, 0.25), 6) as q25, round(median({c}), 6) as q50, "
        "round(quantile_cont({c}, 0.75), 6) as q75, max({c}) as max"
    ),
)
def a9(v):
    return _rounded(stats.describe(durable(v.bands()), COLUMNS), mean=4, std=4, q25=6, q50=6, q75=6)


CORRELATED = ["red", "green", "swir22"]


@query(
    "a10_correlations",
    " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 8) as r from bands"
        for a in CORRELATED for b in CORRELATED
    ),
)
def a10(v):
    return _rounded(stats.correlations(v.bands(), [*CORRELATED, "ndre"]), r=8)


@query(
    "a11_log_distribution",
    _per_column(
        "min({c}) as lowest, count({c}) as count, round(avg(ln(1 + {c} - low + 1)), 7) as mean, "
        "round(quantile_cont(ln(1 + {c} - low + 1), 0.25), 7) as q25, "
        "round(median(ln(1 + {c} - low + 1)), 7) as q50, "
        "round(quantile_cont(ln(1 + {c} - low + 1), 0.75), 7) as q75",
        "(select ta, ec, drp, min({c}) over () as low from samples)", ["ta", "ec", "drp"],
    ),
)
def a11(v):
    return _rounded(
        stats.log_distribution(v.samples(), ["ta", "ec", "drp"]), mean=7, q25=7, q50=7, q75=7
    )


# A predictor that SQL can express: the mean of the place in the training rows, else the overall
# one. Places are held out as a whole, so on the test side it is the overall mean.
BASELINE_SQL = f"""{LABELLED_SQL}, {split_sql('labelled')},
    means as (select site, avg(ec) as m from marked where split = 'train' group by site),
    overall as (select avg(ec) as m from marked where split = 'train'),
    scored as (select l.sample_id, l.site, l.lat, l.lon, l.split, l.ec as y,
                      coalesce(means.m, overall.m) as prediction, overall.m as flat
               from marked l left join means on means.site = l.site, overall)"""


def scored(v):
    rows = marked(v)
    flat = rows.filter("split = 'train'").agg(F.avg("ec")).scalar()
    return (
        prep.location_mean(rows, ["site"], "ec", "prediction")
        .withColumn("flat", flat)
        .withColumnRenamed("ec", "y")
    )


def _both_models(v):
    rows = scored(v)
    table = rows.select(
        "split", "y",
        F.inline(
            F.array(
                F.struct(F.lit("place mean").alias("model"), "prediction"),
                F.struct(F.lit("overall mean").alias("model"), F.col("flat").alias("prediction")),
            )
        ),
    )
    return metrics.regression_metrics(table, ["split", "model"], 3)


METRICS_SQL = f"""{BASELINE_SQL},
    long as (select split, 'place mean' as model, y, prediction from scored
             union all select split, 'overall mean', y, flat from scored),
    sums as (select split, model, count(*) as n, sum((y - prediction) * (y - prediction)) as res,
                    sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)) as part
             from long group by split, model),
    table_ as (select split, model, n,
                      case when round(1 - part, 7) = 0 then 0 else round(1 - part, 7) end as r2, round(sqrt(res / n), 4) as rmse,
                      round(1 - part * (n - 1) / (n - 3 - 1), 7) as adj_r2 from sums)"""


def _metric_table(v):
    table = _rounded(_both_models(v), r2=7, rmse=4, adj_r2=7)
    # The overall mean scores 0 on its own rows; make that 0.0 whatever the sign of its noise.
    return table.withColumn("r2", F.when(F.col("r2") == 0, F.lit(0.0)).otherwise(F.col("r2")))


@query("a12_regression_metrics", f"with {METRICS_SQL} select * from table_")
def a12(v):
    return _metric_table(v)


@query(
    "a13_best_model",
    f"""with {METRICS_SQL} select * from table_
        qualify row_number() over (partition by split order by rmse, model desc) = 1
        """,
)
def a13(v):
    best = metrics.best_per_group(
        _metric_table(v).withColumn("_score", F.struct(-F.col("rmse"), "model")), ["split"], "_score"
    )
    return best.drop("_score")


@query(
    "a14_class_counts", "select patch, class, count(*) as pixels from pixels group by patch, class"
)
def a14(v):
    return zonal.class_counts(v.pixels(), ["patch"])


@query(
    "a15_extent",
    f"""with {BASELINE_SQL} select split, round(least(min(y), min(prediction)), 5) as low,
               round(greatest(max(y), max(prediction)), 5) as high from scored group by split""",
)
def a15(v):
    return _rounded(metrics.extent(scored(v), ["split"]), low=5, high=5)


@query(
    "a16_run_counts",
    f"""with {LABELLED_SQL}, {split_sql('labelled')}
        select split, count(*) as rows, cast(3 as bigint) as features from marked group by split""",
)
def a16(v):
    return stats.run_counts(marked(v), ["red", "green", "swir22"])


@query(
    "w6_mean_slope",
    """with g as (select patch, r, c,
         case when lag(c) over x is not null and lead(c) over x is not null
              then (lead(value) over x - lag(value) over x) / 2
              when lead(c) over x is not null then lead(value) over x - value
              else value - lag(value) over x end as gx,
         case when lag(r) over y is not null and lead(r) over y is not null
              then (lead(value) over y - lag(value) over y) / 2
              when lead(r) over y is not null then lead(value) over y - value
              else value - lag(value) over y end as gy
       from (select patch, r, c, value * 100 as value from pixels)
       window x as (partition by patch, r order by c), y as (partition by patch, c order by r))
       select patch, round(avg(degrees(atan(sqrt(gx * gx + gy * gy) / 30))), 6) as topographic_slope
       from g group by patch""",
)
def w6(v):
    terrain = v.pixels().withColumn("value", F.col("value") * 100.0)
    return _rounded(zonal.mean_slope(terrain), topographic_slope=6)


TARGETS = ["ta", "ec", "drp"]
# How strongly each feature goes with each target.
LINKS_SQL = (
    "wide as (select s.ta, s.ec, s.drp, b.* from samples s join bands b on b.sample_id = s.sample_id),"
    "links as ("
    + " union all ".join(
        f"select '{t}' as target, '{c}' as feature, abs(round(corr({t}, {c}), 8)) as strength from wide"
        for t in TARGETS for c in COLUMNS
    )
    + ")"
)


def links(v):
    wide = v.samples().select("sample_id", *TARGETS).join(v.bands(), "sample_id")
    table = stats.correlations(wide, [*TARGETS, *COLUMNS])
    return table.filter(F.col("a").isin(TARGETS) & F.col("b").isin(COLUMNS)).select(
        F.col("a").alias("target"), F.col("b").alias("feature"),
        F.abs(F.round("r", 8)).alias("strength"),
    )


@query(
    "w7_rank_of_feature",
    f"""with {LINKS_SQL} select * from (select *, cast(row_number() over (partition by target
        order by strength desc, feature) as int) as rank from links) where feature in ('nir', 'red')""",
)
def w7(v):
    return metrics.rank_of(links(v), ["target"], "strength", "feature", ["nir", "red"])


@query(
    "o2_top_k_features",
    f"""with {LINKS_SQL} select *, cast(row_number() over (partition by target
        order by strength desc, feature) as int) as rank from links qualify rank <= 5""",
)
def o2(v):
    return metrics.top_k(links(v), ["target"], "strength", 5, ["feature"])


@query("o3_leaderboard", f"with {METRICS_SQL} select split, model, r2, rmse from table_ order by split, r2 desc")
def o3(v):
    return metrics.leaderboard(_metric_table(v), ["split"]).select("split", "model", "r2", "rmse")


@query(
    "m12_holdout_residuals",
    f"""with {BASELINE_SQL} select sample_id, lat, lon, y, round(prediction, 5) as prediction,
               round(abs(y - prediction), 5) as residual from scored where split = 'test'""",
)
def m12(v):
    held_out = scored(v).filter("split = 'test'")
    return _rounded(
        metrics.residuals(held_out, ["sample_id", "lat", "lon"]), prediction=5, residual=5
    )


@query(
    "r1_alerts",
    """select sample_id, coalesce(ec / 50 > 800, false) or coalesce(drp / 4 > 100, false) as alert
       from samples""",
)
def r1(v):
    rows = v.samples().select(
        "sample_id", (F.col("ec") / 50.0).alias("ec"), (F.col("drp") / 4.0).alias("drp")
    )
    return triage.with_alert(rows, "ec", "drp").select("sample_id", "alert")


@query(
    "r2_highest_risk_places",
    """with p as (select site, round(avg(ta), 6) as risk from samples group by site)
       select site, risk from p where risk >= (select quantile_cont(risk, 0.75) from p)""",
)
def r2(v):
    return triage.highest_risk_places(v.samples(), ["site"], "ta")

