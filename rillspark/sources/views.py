"""The measurement tables, derived from the test tables.

``Views`` builds them with the DataFrame API; ``SQL_VIEWS`` says the same in ANSI SQL, which the
oracle queries put in front of their own text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.session import durable, tune

# Extent of the monthly cube below: 25 cells, 3 degrees by 4 degrees apart.
GRID_LAT0, GRID_LAT_STEP, GRID_ROWS = -22.05, -3.0, 5
GRID_LON0, GRID_LON_STEP, GRID_COLS = 15.25, 4.0, 5
GRID_FIRST, GRID_LAST = "1995-01-01", "2001-08-01"


def _lat(site):
    return F.lit(-22.0) - (site % 130).cast("double") / 10.0


def _lon(site):
    return F.lit(15.0) + (site % 17).cast("double")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.dir = sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that several steps read: written down when it is first asked for."""
        if name not in self._made:
            self._made[name] = durable(make())
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        # The files of a table are listed and its schema read once.
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    def sites(self) -> DataFrame:
        site = F.col("c_custkey")
        return self.table("customer").select(
            site.alias("site"),
            _lat(site).alias("lat"),
            _lon(site).alias("lon"),
            F.col("c_nationkey").alias("nation"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance"),
        )

    def samples(self) -> DataFrame:
        # Coordinates are a function of the site id, so no join with the sites is needed.
        site, price = F.col("o_custkey"), F.col("o_totalprice")
        return self.table("orders").select(
            F.col("o_orderkey").alias("sample_id"),
            site.alias("site"),
            _lat(site).alias("lat"),
            _lon(site).alias("lon"),
            F.col("o_orderdate").cast("date").alias("d"),
            F.date_format("o_orderdate", "dd-MM-yyyy").alias("date_text"),
            price.alias("ta"),
            F.when(F.col("o_orderstatus") != "P", price / 10.0).alias("ec"),
            F.when(F.col("o_orderpriority") != "5-LOW", price / 1000.0).alias("drp"),
            F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("cat"),
            F.col("o_orderstatus").alias("status"),
        )

    def bands(self) -> DataFrame:
        qty, price = F.col("l_quantity"), F.col("l_extendedprice")
        seen = F.max("l_discount") > 0.02
        return (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("sample_id"))
            .agg(
                F.when(seen, F.max(qty) * 200.0).alias("red"),
                F.when(seen, F.max(price) / 8.0).alias("green"),
                F.when(seen, F.min(price) / 8.0).alias("blue"),
                F.when(seen, F.max(price) / 4.0).alias("nir"),
                F.when(seen, F.min(qty) * 250.0).alias("swir16"),
                F.when(seen, F.min(qty) * 125.0 + F.max("l_tax") * 1000.0).alias("swir22"),
            )
        )

    def grid(self) -> DataFrame:
        month = F.trunc(F.col("o_orderdate").cast("date"), "MM")
        months = F.sequence(
            F.lit(GRID_FIRST).cast("date"),
            F.lit(GRID_LAST).cast("date"),
            F.expr("interval 1 month"),
        )
        cells = self.table("nation").select(
            F.col("n_nationkey").alias("cell"),
            (F.lit(GRID_LAT0) + F.floor(F.col("n_nationkey") / 5).cast("double") * GRID_LAT_STEP)
            .alias("lat"),
            (F.lit(GRID_LON0) + (F.col("n_nationkey") % 5).cast("double") * GRID_LON_STEP)
            .alias("lon"),
            F.explode(months).alias("t"),
        )
        price = F.col("o_totalprice")
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        monthly = (
            self.table("orders")
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").alias("cell"), month.alias("t"))
            .agg(
                F.sum(F.floor(price / 1000.0)).cast("double").alias("ppt"),
                (F.max(price) / 4.0).alias("tmax"),
                (F.min(price) / 4.0).alias("tmin"),
                ((F.max(price) + F.min(price)) / 2.0).alias("pet"),
                F.count("*").cast("double").alias("soil"),
                (F.max(price) - F.min(price)).alias("def"),
            )
        )
        return cells.join(monthly, ["cell", "t"], "left")

    def scenes(self) -> DataFrame:
        key = F.col("event_id")
        south = F.lit(-35.0) + (key * 7 % 1300).cast("double") / 100.0
        west = F.lit(15.0) + (key * 13 % 1700).cast("double") / 100.0
        return self.table("events").select(
            key.alias("scene_id"),
            F.col("user_id").alias("loc"),
            F.col("ts"),
            F.least(F.col("value"), F.lit(100.0)).alias("cloud_cover"),
            south.alias("min_lat"),
            (south + 1.0).alias("max_lat"),
            west.alias("min_lon"),
            (west + 1.0).alias("max_lon"),
        )

    def pixels(self) -> DataFrame:
        """8 x 8 patches; class 0 is nodata."""
        value = F.col("value")
        code = F.least((1 + F.floor(F.abs(value) * 40.0)) * 10, F.lit(90))
        return (
            self.table("embeddings")
            .select(F.col("vec_id").alias("patch"), F.posexplode("embedding").alias("pos", "v"))
            .select(
                "patch",
                F.floor(F.col("pos") / 8).cast("int").alias("r"),
                (F.col("pos") % 8).cast("int").alias("c"),
                F.element_at(F.array(*map(F.lit, ("red", "green", "nir", "swir16"))),
                             (F.col("pos") % 4 + 1).cast("int")).alias("band"),
                F.col("v").cast("double").alias("value"),
            )
            .withColumn(
                "class", F.when(F.abs(value) < 0.01, F.lit(0)).otherwise(code).cast("int")
            )
        )

    def obs(self) -> DataFrame:
        kind, value = F.col("event_type"), F.col("value")
        return self.table("events").select(
            F.col("event_id").alias("obs_id"),
            F.col("user_id").alias("loc"),
            "ts",
            F.col("ts").cast("date").alias("d"),
            F.when(kind != "error", value).alias("value"),
            F.when(kind.isin("view", "click"), value * 2.0).alias("flow"),
            kind.alias("kind"),
        )

    def stations(self) -> DataFrame:
        """Points that lie on no grid."""
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("station"),
            (F.lit(-35.0) + (key * 37 % 1300).cast("double") / 100.0).alias("plat"),
            (F.lit(15.0) + (key * 91 % 1700).cast("double") / 100.0).alias("plon"),
        )

    def station_series(self) -> DataFrame:
        """One row per station point and month."""
        monthly = (
            self.table("lineitem")
            .groupBy(
                F.col("l_suppkey").alias("station"),
                F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("t"),
            )
            .agg(F.max("l_quantity").alias("flow"), F.max("l_extendedprice").alias("pet"))
        )
        return (
            monthly.join(self.stations(), "station")
            .groupBy("plat", "plon", "t")
            .agg(F.max("flow").alias("flow"), F.max("pet").alias("pet"))
        )


SQL_VIEWS: dict[str, str] = {
    "sites": """
        select c_custkey as site, -22.0 - cast(c_custkey % 130 as double) / 10 as lat,
               15.0 + cast(c_custkey % 17 as double) as lon, c_nationkey as nation,
               c_mktsegment as segment, c_acctbal as balance
        from customer""",
    "samples": """
        select o_orderkey as sample_id, o_custkey as site,
               -22.0 - cast(o_custkey % 130 as double) / 10 as lat,
               15.0 + cast(o_custkey % 17 as double) as lon,
               cast(o_orderdate as date) as d, strftime(o_orderdate, '%d-%m-%Y') as date_text,
               o_totalprice as ta,
               case when o_orderstatus <> 'P' then o_totalprice / 10 end as ec,
               case when o_orderpriority <> '5-LOW' then o_totalprice / 1000 end as drp,
               case when o_orderpriority <> '3-MEDIUM' then o_orderpriority end as cat,
               o_orderstatus as status
        from orders""",
    "bands": """
        select l_orderkey as sample_id,
               case when max(l_discount) > cast(0.02 as double) then max(l_quantity) * 200 end as red,
               case when max(l_discount) > cast(0.02 as double) then max(l_extendedprice) / 8 end as green,
               case when max(l_discount) > cast(0.02 as double) then min(l_extendedprice) / 8 end as blue,
               case when max(l_discount) > cast(0.02 as double) then max(l_extendedprice) / 4 end as nir,
               case when max(l_discount) > cast(0.02 as double) then min(l_quantity) * 250 end as swir16,
               case when max(l_discount) > cast(0.02 as double)
                    then min(l_quantity) * 125 + max(l_tax) * 1000 end as swir22
        from lineitem group by l_orderkey""",
    "grid": """
        select n.n_nationkey as cell, m.t as t,
               cast(-22.05 as double) + cast(n.n_nationkey // 5 as double) * -3 as lat,
               cast(15.25 as double) + cast(n.n_nationkey % 5 as double) * 4 as lon,
               g.ppt, g.tmax, g.tmin, g.pet, g.soil, g.def
        from nation n
        cross join (select cast(unnest(generate_series(timestamp '1995-01-01',
                    timestamp '2001-08-01', interval 1 month)) as date) as t) m
        left join (
            select c_nationkey as cell, cast(date_trunc('month', o_orderdate) as date) as t,
                   cast(sum(floor(o_totalprice / 1000)) as double) as ppt,
                   max(o_totalprice) / 4 as tmax, min(o_totalprice) / 4 as tmin,
                   (max(o_totalprice) + min(o_totalprice)) / 2 as pet,
                   cast(count(*) as double) as soil, max(o_totalprice) - min(o_totalprice) as def
            from orders join customer on o_custkey = c_custkey group by 1, 2
        ) g on g.cell = n.n_nationkey and g.t = m.t""",
    "scenes": """
        select event_id as scene_id, user_id as loc, ts, least(value, 100) as cloud_cover,
               -35.0 + cast(event_id * 7 % 1300 as double) / 100 as min_lat,
               -35.0 + cast(event_id * 7 % 1300 as double) / 100 + 1 as max_lat,
               15.0 + cast(event_id * 13 % 1700 as double) / 100 as min_lon,
               15.0 + cast(event_id * 13 % 1700 as double) / 100 + 1 as max_lon
        from events""",
    "pixels": """
        select patch, cast(pos // 8 as int) as r, cast(pos % 8 as int) as c,
               ['red', 'green', 'nir', 'swir16'][pos % 4 + 1] as band, value,
               cast(case when abs(value) < cast(0.01 as double) then 0
                    else least((1 + floor(abs(value) * 40)) * 10, 90) end as int) as class
        from (select vec_id as patch, generate_subscripts(embedding, 1) - 1 as pos,
                     cast(unnest(embedding) as double) as value from embeddings)""",
    "obs": """
        select event_id as obs_id, user_id as loc, ts, cast(ts as date) as d,
               case when event_type <> 'error' then value end as value,
               case when event_type in ('view', 'click') then value * 2 end as flow,
               event_type as kind
        from events""",
    "stations": """
        select s_suppkey as station, -35.0 + cast(s_suppkey * 37 % 1300 as double) / 100 as plat,
               15.0 + cast(s_suppkey * 91 % 1700 as double) / 100 as plon
        from supplier""",
    "station_series": """
        select -35.0 + cast(l_suppkey * 37 % 1300 as double) / 100 as plat,
               15.0 + cast(l_suppkey * 91 % 1700 as double) / 100 as plon,
               cast(date_trunc('month', l_shipdate) as date) as t,
               max(l_quantity) as flow, max(l_extendedprice) as pet
        from lineitem group by 1, 2, 3""",
}


def with_views(sql: str) -> str:
    """Put the definitions of the views that ``sql`` uses in front of it."""
    used = [name for name in SQL_VIEWS if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{name} as ({SQL_VIEWS[name]})" for name in used)
    body = sql.strip()
    head = re.match(r"with(\s+recursive)?\s", body, re.IGNORECASE)
    if head:
        return f"with{head.group(1) or ''} {ctes},\n{body[head.end():]}"
    return f"with {ctes}\n{body}"
