"""Encoding, splits and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.catalog import query
from rillspark.operators import prep, split
from rillspark.session import durable

FEATURES = ["red", "green", "swir22"]


def split_sql(source: str, group: str = "site", fraction: str = "0.2", name: str = "marked") -> str:
    """CTEs that mark whole groups as test, in the order of md5(42_group)."""
    return f"""
    test_groups as (select {group} from (select distinct {group} from {source})
        qualify row_number() over (order by md5('42_' || cast({group} as varchar)))
             <= ceil(cast({fraction} as double) * count(*) over ())),
    {name} as (select *, case when {group} in (select {group} from test_groups) then 'test'
                    else 'train' end as split from {source})"""


LABELLED_SQL = """
    labelled as (select s.sample_id, s.site, s.lat, s.lon, s.ec, b.red, b.green, b.swir22
                 from samples s left join bands b on b.sample_id = s.sample_id
                 where s.ec is not null)"""


def labelled(v):
    return (
        v.samples().select("sample_id", "site", "lat", "lon", "ec").filter("ec is not null")
        .join(v.bands().select("sample_id", *FEATURES), "sample_id", "left")
    )


def marked(v):
    return split.group_split(labelled(v), ["site"])


@query(
    "e1_one_hot",
    """select sample_id, cast(coalesce(cat = '2-HIGH', false) as int) as "cat_2-HIGH",
              cast(coalesce(cat = '4-NOT SPECIFIED', false) as int) as "cat_4-NOT SPECIFIED",
              cast(coalesce(cat = '5-LOW', false) as int) as "cat_5-LOW" from samples""",
)
def e1(v):
    return prep.one_hot(v.samples().select("sample_id", "cat"))


@query(
    "e1_one_hot_sparse",
    """with c as (select distinct day as value from (select strftime(d, '%Y-%m-%d') as day from samples) where day is not null),
            p as (select value, row_number() over (order by value) - 2 as place from c)
       select s.sample_id, case when p.place >= 0 then p.place else -1 end as place,
              cast(case when p.place >= 0 then 1 else 0 end as double) as entries, (select count(*) - 1 from c) as width
       from samples s left join p on p.value = strftime(s.d, '%Y-%m-%d')""",
)
def e1_sparse(v):
    days = v.samples().select("sample_id", F.date_format("d", "yyyy-MM-dd").alias("day"))
    made, _ = prep.one_hot_sparse(days)
    parts = F.unwrap_udt("encoded")
    return made.select(
        "sample_id",
        F.coalesce(F.try_element_at(parts["indices"], F.lit(1)), F.lit(-1)).cast("long").alias("place"),
        F.aggregate(parts["values"], F.lit(0.0), lambda a, x: a + x).alias("entries"),
        parts["size"].cast("long").alias("width"),
    )


@query(
    "e2_factorize",
    """select s.sample_id, coalesce(c.code, -1) as cat_code from samples s
       left join (select cat, row_number() over (order by min(sample_id)) - 1 as code
                  from samples where cat is not null group by cat) c on c.cat = s.cat""",
)
def e2(v):
    return prep.factorize(v.samples().select("sample_id", "cat"), "cat", "sample_id").drop("cat")


@query(
    "e3_label_encode",
    """select sample_id, dense_rank() over (order by coalesce(cat, 'nan')) - 1 as cat_code
       from samples""",
)
def e3(v):
    return prep.label_encode(v.samples().select("sample_id", "cat"), "cat").drop("cat")


@query(
    "e4_encode_all",
    """select sample_id, ta, cast(year(d) as int) as d_year, cast(month(d) as int) as d_month,
              cast(day(d) as int) as d_day, dense_rank() over (order by status) - 1 as status
       from samples""",
)
def e4(v):
    rows = v.samples().select("sample_id", "ta", "d", "status", F.array("ta").alias("raster"))
    return prep.encode_all(rows, ["ta"])


@query(
    "e5_impute_from_train",
    f"""with {LABELLED_SQL}, {split_sql('labelled')},
        m as (select median(red) as red, median(green) as green, median(swir22) as swir22
              from marked where split = 'train')
        select l.sample_id, l.split, coalesce(l.red, m.red) as red,
               coalesce(l.green, m.green) as green, coalesce(l.swir22, m.swir22) as swir22
        from marked l, m""",
)
def e5(v):
    rows = durable(marked(v))
    return prep.fit_on(rows, FEATURES).impute(rows).select("sample_id", "split", *FEATURES)


@query(
    "e6_impute_from_all",
    f"""with {LABELLED_SQL},
        m as (select median(red) as red, median(green) as green, median(swir22) as swir22
              from labelled)
        select l.sample_id, coalesce(l.red, m.red) as red,
               coalesce(l.green, m.green) as green, coalesce(l.swir22, m.swir22) as swir22
        from labelled l, m""",
)
def e6(v):
    rows = durable(labelled(v))
    return prep.fit_on(rows, FEATURES, "all").impute(rows).select("sample_id", *FEATURES)


@query(
    "e7_standardise",
    f"""with {LABELLED_SQL}, {split_sql('labelled')},
        m as (select median(red) as red, median(green) as green, median(swir22) as swir22
              from marked where split = 'train'),
        filled as (select l.sample_id, l.split, coalesce(l.red, m.red) as red,
                   coalesce(l.green, m.green) as green, coalesce(l.swir22, m.swir22) as swir22
                   from marked l, m),
        s as (select avg(red) as mr, stddev_pop(red) as sr, avg(green) as mg,
              stddev_pop(green) as sg, avg(swir22) as mw, stddev_pop(swir22) as sw
              from filled where split = 'train')
        select f.sample_id, f.split, round((f.red - s.mr) / s.sr, 7) as red,
               round((f.green - s.mg) / s.sg, 7) as green,
               round((f.swir22 - s.mw) / s.sw, 7) as swir22 from filled f, s""",
)
def e7(v):
    rows = durable(marked(v))
    scaled = prep.fit_on(rows, FEATURES).transform(rows)
    return scaled.select("sample_id", "split", *(F.round(c, 7).alias(c) for c in FEATURES))


def _random_sql(fraction: str) -> str:
    return f"""select sample_id, case when row_number() over (order by md5('42_' || cast(sample_id as varchar)))
               <= ceil(cast({fraction} as double) * count(*) over ()) then 'test' else 'train' end as split
               from samples"""


@query("e8_random_split", _random_sql("0.2"))
def e8(v):
    return split.random_split(v.samples().select("sample_id"), ["sample_id"])


@query("e8_random_split_70_30", _random_sql("0.3"))
def e8_70(v):
    return split.random_split(v.samples().select("sample_id"), ["sample_id"], 0.3)


@query(
    "e8_random_split_by_digest",
    """select sample_id, case when md5('42_' || cast(sample_id as varchar)) < '33333333'
              then 'test' else 'train' end as split from samples""",
)
def e8_digest(v):
    return split.random_split(v.samples().select("sample_id"), ["sample_id"], exact=False)


@query(
    "e9_group_split",
    f"with {split_sql('samples')} select sample_id, site, split from marked",
)
def e9(v):
    return split.group_split(v.samples().select("sample_id", "site"), ["site"])


@query(
    "e9_group_split_70_30",
    f"with {split_sql('samples', fraction='0.3')} select sample_id, site, split from marked",
)
def e9_70(v):
    return split.group_split(v.samples().select("sample_id", "site"), ["site"], 0.3)


@query(
    "e10_k_fold",
    """select sample_id, cast(('0x' || md5('42_' || cast(sample_id as varchar))[1:8])::bigint % 3 as int)
              as fold from samples""",
)
def e10(v):
    return split.k_fold(v.samples().select("sample_id"), ["sample_id"], 3)


@query(
    "e11_group_k_fold",
    """with recursive
       sizes as (select site, count(*) as n from samples group by site),
       ranked as (select site, n, row_number() over (order by n desc, site) as i from sizes),
       dealt as (
         select cast(0 as bigint) as i, cast(-1 as bigint) as site, -1 as fold,
                cast(0 as bigint) as a, cast(0 as bigint) as b, cast(0 as bigint) as c
         union all
         select r.i, r.site,
                case when d.a <= d.b and d.a <= d.c then 0 when d.b <= d.c then 1 else 2 end,
                d.a + case when d.a <= d.b and d.a <= d.c then r.n else 0 end,
                d.b + case when not (d.a <= d.b and d.a <= d.c) and d.b <= d.c then r.n else 0 end,
                d.c + case when not (d.a <= d.b and d.a <= d.c) and not d.b <= d.c then r.n else 0 end
         from dealt d join ranked r on r.i = d.i + 1)
       select s.sample_id, s.site, cast(d.fold as int) as fold from samples s
       join dealt d on d.site = s.site""",
)
def e11(v):
    return split.group_k_fold(v.samples().select("sample_id", "site"), ["site"], 3)


@query(
    "e12_location_mean",
    f"""with {LABELLED_SQL}, {split_sql('labelled')},
        means as (select site, avg(ec) as m from marked where split = 'train' group by site)
        select l.sample_id, l.split, round(coalesce(means.m,
               (select avg(ec) from marked where split = 'train')), 7) as loc_mean_cond
        from marked l left join means on means.site = l.site""",
)
def e12(v):
    rows = prep.location_mean(marked(v), ["site"], "ec", "loc_mean_cond")
    return rows.select("sample_id", "split", F.round("loc_mean_cond", 7).alias("loc_mean_cond"))


@query(
    "e13_sequential_split",
    """select obs_id, case when row_number() over (order by loc, ts)
              <= floor(count(*) over () * cast(0.8 as double)) then 'train' else 'test' end as split
       from obs""",
)
def e13(v):
    return split.sequential_split(v.obs().select("obs_id", "loc", "ts"), "loc", "ts").select(
        "obs_id", "split"
    )


@query(
    "e14_by_target",
    """select sample_id, 'ta' as target, ta as y from samples where ta is not null
       union all select sample_id, 'ec', ec from samples where ec is not null
       union all select sample_id, 'drp', drp from samples where drp is not null""",
)
def e14(v):
    rows = v.samples().select("sample_id", "ta", "ec", "drp")
    return prep.by_target(rows, ["sample_id"], ["ta", "ec", "drp"])


@query(
    "e15_no_leak",
    f"""with {split_sql('samples')}
        select count(*) as groups, count(*) filter (sides > 1) as groups_in_both
        from (select site, count(distinct split) as sides from marked group by site)""",
)
def e15(v):
    return split.groups_in_both(split.group_split(v.samples().select("site"), ["site"]), ["site"])
