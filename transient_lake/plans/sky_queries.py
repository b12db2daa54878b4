"""Registered sky queries: J1 (both modes), N16, J2, J3, C4-C7."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions.numeric import round_half_up

from ..functions import sky as fsky
from ..operators import sky
from ..session import scratch_path
from ..sources import sky_store
from ..sources import testdata as td
from .registry import register

# DuckDB haversine in arcsec, same operation order as functions.sky.
def _hav_sql(ra1, dec1, ra2, dec2, unit="3600"):
    return (f"degrees(asin(least(1.0, sqrt("
            f"sin(radians({dec2} - {dec1}) / 2) * sin(radians({dec2} - {dec1}) / 2) + "
            f"cos(radians({dec1})) * cos(radians({dec2})) * "
            f"sin(radians({ra2} - {ra1}) / 2) * sin(radians({ra2} - {ra1}) / 2)))) * 2) * {unit}")


_PAIR_SELECT = """
a.obj_id as obj_id_1, a.source as source_1, a.ra_deg as ra_deg_1, a.dec_deg as dec_deg_1, a.timestamp as timestamp_1,
b.obj_id as obj_id_2, b.source as source_2, b.ra_deg as ra_deg_2, b.dec_deg as dec_deg_2, b.timestamp as timestamp_2"""


def _round_sep(df):
    return df.withColumn("sep_arcsec", round_half_up("sep_arcsec", 6))


@register("crossmatch_exact", sql=f"""
select * from (
  select {_PAIR_SELECT}, {_hav_sql('a.ra_deg', 'a.dec_deg', 'b.ra_deg', 'b.dec_deg')} as sep
  from sky_alerts a join sky_alerts b
    on a.obj_id < b.obj_id and a.source <> b.source
   and b.dec_deg between a.dec_deg - 4.0 / 3600 and a.dec_deg + 4.0 / 3600)
where sep <= 4.0
""".replace("select * from", "select * exclude (sep), round(sep, 6) as sep_arcsec from"), views=("sky_alerts",))
def q_crossmatch_exact(spark, sf_dir):
    """J1 exact: every cross-survey pair of alerts within 4 arcsec."""
    return _round_sep(sky.crossmatch(td.sky_alerts(spark, sf_dir), 4.0))


_ACOS = ("degrees(acos(sin(radians(a.dec_deg)) * sin(radians(b.dec_deg)) + cos(radians(a.dec_deg)) * "
         "cos(radians(b.dec_deg)) * cos(radians(a.ra_deg - b.ra_deg)))) * 3600")


@register("crossmatch_decimal_bucket", sql=f"""
select * exclude (sep, hav), round(hav, 6) as sep_arcsec from (
  select {_PAIR_SELECT}, {_ACOS} as sep, {_hav_sql('a.ra_deg', 'a.dec_deg', 'b.ra_deg', 'b.dec_deg')} as hav
  from sky_alerts a join sky_alerts b
    on cast(a.dec_deg as decimal(10, 3)) = cast(b.dec_deg as decimal(10, 3))
  where a.obj_id < b.obj_id and a.source <> b.source)
where sep <= 4.0
""", views=("sky_alerts",))
def q_crossmatch_decimal_bucket(spark, sf_dir):
    """J1 legacy mode: decimal(10,3) dec bucket equality + arccos distance."""
    return _round_sep(sky.crossmatch(td.sky_alerts(spark, sf_dir), 4.0, mode="decimal_bucket"))


@register("split_pair", sql=f"""
with p as (
  select * from (
    select {_PAIR_SELECT}, {_hav_sql('a.ra_deg', 'a.dec_deg', 'b.ra_deg', 'b.dec_deg')} as sep
    from sky_alerts a join sky_alerts b
      on a.obj_id < b.obj_id and a.source <> b.source
     and b.dec_deg between a.dec_deg - 4.0 / 3600 and a.dec_deg + 4.0 / 3600)
  where sep <= 4.0)
select obj_id_1 as obj_id, source_1 as source, ra_deg_1 as ra_deg, dec_deg_1 as dec_deg, timestamp_1 as timestamp from p
union all
select obj_id_2, source_2, ra_deg_2, dec_deg_2, timestamp_2 from p
""", views=("sky_alerts",))
def q_split_pair(spark, sf_dir):
    """Matched pairs unpivoted into one detection row per side."""
    return sky.split_pair(sky.crossmatch(td.sky_alerts(spark, sf_dir), 4.0))


@register("cone_search", sql=f"""
select * exclude (d), round(d, 8) as distance_deg from (
  select c.cone_id, o.source_id as obj_name, o.ra_deg as ra, o.dec_deg as dec,
         {_hav_sql('c.ra', 'c.dec_c', 'o.ra_deg', 'o.dec_deg', unit='1')} as d, c.radius_arcsec / 3600.0 as r
  from cones c join objects o on o.dec_deg between c.dec_c - c.radius_arcsec / 3600.0
                                               and c.dec_c + c.radius_arcsec / 3600.0)
where d <= r
""".replace("exclude (d)", "exclude (d, r)"), views=("objects", "cones"))
def q_cone_search(spark, sf_dir):
    """All catalogue objects inside each of the cone requests."""
    out = sky.cone_search(td.objects(spark, sf_dir), td.cones(spark, sf_dir))
    return out.withColumn("distance_deg", round_half_up("distance_deg", 8))


@register("cone_search_store", sql=f"""
select * exclude (d, r), round(d, 8) as distance_deg from (
  select c.cone_id, o.source_id as obj_name, o.ra_deg as ra, o.dec_deg as dec,
         {_hav_sql('c.ra', 'c.dec_c', 'o.ra_deg', 'o.dec_deg', unit='1')} as d, c.radius_arcsec / 3600.0 as r
  from (select * from cones where cone_id % 5 = 0) c join objects o
    on o.dec_deg between c.dec_c - c.radius_arcsec / 3600.0 and c.dec_c + c.radius_arcsec / 3600.0)
where d <= r
""", views=("objects", "cones"))
def q_cone_search_store(spark, sf_dir):
    """Cones over objects that are stored by sky cell."""
    path = os.path.join(scratch_path(spark, "sky"), "objects")
    sky_store.write_objects(td.objects(spark, sf_dir).select("source_id", "ra_deg", "dec_deg"), path, cell_deg=15.0)
    out = sky_store.cone_search(spark, path, td.cones(spark, sf_dir).where("cone_id % 5 = 0"), cell_deg=15.0)
    return out.withColumn("distance_deg", round_half_up("distance_deg", 8))


_MIXED_RADIUS = "case when cone_id % 50 = 0 then 648000.0 when cone_id % 10 = 1 then 3600.0 else 1.0 end"


@register("cone_search_mixed", sql=f"""
select * exclude (d, r), round(d, 8) as distance_deg from (
  select c.cone_id, o.source_id as obj_name, o.ra_deg as ra, o.dec_deg as dec,
         {_hav_sql('c.ra', 'c.dec_c', 'o.ra_deg', 'o.dec_deg', unit='1')} as d, c.r / 3600.0 as r
  from (select *, ({_MIXED_RADIUS})::DOUBLE as r from cones) c join objects o
    on o.dec_deg between c.dec_c - c.r / 3600.0 and c.dec_c + c.r / 3600.0)
where d <= r
""", views=("objects", "cones"))
def q_cone_search_mixed(spark, sf_dir):
    """Whole-sky cones, cones of a degree and of an arcsecond in one request."""
    c = td.cones(spark, sf_dir).withColumn("radius_arcsec", F.expr(_MIXED_RADIUS).cast("double"))
    return sky.cone_search(td.objects(spark, sf_dir), c).withColumn("distance_deg", round_half_up("distance_deg", 8))


@register("nearest_match", sql=f"""
select obj_id, match_id, match_ra, match_dec, round(sep, 6) as sep_arcsec from (
  select z.obj_id, l.obj_id as match_id, l.ra_deg as match_ra, l.dec_deg as match_dec, s.sep,
         row_number() over (partition by z.obj_id order by s.sep, l.obj_id) as rn
  from sky_alerts z join sky_alerts l
    on z.source = 'ztf' and l.source = 'lsst'
   and l.dec_deg between z.dec_deg - 5.0 / 3600 and z.dec_deg + 5.0 / 3600,
  lateral (select {_hav_sql('z.ra_deg', 'z.dec_deg', 'l.ra_deg', 'l.dec_deg')} as sep) s
  where s.sep <= 5.0)
where rn = 1
""", views=("sky_alerts",))
def q_nearest_match(spark, sf_dir):
    """Nearest LSST counterpart within 5 arcsec of every ZTF alert."""
    a = td.sky_alerts(spark, sf_dir)
    out = sky.nearest_match(a.where("source = 'ztf'"), a.where("source = 'lsst'").withColumnRenamed("obj_id", "cat_id"),
                            5.0)
    return out.withColumn("sep_arcsec", round_half_up("sep_arcsec", 6))


def hms_sql(ra: str) -> str:
    u = f"(cast(round({ra} / 15.0 * 36000000) as bigint) % 864000000)"
    return (f"lpad(cast(({u} // 36000000) as varchar), 2, '0') || ':' || "
            f"lpad(cast((({u} % 36000000) // 600000) as varchar), 2, '0') || ':' || "
            f"lpad(cast((({u} % 600000) // 10000) as varchar), 2, '0') || '.' || lpad(cast(({u} % 10000) as varchar), 4, '0')")


def dms_sql(dec: str) -> str:
    v = f"cast(round(abs({dec}) * 36000000) as bigint)"
    return (f"(case when {dec} < 0 then '-' else '+' end) || "
            f"lpad(cast(({v} // 36000000) as varchar), 2, '0') || ':' || "
            f"lpad(cast((({v} % 36000000) // 600000) as varchar), 2, '0') || ':' || "
            f"lpad(cast((({v} % 600000) // 10000) as varchar), 2, '0') || '.' || lpad(cast(({v} % 10000) as varchar), 4, '0')")


@register("sexagesimal_format", sql=f"""
select archive_id, {hms_sql('ra_deg')} as ra_hms, {dms_sql('dec_deg')} as dec_dms from objects
""", views=("objects",))
def q_sexagesimal_format(spark, sf_dir):
    """Catalogue coordinates in sexagesimal notation."""
    o = td.objects(spark, sf_dir)
    return o.select("archive_id", fsky.deg_to_hms("ra_deg").alias("ra_hms"), fsky.deg_to_dms("dec_deg").alias("dec_dms"))


_TS_FROM_MJD = "epoch_ms(cast(round(({m} - 40587) * 86400000.0) as bigint))"


@register("normalise_alerts", sql=f"""
select 'ZTF' || obj_id as obj_id, 'ztf' as source, ra_deg, dec_deg,
       {_TS_FROM_MJD.format(m="(epoch_us(timestamp) / 86400000000.0 + 40587 + 2400000.5 - 2400000.5)")} as timestamp
from sky_alerts where source = 'ztf'
union all
select obj_id, 'lsst', ra_deg, dec_deg, {_TS_FROM_MJD.format(m="(epoch_us(timestamp) / 86400000000.0 + 40587)")}
from sky_alerts where source = 'lsst'
""", views=("sky_alerts",))
def q_normalise_alerts(spark, sf_dir):
    """N1 + N2: ZTF and LSST alert packets to detections (M1)."""
    return sky.normalise_ztf_alert(td.ztf_alerts(spark, sf_dir)).unionByName(
        sky.normalise_lsst_alert(td.lsst_alerts(spark, sf_dir)))


_SEX = r"^\s*([+-]?)\s*(\d+(?:\.\d*)?)[\s:]+(\d+(?:\.\d*)?)[\s:]+(\d+(?:\.\d*)?)\s*$"


def _parse_sql(t: str, hours: bool) -> str:
    g = [f"try_cast(regexp_extract({t}, '{_SEX}', {i}) as double)" for i in (2, 3, 4)]
    mag = f"({g[0]} + {g[1]} / 60.0 + {g[2]} / 3600.0)" + (" * 15.0" if hours else "")
    return (f"case when regexp_matches({t}, '{_SEX}') then (case when regexp_extract({t}, '{_SEX}', 1) = '-' "
            f"then -{mag} else {mag} end) else try_cast(trim({t}) as double) end")


@register("parse_coordinates", sql=f"""
with t as (
  select archive_id,
         case cast(source_id as bigint) % 3
           when 0 then replace({hms_sql('ra_deg')}, ':', ' ') || '  ' || replace({dms_sql('dec_deg')}, ':', ' ')
           when 1 then cast(ra_deg as varchar) || ', ' || cast(dec_deg as varchar)
           else cast(ra_deg as varchar) || ' ' || cast(dec_deg as varchar) end as text
  from objects),
s as (select archive_id, trim(text) as t, regexp_split_to_array(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ') as toks
      from t),
p as (select archive_id,
             case when contains(t, ',') then trim(split_part(t, ',', 1))
                  when len(toks) = 2 then toks[1] when len(toks) = 6 then array_to_string(toks[1:3], ' ') end as ra_txt,
             case when contains(t, ',') then trim(split_part(t, ',', 2))
                  when len(toks) = 2 then toks[2] when len(toks) = 6 then array_to_string(toks[4:6], ' ') end as dec_txt,
             contains(t, ',') or len(toks) = 2 as plain
      from s)
select archive_id, ra_txt, dec_txt,
       round(case when plain then try_cast(ra_txt as double) else {_parse_sql('ra_txt', True)} end, 8) as ra_deg,
       round({_parse_sql('dec_txt', False)}, 8) as dec_deg
from p
""", views=("objects",))
def q_parse_coordinates(spark, sf_dir):
    """C7 + C6: typed ``RA Dec`` text (sexagesimal with spaces, decimal with
    a comma or a space) split and parsed back to degrees."""
    o = td.objects(spark, sf_dir)
    n = F.col("source_id").cast("long") % 3
    sexa = F.concat(F.regexp_replace(fsky.deg_to_hms("ra_deg"), ":", " "), F.lit("  "),
                    F.regexp_replace(fsky.deg_to_dms("dec_deg"), ":", " "))
    text = (F.when(n == 0, sexa)
            .when(n == 1, F.concat(F.col("ra_deg").cast("string"), F.lit(", "), F.col("dec_deg").cast("string")))
            .otherwise(F.concat(F.col("ra_deg").cast("string"), F.lit(" "), F.col("dec_deg").cast("string"))))
    parts = o.select("archive_id", fsky.split_coordinates(text).alias("p"), (n != 0).alias("plain"))
    ra_txt, dec_txt = F.col("p")[0], F.col("p")[1]
    ra = F.when(F.col("plain"), ra_txt.try_cast("double")).otherwise(fsky.sexagesimal_to_deg(ra_txt, True))
    return parts.select("archive_id", ra_txt.alias("ra_txt"), dec_txt.alias("dec_txt"),
                        round_half_up(ra, 8).alias("ra_deg"),
                        round_half_up(fsky.sexagesimal_to_deg(dec_txt, False), 8).alias("dec_deg"))
