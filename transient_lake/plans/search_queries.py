"""Registered search queries: F4, F5/ST4 (batch), F7, C10, T2/N17, T3, T1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_half_up

from ..functions import sky as fsky
from ..operators import catalogue as cat
from ..operators import search as S
from ..operators import sky
from ..session import checkpoint_dir
from ..sources import testdata as td
from .registry import register
from .sky_queries import _hav_sql, dms_sql, hms_sql

SEARCH = {
    "mags": [{"value": 15.0, "operator": "<"}, {"filter": "g", "operator": "="}],
    "limits": [{"mjd": 60330.0, "operator": ">"}, {"value": 19.5, "operator": ">="}],
}


@register("search_objects", sql="""
select obj_id from legacy_objects
where coalesce(len(list_filter(mags, lambda x: x.value < 15.0 and x.filter = 'g')) > 0, false)
  and coalesce(len(list_filter(limits, lambda x: x.mjd > 60330.0 and x.value >= 19.5)) > 0, false)
""", views=("lc_points", "legacy_objects"))
def q_search_objects(spark, sf_dir):
    """objects with a g detection brighter than 15 and a deep late limit."""
    return S.search_objects_long(td.legacy_rows(spark, sf_dir), SEARCH)


SEARCH_IN_LIKE = {
    "mags": [{"filter": ["r", "i"], "operator": "IN"}, {"value": 14.5, "operator": "<="}],
    "limits": [{"filter": "o%", "operator": "LIKE"}],
}


@register("search_objects_in_like", sql="""
select obj_id from legacy_objects
where coalesce(len(list_filter(mags, lambda x: x.filter in ('r', 'i') and x.value <= 14.5)) > 0, false)
  and coalesce(len(list_filter(limits, lambda x: x.filter like 'o%')) > 0, false)
""", views=("lc_points", "legacy_objects"))
def q_search_objects_in_like(spark, sf_dir):
    """F4 with the IN and LIKE operators."""
    return S.search_objects_long(td.legacy_rows(spark, sf_dir), SEARCH_IN_LIKE)


CONDITIONS = {
    "redshift": [{"source": "any", "value": 0.03, "operator": "<"}],
    "discovery_date": [{"source": "tns", "date_limit": "2024-01-10", "operator": ">"}],
    "discovery_source": [{"source": "tns", "value": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}],
    "latest_detection": [{"source": "atlas", "value": 21.5, "operator": "<"},
                         {"source": "any", "mag_rate": 0.3, "operator": ">"}],
}


@register("alert_conditions", sql="""
select obj_id from alert_docs
where coalesce(len(list_filter(redshift, lambda x: x.value < 0.03)) > 0, false)
  and coalesce(len(list_filter(list_filter(discovery_date, lambda x: x.source = 'tns'),
                               lambda x: not coalesce(cast(x.value as timestamp) > timestamp '2024-01-10', false))) = 0,
               false)
  and coalesce(len(list_filter(list_filter(discovery_source, lambda x: x.source = 'tns'),
                               lambda x: not coalesce(x.value in ('BUILDING', 'MACHINERY', 'AUTOMOBILE'), false))) = 0,
               false)
  and coalesce(len(list_filter(list_filter(latest_detection, lambda x: x.source = 'atlas'),
                               lambda x: not coalesce(x.value < 21.5, false))) = 0, false)
  and coalesce(len(list_filter(latest_detection, lambda x: x.mag_rate > 0.3)) > 0, false)
""", views=("lc_points", "alert_docs"))
def q_alert_conditions(spark, sf_dir):
    """F5/ST4 (batch form): documents meeting the monitoring conditions."""
    return S.match_alert_conditions_long(td.alert_rows(spark, sf_dir), CONDITIONS)


@register("validate_cones", sql="""
with r as (select *, try_cast(trim(ra) as double) as rv, try_cast(trim(dec) as double) as dv,
                  try_cast(trim(radius) as double) as sv,
                  (ra is null or trim(ra) = '') as rb, (dec is null or trim(dec) = '') as db,
                  (radius is null or trim(radius) = '') as sb from cone_requests),
e as (select *, case
   when rb and db and sb then null
   when rb or db or sb then 'missing:'
        || concat_ws(',', case when rb then 'ra' end, case when db then 'dec' end, case when sb then 'radius' end)
   when rv is null or dv is null or sv is null then 'not_a_number'
   when rv < 0 or rv > 360 then 'ra_out_of_range' when dv < -90 or dv > 90 then 'dec_out_of_range'
   when sv <= 0 then 'radius_not_positive'
   end as error from r)
select request_id, ra, dec, radius,
       case when not (rb and db and sb) and error is null then rv end as ra_deg,
       case when not (rb and db and sb) and error is null then dv end as dec_deg,
       case when not (rb and db and sb) and error is null then sv end as radius_arcsec,
       case when rb and db and sb then 'none' when error is not null then 'error' else 'ok' end as status, error
from e
""", views=("cone_requests",))
def q_validate_cones(spark, sf_dir):
    """cone requests parsed and checked, one code per failure."""
    return S.validate_cones(td.cone_requests(spark, sf_dir))


_SHORT = "regexp_replace(regexp_replace(cast(cast({x} as decimal(24, 6)) as varchar), '0+$', ''), '\\.$', '')"


@register("cone_links", sql=f"""
with q as (select cone_id, ra, dec_c, radius_arcsec,
                  printf('?ra=%.6f&dec=%.6f&radius=', ra, dec_c) || {_SHORT.format(x='radius_arcsec')} as query
           from cones)
select cone_id, query, try_cast(regexp_extract(query, '[?&]ra=([^&]*)', 1) as double) as ra_deg,
       try_cast(regexp_extract(query, '[?&]dec=([^&]*)', 1) as double) as dec_deg,
       try_cast(regexp_extract(query, '[?&]radius=([^&]*)', 1) as double) as radius_arcsec, 'ok' as status
from q
""", views=("cones",))
def q_cone_links(spark, sf_dir):
    """Cone -> shareable query string -> parsed back (round trip)."""
    c = td.cones(spark, sf_dir).select("cone_id", S.cone_query_string("ra", "dec_c", "radius_arcsec").alias("query"))
    return S.parse_cone_query(c).select("cone_id", "query", "ra_deg", "dec_deg", "radius_arcsec", "status")


@register("alerts_page", sql=f"""
select discovery_date, source_id as obj_name, object_type, {hms_sql('ra_deg')} as ra_hms, {dms_sql('dec_deg')} as dec_dms,
       redshift, reporting_group, 'ZTF' as discovery_source
from objects where source = 'tns'
order by discovery_date desc, source_id limit 25 offset 50
""", views=("objects",))
def q_alerts_page(spark, sf_dir):
    """The third page (25 rows) of the TNS alert list, read from
    assembled source-keyed documents (J4)."""
    o = td.objects(spark, sf_dir)
    env = o.select("source_id", "source", "discovery_date", fsky.deg_to_hms("ra_deg").alias("ra_hms"),
                   fsky.deg_to_dms("dec_deg").alias("dec_dms"))
    tns = o.select("source_id", "object_type", "redshift", "reporting_group",
                   F.lit("ZTF").alias("discovery_data_source"))
    meta = cat.assemble_metadata(env, {"tns": tns}, key="source_id")
    return S.alerts_page(meta, 25, 50)


@register("alerts_page_keyset", sql=f"""
select discovery_date, source_id as obj_name, object_type, {hms_sql('ra_deg')} as ra_hms, {dms_sql('dec_deg')} as dec_dms,
       redshift, reporting_group, 'ZTF' as discovery_source
from objects where source = 'tns'
order by discovery_date desc, source_id limit 25 offset 75
""", views=("objects",))
def q_alerts_page_keyset(spark, sf_dir):
    """The fourth page by the cursor that the third one ends with."""
    o = td.objects(spark, sf_dir)
    tns = o.select("source_id", "object_type", "redshift", "reporting_group", F.lit("ZTF").alias("discovery_data_source"))
    meta = cat.assemble_metadata(o.select("source_id", "source", "discovery_date", fsky.deg_to_hms("ra_deg").alias("ra_hms"),
                                          fsky.deg_to_dms("dec_deg").alias("dec_dms")), {"tns": tns}, key="source_id")
    last = S.alerts_page(meta, 25, 50).orderBy("discovery_date", F.desc("obj_name")).first()
    return S.alerts_page(meta, 25, after=(last["discovery_date"], last["obj_name"]))


@register("cone_page", sql=f"""
with hits as (
  select * exclude (d, r), round(d, 8) as distance_deg from (
    select c.cone_id, o.source_id as obj_name, o.ra_deg as ra, o.dec_deg as dec,
           {_hav_sql('c.ra', 'c.dec_c', 'o.ra_deg', 'o.dec_deg', unit='1')} as d, c.radius_arcsec / 3600.0 as r
    from cones c join objects o on o.dec_deg between c.dec_c - c.radius_arcsec / 3600.0
                                                 and c.dec_c + c.radius_arcsec / 3600.0)
  where d <= r),
ranked as (select *, row_number() over (partition by cone_id order by distance_deg, obj_name) as rank,
                  greatest(1, cast(ceil(count(*) over (partition by cone_id) / 20.0) as bigint)) as n_pages from hits)
select * from ranked where rank > 20 and rank <= 40
""", views=("objects", "cones"))
def q_cone_page(spark, sf_dir):
    """T3 + T1: page 2 (20 per page) of every cone's hits, nearest first,
    with each cone's page count."""
    checkpoint_dir(spark)
    objects, cones = td.objects(spark, sf_dir), td.cones(spark, sf_dir)

    def hits(of):
        return sky.cone_search(objects, of).withColumn("distance_deg", round_half_up("distance_deg", 8))
    # all hits are counted, whole cells of them at once; those that can be on the page are found in cones cut to their reach
    counts = S.page_reach(sky.cone_cells(objects, cones), page=2, size=20, rows="n").checkpoint()
    cut = cones.join(counts, "cone_id").withColumn(
        "radius_arcsec", F.least("radius_arcsec", (F.col("reach") + 1e-8) * 3600.0)).select(*cones.columns)
    return S.page_slice(hits(cut), page=2, size=20, counts=counts)
