"""Registered light-curve queries: N3-N6, U1, F1/J5, A1-A5, A7/A8, W1-W5.

The oracles use window functions (row_number / lag), an independent
formulation of what the Spark side computes with min_by/max_by aggregates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_half_up

from ..operators import photometry as ph
from ..sources import testdata as td
from .registry import register

G = "obj_id, survey, filter"


def iso_sql(x: str) -> str:
    return f"strftime(epoch_ms(cast(round(({x} - 40587) * 86400000.0) as bigint)), '%Y-%m-%d %H:%M:%S.%g')"


PTS = "pts as (select * from lc_points where filter is not null and detection in (0, 1))"
ROW_ORDER = 'mag nulls last, mag_err nulls last, "limit" nulls last'

# W2 building blocks: deduplicated detections, first detection, valid
# non-detection, and the combined series S.
W2_CTES = f"""
with {PTS},
dd as (select * exclude (rn) from (
  select *, row_number() over (partition by {G}, mjd order by {ROW_ORDER}) as rn
  from pts where detection = 1) where rn = 1),
e as (select {G}, mjd as e_mjd, mag as e_mag from (
  select *, row_number() over (partition by {G} order by mjd) as r from dd) where r = 1),
v as (select {G}, mjd, "limit" as mag from (
  select n.*, row_number() over (partition by n.obj_id, n.survey, n.filter
                                 order by n.mjd desc, n.mag nulls last, n.mag_err nulls last, n."limit" nulls last) as r
  from pts n join e on n.obj_id = e.obj_id and n.survey = e.survey and n.filter = e.filter
  where n.detection = 0 and n.mjd <= e.e_mjd and n."limit" >= e.e_mag) where r = 1),
s as (select {G}, mjd, mag from dd
      union all
      select v.obj_id, v.survey, v.filter, v.mjd, v.mag from v join e using (obj_id, survey, filter)
      where v.mjd < e.e_mjd),
pk as (select {G}, round(mag, 8) as peak_mag from (
  select *, row_number() over (partition by {G} order by mag, mjd, mag_err nulls last, "limit" nulls last) as r
  from pts where detection = 1 and mag is not null) where r = 1),
rr as (select *, -((mag - lag(mag) over w) / (mjd - lag(mjd) over w)) as rate,
              row_number() over (partition by {G} order by mjd desc) as rk
       from s window w as (partition by {G} order by mjd))
"""


def _lc(spark, sf_dir):
    return td.lc_points(spark, sf_dir)


@register("peak_mags", sql=f"""
with {PTS}
select {G}, round(mag, 8) as peak_mag, mjd as peak_mjd, {iso_sql('mjd')} as date from (
  select *, row_number() over (partition by {G} order by mag, mjd, mag_err nulls last, "limit" nulls last) as rn
  from pts where detection = 1 and mag is not null) where rn = 1
""", views=("lc_points",))
def q_peak_mags(spark, sf_dir):
    """A1: brightest detection per (object, survey, filter)."""
    return ph.peak_mags(_lc(spark, sf_dir))


@register("latest_non_detections", sql=f"""
with {PTS}
select {G}, round("limit", 8) as mag, mjd, {iso_sql('mjd')} as date from (
  select *, row_number() over (partition by {G} order by mjd desc, {ROW_ORDER}) as rn
  from pts where detection = 0) where rn = 1
""", views=("lc_points",))
def q_latest_non_detections(spark, sf_dir):
    """A2: latest upper limit per (object, survey, filter)."""
    return ph.latest_non_detections(_lc(spark, sf_dir))


@register("latest_detections", sql=W2_CTES + f"""
select rr.obj_id, rr.survey, rr.filter, round(rr.mag, 8) as mag, pk.peak_mag, round(rr.rate, 6) as mag_rate,
       rr.mjd, {iso_sql('rr.mjd')} as date
from rr left join pk using (obj_id, survey, filter) where rr.rk = 1
""", views=("lc_points",))
def q_latest_detections(spark, sf_dir):
    """W2 + W4: latest detection, its rate of change and the peak."""
    return ph.latest_detections(_lc(spark, sf_dir))


@register("latest_detections_compat", sql=W2_CTES + f"""
select rr.obj_id, rr.survey, rr.filter, pk.peak_mag as mag, pk.peak_mag, round(rr.rate, 6) as mag_rate,
       rr.mjd, {iso_sql('rr.mjd')} as date
from rr left join pk using (obj_id, survey, filter) where rr.rk = 1
""", views=("lc_points",))
def q_latest_detections_compat(spark, sf_dir):
    """W4 with the reference's field layout (mag carries the peak, D3)."""
    return ph.latest_detections(_lc(spark, sf_dir), compat=True)


@register("latest_detections_nightly", sql=W2_CTES + f"""
, nm as (select {G}, floor(mjd) as night, avg(mag) as mean_mag from s group by all),
nr as (select *, -((mean_mag - lag(mean_mag) over w) / (night - lag(night) over w)) as rate,
              row_number() over (partition by {G} order by night desc) as rk
       from nm window w as (partition by {G} order by night))
select rr.obj_id, rr.survey, rr.filter, round(nr.mean_mag, 8) as mag, pk.peak_mag, round(nr.rate, 6) as mag_rate,
       rr.mjd, {iso_sql('rr.mjd')} as date
from rr join nr on rr.obj_id = nr.obj_id and rr.survey = nr.survey and rr.filter = nr.filter and nr.rk = 1
left join pk on rr.obj_id = pk.obj_id and rr.survey = pk.survey and rr.filter = pk.filter
where rr.rk = 1
""", views=("lc_points",))
def q_latest_detections_nightly(spark, sf_dir):
    """Rate of change on nightly means (the ATLAS mode)."""
    return ph.latest_detections(_lc(spark, sf_dir), nightly=True)


@register("nightly_means", sql=f"""
with {PTS}
select {G}, cast(floor(mjd) as bigint) as night, round(avg(mag), 6) as mean_mag, count(*) as n
from pts where detection = 1 group by all
""", views=("lc_points",))
def q_nightly_means(spark, sf_dir):
    """A3: mean detected magnitude per night."""
    return ph.nightly_means(_lc(spark, sf_dir)).withColumn("mean_mag", round_half_up("mean_mag", 6))


@register("detection_summary", sql="""
select obj_id, cast(count_if(detection = 1) as bigint) as n_detections,
       array_to_string(list_sort(list_distinct(list(upper(survey)))), ' + ') as surveys
from lc_points group by obj_id
""", views=("lc_points",))
def q_detection_summary(spark, sf_dir):
    """A4: detection count and contributing surveys per object."""
    return ph.detection_summary(_lc(spark, sf_dir))


@register("lightcurve_series", sql="""
select obj_id, survey, filter, cast(count_if(detection = 1) as bigint) as n_points, cast(count_if(detection = 0) as bigint) as n_limits,
       min(mjd) as mjd_first, max(mjd) as mjd_last,
       concat_ws(' ', upper(coalesce(survey, 'unknown')), coalesce(filter, 'Unknown')) as label
from lc_points
where mjd is not null and ((detection = 1 and mag is not null) or (detection = 0 and "limit" is not null))
group by all
""", views=("lc_points",))
def q_lightcurve_series(spark, sf_dir):
    """A5 + F8: plottable series per survey and band."""
    return ph.lightcurve_series(_lc(spark, sf_dir))


@register("lightcurve_points", sql="""
with p as (
  select obj_id, survey, filter, case when detection = 1 then 'detection' else 'limit' end as kind, mjd,
         case when detection = 1 then mag else "limit" end as value, case when detection = 1 then mag_err end as error
  from lc_points
  where mjd is not null and ((detection = 1 and mag is not null) or (detection = 0 and "limit" is not null)))
select *, row_number() over (partition by obj_id, survey, filter, kind
                             order by mjd nulls first, value nulls first, error nulls first) - 1 as position from p
""", views=("lc_points",))
def q_lightcurve_points(spark, sf_dir):
    """A5: the points of every plot series in time order."""
    return ph.lightcurve_points(_lc(spark, sf_dir))


@register("count_per_source", sql="""
select survey, cast(sum(n) as bigint) as lc_count, count(*) as n_objs, cast(count_if(det) as bigint) as n_with_detection from (
  select survey, obj_id, count(*) as n, max(detection = 1) as det from lc_points group by all)
group by survey
""", views=("lc_points",))
def q_count_per_source(spark, sf_dir):
    """Status counters per survey."""
    return ph.count_per_source(_lc(spark, sf_dir))


_M4 = 'obj_id, survey, filter, mjd, mag, mag_err, "limit", fwhm, detection, camera'


@register("normalise_ztf", sql="""
select * from (
  select obj_id, 'ztf' as survey,
         case cast("i:fid" as int) when 1 then 'g' when 2 then 'r' when 3 then 'i' end as filter,
         "i:jd" - 2400000.5 as mjd, "i:magpsf" as mag, "i:sigmapsf" as mag_err, "i:diffmaglim" as "limit",
         "i:fwhm" as fwhm,
         case "d:tag" when 'valid' then 1 when 'badquality' then -1 when 'upperlim' then 0 end as detection,
         'main' as camera
  from ztf_raw) where detection >= 0
""", views=("ztf_raw",))
def q_normalise_ztf(spark, sf_dir):
    """ZTF photometry to the common schema."""
    return ph.normalise_ztf_lc(td.ztf_raw(spark, sf_dir))


@register("normalise_asassn", sql="""
select obj_id, 'asas-sn' as survey, phot_filter as filter, jd - 2400000.5 as mjd,
       case when mag_err > 99 then null else mag end as mag,
       case when mag_err > 99 then null else mag_err end as mag_err,
       "limit", fwhm, case when mag_err > 99 then 0 else 1 end as detection, camera
from asassn_raw where quality is distinct from 'B'
""", views=("asassn_raw",))
def q_normalise_asassn(spark, sf_dir):
    """ASAS-SN photometry to the common schema."""
    return ph.normalise_asassn_lc(td.asassn_raw(spark, sf_dir))


_ATLAS = """
select obj_id, 'atlas' as survey, F as filter, MJD as mjd, sign(mag5sig) * abs(m) as mag, dm as mag_err,
       mag5sig as "limit", maj as fwhm,
       case when uJy / nullif(duJy, 0) is null then {null_det}
            when uJy / nullif(duJy, 0) < 5.0 then 0 else 1 end as detection,
       substr(Obs, 1, 2) as camera
from atlas_raw"""


@register("normalise_atlas", sql=f"""
with a as ({_ATLAS.format(null_det=0)})
select * from a where obj_id in (select obj_id from a group by obj_id having max(detection) = 1)
""", views=("atlas_raw",))
def q_normalise_atlas(spark, sf_dir):
    """ATLAS forced photometry to the common schema (objects with a
    detection only)."""
    return ph.normalise_atlas_lc(td.atlas_raw(spark, sf_dir))


@register("normalise_lsst", sql="""
select obj_id, 'lsst' as survey, "r:band" as filter, "r:midpointMjdTai" as mjd,
       round(case when "r:psfFlux" > 0 then log10("r:psfFlux") * -2.5 + 31.4 end, 6) as mag,
       round(abs("r:psfFluxErr" * 1.0857 / nullif("r:psfFlux", 0)), 6) as mag_err,
       cast(null as double) as "limit", cast(null as double) as fwhm, 1 as detection, 'main' as camera
from lsst_raw
""", views=("lsst_raw",))
def q_normalise_lsst(spark, sf_dir):
    """LSST fluxes to magnitudes."""
    lc = ph.normalise_lsst_lc(td.lsst_raw(spark, sf_dir))
    return lc.withColumn("mag", round_half_up("mag", 6)).withColumn("mag_err", round_half_up("mag_err", 6))


@register("cut_mjd_window", sql="""
with w as (select *, obj_id % 4 = 1 as x from mjd_windows)
select l.* from lc_points l join w using (obj_id)
where l.mjd between w.discovery_mjd - coalesce(w.prior_days, case when x then 7 else 30 end)
                and w.discovery_mjd + coalesce(w.active_days, case when x then 14 else 60 end)
""", views=("lc_points", "mjd_windows"))
def q_cut_mjd_window(spark, sf_dir):
    """F1 + J5: points inside each object's active window (settings, or the
    defaults of its source)."""
    source = F.when(F.col("obj_id") % 4 == 1, "xmatch").otherwise("tns")
    return ph.cut_mjd_window(_lc(spark, sf_dir), td.mjd_windows(spark, sf_dir).withColumn("source", source))


@register("dedupe_keep_first", sql=f"""
select * exclude (rn) from (
  select *, row_number() over (partition by {G}, mjd order by detection desc, {ROW_ORDER}) as rn from lc_points)
where rn = 1
""", views=("lc_points",))
def q_dedupe_keep_first(spark, sf_dir):
    """One point per (object, survey, filter, mjd), detections first."""
    lc = _lc(spark, sf_dir)
    return ph.dedupe_keep_first(lc, ["obj_id", "survey", "filter", "mjd"], "-detection", "mag", "mag_err", "limit")


@register("first_per_group", sql="""
select * exclude (rn) from (
  select *, row_number() over (partition by obj_id order by mjd, survey nulls last, filter nulls last, mag nulls last) as rn from lc_points)
where rn = 1
""", views=("lc_points",))
def q_first_per_group(spark, sf_dir):
    """The earliest point of each object."""
    return ph.first_per_group(_lc(spark, sf_dir), ["obj_id"], "mjd", "survey", "filter", "mag")


@register("lightcurve_ingest", sql=f"""
with z as (
  select * from (
    select obj_id, 'ztf' as survey,
           case cast("i:fid" as int) when 1 then 'g' when 2 then 'r' when 3 then 'i' end as filter,
           "i:jd" - 2400000.5 as mjd, "i:magpsf" as mag,
           case "d:tag" when 'valid' then 1 when 'badquality' then -1 when 'upperlim' then 0 end as detection
    from ztf_raw) where detection >= 0),
s as (select obj_id, 'asas-sn' as survey, phot_filter as filter, jd - 2400000.5 as mjd,
             case when mag_err > 99 then null else mag end as mag, case when mag_err > 99 then 0 else 1 end as detection
      from asassn_raw where quality is distinct from 'B'),
a0 as (select obj_id, 'atlas' as survey, F as filter, MJD as mjd, sign(mag5sig) * abs(m) as mag,
              case when uJy / nullif(duJy, 0) is null then 0 when uJy / nullif(duJy, 0) < 5.0 then 0 else 1 end
              as detection from atlas_raw),
a as (select * from a0 where obj_id in (select obj_id from a0 group by obj_id having max(detection) = 1)),
l as (select obj_id, 'lsst' as survey, "r:band" as filter, "r:midpointMjdTai" as mjd,
             case when "r:psfFlux" > 0 then log10("r:psfFlux") * -2.5 + 31.4 end as mag, 1 as detection
      from lsst_raw),
u as (select * from z union all select * from s union all select * from a union all select * from l)
select u.survey, count(*) as n_points, count(distinct u.obj_id) as n_objects,
       cast(count_if(u.detection = 1) as bigint) as n_detections, round(min(u.mag), 6) as min_mag
from u join mjd_windows w using (obj_id)
where u.mjd between w.discovery_mjd - coalesce(w.prior_days, 30) and w.discovery_mjd + coalesce(w.active_days, 60)
group by u.survey
""", views=("ztf_raw", "asassn_raw", "atlas_raw", "lsst_raw", "mjd_windows"))
def q_lightcurve_ingest(spark, sf_dir):
    """U1 + N3-N6 + F1: all four surveys normalised, unioned and cut to the
    active windows; per-survey status counters."""
    lc = ph.union_lightcurves(
        ph.normalise_ztf_lc(td.ztf_raw(spark, sf_dir)), ph.normalise_asassn_lc(td.asassn_raw(spark, sf_dir)),
        ph.normalise_atlas_lc(td.atlas_raw(spark, sf_dir)), ph.normalise_lsst_lc(td.lsst_raw(spark, sf_dir)))
    cut = ph.cut_mjd_window(lc, td.mjd_windows(spark, sf_dir))
    return cut.groupBy("survey").agg(
        F.count("*").alias("n_points"), F.countDistinct("obj_id").alias("n_objects"),
        F.expr("count_if(detection = 1)").alias("n_detections"), round_half_up(F.min("mag"), 6).alias("min_mag"))
