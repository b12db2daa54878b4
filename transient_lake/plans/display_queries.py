"""Registered object-page, survey-metadata, retention and time queries:
N9-N12, N18-N22, A6, C1-C3, C8, C11-C14, C20, W7.

Documents are built in Spark as JSON payloads (the archive's own format)
and parsed back by the operators; the oracles compute the same answers
straight from the base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_half_up

from ..functions import time as T
from ..operators import display as D
from ..operators import retention as R
from ..operators import survey_meta as M
from ..sources import config as cfg
from ..sources import testdata as td
from .lc_queries import iso_sql
from .registry import register
from .sky_queries import _hav_sql

# presence of each survey payload (a peak exists) per light-curve object
_DOC_BASE = """
has as (select obj_id, max(survey = 'ztf' and detection = 1)::int as z, max(survey = 'atlas' and detection = 1)::int as a,
               max(survey = 'asas-sn' and detection = 1)::int as s, max(survey = 'lsst' and detection = 1)::int as l
        from lc_points group by obj_id),
c as (select c.c_custkey as archive_id, c.c_custkey, c.c_mktsegment, coalesce(h.z, 0) as z, coalesce(h.a, 0) as a,
             coalesce(h.s, 0) as s, coalesce(h.l, 0) as l, (c.c_custkey % 4 <> 0)::int as sh, (c.c_custkey % 7 = 0)::int as fk
      from customer c left join has h on h.obj_id = c.c_custkey)"""


@register("metadata_unpivot", sql=f"""
with {_DOC_BASE},
r as (
  select archive_id, 0 as source_pos, 'tns' as source, 'TNS' as source_label, 0 as field_pos, 'object_type' as field,
         'Object Type' as label, c_mktsegment as value from c
  union all select archive_id, 0, 'tns', 'TNS', 1, 'redshift', 'Redshift',
         case when c_custkey % 3 <> 0 then cast((c_custkey % 97 + 3) / 100.0::DOUBLE as varchar) else '—' end from c
  union all select archive_id, 0, 'tns', 'TNS', 2, 'hostname', 'Host Name',
         case when c_custkey % 2 = 0 then 'NGC' || cast(c_custkey as varchar) else '—' end from c
  union all select archive_id, 0, 'tns', 'TNS', 3, 'discovery_date', 'Discovery Date',
         '2024-01-' || lpad(cast(c_custkey % 28 + 1 as varchar), 2, '0') || 'T12:00:00' from c
  union all select archive_id, 0, 'tns', 'TNS', 4, 'reporting_group', 'Reporting Group', c_mktsegment from c
  union all select archive_id, 1 + z + a + s, 'sherlock', 'Lasair-Sherlock', 0, 'redshift', 'Redshift',
         cast((c_custkey % 50 + 2) / 1000.0::DOUBLE as varchar) from c where sh = 1
  union all select archive_id, 1 + z + a + s, 'sherlock', 'Lasair-Sherlock', 1, 'catalogue_object_id',
         'Catalogue Object ID', 'CAT' || cast(c_custkey as varchar) from c where sh = 1
  union all select archive_id, 1 + z + a + s, 'sherlock', 'Lasair-Sherlock', 2, 'best_distance', 'Best Distance',
         case when c_custkey % 10 = 5 then 'unknown' else cast((c_custkey % 900) / 10.0::DOUBLE + 1 as varchar) end
         from c where sh = 1
  union all select archive_id, 1 + z + a + s + sh, 'fink', 'Fink', 0, 'peak_mag', 'Peak Magnitude',
         '{{"mag":"junk","filter":"r"}}' from c where fk = 1)
select * from r
""", views=("lc_points",))
def q_metadata_unpivot(spark, sf_dir):
    """N18 + C14: scalar metadata rows per source, sources in display order."""
    return D.metadata_unpivot(td.meta_docs(spark, sf_dir))


_PEAKS = """
pts as (select * from lc_points where filter is not null and detection = 1 and mag is not null),
pk as (select obj_id, survey, filter, round(mag, 8) as peak_mag, mjd from (
  select *, row_number() over (partition by obj_id, survey, filter order by mag, mjd, mag_err nulls last, "limit" nulls last)
         as rn from pts) where rn = 1)"""


@register("list_field_rows", sql=f"""
with {_PEAKS},
e as (select obj_id as archive_id, case when survey = 'asas-sn' then 'asas_sn' else survey end as source, filter,
             peak_mag, {iso_sql('mjd')} as date,
             row_number() over (partition by obj_id, survey order by filter) - 1 as row from pk)
select archive_id, source, 'peak_mags' as field, 'Peak Magnitudes' as field_label, row, 0 as col_pos, 'filter' as column,
       'Filter' as column_label, filter as value from e
union all select archive_id, source, 'peak_mags', 'Peak Magnitudes', row, 1, 'limit', 'Magnitude',
       cast(peak_mag as varchar) from e
union all select archive_id, source, 'peak_mags', 'Peak Magnitudes', row, 2, 'date', 'Date', date from e
""", views=("lc_points",))
def q_list_field_rows(spark, sf_dir):
    """List-valued metadata (per-survey peak arrays) as long rows."""
    return D.list_field_rows(td.meta_docs(spark, sf_dir))


@register("brightest_across_sources", sql=f"""
with {_PEAKS}
select obj_id as archive_id, peak_mag, filter as peak_filter from (
  select *, row_number() over (partition by obj_id order by peak_mag,
         case when survey = 'asas-sn' then 'asas_sn' else survey end, filter) as rn from pk)
where rn = 1
""", views=("lc_points",))
def q_brightest_across_sources(spark, sf_dir):
    """Brightest peak over every source payload (unreadable ones skipped)."""
    return D.brightest_across_sources(td.meta_docs(spark, sf_dir))


@register("key_facts", sql=f"""
with {_PEAKS}, {_DOC_BASE.strip()},
best as (select obj_id, peak_mag, filter from (
  select *, row_number() over (partition by obj_id order by peak_mag,
         case when survey = 'asas-sn' then 'asas_sn' else survey end, filter) as rn from pk) where rn = 1),
det as (select obj_id, count_if(detection = 1) as n,
               array_to_string(list_sort(list_distinct(list(upper(survey)) filter (where detection = 1))), ' + ') as s
        from lc_points group by obj_id)
select c.archive_id,
       case when c_custkey % 3 <> 0 then printf('%.4g', (c_custkey % 97 + 3) / 100.0::DOUBLE)
            when sh = 1 then printf('%.4g', (c_custkey % 50 + 2) / 1000.0::DOUBLE) else '—' end as redshift,
       case when c_custkey % 2 = 0 then 'NGC' || cast(c_custkey as varchar)
            when sh = 1 then 'CAT' || cast(c_custkey as varchar) else '—' end as host,
       '2024-01-' || lpad(cast(c_custkey % 28 + 1 as varchar), 2, '0') as discovered,
       c_mktsegment as discovered_unit,
       case when sh = 0 then '—' when c_custkey % 10 = 5 then 'unknown'
            else printf('%.2f', (c_custkey % 900) / 10.0::DOUBLE + 1) end as distance,
       case when sh = 1 and c_custkey % 10 <> 5 then 'Mpc' end as distance_unit,
       coalesce(printf('%.1f', best.peak_mag), '—') as peak_mag, best.filter as peak_unit,
       coalesce(cast(det.n as varchar), '—') as detections, nullif(det.s, '') as detections_unit
from c left join best on best.obj_id = c.archive_id left join det on det.obj_id = c.archive_id
""", views=("lc_points",))
def q_key_facts(spark, sf_dir):
    """C11/C12/C20 + A4/A6: the six key facts of every object page."""
    return D.key_facts(td.meta_docs(spark, sf_dir), td.lc_points(spark, sf_dir))


@register("photometry_table", sql="""
select obj_id, mjd,
       case when detection = 1 then printf('%.2f', mag) else '> ' || printf('%.2f', "limit") end as magnitude,
       case when detection = 1 then 'detection' else 'upper limit' end as kind,
       case when filter in ('u', 'c', 'g', 'V', 'r', 'o', 'i', 'z', 'w') then filter else 'Unknown' end as band,
       upper(survey) as survey
from lc_points where mjd is not null and detection in (0, 1)
""", views=("lc_points",))
def q_photometry_table(spark, sf_dir):
    """N20 + C13: photometry table rows with canonical bands."""
    return D.photometry_table(td.lc_points(spark, sf_dir))


@register("canonical_band", sql="""
with f as (select distinct p_brand || '' as raw from part
           union all select * from (values ('R'), ('g_ASAS-SN'), ('y'), (' g '), ('Unknown')) t(raw))
select raw, case when c in ('u', 'c', 'g', 'V', 'r', 'o', 'i', 'z', 'w', 'Unknown') then c else 'Unknown' end as band
from (select raw, case when trim(raw) in ('u', 'c', 'g', 'V', 'r', 'o', 'i', 'z', 'w', 'Unknown') then trim(raw)
                       when trim(raw) = 'R' then 'r'
                       when trim(raw) in ('g_asas-sn', 'g_asas_sn') or lower(trim(raw)) in ('g_asas-sn', 'g_asas_sn') then 'g'
                       when trim(raw) = 'y' or lower(trim(raw)) = 'y' then 'z'
                       else trim(raw) end as c
      from f)
""")
def q_canonical_band(spark, sf_dir):
    """Raw filter names (part brands plus alias spellings) -> bands."""
    p = td.table(spark, sf_dir, "part").select(F.col("p_brand").alias("raw")).distinct()
    extra = spark.createDataFrame([("R",), ("g_ASAS-SN",), ("y",), (" g ",), ("Unknown",)], "raw string")
    return p.unionByName(extra).select("raw", D.canonical_band("raw").alias("band"))


@register("ztf_metadata", sql="""
with two as (select * from fink_ztf_rows union all select * replace ('same epoch' as "d:gcvs") from fink_ztf_rows),
newest as (select obj_id, arg_max({'classification': "d:classification", 'gcvs': "d:gcvs", 'tns': "d:tns"}, ("i:jd",
             -- Spark orders NULL first in a struct, DuckDB last
             coalesce('v' || "d:classification", ''), coalesce('v' || "d:gcvs", ''), coalesce('v' || "d:tns", ''))) as r
           from two group by obj_id),
kv as (select obj_id, 'classification' as key, r.classification as value from newest
       union all select obj_id, 'gcvs', r.gcvs from newest union all select obj_id, 'tns', r.tns from newest)
select obj_id, key, value from kv where value is not null and value not in ('nan', 'None')
union all select distinct obj_id, 'object_id', 'ZTF' || obj_id from fink_ztf_rows
union all select distinct obj_id, 'source_id_name', 'objectId' from fink_ztf_rows
""", views=("fink_ztf_rows",))
def q_ztf_metadata(spark, sf_dir):
    """Whitelisted fields of each object's newest ZTF row, of which there
    are two with one epoch (long form)."""
    rows = td.fink_ztf_rows(spark, sf_dir)
    rows = rows.unionByName(rows.withColumn("d:gcvs", F.lit("same epoch")))
    m = M.ztf_metadata(rows.withColumn("name", F.concat(F.lit("ZTF"), F.col("obj_id").cast("string"))), object_id="name")
    return m.select("obj_id", F.explode("meta").alias("key", "value"))


@register("lsst_metadata", sql="""
with newest as (select obj_id, arg_max({'classification': "f:classification", 'score': "f:score"},
                                       "r:midpointMjdTai") as r from lsst_meta_rows group by obj_id),
kv as (select obj_id, 'classification' as key, r.classification as value from newest
       union all select obj_id, 'score', r.score from newest)
select obj_id, key, value from kv where value is not null and value <> 'nan'
union all select distinct obj_id, 'object_id', cast(obj_id * 10 as varchar) from lsst_meta_rows
union all select distinct obj_id, 'source_id_name', 'diaObjectId' from lsst_meta_rows
union all select distinct obj_id, 'ra_deg', cast(obj_id % 360 as varchar) || '.0' from lsst_meta_rows
union all select distinct obj_id, 'dec_deg', cast(obj_id % 90 as varchar) || '.0' from lsst_meta_rows
""", views=("lsst_meta_rows",))
def q_lsst_metadata(spark, sf_dir):
    """``f:`` fields (no tns / version names) of each newest LSST row,
    with the survey's id and the object's position."""
    rows = td.lsst_meta_rows(spark, sf_dir).withColumn("name", F.col("obj_id") * 10)
    at = rows.select("obj_id").distinct().select("obj_id", (F.col("obj_id") % 360).cast("double").alias("ra_deg"),
                                                 (F.col("obj_id") % 90).cast("double").alias("dec_deg"))
    m = M.lsst_metadata(rows, object_id="name", position=at)
    return m.select("obj_id", F.explode("meta").alias("key", "value"))


@register("alerce_best_class", sql=f"""
with cls as (select * from (values ('lsst', '{cfg.ALERCE_CLASSIFIERS['lsst']}'), ('ztf', '{cfg.ALERCE_CLASSIFIERS['ztf']}'))
             t(survey, classifier_name)),
b as (select * from (
  select p.*, row_number() over (partition by oid, p.survey order by class_name, classifier_version,
         case when isnan(probability) then null else probability end desc nulls last) as rn
  from alerce_probabilities p join cls using (survey, classifier_name) where ranking = 1) where rn = 1)
select oid,
       max(case when survey = 'lsst' then classifier_name end) as lsst_classifier,
       max(case when survey = 'lsst' then class_name end) as lsst_class_name,
       max(case when survey = 'lsst' then case when isnan(probability) then null else probability end end) as lsst_class_prob,
       max(case when survey = 'lsst' then classifier_version end) as lsst_class_version,
       max(case when survey = 'ztf' then classifier_name end) as ztf_classifier,
       max(case when survey = 'ztf' then class_name end) as ztf_class_name,
       max(case when survey = 'ztf' then case when isnan(probability) then null else probability end end) as ztf_class_prob,
       max(case when survey = 'ztf' then classifier_version end) as ztf_class_version
from b group by oid
""", views=("alerce_probabilities",))
def q_alerce_best_class(spark, sf_dir):
    """Configured classifier's rank-1 class per survey, pivoted."""
    cls = spark.createDataFrame(sorted(cfg.ALERCE_CLASSIFIERS.items()), "survey string, classifier_name string")
    return M.alerce_best_class(td.alerce_probabilities(spark, sf_dir), cls)


@register("alerce_spm_features", sql="""
with f as (select oid, name, case when isnan(value) then null else value end as value, 'ZTF' as survey,
                  case fid when 1 then 'g' when 2 then 'r' when 3 then 'i' end as filter, fid, version
           from alerce_features where starts_with(name, 'SPM')),
v as (select oid, arg_min(version, (name, fid)) as feature_version from f group by oid)
select f.oid, f.name, f.value, f.survey, f.filter, v.feature_version from f join v using (oid)
""", views=("alerce_features",))
def q_alerce_spm_features(spark, sf_dir):
    """SPM features with bands and the object's feature version."""
    return M.alerce_spm_features(td.alerce_features(spark, sf_dir))


@register("atlas_metadata", sql="""
select obj_id, round(arg_min(RA, (MJD, RA, "Dec")), 6) as ra_deg, round(arg_min("Dec", (MJD, RA, "Dec")), 6) as dec_deg
from atlas_raw group by obj_id
""", views=("atlas_raw",))
def q_atlas_metadata(spark, sf_dir):
    """Each ATLAS object's position from its first row."""
    return M.atlas_metadata(td.atlas_raw(spark, sf_dir))


@register("antares_metadata", sql=f"""
with loci as (select obj_id as locus_id, ra_deg, dec_deg,
                     case when dec_deg > 0 then 'in_tns,north' else 'in_tns,south' end as tags from sky_alerts
              where source = 'lsst')
select obj_id, locus_id, ra_deg, dec_deg, round(sep, 6) as separation_arcsec, tags from (
  select z.obj_id, l.locus_id, l.ra_deg, l.dec_deg, l.tags, s.sep,
         row_number() over (partition by z.obj_id order by s.sep, l.locus_id) as rn
  from sky_alerts z join loci l on z.source = 'ztf'
   and l.dec_deg between z.dec_deg - 5.0 / 3600 and z.dec_deg + 5.0 / 3600,
  lateral (select {_hav_sql('z.ra_deg', 'z.dec_deg', 'l.ra_deg', 'l.dec_deg')} as sep) s
  where s.sep <= 5.0)
where rn = 1
""", views=("sky_alerts",))
def q_antares_metadata(spark, sf_dir):
    """Nearest broker locus (within 5 arcsec) with its tags."""
    a = td.sky_alerts(spark, sf_dir).where("source = 'ztf'")
    out = M.antares_metadata(a, td.antares_loci(spark, sf_dir))
    return out.withColumn("tags", F.array_join("tags", ","))


@register("snapshot_retention", sql="""
with f as (
  select path, regexp_extract(path, '([^/]*)$', 1) as name from (
    select distinct concat('/backups/', case o_orderkey % 3 when 0 then 'archive_meta' when 1 then 'archive_lc' else 'pg' end, '-',
                  strftime(o_orderdate + to_hours(cast(o_orderkey % 24 as int)), '%Y%m%d-%H%M%S'),
                  case when o_orderkey % 97 = 0 then '.tmp' else '.json' end) as path from orders)),
s as (select path, regexp_extract(name, '^(.*)-(\\d{8})-(\\d{6})\\.json$', 1) as prefix,
             strptime(regexp_extract(name, '^(.*)-(\\d{8})-(\\d{6})\\.json$', 2), '%Y%m%d')::date as snapshot_date,
             strptime(regexp_extract(name, '^(.*)-(\\d{8})-(\\d{6})\\.json$', 2)
                      || regexp_extract(name, '^(.*)-(\\d{8})-(\\d{6})\\.json$', 3), '%Y%m%d%H%M%S') as ts
      from f where regexp_matches(name, '^(.*)-(\\d{8})-(\\d{6})\\.json$')),
t as (select *, date_diff('day', snapshot_date, date '1998-08-02') as age_days from s),
u as (select *, case when age_days <= 7 then 'daily' when age_days <= 90 then 'weekly' when age_days <= 365 then 'monthly'
                     else 'expired' end as tier from t),
v as (select *, case when tier = 'weekly' then (date_diff('day', date '0001-01-01', snapshot_date) + 1) // 7
                     when tier = 'monthly' then year(snapshot_date) * 12 + month(snapshot_date) end as bucket from u)
select path, prefix, cast(snapshot_date as varchar) as snapshot_date, age_days, tier, bucket,
       tier = 'daily' or (tier in ('weekly', 'monthly') and
         row_number() over (partition by prefix, tier, bucket order by ts desc, path desc) = 1) as keep
from v
""")
def q_snapshot_retention(spark, sf_dir):
    """Which backup snapshots the rotation keeps (today 1998-08-02)."""
    snaps = R.snapshot_table(td.snapshot_files(spark, sf_dir))
    out = R.snapshot_retention(snaps, "1998-08-02")
    return out.withColumn("age_days", F.col("age_days").cast("long")).withColumn(
        "snapshot_date", F.col("snapshot_date").cast("string"))


@register("time_conversions", sql=f"""
select event_id, {iso_sql('mjd')} as iso, round(mjd, 8) as mjd, round(jd - 2400000.5, 8) as mjd_from_jd,
       round(epoch_us(cast(strptime({iso_sql('mjd')}, '%Y-%m-%d %H:%M:%S.%g') as timestamp)) / 86400000000.0 + 40587, 8)
         as mjd_round_trip
from (select event_id, epoch_us(ts) / 86400000000.0::DOUBLE + 40587 as mjd,
             epoch_us(ts) / 86400000000.0::DOUBLE + 40587 + 2400000.5::DOUBLE as jd from events)
""")
def q_time_conversions(spark, sf_dir):
    """MJD -> ISO text, JD -> MJD, timestamp -> MJD (round trip)."""
    e = td.table(spark, sf_dir, "events").select(
        "event_id", T.timestamp_to_mjd(F.col("ts").cast("timestamp")).alias("mjd"))
    e = e.withColumn("jd", F.col("mjd") + T.JD_MJD_OFFSET)
    return e.select("event_id", T.mjd_to_iso("mjd").alias("iso"), round_half_up("mjd", 8).alias("mjd"),
                    round_half_up(T.jd_to_mjd("jd"), 8).alias("mjd_from_jd"),
                    round_half_up(T.timestamp_to_mjd(T.mjd_to_timestamp("mjd")), 8).alias("mjd_round_trip"))


@register("round_half_up", sql="""
select l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 2) as discount_amount,
       round(l_quantity / 7.0::DOUBLE, 4) as qty_sevenths
from lineitem
""")
def q_round_half_up(spark, sf_dir):
    """NULL-safe half-up rounding of computed values."""
    li = td.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", round_half_up(F.col("l_extendedprice") * F.col("l_discount"), 2)
                     .alias("discount_amount"), round_half_up(F.col("l_quantity") / 7.0, 4).alias("qty_sevenths"))
