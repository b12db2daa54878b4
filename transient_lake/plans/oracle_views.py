"""DuckDB forms of the adapter views in ``sources/testdata.py``.

``with_views(sql, *names)`` prefixes an oracle query with the CTEs it needs.
Literals are cast to DOUBLE so both engines divide in binary floating point.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "sky_alerts": """
select concat(case when event_id % 2 = 0 then 'Z' else 'L' end, event_id) as obj_id,
       case when event_id % 2 = 0 then 'ztf' else 'lsst' end as source,
       (((event_id // 2) * 137 * 3600 + (event_id % 2) * (((event_id * 7919) % 13) - 6) * 700
         + 2592000000000) % 1296000000) / 3600000.0::DOUBLE as ra_deg,
       ((((event_id // 2) * 71) % 140001) * 3600 + (event_id % 2) * (((event_id * 104729) % 11) - 5) * 700)
         / 3600000.0::DOUBLE - 70.0::DOUBLE as dec_deg,
       ts as timestamp
from events""",
    "sky_chain": """
select concat('C', event_id) as obj_id,
       case event_id % 3 when 0 then 'ztf' when 1 then 'lsst' else 'atlas' end as source,
       (((event_id // 6) * 137) % 360000) / 1000.0::DOUBLE as ra_deg,
       ((((event_id // 6) * 71) % 140001) * 3600 + (event_id % 6) * 3000) / 3600000.0::DOUBLE - 70.0::DOUBLE as dec_deg,
       ts as timestamp
from events""",
    "lc_points": """
select user_id as obj_id,
       case event_id % 4 when 0 then 'ztf' when 1 then 'atlas' when 2 then 'asas-sn' else 'lsst' end as survey,
       case event_type when 'click' then 'g' when 'view' then 'r' when 'purchase' then 'i'
            when 'signup' then 'o' else 'c' end as filter,
       epoch_us(ts) / 86400000000.0::DOUBLE + 40587 as mjd,
       14 + ((event_id * 37) % 800) / 100.0::DOUBLE as mag,
       (event_id % 50) / 1000.0::DOUBLE as mag_err,
       18 + ((event_id * 13) % 300) / 100.0::DOUBLE as "limit",
       cast(null as double) as fwhm,
       case when event_id % 17 = 0 then -1 when event_id % 5 = 0 then 0 else 1 end as detection,
       'main' as camera
from events""",
    "ztf_raw": """
select user_id as obj_id,
       14 + ((event_id * 37) % 800) / 100.0::DOUBLE as "i:magpsf",
       (event_id % 50) / 1000.0::DOUBLE as "i:sigmapsf",
       case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 else 4 end as "i:fid",
       epoch_us(ts) / 86400000000.0::DOUBLE + 40587 + 2400000.5::DOUBLE as "i:jd",
       18 + ((event_id * 13) % 300) / 100.0::DOUBLE as "i:diffmaglim",
       case when event_id % 17 = 0 then 'badquality' when event_id % 5 = 0 then 'upperlim'
            when event_id % 23 = 0 then 'unknown' else 'valid' end as "d:tag",
       (event_id % 30) / 10.0::DOUBLE as "i:fwhm"
from events where event_id % 4 = 0""",
    "asassn_raw": """
select user_id as obj_id,
       epoch_us(ts) / 86400000000.0::DOUBLE + 40587 + 2400000.5::DOUBLE as jd,
       14 + ((event_id * 37) % 800) / 100.0::DOUBLE as mag,
       case when event_id % 5 = 0 then 99.99::DOUBLE else (event_id % 50) / 1000.0::DOUBLE end as mag_err,
       18 + ((event_id * 13) % 300) / 100.0::DOUBLE as "limit",
       (event_id % 30) / 10.0::DOUBLE as fwhm,
       case event_type when 'click' then 'g' else 'V' end as phot_filter,
       case when event_id % 13 = 0 then 'B' when event_id % 29 = 0 then null else 'G' end as quality,
       concat('b', cast(event_id % 6 as varchar)) as camera
from events where event_id % 4 = 2""",
    "atlas_raw": """
select user_id as obj_id,
       epoch_us(ts) / 86400000000.0::DOUBLE + 40587 as MJD,
       case when event_id % 3 = 0 then -1 else 1 end * (14 + ((event_id * 37) % 800) / 100.0::DOUBLE) as m,
       (event_id % 50) / 1000.0::DOUBLE as dm,
       case when event_id % 41 = 0 then null else ((event_id * 11) % 90) - 20.0::DOUBLE end as uJy,
       case when event_id % 43 = 0 then null else 2.0::DOUBLE + event_id % 5 end as duJy,
       case when event_id % 2 = 1 then 'o' else 'c' end as F,
       180 + ((user_id * 7919) % 36000) / 3600.0::DOUBLE as RA,
       20 + ((user_id * 104729) % 36000) / 3600.0::DOUBLE as "Dec",
       (event_id % 30) / 10.0::DOUBLE as maj,
       case when event_id % 31 = 0 then -1 else 1 end * (18 + ((event_id * 13) % 300) / 100.0::DOUBLE) as mag5sig,
       concat(case when event_id % 3 = 0 then '01a' else '02a' end, cast(event_id as varchar)) as Obs
from events where event_id % 4 = 1""",
    "lsst_raw": """
select user_id as obj_id,
       epoch_us(ts) / 86400000000.0::DOUBLE + 40587 as "r:midpointMjdTai",
       case event_type when 'click' then 'g' when 'view' then 'r' when 'purchase' then 'i' else 'z' end as "r:band",
       case when event_id % 19 = 0 then -1.0::DOUBLE
            else power(10.0::DOUBLE, (31.4::DOUBLE - (14 + ((event_id * 37) % 800) / 100.0::DOUBLE)) / 2.5::DOUBLE)
       end as "r:psfFlux",
       (event_id % 50) * 10.0::DOUBLE as "r:psfFluxErr",
       (event_id % 70) / 2.0::DOUBLE as "r:snr"
from events where event_id % 4 = 3""",
    "mjd_windows": """
select c_custkey as obj_id,
       60310.0::DOUBLE + (c_custkey * 37) % 30 as discovery_mjd,
       case when c_custkey % 3 = 0 then cast(1 + c_custkey % 10 as int) end as prior_days,
       case when c_custkey % 3 = 0 then cast(2 + c_custkey % 20 as int) end as active_days
from customer""",
    "objects": """
select cast(o_orderkey as varchar) as source_id,
       concat('TXV-', substr(cast(o_orderdate as varchar), 1, 4), '-', lpad(cast(o_orderkey as varchar), 6, '0'))
         as archive_id,
       case when o_orderkey % 4 = 0 then 'xmatch' else 'tns' end as source,
       180 + ((o_orderkey * 7919) % 36000) / 3600.0::DOUBLE as ra_deg,
       20 + ((o_orderkey * 104729) % 36000) / 3600.0::DOUBLE as dec_deg,
       o_orderdate as discovery_date,
       o_orderdate + to_days(cast((o_orderkey * 13) % 200 as int)) as update_date,
       case when o_orderkey % 7 = 0 then null else o_totalprice / 10000000 end as redshift,
       o_orderpriority as object_type,
       o_orderstatus as reporting_group,
       o_custkey as reporter_id
from orders""",
    "cones": """
select s_suppkey as cone_id,
       180 + (((s_suppkey * 37) * 7919) % 36000) / 3600.0::DOUBLE as ra,
       20 + (((s_suppkey * 37) * 104729) % 36000) / 3600.0::DOUBLE as dec_c,
       cast((s_suppkey % 4) * 400 + 100 as double) as radius_arcsec
from supplier""",
    "sherlock_xm": """
select cast(l_orderkey - l_orderkey % 3 as varchar) as source_id,
       concat('T', cast(l_orderkey as varchar)) as transient_object_id,
       l_linenumber + 10 * (l_orderkey % 3) as rank, concat('CAT', cast(l_partkey as varchar)) as catalogue_object_id,
       l_discount as z, 180 + ((l_partkey * 7919) % 36000) / 3600.0::DOUBLE as raDeg,
       20 + ((l_partkey * 104729) % 36000) / 3600.0::DOUBLE as decDeg,
       case l_returnflag when 'R' then 'SN' when 'A' then 'NT' else 'VS' end as classification,
       l_quantity as separationArcsec
from lineitem""",
    "public_catalogue": """
select cast(l_orderkey + l_linenumber - 1 as varchar) as name,
       case when l_linenumber = 3 then 'FRB' else 'SN' end as type, l_shipdate as discoverydate
from lineitem""",
    "active_settings": """
select concat('TXV-', substr(cast(o_orderdate as varchar), 1, 4), '-', lpad(cast(o_orderkey as varchar), 6, '0'))
         as archive_id, case when o_orderkey % 5 = 0 then cast(10 + o_orderkey % 90 as int) end as active_days
from orders""",
    "legacy_objects": """
select obj_id,
       list(struct_pack(value := mag, source := survey, filter := filter, mjd := mjd)) filter (where detection = 1)
         as mags,
       list(struct_pack(value := "limit", source := survey, filter := filter, mjd := mjd)) filter (where detection = 0)
         as limits
from lc_points group by obj_id""",
    "alert_docs": """
select c.c_custkey as obj_id,
       [struct_pack(value := c_acctbal / 100000.0::DOUBLE, source := 'tns'),
        struct_pack(value := (c_custkey % 50) / 1000.0::DOUBLE, source := 'sherlock')] as redshift,
       [struct_pack(value := cast(date '2024-01-01' + cast(c_custkey % 30 as int) as varchar), source := 'tns')]
         as discovery_date,
       [struct_pack(value := c_mktsegment, source := 'tns')] as discovery_source,
       p.latest_detection
from customer c left join (
  select obj_id, list(struct_pack(value := mag, source := survey, filter := filter, mag_rate := mag_err * 10))
         as latest_detection
  from lc_points where detection = 1 group by obj_id) p on p.obj_id = c.c_custkey""",
    "cone_requests": """
select s_suppkey as request_id,
       case when s_suppkey % 23 = 0 or s_suppkey % 11 = 0 then null when s_suppkey % 13 = 0 then 'abc'
            else cast(s_suppkey * 4 as varchar) end as ra,
       case when s_suppkey % 23 = 0 then null when s_suppkey % 17 = 0 then ' ' else cast(s_suppkey - 60 as varchar) end
         as dec,
       case when s_suppkey % 23 = 0 then '' when s_suppkey % 19 = 0 then '0' else cast(s_suppkey % 30 as varchar) end
         as radius
from supplier""",
    "fink_ztf_rows": """
select user_id as obj_id, epoch_us(ts) / 86400000000.0::DOUBLE + 40587 + 2400000.5::DOUBLE as "i:jd",
       event_type as "d:classification",
       case when event_id % 3 = 0 then 'nan' else cast(event_id % 7 as varchar) end as "d:gcvs",
       case when event_id % 5 = 0 then null else concat('TNS', cast(user_id as varchar)) end as "d:tns",
       cast(event_id % 11 as varchar) as "d:not_listed"
from events where event_id % 4 = 0""",
    "lsst_meta_rows": """
select user_id as obj_id, epoch_us(ts) / 86400000000.0::DOUBLE + 40587 as "r:midpointMjdTai",
       event_type as "f:classification",
       case when event_id % 3 = 0 then 'nan' else cast(event_id % 9 as varchar) end as "f:score",
       concat('tns', cast(event_id as varchar)) as "f:tns_name", 'v1' as "f:model_version"
from events where event_id % 4 = 3""",
    "alerce_probabilities": """
select l_orderkey as oid, case when l_linenumber % 2 = 0 then 'lsst' else 'ztf' end as survey,
       case when l_partkey % 3 = 0 then 'other_classifier' when l_linenumber % 2 = 0
            then 'stamp_classifier_rubin_beta_20260421' else 'lc_classifier_BHRF_forced_phot' end as classifier_name,
       concat('v', cast(l_suppkey % 3 as varchar)) as classifier_version,
       case l_returnflag when 'R' then 'SNIa' when 'A' then 'AGN' else 'SNII' end as class_name,
       case when l_tax = 0 then 'NaN'::DOUBLE else l_discount * 10 end as probability,
       case when l_linenumber <= 2 then 1 else l_linenumber end as ranking
from lineitem""",
    "alerce_features": """
select l_orderkey as oid,
       concat(case when l_partkey % 2 = 0 then 'SPM_' else 'GP_' end, cast(l_linenumber as varchar)) as name,
       case when l_tax = 0 then 'NaN'::DOUBLE else l_quantity end as value,
       cast(l_suppkey % 4 as int) as fid, concat('1.', cast(l_orderkey % 3 as varchar)) as version
from lineitem""",
    "users": """
select c_custkey as user_id,
       case when c_custkey % 11 = 0 then null else c_name end as username,
       case when c_custkey % 5 = 0 then '' end as nickname,
       case when c_custkey % 4 = 0 then null else concat('Ann', cast(c_custkey % 10 as varchar)) end as forename,
       upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as surname,
       case when c_custkey % 9 = 0 then null else concat(lower(c_name), '@example.org') end as email
from customer""",
    "identities": """
select case when c_custkey % 2 = 0 then 'orcid' else 'github' end as provider,
       lpad(cast(c_custkey as varchar), 8, '0') as provider_user_id, c_custkey as user_id
from customer""",
    "teams": """
select n_nationkey as team_id, n_name as name, concat('region ', cast(n_regionkey as varchar)) as description
from nation""",
    "memberships": """
select distinct * from (
  select n_nationkey as team_id, c_custkey as user_id,
         case when c_custkey % 20 = 0 then 'owner' when c_custkey % 20 = 1 then 'admin' else 'member' end as role
  from customer join nation on c_nationkey = n_nationkey
  union all
  select cast((c_custkey * 7) % 25 as int), c_custkey, 'member' from customer
  where c_custkey % 3 = 0 and cast((c_custkey * 7) % 25 as int) <> c_nationkey)""",
    "tags": """
select p_partkey as tag_id, concat(p_brand, '-', p_type) as name,
       case when p_partkey % 2 = 0 then p_partkey % 100 end as owner_user_id,
       case when p_partkey % 2 = 1 then cast(p_partkey % 25 as int) end as owner_team_id
from part""",
    "assignments": """
select object_id, tag_id, min(applied_by) as applied_by from (
  select cast(l_orderkey as varchar) as object_id, l_partkey as tag_id, l_suppkey as applied_by
  from lineitem)
group by object_id, tag_id""",
    "notices": """
select page_id as message_id,
       case when page_id % 3 = 0 then 'other@example.org' else 'TNS <notices@example.org>' end as "from",
       url as subject, 'text/html' as content_type, html as body
from pages""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with ``WITH`` definitions for the named adapter views."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body[:15].lower() == "with recursive ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
