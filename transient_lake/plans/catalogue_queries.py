"""Registered catalogue queries: N7, N8, N13-N15, J4, J6-J10, S6, S10, S11,
U2, U3, W6, C9, F2, F3, F6, ST6 (batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_half_up

from ..operators import catalogue as cat
from ..operators import photometry as ph
from ..sources import config as cfg
from ..sources import testdata as td
from ..functions.sky import deg_to_dms, deg_to_hms
from .registry import register
from .sky_queries import dms_sql, hms_sql

NOW = "1998-08-01"


def _tns_source(o):
    return o.select("source_id", "archive_id", F.col("source_id").alias("object_id"),
                    F.lit("objname").alias("source_id_name"), "ra_deg", "dec_deg", "object_type", "redshift",
                    F.lit(None).cast("string").alias("hostname"),
                    F.col("discovery_date").cast("string").alias("discovery_date"), "reporting_group",
                    F.lit("ZTF").alias("discovery_data_source"))


@register("tns_metadata", sql=f"""
select archive_id, source_id as object_id, 'objname' as source_id_name, ra_deg, dec_deg,
       {hms_sql('ra_deg')} as ra_hms, {dms_sql('dec_deg')} as dec_dms, object_type, redshift,
       cast(null as varchar) as hostname, replace(cast(discovery_date as varchar), ' ', 'T') as discovery_date,
       reporting_group, 'ZTF' as discovery_data_source
from objects
""", views=("objects",))
def q_tns_metadata(spark, sf_dir):
    """Nested name-server records, one per catalogue object, projected to
    the fields of interest."""
    o = td.objects(spark, sf_dir)
    raw = o.select("archive_id", F.col("source_id").alias("objname"), F.col("ra_deg").alias("radeg"),
                   F.col("dec_deg").alias("decdeg"), deg_to_hms("ra_deg").alias("ra"), deg_to_dms("dec_deg").alias("dec"),
                   F.struct(F.col("object_type").alias("name")).alias("object_type"), "redshift",
                   F.lit(None).cast("string").alias("hostname"),
                   F.col("discovery_date").cast("string").alias("discoverydate"),
                   F.struct(F.col("reporting_group").alias("group_name")).alias("reporting_group"),
                   F.struct(F.lit("ZTF").alias("group_name")).alias("discovery_data_source"))
    return cat.tns_metadata(raw)


_SHERLOCK_SQL = """
select source_id, catalogue_object_id, z as redshift, raDeg as ra_deg, decDeg as dec_deg, classification,
       separationArcsec from (
  select *, row_number() over (partition by source_id order by rank, catalogue_object_id) as rn from sherlock_xm)
where rn = 1"""


@register("sherlock_metadata", sql=_SHERLOCK_SQL, views=("sherlock_xm",))
def q_sherlock_metadata(spark, sf_dir):
    """The best-ranked contextual crossmatch per object."""
    return cat.sherlock_metadata(td.sherlock_xm(spark, sf_dir), key="source_id")


def _sources(spark, sf_dir):
    o = td.objects(spark, sf_dir)
    return {
        "tns": _tns_source(o).drop("archive_id"),
        "sherlock": cat.sherlock_metadata(td.sherlock_xm(spark, sf_dir), key="source_id"),
        "fink_ztf": o.where("cast(source_id as bigint) % 2 = 0").select(
            "source_id", F.concat(F.lit("ZTF"), "source_id").alias("object_id"), F.col("redshift").alias("score")),
        "asas_sn": o.where("cast(source_id as bigint) % 5 = 0").select(
            "source_id", F.concat(F.lit("ASASSN-"), "source_id").alias("object_id")),
    }


@register("assemble_metadata", sql=f"""
with sh as ({_SHERLOCK_SQL})
select o.source_id, o.archive_id,
       concat_ws(',', case when o.source_id::bigint % 5 = 0 then 'asas_sn' end,
                      case when o.source_id::bigint % 2 = 0 then 'fink_ztf' end,
                      case when sh.source_id is not null then 'sherlock' end, 'tns') as sources,
       1 + (o.source_id::bigint % 5 = 0)::int + (o.source_id::bigint % 2 = 0)::int
         + (sh.source_id is not null)::int as n_sources,
       round(sh.redshift, 6) as sherlock_redshift, o.object_type as tns_type
from objects o left join sh using (source_id)
""", views=("objects", "sherlock_xm"))
def q_assemble_metadata(spark, sf_dir):
    """Envelope + source-keyed payloads of every source that matched."""
    env = td.objects(spark, sf_dir).select("source_id", "archive_id")
    m = cat.assemble_metadata(env, _sources(spark, sf_dir), key="source_id")
    ds = F.col("data_sources")
    return m.select(
        "source_id", "archive_id", F.array_join(F.array_sort(F.map_keys(ds)), ",").alias("sources"),
        F.size(ds).alias("n_sources"),
        round_half_up(F.get_json_object(ds["sherlock"], "$.redshift").cast("double"), 6).alias("sherlock_redshift"),
        F.get_json_object(ds["tns"], "$.object_type").alias("tns_type"))


@register("missing_ids", sql="""
select distinct name as source_id from public_catalogue
where name not in (select source_id from objects where source = 'tns')
""", views=("public_catalogue", "objects"))
def q_missing_ids(spark, sf_dir):
    """Public catalogue names not yet in the archive."""
    allv = td.public_catalogue(spark, sf_dir).select(F.col("name").alias("source_id"))
    return cat.missing_ids(allv, cat.catalogue_objects(td.objects(spark, sf_dir), "tns"))


@register("restrict_to_ids", sql="""
select * from lc_points where obj_id in (select c_custkey from customer where c_acctbal > 5000)
""", views=("lc_points",))
def q_restrict_to_ids(spark, sf_dir):
    """Light-curve points of the listed objects only."""
    ids = td.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("obj_id"))
    return cat.restrict_to_ids(td.lc_points(spark, sf_dir), ids, "obj_id")


@register("resolve_source_ids", sql="""
with m as (select cast(reporter_id as varchar) as source_id, archive_id, update_date from objects),
latest as (select source_id, arg_max(archive_id, (update_date, archive_id)) as archive_id from m group by source_id)
select r.source_id, latest.archive_id
from (select cast(c_custkey as varchar) as source_id from customer) r left join latest using (source_id)
""", views=("objects",))
def q_resolve_source_ids(spark, sf_dir):
    """Requested source ids -> newest archive id (NULL when unknown);
    source ids repeat across documents here (one per reporter)."""
    meta = td.objects(spark, sf_dir).select(F.col("reporter_id").cast("string").alias("source_id"),
                                             "archive_id", "update_date")
    req = td.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"))
    return cat.resolve_source_ids(req, meta)


@register("get_documents", sql="""
select i.archive_id, o.ra_deg, o.dec_deg, o.object_type
from (select distinct concat('TXV-1995-', lpad(cast(l_orderkey as varchar), 6, '0')) as archive_id
      from lineitem) i
left join objects o using (archive_id)
""", views=("objects",))
def q_get_documents(spark, sf_dir):
    """Documents by id with sub-field selection; unknown ids give NULLs."""
    ids = (td.table(spark, sf_dir, "lineitem")
           .select(F.concat(F.lit("TXV-1995-"), F.lpad(F.col("l_orderkey").cast("string"), 6, "0"))
                   .alias("archive_id")).distinct())
    return cat.get_documents(ids, td.objects(spark, sf_dir), fields=["ra_deg", "dec_deg", "object_type"])


@register("citations_for", sql=f"""
with stems as {cfg.CITATION_STEMS_SQL},
keys as (
  select o.archive_id, k.source, k.pos from objects o,
  lateral (select * from (values (0, 'tns'), (1, 'sherlock'), (2, 'fink_ztf'), (3, 'asas_sn'))
           t(pos, source)) k
  where k.source = 'tns' or (k.source = 'sherlock' and o.source_id::bigint % 3 = 0)
        or (k.source = 'fink_ztf' and o.source_id::bigint % 2 = 0)
        or (k.source = 'asas_sn' and o.source_id::bigint % 5 = 0)),
j as (select keys.*, stems.stem, '@misc{{' || stems.stem || '}}' as text from keys left join stems using (source))
select archive_id, string_agg(text, chr(10) order by pos) filter (where text is not null) as citations,
       coalesce(string_agg(case when stem is null then source end, ',' order by source), '') as unmapped
from j group by archive_id
""", views=("objects",))
def q_citations_for(spark, sf_dir):
    """Per object, the distinct citation texts of its sources in
    source order; source keys without a citation stem reported."""
    o = td.objects(spark, sf_dir)
    n = F.col("source_id").cast("long")
    ds = F.map_filter(F.create_map(
        F.lit("tns"), F.lit("{}"),
        F.lit("sherlock"), F.when(n % 3 == 0, F.lit("{}")),
        F.lit("fink_ztf"), F.when(n % 2 == 0, F.lit("{}")),
        F.lit("asas_sn"), F.when(n % 5 == 0, F.lit("{}"))), lambda k, v: v.isNotNull())
    meta = o.select("archive_id", ds.alias("data_sources"))
    stems = cfg.citation_stems(spark)
    bib = stems.select("stem").distinct().select("stem", F.concat(F.lit("@misc{"), "stem", F.lit("}")).alias("text"))
    out = cat.citations_for(meta, stems, bib)
    return out.select("archive_id", "citations",
                      F.array_join("unmapped", ",").alias("unmapped"))


@register("upsert_documents", sql="""
with ch as (
  select archive_id, 'CHANGED' as object_type, ra_deg, dec_deg from objects where object_type = '1-URGENT'
  union all
  select concat('TXV-2000-', lpad(cast(c_custkey as varchar), 6, '0')), 'NEW', 0.0, 0.0 from customer)
select archive_id, object_type, ra_deg, dec_deg from objects where archive_id not in (select archive_id from ch)
union all select * from ch
""", views=("objects",))
def q_upsert_documents(spark, sf_dir):
    """Urgent objects re-typed and every customer's new document
    inserted: insert-or-replace of whole documents by id."""
    o = td.objects(spark, sf_dir).select("archive_id", "object_type", "ra_deg", "dec_deg", "source_id")
    changed = o.where("object_type = '1-URGENT'").select(
        "archive_id", F.lit("CHANGED").alias("object_type"), "ra_deg", "dec_deg")
    new = td.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("TXV-2000-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("archive_id"),
        F.lit("NEW").alias("object_type"), F.lit(0.0).alias("ra_deg"), F.lit(0.0).alias("dec_deg"))
    return cat.upsert(o.drop("source_id"), changed.unionByName(new), "archive_id")


@register("set_fields", sql="""
select o.archive_id,
       case when o.object_type = '1-URGENT' then null
            when o.object_type = '2-HIGH' then 0.5 else o.redshift end as redshift,
       o.object_type
from objects o
""", views=("objects",))
def q_set_fields(spark, sf_dir):
    """Sub-document overwrite of the redshift of urgent (cleared to
    NULL) and high-priority (set) objects; a presence flag lets NULL be set."""
    o = td.objects(spark, sf_dir)
    t = F.col("object_type")
    ch = o.where(t.isin("1-URGENT", "2-HIGH")).select(
        "archive_id", F.when(t == "1-URGENT", F.lit(None).cast("double")).otherwise(F.lit(0.5)).alias("redshift"),
        F.lit(True).alias("set_redshift"))
    return cat.set_fields(o.select("archive_id", "redshift", "object_type"), ch, "archive_id", ["redshift"])


@register("replace_survey_points", sql="""
with refreshed as (select c_custkey as obj_id from customer where c_mktsegment = 'BUILDING'),
new as (select obj_id, survey, filter, mjd, mag + 0.5 as mag, mag_err, "limit", fwhm, detection, camera
        from lc_points where survey = 'ztf' and mag < 18 and obj_id in (select obj_id from refreshed))
select * from lc_points where not (survey = 'ztf' and obj_id in (select obj_id from refreshed))
union all select * from new
""", views=("lc_points",))
def q_replace_survey_points(spark, sf_dir):
    """The BUILDING segment's objects are refreshed: their ZTF points are
    replaced by the new pull (objects whose pull returned no points lose
    the old ones)."""
    lc = td.lc_points(spark, sf_dir)
    refreshed = td.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("obj_id"))
    new = (lc.where("survey = 'ztf' and mag < 18").join(refreshed, "obj_id", "left_semi")
           .withColumn("mag", F.col("mag") + 0.5))
    return cat.replace_survey_points(lc, new, refreshed, "ztf")


def _b36_sql(x):
    digits = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    parts = [f"substr({digits}, cast(({x} // {36 ** k}) % 36 as int) + 1, 1)" for k in range(5, -1, -1)]
    return " || ".join(parts)


@register("base36_ids", sql=f"""
select o_orderkey, {_b36_sql('(o_orderkey * 7919)')} as alpha from orders
""")
def q_base36_ids(spark, sf_dir):
    """Integers to 6-digit base-36 identifiers."""
    o = td.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", cat.base36(F.col("o_orderkey") * 7919).alias("alpha"))


@register("assign_ids", sql="""
with reg as (select cast(substr(cast(discovery_date as varchar), 1, 4) as int) as year,
                    cast(source_id as bigint) as idx, archive_id, source_id from objects),
new as (select name as source_id, min(y) as year from (
          select name, cast(substr(cast(discoverydate as varchar), 1, 4) as int) as y from public_catalogue
          union all select name, cast(substr(cast(discoverydate as varchar), 1, 4) as int) + 1 from public_catalogue)
        group by name),
known as (select source_id, arg_max(archive_id, (year, idx)) as archive_id from reg group by source_id),
base as (select year, max(idx) as mx from reg group by year),
fresh as (select n.source_id, n.year, coalesce(mx, 0) + row_number() over (partition by n.year order by md5(n.source_id)) as idx
          from new n left join base using (year) where n.source_id not in (select source_id from known))
select source_id, year, idx, 'TXV-' || year || '-' || lpad(upper(to_base(idx, 36)), 6, '0') as archive_id, true as is_new from fresh
union all select source_id, year, null, archive_id, false from new join known using (source_id)
""", views=("objects", "public_catalogue"))
def q_assign_ids(spark, sf_dir):
    """Yearly identifiers for new public objects, ids reused for known
    ones; every object is asked for under two years."""
    o = td.objects(spark, sf_dir)
    reg = o.select(F.substring(F.col("discovery_date").cast("string"), 1, 4).cast("int").alias("year"),
                   F.col("source_id").cast("long").alias("idx"), "archive_id", "source_id")
    new = td.public_catalogue(spark, sf_dir).select(
        F.col("name").alias("source_id"),
        F.substring(F.col("discoverydate").cast("string"), 1, 4).cast("int").alias("year"))
    twice = new.unionByName(new.withColumn("year", F.col("year") + 1))
    return cat.assign_ids(twice, reg).select("source_id", "year", "idx", "archive_id", "is_new")


@register("catalogue_objects", sql="""
select archive_id, source_id from objects where source = 'xmatch'
""", views=("objects",))
def q_catalogue_objects(spark, sf_dir):
    """(archive_id, source_id) of one catalogue source."""
    return cat.catalogue_objects(td.objects(spark, sf_dir), "xmatch")


@register("active_objects", sql=f"""
select o.archive_id, o.source, o.source_id from objects o left join active_settings s using (archive_id)
where date_diff('day', cast(o.discovery_date as date), date '{NOW}')
  < coalesce(s.active_days, case o.source when 'tns' then 60 when 'xmatch' then 14 end)
""", views=("objects", "active_settings"))
def q_active_objects(spark, sf_dir):
    """objects of both sources still inside their active window at ``NOW``."""
    return cat.active_objects(td.objects(spark, sf_dir), td.active_settings(spark, sf_dir), None, NOW)


@register("due_sources", sql=f"""
select o.archive_id, c.source_name, c.meta_only from objects o cross join {cfg.SOURCE_CONFIG_SQL} c
where o.update_date + to_days(c.update_frequency) <= timestamp '{NOW}'
""", views=("objects",))
def q_due_sources(spark, sf_dir):
    """(object, source) pairs due for a refresh at ``NOW``."""
    return cat.due_sources(td.objects(spark, sf_dir), cfg.SOURCE_CONFIG, NOW)


@register("refresh_requests", sql=f"""
select distinct name as object_id, 'bulk' as queue, cast(null as varchar) as source_name from public_catalogue
where name not in (select source_id from objects where source = 'tns')
union all
select o.source_id, 'update', null from objects o left join active_settings s using (archive_id)
where o.source = 'tns' and date_diff('day', cast(o.discovery_date as date), date '{NOW}') < coalesce(s.active_days, 60)
union all
select o.source_id, 'refresh', c.source_name from objects o cross join {cfg.SOURCE_CONFIG_SQL} c
where o.update_date + to_days(c.update_frequency) <= timestamp '{NOW}'
""", views=("objects", "active_settings", "public_catalogue"))
def q_refresh_requests(spark, sf_dir):
    """ST6 (batch): bulk / update / refresh work list."""
    allv = td.public_catalogue(spark, sf_dir).select(F.col("name").alias("source_id"))
    return cat.refresh_requests(allv, td.objects(spark, sf_dir), td.active_settings(spark, sf_dir), cfg.SOURCE_CONFIG, NOW)


@register("frb_name_fix", sql="""
select distinct name, type, case when type = 'FRB' and not starts_with(name, 'FRB') then 'FRB' || name else name end
       as object_id from public_catalogue
""", views=("public_catalogue",))
def q_frb_name_fix(spark, sf_dir):
    """FRB naming convention applied to the public catalogue."""
    pc = td.public_catalogue(spark, sf_dir).select("name", "type").distinct()
    return cat.frb_name_fix(pc)


@register("snake_case_values", sql="""
with c as (select p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '),
                                                            lambda x: upper(x[1]) || x[2:]), '') as camel from part)
select p_partkey, camel,
       lower(regexp_replace(regexp_replace(camel, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))
       as snake
from c
""")
def q_snake_case_values(spark, sf_dir):
    """CamelCase values to snake_case."""
    p = td.table(spark, sf_dir, "part")
    camel = F.regexp_replace(F.initcap(F.lower("p_type")), " ", "")
    return p.select("p_partkey", camel.alias("camel")).withColumn("snake", cat.camel_to_snake("camel"))


@register("clean_empty_fields", sql="""
select o_orderkey,
       (select string_agg(cast(l_quantity as varchar), ',' order by l_quantity) from lineitem
        where l_orderkey = o_orderkey and l_returnflag = 'R') as returned
from orders
""")
def q_clean_empty_fields(spark, sf_dir):
    """Per order, the returned line quantities; empty lists dropped
    (NULL) as the document cleaner does."""
    o = td.table(spark, sf_dir, "orders").select("o_orderkey")
    li = td.table(spark, sf_dir, "lineitem")
    per = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))).alias("returned"))
    doc = o.join(per, "o_orderkey", "left").select(
        "o_orderkey", F.coalesce("returned", F.array().cast("array<double>")).alias("returned"))
    clean = cat.clean_empty_fields(doc)
    return clean.select("o_orderkey", F.array_join(F.transform("returned", lambda x: x.cast("string")), ",")
                        .alias("returned"))


@register("export_frame", sql="""
select w.obj_id, w.discovery_mjd, w.prior_days, w.active_days, p.survey, p.filter, p.mjd, p.mag, p.mag_err, p."limit", p.detection
from mjd_windows w left join lc_points p using (obj_id)
""", views=("lc_points", "mjd_windows"))
def q_export_frame(spark, sf_dir):
    """S6 (pre-write frame): one row per object with metadata and its
    light-curve array, compared point by point."""
    f = cat.export_frame(td.mjd_windows(spark, sf_dir), td.lc_points(spark, sf_dir), key="obj_id")
    return f.select("obj_id", "meta.*", F.explode_outer("lc").alias("p")).select(
        "obj_id", "discovery_mjd", "prior_days", "active_days",
        *[F.col("p")[c].alias(c) for c in ("survey", "filter", "mjd", "mag", "mag_err", "limit", "detection")])


@register("union_lightcurves", sql="""
select * from (
  select obj_id, 'ztf' as survey, case cast("i:fid" as int) when 1 then 'g' when 2 then 'r' when 3 then 'i' end as filter,
         "i:jd" - 2400000.5 as mjd, "i:magpsf" as mag, "i:sigmapsf" as mag_err, "i:diffmaglim" as "limit", "i:fwhm" as fwhm,
         case "d:tag" when 'valid' then 1 when 'badquality' then -1 when 'upperlim' then 0 end as detection, 'main' as camera
  from ztf_raw) where detection >= 0
union all
select obj_id, 'lsst', "r:band", "r:midpointMjdTai",
       round(case when "r:psfFlux" > 0 then log10("r:psfFlux") * -2.5 + 31.4 end, 6),
       round(abs("r:psfFluxErr" * 1.0857 / nullif("r:psfFlux", 0)), 6), null, null, 1, 'main' from lsst_raw
""", views=("ztf_raw", "lsst_raw"))
def q_union_lightcurves(spark, sf_dir):
    """Light curves of several surveys concatenated by name."""
    lsst = ph.normalise_lsst_lc(td.lsst_raw(spark, sf_dir))
    lsst = lsst.withColumn("mag", round_half_up("mag", 6)).withColumn("mag_err", round_half_up("mag_err", 6))
    return ph.union_lightcurves(ph.normalise_ztf_lc(td.ztf_raw(spark, sf_dir)), lsst)


@register("sql_id_listing", sql="""
select archive_id, source_id from objects where source = 'tns' and discovery_date >= timestamp '1997-01-01'
""", views=("objects",))
def q_sql_id_listing(spark, sf_dir):
    """free SQL over a named view with bound parameter markers (the
    dump's id listing)."""
    cat.register_views({"tl_meta": td.objects(spark, sf_dir)})
    return cat.run_sql(spark, "SELECT archive_id, source_id FROM tl_meta WHERE source = :source "
                              "AND discovery_date >= CAST(:since AS TIMESTAMP_NTZ)", source="tns", since="1997-01-01")
