"""Object-page data: metadata tables (N18, N19), photometry table (N20),
brightest peak across sources (A6), source preference and ordering (C11,
C14), canonical bands (C13) and the six key facts (C12, C20).

Documents are ``(archive_id, data_sources map<string, json-string>)``; every
function works on all objects at once and returns long rows or columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_format

# Display labels of metadata fields.
FIELD_LABELS = {
    "identifier": "Identifier",
    "ra_deg": "RA (deg)",
    "dec_deg": "Dec (deg)",
    "object_type": "Object Type",
    "discovery_date": "Discovery Date",
    "reporting_group": "Reporting Group",
    "discovery_data_source": "Discovery Data Source",
    "redshift": "Redshift",
    "host_name": "Host Name",
    "hostname": "Host Name",
    "mag": "Magnitude",
    "mag_err": "Magnitude Error",
    "mag_filter": "Magnitude Filter",
    "association_type": "Association Type",
    "best_distance": "Best Distance",
    "best_distance_flag": "Best Distance Flag",
    "best_distance_source": "Best Distance Source",
    "catalogue_object_id": "Catalogue Object ID",
    "catalogue_object_type": "Catalogue Object Type",
    "catalogue_table_name": "Catalogue Table",
    "classificationReliability": "Classification Reliability",
    "separation_arcsec": "Separation (arcsec)",
    "north_separation_arcsec": "North Separation (arcsec)",
    "east_separation_arcsec": "East Separation (arcsec)",
    "physical_separation_kpc": "Physical Separation (kpc)",
    "peak_mag": "Peak Magnitude",
    "peak_mags": "Peak Magnitudes",
    "latest_detection": "Latest Detection",
    "latest_detections": "Latest Detections",
    "latest_nondetection": "Latest Non-detection",
    "latest_non_detections": "Latest Non-detections",
    "limit": "Magnitude",
    "filter": "Filter",
    "date": "Date",
    "value": "Magnitude",
    "mag_rate": "Mag Rate",
}

# Display labels of sources and the preferred tab order.
SOURCE_LABELS = {
    "tns": "TNS",
    "ztf": "ZTF",
    "atlas": "ATLAS",
    "atlas_twb": "ATLAS TWB",
    "asas_sn": "ASAS-SN",
    "asas-sn": "ASAS-SN",
    "asas-sn_skypatrol": "ASAS-SN Skypatrol",
    "sherlock": "Lasair-Sherlock",
    "fink": "Fink",
    "mangrove": "Mangrove",
    "lasair": "Lasair",
    "lsst": "LSST",
}
SOURCE_ORDER = ["tns", "ztf", "atlas", "asas_sn", "sherlock"]

# Placeholder for missing values.
EM_DASH = "—"

# Known bands and aliases for canonical band names.
BANDS = ["u", "c", "g", "V", "r", "o", "i", "z", "w", "Unknown"]
BAND_ALIASES = {"R": "r", "g_asas-sn": "g", "g_asas_sn": "g", "y": "z"}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def title_case(text: Column) -> Column:
    """Python's ``str.title()``: a letter following a non-letter is upper
    case, every other letter lower case (``x3hsp`` -> ``X3Hsp``)."""
    chars = F.split(text, "")

    def step(c, i):
        prev = F.element_at(chars, i)  # 1-based: the previous character
        after_letter = (i > 0) & prev.rlike(r"^\p{L}$")
        return F.when(after_letter, F.lower(c)).otherwise(F.upper(c))
    return F.array_join(F.transform(chars, step), "")


def field_label(field: Column) -> Column:
    """Label from the fixed map, else the title-cased name with ``_`` as
    spaces."""
    return F.coalesce(_map(FIELD_LABELS)[field], title_case(F.regexp_replace(field, "_", " ")))


def source_label(source: Column) -> Column:
    return F.coalesce(_map(SOURCE_LABELS)[source], F.upper(F.regexp_replace(source, "_", " ")))


def ordered_sources(data_sources: Column) -> Column:
    """C14: source keys, preferred ones first (in preference order), then the
    rest in document order."""
    keys = F.map_keys(data_sources)
    pref = F.array(*[F.lit(s) for s in SOURCE_ORDER])
    first = F.filter(pref, lambda s: F.array_contains(keys, s))
    return F.concat(first, F.filter(keys, lambda k: ~F.array_contains(pref, k)))


def canonical_band(filter_col) -> Column:
    """Raw filter name -> known band key, aliases applied, else Unknown."""
    f = F.col(filter_col) if isinstance(filter_col, str) else filter_col
    b = F.trim(F.coalesce(f, F.lit("Unknown")))
    known = F.array(*[F.lit(x) for x in BANDS])
    alias = F.coalesce(_map(BAND_ALIASES)[b], _map(BAND_ALIASES)[F.lower(b)], b)
    cand = F.when(F.array_contains(known, b), b).otherwise(alias)
    return F.when(F.array_contains(known, cand), cand).otherwise(F.lit("Unknown"))


def _is_list(raw: F.Column) -> F.Column:
    """Is a field's JSON a list?  Text that merely begins with a bracket is not."""
    return F.coalesce(raw.startswith("[") & F.from_json(raw, "array<string>").isNotNull(), F.lit(False))


def metadata_unpivot(docs: DataFrame) -> DataFrame:
    """Scalar fields of every source payload as (field, label, value)
    rows; list fields are left to N19; nested objects are kept as compact
    JSON; JSON nulls show as an em dash."""
    per_src = docs.select("archive_id", F.posexplode(ordered_sources(F.col("data_sources"))).alias("source_pos", "source"),
                          "data_sources")
    per_src = per_src.select("archive_id", "source_pos", "source", source_label(F.col("source")).alias("source_label"),
                             F.col("data_sources")[F.col("source")].alias("payload"))
    fields = per_src.select("archive_id", "source_pos", "source", "source_label",
                            F.posexplode(F.from_json("payload", "map<string,string>")).alias("field_pos", "field", "raw"))
    scalars = fields.where(~_is_list(F.col("raw")))
    return scalars.select("archive_id", "source_pos", "source", "source_label", "field_pos", "field",
                          field_label(F.col("field")).alias("label"),
                          F.coalesce("raw", F.lit(EM_DASH)).alias("value"))


def list_field_rows(docs: DataFrame) -> DataFrame:
    """List fields as long rows (field, row, column, value).  Object
    entries give one row per key; a bare scalar entry sits in the first
    column (``column`` NULL)."""
    per_src = docs.select("archive_id", F.explode("data_sources").alias("source", "payload"))
    fields = per_src.select("archive_id", "source", F.explode(F.from_json("payload", "map<string,string>"))
                            .alias("field", "raw")).where(_is_list(F.col("raw")))
    entries = fields.select("archive_id", "source", "field",
                            F.posexplode(F.from_json("raw", "array<string>")).alias("row", "entry"))
    obj = entries.where(F.col("entry").startswith("{")).select(
        "archive_id", "source", "field", "row",
        F.posexplode(F.from_json("entry", "map<string,string>")).alias("col_pos", "column", "value"))
    scal = entries.where(~F.col("entry").startswith("{") | F.col("entry").isNull()).select(
        "archive_id", "source", "field", "row", F.lit(0).alias("col_pos"), F.lit(None).cast("string").alias("column"),
        F.col("entry").alias("value"))
    out = obj.unionByName(scal)
    return out.select("archive_id", "source", "field", field_label(F.col("field")).alias("field_label"), "row",
                      "col_pos", "column", F.when(F.col("column").isNotNull(), field_label(F.col("column")))
                      .alias("column_label"), F.coalesce("value", F.lit(EM_DASH)).alias("value"))


def photometry_table(lc: DataFrame) -> DataFrame:
    """Table rows for points with an epoch and detection 0/1;
    magnitude ``%.2f`` or ``> limit``; kind; ordered by mjd."""
    p = lc.where(F.col("mjd").isNotNull() & F.col("detection").isin(0, 1))
    mag = F.when(F.col("detection") == 1, py_format("mag", ".2f")) \
        .otherwise(F.concat(F.lit("> "), py_format("limit", ".2f")))
    return p.select("obj_id", "mjd", F.coalesce(mag, F.lit(EM_DASH)).alias("magnitude"),
                    F.when(F.col("detection") == 1, "detection").otherwise("upper limit").alias("kind"),
                    canonical_band("filter").alias("band"), F.upper("survey").alias("survey"))


def _peak_entries(docs: DataFrame) -> DataFrame:
    """Every peak entry of every source payload: (archive_id, source, entry)."""
    per_src = docs.select("archive_id", F.explode("data_sources").alias("source", "payload"))
    fields = per_src.select("archive_id", "source", F.from_json("payload", "map<string,string>").alias("m"))
    raw = F.coalesce(F.nullif(F.col("m")["peak_mags"], F.lit("[]")), F.col("m")["peak_mag"])
    arr = F.when(raw.startswith("{"), F.array(raw)).otherwise(F.from_json(raw, "array<string>"))
    return fields.select("archive_id", "source", F.explode(arr).alias("entry")).select(
        "archive_id", "source", F.from_json("entry", "map<string,string>").alias("e"))


def brightest_across_sources(docs: DataFrame) -> DataFrame:
    """Smallest peak magnitude over all sources (first of limit / mag /
    value that is *present*; unreadable values ignored) and its filter."""
    e = F.col("e")
    raw = (F.when(F.map_contains_key(e, "limit"), e["limit"]).when(F.map_contains_key(e, "mag"), e["mag"])
           .otherwise(e["value"]))
    vals = _peak_entries(docs).select("archive_id", "source", raw.try_cast("double").alias("mag"),
                                      e["filter"].alias("filter")).where(F.col("mag").isNotNull() & ~F.isnan("mag"))
    best = vals.groupBy("archive_id").agg(F.min_by(F.struct("mag", "filter"), F.struct("mag", "source", "filter"))
                                         .alias("b"))
    return best.select("archive_id", F.col("b.mag").alias("peak_mag"), F.col("b.filter").alias("peak_filter"))


def first_present(data_sources: Column, sources: list[str], field: str) -> Column:
    """C11: first non-null ``field`` across ``sources`` in preference order."""
    return F.coalesce(*[F.get_json_object(data_sources[F.lit(s)], f"$.{field}") for s in sources])


def _is_number_field(data_sources: Column, source: str, field: str) -> Column:
    return data_sources[F.lit(source)].rlike(f'"{field}"\\s*:\\s*-?[0-9]')


def key_facts(docs: DataFrame, lc: DataFrame | None = None) -> DataFrame:
    """The six facts of an object page as columns: redshift (tns then
    sherlock, ``.4g``), host (tns hostname / host_name, else sherlock
    catalogue id), discovery date trimmed to the day (C20) with reporting
    group, peak magnitude ``.1f`` with filter (A6), distance ``.2f`` with
    ``Mpc`` only when numeric, detections with surveys (A4)."""
    ds = F.col("data_sources")
    red = first_present(ds, ["tns", "sherlock"], "redshift")
    red_num = red.try_cast("double")
    host = F.coalesce(first_present(ds, ["tns"], "hostname"), first_present(ds, ["tns"], "host_name"),
                      first_present(ds, ["sherlock"], "catalogue_object_id"))
    disc = F.coalesce(F.col("discovery_date"), first_present(ds, ["tns"], "discovery_date"))
    disc_day = F.split(F.regexp_replace(disc, "T", " "), " ")[0]
    dist = first_present(ds, ["sherlock"], "best_distance")
    dist_num = dist.try_cast("double")
    facts = docs.select(
        "archive_id",
        F.coalesce(F.when((red_num.isNotNull()) & (red_num != 0), py_format(red_num, ".4g"))
                   .when(red_num.isNull() & (F.coalesce(red, F.lit("")) != ""), red), F.lit(EM_DASH)).alias("redshift"),
        F.coalesce(F.nullif(host, F.lit("")), F.lit(EM_DASH)).alias("host"),
        F.coalesce(F.nullif(disc_day, F.lit("")), F.lit(EM_DASH)).alias("discovered"),
        first_present(ds, ["tns"], "reporting_group").alias("discovered_unit"),
        F.coalesce(F.when(dist_num.isNotNull(), py_format(dist_num, ".2f")).otherwise(dist), F.lit(EM_DASH))
        .alias("distance"),
        F.when(_is_number_field(ds, "sherlock", "best_distance"), F.lit("Mpc")).alias("distance_unit"))
    peak = brightest_across_sources(docs)
    out = facts.join(peak, "archive_id", "left").select(
        *facts.columns, F.coalesce(py_format("peak_mag", ".1f"), F.lit(EM_DASH)).alias("peak_mag"),
        F.col("peak_filter").alias("peak_unit"))
    if lc is not None:
        det = lc.groupBy(F.col("obj_id").alias("archive_id")).agg(
            F.expr("count_if(detection = 1)").alias("_n"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("detection") == 1, F.upper("survey")))), " + ")
            .alias("_s"))
        out = out.join(det, "archive_id", "left").select(
            *out.columns, F.coalesce(F.col("_n").cast("string"), F.lit(EM_DASH)).alias("detections"),
            F.nullif(F.col("_s"), F.lit("")).alias("detections_unit"))
    return out
