"""Catalogue assembly and maintenance: J4-J11, S6/S7, S10/S11, U2/U3, W6,
F2/F3/F6, N7/N8/N13-N15 and the refresh work list (ST6, batch form).

The reference builds one object document per call; here every operator
works on whole tables: source tables are joined on ``archive_id`` and the
open ``data_sources`` part of a document is a ``map<string, string>`` of
JSON payloads, one entry per source that matched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..sources.config import ACTIVE_DEFAULTS
from .numbering import number_by_digest
from .photometry import default_days

# --- N7, N8, N13-N15 -----------------------------------------------------


def tns_metadata(raw: DataFrame, key: str = "archive_id") -> DataFrame:
    """The twelve fields of interest of a name-server record (nested, as
    the service sends it); discovery date in ISO ``T`` form."""
    return raw.select(
        key, F.col("objname").alias("object_id"), F.lit("objname").alias("source_id_name"),
        F.col("radeg").alias("ra_deg"), F.col("decdeg").alias("dec_deg"), F.col("ra").alias("ra_hms"),
        F.col("dec").alias("dec_dms"), F.col("object_type.name").alias("object_type"), "redshift", "hostname",
        F.regexp_replace("discoverydate", " ", "T").alias("discovery_date"),
        F.col("reporting_group.group_name").alias("reporting_group"),
        F.col("discovery_data_source.group_name").alias("discovery_data_source"))


def sherlock_metadata(crossmatches: DataFrame, key: str = "archive_id") -> DataFrame:
    """The best-ranked contextual crossmatch per object; raDeg/decDeg/z
    renamed, the transient id dropped.  ``min_by`` on rank is an aggregate
    (map-side partial), so one object with many crossmatches stays cheap."""
    cols = [c for c in crossmatches.columns if c not in (key, "transient_object_id")]
    best = crossmatches.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("rank", "catalogue_object_id"))
                                         .alias("m"))
    out = best.select(key, "m.*").drop("rank")
    return (out.withColumnRenamed("raDeg", "ra_deg").withColumnRenamed("decDeg", "dec_deg")
            .withColumnRenamed("z", "redshift"))


def frb_name_fix(df: DataFrame, name: str = "name", type_col: str = "type") -> DataFrame:
    """FRB objects are named with an ``FRB`` prefix."""
    fixed = F.when((F.col(type_col) == "FRB") & ~F.col(name).startswith("FRB"),
                   F.concat(F.lit("FRB"), F.col(name))).otherwise(F.col(name))
    return df.withColumn("object_id", fixed)


def clean_empty_fields(df: DataFrame) -> DataFrame:
    """Empty arrays become NULL (and so vanish from ``to_json``);
    empty entries are removed from maps."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if t == "array":
            out.append(F.when(F.size(c) > 0, c).alias(f.name))
        elif t == "map":
            out.append(F.map_filter(c, lambda k, v: v.isNotNull() & (v != F.lit("[]"))).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


# Where a word begins inside a camel-case name.
CAMEL_BREAKS = ("(.)([A-Z][a-z]+)", "([a-z0-9])([A-Z])")


def camel_to_snake(col) -> Column:
    """CamelCase to snake_case, for values."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(reduce(lambda x, at: F.regexp_replace(x, at, "$1_$2"), CAMEL_BREAKS, c))


def snake_case_columns(df: DataFrame) -> DataFrame:
    """N15 for names: the column names of ``df`` through the same expression
    (constants, so Spark folds them while planning)."""
    names = df.sparkSession.range(1).select(*[camel_to_snake(F.lit(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return df.toDF(*names.first())


# --- J4 ------------------------------------------------------------------

def assemble_metadata(envelope: DataFrame, sources: dict[str, DataFrame], key: str = "archive_id") -> DataFrame:
    """Envelope + one JSON payload per matching source.

    Each source table has one row per ``key``; it is left-joined and packed
    as ``to_json(struct(*))``.  Sources without a row are absent from the
    map (``map_filter`` on NULL), matching the reference's omitted keys."""
    out = envelope
    entries = []
    for name, df in sources.items():
        payload_cols = [c for c in df.columns if c != key]
        packed = df.select(key, F.to_json(F.struct(*payload_cols)).alias(f"_src_{name}"))
        out = out.join(packed, key, "left")
        entries += [F.lit(name), F.col(f"_src_{name}")]
    ds = F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())
    return out.withColumn("data_sources", ds).drop(*[f"_src_{n}" for n in sources])


# --- J6, J7, U3 ----------------------------------------------------------

def missing_ids(all_ids: DataFrame, current: DataFrame, key: str = "source_id") -> DataFrame:
    """Ids of the public catalogue not yet ingested (distinct)."""
    return all_ids.select(key).distinct().join(current.select(key), key, "left_anti")


def restrict_to_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the id list (semi join, no duplicates)."""
    return df.join(ids.select(key), key, "left_semi")


# --- J8 / T4, J9 ---------------------------------------------------------

def resolve_source_ids(requests: DataFrame, meta: DataFrame) -> DataFrame:
    """Each requested source_id -> archive_id of its most recently
    updated document (NULL when unknown).  The newest-per-source_id step is
    a ``max_by`` aggregate, so duplicated source ids reduce map-side."""
    latest = meta.groupBy("source_id").agg(
        F.max_by("archive_id", F.struct("update_date", "archive_id")).alias("archive_id"))
    return requests.select("source_id").join(latest, "source_id", "left")


def get_documents(ids: DataFrame, meta: DataFrame, key: str = "archive_id", fields=None) -> DataFrame:
    """Documents for a list of ids; unknown ids give NULL fields.
    ``fields`` restricts to sub-fields (Catalyst prunes the scan)."""
    m = meta if fields is None else meta.select(key, *fields)
    return ids.select(key).join(m, key, "left")


# --- J10, J11, U4 --------------------------------------------------------

def citations_for(meta: DataFrame, stems: DataFrame, bibtex: DataFrame) -> DataFrame:
    """Per object, its sources' citation texts in source order,
    distinct, concatenated with new lines; unmapped source keys reported.

    ``stems``: (source, stem) registry, ``bibtex``: (stem, text).  Both are
    dimension tables with one row per source / file, small by construction,
    so Spark broadcasts them by measured size."""
    keys = meta.select("archive_id", F.posexplode(F.map_keys("data_sources")).alias("pos", "source"))
    j = keys.join(stems, "source", "left").join(bibtex, "stem", "left")
    # one entry per stem, at the position of its first source with a text
    per_stem = j.groupBy("archive_id", "stem").agg(
        F.min(F.when(F.col("text").isNotNull(), F.col("pos"))).alias("pos"), F.max("text").alias("text"),
        F.collect_set(F.when(F.col("stem").isNull(), F.col("source"))).alias("sources"))
    cited = F.when(F.col("text").isNotNull(), F.struct("pos", "text"))
    per = per_stem.groupBy("archive_id").agg(F.array_sort(F.collect_list(cited)).alias("texts"),
                                             F.array_sort(F.flatten(F.collect_list("sources"))).alias("unmapped"))
    return per.select("archive_id", "unmapped", F.when(F.size("texts") > 0, F.array_join(
        F.transform("texts", lambda x: x["text"]), "\n")).alias("citations"))


def hit_source_citations(members: DataFrame, associated: DataFrame, registry: DataFrame) -> DataFrame:
    """Per hit, the citation entries of every survey among its members.
    The survey list per hit is a ``collect_set`` (bounded by the number of
    surveys); the two dimension tables are broadcast by measured size."""
    per = members.select("xmatch_id", F.col("source").alias("survey")).distinct()
    j = per.join(associated, "survey").join(registry, "key")
    return j.groupBy("xmatch_id").agg(F.array_sort(F.collect_set(
        F.struct("alias", "name", "bibcode", "reference"))).alias("sources"))


# --- S10, S11, U2 --------------------------------------------------------

def last_change(changes: DataFrame, key: str | list[str], order: str | None = None) -> DataFrame:
    """One change a key: the one with the largest ``order``, of equal ones
    (or without ``order``) the largest by content, whatever the row order."""
    keys = [key] if isinstance(key, str) else key
    cols = [c for c in changes.columns if c not in keys]
    if not cols:
        return changes.distinct()
    content = F.to_json(F.struct(*cols))
    rank = content if order is None else F.struct(F.col(order), content)
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("_c")).select(*keys, "_c.*")


def upsert(target: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Whole-document insert-or-replace.  With several changes for a
    key the one with the largest ``order`` wins, ties by content; without
    ``order`` the caller gives one change a key."""
    if order is not None:
        changes = last_change(changes, key, order)
    kept = target.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.select(*target.columns))


def set_fields(target: DataFrame, changes: DataFrame, key: str | list[str], fields: list[str],
               order: str | None = None) -> DataFrame:
    """Overwrite only ``fields`` of matched documents.  ``changes``
    carries ``<field>`` plus a boolean ``set_<field>`` so NULL can be set.
    Several changes of a document are reduced field by field: the one with
    the largest ``order`` that sets the field wins, ties by the larger value
    (NULL smallest)."""
    keys = [key] if isinstance(key, str) else key
    def newest(f: str) -> Column:
        rank = F.struct(F.col(f)) if order is None else F.struct(F.col(order), F.col(f))
        return F.max(F.when(F.col(f"set_{f}"), F.struct(rank.alias("r"), F.col(f).alias("v")))).alias(f"_new_{f}")
    j = target.join(changes.groupBy(*keys).agg(*[newest(f) for f in fields]), keys, "left")
    out = [F.when(F.col(f"_new_{f}").isNotNull(), F.col(f"_new_{f}.v")).otherwise(F.col(f)).alias(f)
           if f in fields else F.col(f) for f in target.columns]
    return j.select(*out)


def replace_survey_points(lc: DataFrame, new_points: DataFrame, refreshed: DataFrame, survey: str) -> DataFrame:
    """For refreshed objects (their pull returned metadata) drop the
    survey's old points and append the new ones.  A refreshed object with no
    new points loses its old points, as in the reference."""
    r = refreshed.select("obj_id").distinct().withColumn("survey", F.lit(survey))
    kept = lc.join(r, ["obj_id", "survey"], "left_anti")
    return kept.unionByName(new_points.select(*lc.columns))


# --- W6 / C9 -------------------------------------------------------------

ID_LEN = 6


def base36(n, width: int = ID_LEN) -> Column:
    """Integer -> base-36 (0-9A-Z) left-padded to ``width``; overflow
    keeps the first ``width`` digits like the reference."""
    c = F.col(n) if isinstance(n, str) else n
    return F.substring(F.lpad(F.conv(c.cast("string"), 10, 36), width, "0"), 1, width)


def assign_ids(new: DataFrame, registry: DataFrame) -> DataFrame:
    """Reuse the id of a known source_id, else the next yearly counter.

    ``new``: (source_id, year), of a source under several years the first
    counts; ``registry``: (year, idx, archive_id, source_id), of several ids
    of a source the latest by (year, idx) is reused.  New rows of a year get
    consecutive numbers after the year's maximum through ``number_by_digest``
    (slices + offsets), so a year holding most of the rows is still numbered
    by many tasks.  A year out of numbers is flagged ``overflow`` and gets no
    id (NULL)."""
    reg_latest = registry.groupBy("source_id").agg(F.max_by("archive_id", F.struct("year", "idx")).alias("known_id"))
    cand = new.groupBy("source_id").agg(F.min("year").alias("year")).join(reg_latest, "source_id", "left")
    base = registry.groupBy("year").agg(F.max("idx").alias("_max"))
    fresh = number_by_digest(cand.where("known_id is null"), ["year"], "source_id", "_k")
    numbered = (fresh.join(base, "year", "left")
                .withColumn("idx", F.col("_k") + F.coalesce("_max", F.lit(0))))
    new_ids = numbered.select("source_id", "year", "idx",
                              F.when(F.col("idx") < F.lit(36 ** ID_LEN), yearly_id("year", "idx")).alias("archive_id"),
                              (F.col("idx") >= F.lit(36 ** ID_LEN)).alias("overflow"),
                              F.lit(True).alias("is_new"))
    known = cand.where("known_id is not null").select(
        "source_id", "year", F.lit(None).cast("long").alias("idx"), F.col("known_id").alias("archive_id"),
        F.lit(False).alias("overflow"), F.lit(False).alias("is_new"))
    return new_ids.unionByName(known)


def yearly_id(year: str, idx: str) -> Column:
    """TXV-<year>-<number in base 36>."""
    return F.concat(F.lit("TXV-"), F.col(year).cast("string"), F.lit("-"), base36(idx))


# --- F2, F3, F6 ----------------------------------------------------------

def catalogue_objects(meta: DataFrame, source: str) -> DataFrame:
    """(archive_id, source_id) of one catalogue source."""
    return meta.where(F.col("source") == source).select("archive_id", "source_id")


def active_objects(meta: DataFrame, settings: DataFrame, source: str | None, now: str,
                   defaults: dict[str, tuple[int, int]] = ACTIVE_DEFAULTS) -> DataFrame:
    """objects of ``source`` (of every source without one) discovered
    fewer than ``active_days`` whole days before ``now`` (a parameter, not the
    wall clock).  Objects without a setting take their source's default; a
    source without one needs a setting."""
    m = meta if source is None else meta.where(F.col("source") == source)
    j = m.join(settings.select("archive_id", "active_days"), "archive_id", "left")
    days = F.datediff(F.to_date(F.lit(now)), F.col("discovery_date").try_cast("date"))
    return (j.where(days < F.coalesce("active_days", default_days(F.col("source"), 1, defaults)))
            .select("archive_id", "source", "source_id"))


def due_sources(meta: DataFrame, source_config, now: str, compat: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(object, source) pairs due for a refresh: update_date plus the
    source's update_frequency days has passed.  ``compat=True`` keeps the
    reference's inverted test (refresh while still fresh, D5).

    ``source_config`` is the list of configuration rows (name, meta_only,
    survey_name, update_frequency) - a handful of constants - so each object
    row is expanded in place by an ``explode`` of those rows: no join and no
    shuffle.  ``keep`` names further columns of ``meta`` to return."""
    rows = F.array(*[F.struct(F.lit(n).alias("source_name"), F.lit(m).alias("meta_only"),
                              F.lit(f).alias("update_frequency")) for n, m, _s, f in source_config])
    x = meta.select("archive_id", *keep, "update_date", F.inline(rows))
    due_at = F.expr("timestampadd(DAY, update_frequency, cast(update_date as timestamp))")
    t_now = F.lit(now).cast("timestamp")
    cond = (due_at >= t_now) if compat else (due_at <= t_now)
    return x.where(cond).select("archive_id", *keep, "source_name", "meta_only")


def refresh_requests(all_ids: DataFrame, meta: DataFrame, settings: DataFrame, source_config: DataFrame,
                     now: str) -> DataFrame:
    """ST6 (batch): the work list - missing ids go to bulk ingest, active
    objects to the update queue (D6), due (object, source) pairs to refresh."""
    miss = missing_ids(all_ids, catalogue_objects(meta, "tns")).select(
        F.col("source_id").alias("object_id"), F.lit("bulk").alias("queue"), F.lit(None).cast("string").alias("source_name"))
    act = active_objects(meta, settings, "tns", now).select(
        F.col("source_id").alias("object_id"), F.lit("update").alias("queue"), F.lit(None).cast("string").alias("source_name"))
    due = due_sources(meta, source_config, now, keep=("source_id",)).select(
        F.col("source_id").alias("object_id"), F.lit("refresh").alias("queue"), "source_name")
    return reduce(DataFrame.unionByName, [miss, act, due])


# --- S6, S7 --------------------------------------------------------------

# Where each schema generation keeps the two collections
# (scope, metadata collection, light-curve collection).
SCHEMA_LAYOUTS = {
    "new": ("objects", "meta", "lightcurves"),
    "old": ("tns", "objects", "lightcurves"),
}


def layout_tables(layout: str) -> tuple[str, str]:
    """Table names of a layout's metadata and light-curve collections."""
    scope, meta, lc = SCHEMA_LAYOUTS[layout]
    return f"{scope}_{meta}", f"{scope}_{lc}"


def export_frame(meta: DataFrame, lc: DataFrame, key: str = "archive_id", limit: int | None = None) -> DataFrame:
    """S6 (pre-write frame): one row per object ``{id, meta, lc}``; ``limit``
    keeps the first N ids.  The light-curve array is one object's light
    curve - the document the dump writes - built by a grouped
    ``collect_list``."""
    m = meta.orderBy(key).limit(limit) if limit else meta
    pts = lc.withColumnRenamed("obj_id", key)
    if limit:  # only the chosen objects' points are grouped
        pts = pts.join(m.select(key), key, "left_semi")
    cols = [c for c in pts.columns if c != key]
    per = pts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("lc"))
    meta_cols = [c for c in m.columns if c != key]
    return m.join(per, key, "left").select(key, F.struct(*meta_cols).alias("meta"), "lc")


def export_archive(meta: DataFrame, lc: DataFrame, path: str, key: str = "archive_id", limit: int | None = None) -> None:
    """Write the dump as JSON lines, one ``{id, meta, lc}`` per object;
    NULL fields are written, so no column gets lost."""
    export_frame(meta, lc, key, limit).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_layout(spark, path: str, layout: str = "new", key: str = "archive_id", limit: int | None = None) -> None:
    """S6 from a layout's tables in the session catalog."""
    meta_t, lc_t = layout_tables(layout)
    export_archive(spark.table(meta_t), spark.table(lc_t), path, key, limit)


# The columns of a light-curve point in a dump.
POINT_SCHEMA = ("survey string, filter string, mjd double, mag double, mag_err double, `limit` double, fwhm double, "
                "detection int, camera string")


def import_archive(spark, path: str, key: str = "archive_id", meta_schema: str | None = None, lc_schema: str | None = None):
    """Inverse of S6 -> (meta, lc) DataFrames.  Without schemas the types
    are inferred; points that are not there at all get ``POINT_SCHEMA``.  An
    object without points has no row in lc."""
    seen = {f.name: f.dataType for f in spark.read.json(path).schema.fields}

    def struct_of(schema: str | None, found, default: str) -> StructType:
        if schema is not None:
            return StructType.fromDDL(schema)
        return found if isinstance(found, StructType) else StructType.fromDDL(default)
    points = seen.get("lc")
    point = struct_of(lc_schema, points.elementType if isinstance(points, ArrayType) else None, POINT_SCHEMA)
    meta = struct_of(meta_schema, seen.get("meta"), "")
    read = spark.read.schema(StructType([StructField(key, seen.get(key, StringType())), StructField("meta", meta),
                                         StructField("lc", ArrayType(point))])).json(path)
    return (read.select(key, "meta.*") if meta.fields else read.select(key)), read.select(key, F.inline("lc"))


def import_documents(spark, path: str, key: str = "archive_id") -> DataFrame:
    """S7 for open documents: (key, meta, lc) of a dump with meta and lc as
    VARIANT, so JSON nulls, number forms and nesting are kept whatever the
    documents hold."""
    doc = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.parse_json("value").alias("d"))
    return doc.select(F.variant_get("d", f"$.{key}", "string").alias(key), F.variant_get("d", "$.meta", "variant").alias("meta"),
                      F.variant_get("d", "$.lc", "variant").alias("lc"))


def load_layout(spark, path: str, base: str, layout: str = "new", key: str = "archive_id") -> tuple[str, str]:
    """S7 into a layout: the dump's metadata and light curves are written as
    the layout's two tables (under ``base``) and registered by name."""
    meta, lc = import_archive(spark, path, key)
    names = layout_tables(layout)
    for df, name in zip((meta, lc), names):
        df.write.mode("overwrite").option("path", f"{base.rstrip('/')}/{name}").saveAsTable(name)
    return names


# --- F9 ------------------------------------------------------------------

def register_views(frames: dict[str, DataFrame]) -> None:
    """name DataFrames as temporary views for free SQL text."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def run_sql(spark, statement: str, **args) -> DataFrame:
    """SQL over registered views with named parameter markers
    (``:name``); values are bound, never pasted into the text."""
    return spark.sql(statement, args=args or None)
