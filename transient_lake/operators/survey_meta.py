"""Per-survey metadata extraction.

Survey payloads arrive as wide rows with prefixed column names (``i:``,
``d:``, ``f:``).  The "newest row per object" step is a ``max_by``
aggregate (partial aggregation, no per-object window), and the kept
fields are chosen from the schema at plan time, then packed into a
``map<string,string>`` so objects with different non-null fields share one
column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up

from ..session import partitions
from .sky import nearest_match

# ZTF (Fink) fields kept as object metadata.
ZTF_META_COLUMNS = [
    "classification", "DR3Name", "anomaly_score", "blazar_stats_m0", "blazar_stats_m1", "blazar_stats_m2",
    "cdsxmatch", "gaiaClass", "gaiaVarFlag", "gcvs", "is_transient", "mangrove_2MASS_name",
    "mangrove_HyperLEDA_name", "mangrove_ang_dist", "mangrove_lum_dist", "mulens", "rf_kn_vs_nonkn",
    "rf_snia_vs_nonia", "slsn_score", "snn_sn_vs_all", "snn_snia_vs_nonia", "spicy_class", "spicy_id", "tns",
    "vsx", "x3hsp", "x4lac",
]
# Text that counts as a missing value in ZTF and in LSST payloads.
MISSING_TEXT = ["nan", "None"]
MISSING_TEXT_LSST = ["nan"]


def _newest(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """The row with the largest ``order``, of equal ones the largest by content."""
    packed = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    return df.groupBy(key).agg(F.max_by(packed, F.struct(F.col(f"`{order}`"), packed)).alias("_r"))


def _as_map(names: list[str], renamed: list[str], missing=MISSING_TEXT, fixed: dict[str, str | F.Column] | None = None) -> F.Column:
    """Kept fields of the newest row; ``fixed`` entries come first and stay whatever they hold."""
    entries, own = [], []
    for src, dst in zip(names, renamed):
        entries += [F.lit(dst), F.col(f"_r.`{src}`")]
    for dst, value in (fixed or {}).items():
        own += [F.lit(dst), F.lit(value) if isinstance(value, str) else value.cast("string")]
    m = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    m = F.map_filter(m, lambda k, v: v.isNotNull() & ~v.isin(*missing) & ~k.isin(*(fixed or {"": ""})))
    return F.map_concat(F.map_filter(F.create_map(*own), lambda k, v: v.isNotNull()), m) if own else m


def ztf_metadata(rows: DataFrame, key: str = "obj_id", object_id: str | None = None) -> DataFrame:
    """Newest row by ``i:jd``; 2-character prefixes stripped; only the
    whitelisted fields; NULL / 'nan' / 'None' values dropped.  With
    ``object_id`` (the column of the survey's name) the name is added, and the
    name of the id's source."""
    keep = [c for c in rows.columns if c not in (key, object_id) and c[2:] in ZTF_META_COLUMNS]
    newest = _newest(rows, key, "i:jd", [*keep, *([object_id] if object_id else [])])
    fixed = {"object_id": F.col(f"_r.`{object_id}`"), "source_id_name": "objectId"} if object_id else None
    return newest.select(key, _as_map(keep, [c[2:] for c in keep], fixed=fixed).alias("meta"))


def lsst_metadata(rows: DataFrame, key: str = "obj_id", object_id: str | None = None, position: DataFrame | None = None) -> DataFrame:
    """Newest row by ``r:midpointMjdTai``; ``f:`` fields whose name has
    neither 'tns' nor 'version'; 'nan' values dropped.  With ``object_id`` the
    survey's id and the name of the id's source are added, with ``position``
    (key, ra_deg, dec_deg) the object's own coordinates."""
    keep = [c for c in rows.columns if c.startswith("f") and "tns" not in c and "version" not in c]
    newest = _newest(rows, key, "r:midpointMjdTai", [*keep, *([object_id] if object_id else [])])
    fixed: dict = {"object_id": F.col(f"_r.`{object_id}`"), "source_id_name": "diaObjectId"} if object_id else {}
    if position is not None:
        newest = newest.join(position.select(key, "ra_deg", "dec_deg"), key, "left")
        fixed |= {"ra_deg": F.col("ra_deg"), "dec_deg": F.col("dec_deg")}
    return newest.select(key, _as_map(keep, [c[2:] for c in keep], MISSING_TEXT_LSST, fixed or None).alias("meta"))


def alerce_best_class(probs: DataFrame, classifiers: DataFrame, key: str = "oid") -> DataFrame:
    """Per object and survey, the configured classifier's rank-1 class
    (NaN probability -> NULL), pivoted to lsst_* / ztf_* columns.

    ``classifiers``: (survey, classifier_name) - one row per survey."""
    p = (probs.join(classifiers, ["survey", "classifier_name"]).where(F.col("ranking") == 1)
         .withColumn("probability", F.nanvl("probability", F.lit(None))))
    # several rank-1 rows: first by class name and version, then the most
    # probable (NULL last)
    order = F.struct("class_name", "classifier_version", F.col("probability").isNull(), -F.col("probability"))
    # by key first: a task then aggregates one shuffle partition, not all that it read of the table
    best = p.repartition(partitions(probs.sparkSession), key).groupBy(key, "survey").agg(F.min_by(
        F.struct("classifier_name", "class_name", "probability", "classifier_version"), order).alias("b"))
    out = best.groupBy(key).agg(*[
        F.max(F.when(F.col("survey") == s, F.col(f"b.{f}"))).alias(f"{s}_{n}")
        for s in ("lsst", "ztf")
        for f, n in (("classifier_name", "classifier"), ("class_name", "class_name"),
                     ("probability", "class_prob"), ("classifier_version", "class_version"))])
    return out


# ZTF filter ids -> bands.
FID_BANDS = {1: "g", 2: "r", 3: "i"}


def alerce_spm_features(features: DataFrame, key: str = "oid") -> DataFrame:
    """SPM features with band names (long form: one row per feature)
    and the version of each object's first feature row."""
    bands = F.create_map(*[F.lit(x) for kv in FID_BANDS.items() for x in kv])
    f = features.where(F.col("name").startswith("SPM")).select(
        key, "name", F.nanvl("value", F.lit(None)).alias("value"), F.lit("ZTF").alias("survey"),
        bands[F.col("fid")].alias("filter"), "fid", "version")
    ver = f.groupBy(key).agg(F.min_by("version", F.struct("name", "fid")).alias("feature_version"))
    return f.drop("fid", "version").join(ver, key)


def atlas_metadata(rows: DataFrame, key: str = "obj_id") -> DataFrame:
    """Position of the first (earliest) forced-photometry row, 6 digits."""
    first = rows.groupBy(key).agg(F.min_by(F.struct("RA", "Dec"), F.struct("MJD", "RA", "Dec")).alias("f"))
    return first.select(key, round_half_up("f.RA", 6).alias("ra_deg"), round_half_up("f.Dec", 6).alias("dec_deg"))


def antares_metadata(objects: DataFrame, loci: DataFrame, radius_arcsec: float = 5.0) -> DataFrame:
    """Nearest locus within the radius: id, position, separation
    (6 digits) and its tag array."""
    m = nearest_match(objects, loci.select(F.col("locus_id").alias("cat_id"), "ra_deg", "dec_deg"), radius_arcsec)
    out = m.join(loci.select(F.col("locus_id").alias("match_id"), "tags"), "match_id")
    return out.select("obj_id", F.col("match_id").alias("locus_id"), F.col("match_ra").alias("ra_deg"),
                      F.col("match_dec").alias("dec_deg"), round_half_up("sep_arcsec", 6).alias("separation_arcsec"), "tags")
