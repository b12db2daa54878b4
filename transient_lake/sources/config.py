"""Configuration dimension tables (M10, M11) and their fixed values.

These tables have one row per configured source, so they are tiny and
constant in size; operators broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Per-source refresh settings
# (name, meta_only, survey_name, update_frequency in days).
SOURCE_CONFIG = [
    ("tns", True, None, 1),
    ("atlas", False, "atlas", 30),
    ("fink_ztf", False, "ztf", 1),
    ("fink_lsst", False, "lsst", 1),
    ("lasair", True, None, 30),
    ("antares", True, None, 10),
    ("asas_sn", False, "asas-sn", 1),
    ("alerce", True, None, 10),
]

# Metadata source key -> citation file stem.
SOURCE_TO_BIB = {
    "tns": "tns",
    "ztf": "ztf",
    "atlas": "atlas",
    "atlas_twb": "atlas_twb",
    "fink": "fink",
    "mangrove": "mangrove",
    "sherlock": "sherlock",
    "asas_sn": "asas-sn",
    "asas-sn": "asas-sn",
    "asas_sn_skypatrol": "asas-sn_skypatrol",
    "asas-sn_skypatrol": "asas-sn_skypatrol",
    "lasair": "lasair",
    "lsst": "lsst",
    # stems that have citation files but no mapping in the reference
    "fink_ztf": "fink_ztf",
    "fink_lsst": "fink_lsst",
    "antares": "antares",
    "alerce": "alerce",
}

# Citation registry (key, name, bibcode, reference, alias).
SOURCE_REGISTRY = [
    ("tns", "tns", "2021AAS...23742305G", "Gal-Yam et al. 2021", 0),
    ("atlas", "atlas_survey", "2018PASP..130f4505T", "Tonry et al. 2018", 1),
    ("atlas_twb", "atlas_twb", "2020PASP..132h5002S", "Smith et al. 2020", 2),
    ("ztf", "ztf_survey", "2019PASP..131a8002B", "Belim et al. 2019", 3),
    ("fink", "fink", "2021MNRAS.501.3272M", "Möller et al. 2020", 4),
    ("asas-sn", "asas-sn_survey", "2014ApJ...788...48S", "Shappee et al. 2014", 5),
    ("asas-sn_skypatrol", "asas-sn_skypatrol", "2023arXiv230403791H", "Hart et al. 2023", 6),
    ("sherlock", "sherlock", "10.5281/zenodo.8038057", "Young et al. 2023", 7),
    ("mangrove", "mangrove", "2020MNRAS.492.4768D", "Ducoin et al. 2020", 8),
    ("lasair", "lasair", "2019RNAAS...3...26S", "Smith et al. 2019", 8),
    ("lsst", "lsst_survey", "2019ApJ...873..111I", "Ivezić et al. 2019", 8),
]

# Our decision (the reference's config lacks the key): registry entries
# cited for each alert survey of a hit.
ASSOCIATED_SOURCES = [("ztf", "ztf"), ("lsst", "lsst"), ("atlas", "atlas"), ("atlas", "atlas_twb"),
                      ("asas-sn", "asas-sn")]

# Preferred order of sources on an object page.
DATA_SOURCE_ORDER = ["tns", "sherlock", "fink_ztf", "fink_lsst", "antares", "asas_sn"]

# Default active windows (days) per catalogue kind.
ACTIVE_DEFAULTS = {"tns": (30, 60), "xmatch": (7, 14)}

# ALeRCE classifiers used for the best class per survey.
ALERCE_CLASSIFIERS = {"lsst": "stamp_classifier_rubin_beta_20260421", "ztf": "lc_classifier_BHRF_forced_phot"}

# Cross-match radius (arcsec), look-back (hours), id digits.
XMATCH_RADIUS_ARCSEC = 4.0
XMATCH_WINDOW_HOURS = 120
XMATCH_ID_LEN = 6


def source_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SOURCE_CONFIG, "source_name string, meta_only boolean, survey_name string, update_frequency int")


def citation_stems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SOURCE_TO_BIB.items()), "source string, stem string")


def source_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCE_REGISTRY, "key string, name string, bibcode string, reference string, alias int")


def associated_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASSOCIATED_SOURCES, "survey string, key string")


def values_sql(rows, cols) -> str:
    """The same rows as a DuckDB ``VALUES`` relation (for oracles)."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(select * from (values {body}) t({', '.join(cols)}))"


SOURCE_CONFIG_SQL = values_sql(SOURCE_CONFIG, ["source_name", "meta_only", "survey_name", "update_frequency"])
CITATION_STEMS_SQL = values_sql(sorted(SOURCE_TO_BIB.items()), ["source", "stem"])
SOURCE_REGISTRY_SQL = values_sql(SOURCE_REGISTRY, ["key", "name", "bibcode", "reference", "alias"])
ASSOCIATED_SOURCES_SQL = values_sql(ASSOCIATED_SOURCES, ["survey", "key"])
