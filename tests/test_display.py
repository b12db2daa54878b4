"""Object-page goldens (the literal cases of the reference's dashboard tests)."""

import json

import pytest

from transient_lake.operators import display as D
from transient_lake.operators import photometry as ph
from transient_lake.operators import search as S

DOC = "archive_id string, discovery_date string, data_sources map<string,string>"
LC = ("obj_id string, survey string, filter string, mjd double, mag double, mag_err double, `limit` double, "
      "fwhm double, detection int, camera string")


def _docs(spark, *docs):
    return spark.createDataFrame([(i, d.get("discovery_date"), {k: json.dumps(v) for k, v in d["ds"].items()})
                                  for i, d in docs], DOC)


def _facts(spark, *docs, lc=None):
    return {r.archive_id: r for r in D.key_facts(_docs(spark, *docs), lc).collect()}


def test_redshift_prefers_tns_then_sherlock(spark):
    f = _facts(spark, ("a", {"ds": {"tns": {"redshift": 0.000804}, "sherlock": {"redshift": 0.021}}}),
               ("b", {"ds": {"tns": {"redshift": None}, "sherlock": {"redshift": 0.021}}}),
               ("c", {"ds": {"tns": {}}}))
    assert f["a"].redshift == "0.000804" and f["b"].redshift == "0.021" and f["c"].redshift == "—"


def test_brightest_peak_ignores_null_and_junk(spark):
    docs = ("x", {"ds": {"ztf": {"peak_mags": [{"filter": "g", "limit": 11.58}]},
                         "atlas": {"peak_mags": [{"filter": "o", "limit": 10.94}, {"filter": "c", "limit": None}]},
                         "fink": {"peak_mag": {"filter": "r", "mag": "junk"}}}})
    f = _facts(spark, docs)
    assert (f["x"].peak_mag, f["x"].peak_unit) == ("10.9", "o")


def test_discovery_date_trimmed_and_distance_units(spark):
    f = _facts(spark, ("a", {"ds": {"tns": {"discovery_date": "2023-05-19T17:27:15", "reporting_group": "ZTF"},
                                    "sherlock": {"best_distance": 6.8512}}}),
               ("b", {"ds": {"tns": {}, "sherlock": {"best_distance": "unknown"}}}))
    assert (f["a"].discovered, f["a"].discovered_unit) == ("2023-05-19", "ZTF")
    assert (f["a"].distance, f["a"].distance_unit) == ("6.85", "Mpc")
    assert (f["b"].distance, f["b"].distance_unit) == ("unknown", None)


def test_detection_summary(spark):
    lc = spark.createDataFrame([("a", "ztf", "g", 1.0, 18.0, 0.1, 19.0, None, 1, "m"),
                                ("a", "atlas", "o", 2.0, 18.0, 0.1, 19.0, None, 1, "m"),
                                ("a", "atlas", "o", 3.0, None, None, 19.0, None, 0, "m"),
                                ("a", "ztf", "g", 4.0, 18.0, 0.1, 19.0, None, -1, "m")], LC)
    f = _facts(spark, ("a", {"ds": {"tns": {}}}), lc=lc)
    assert (f["a"].detections, f["a"].detections_unit) == ("2", "ATLAS + ZTF")


def test_photometry_table_rows(spark):
    lc = spark.createDataFrame([("a", "ztf", "R", 3.0, 18.123, 0.1, 19.0, None, 1, "m"),
                                ("a", "ztf", "g", 1.0, None, None, 19.24, None, 0, "m"),
                                ("a", "ztf", "g", 2.0, 17.0, 0.1, 19.0, None, -1, "m"),
                                ("a", "ztf", "g", None, 17.0, 0.1, 19.0, None, 1, "m")], LC)
    rows = D.photometry_table(lc).orderBy("mjd").collect()
    assert [(r.mjd, r.magnitude, r.kind, r.band) for r in rows] == [
        (1.0, "> 19.24", "upper limit", "g"), (3.0, "18.12", "detection", "r")]


@pytest.mark.parametrize("raw,band", [("R", "r"), ("g_ASAS-SN", "g"), ("y", "z"), (" V ", "V"), ("Q", "Unknown"),
                                      (None, "Unknown")])
def test_canonical_band(spark, raw, band):
    df = spark.createDataFrame([(raw,)], "f string")
    assert df.select(D.canonical_band("f").alias("b")).first().b == band


def test_unplottable_points_make_no_series(spark):
    lc = spark.createDataFrame([("a", "ztf", "g", 1.0, None, None, None, None, 1, "m"),
                                ("a", "ztf", "g", 2.0, None, None, None, None, 0, "m"),
                                ("a", "atlas", "o", 2.0, 18.0, 0.1, None, None, 1, "m"),
                                ("a", "atlas", "c", 3.0, None, None, 19.0, None, 0, "m")], LC)
    labels = sorted(r.label for r in ph.lightcurve_series(lc).collect())
    assert labels == ["ATLAS c", "ATLAS o"]


def test_paging_values_must_be_integers(spark):
    meta = spark.createDataFrame([], "source_id string, source string, discovery_date string, ra_hms string, "
                                     "dec_dms string, data_sources map<string,string>")
    assert S.alerts_page(meta, True, 0).count() == 0  # a bool is an int, as in Python
    for bad in (("25", 0), (25, 1.5), (-1, 0), (None, 0)):
        with pytest.raises(ValueError):
            S.alerts_page(meta, *bad)


def test_empty_search_returns_everything(spark):
    docs = spark.createDataFrame([("a", [(1.0, "ztf", "g", 1.0)])],
                                 "obj_id string, mags array<struct<value:double,source:string,filter:string,mjd:double>>")
    assert S.search_objects(docs, {}).count() == 1


def test_metadata_unpivot_labels_and_dash(spark):
    docs = _docs(spark, ("a", {"ds": {"sherlock": {"x3hsp": 1, "catalogue_object_id": None, "nested": {"k": 1}},
                                      "tns": {"object_type": "SN Ia", "peak_mags": [{"filter": "g"}]}}}))
    rows = D.metadata_unpivot(docs).orderBy("source_pos", "field_pos").collect()
    assert [(r.source, r.label, r.value) for r in rows] == [
        ("tns", "Object Type", "SN Ia"), ("sherlock", "X3Hsp", "1"), ("sherlock", "Catalogue Object ID", "—"),
        ("sherlock", "Nested", '{"k":1}')]
    lists = D.list_field_rows(docs).collect()
    assert [(r.field_label, r.column_label, r.value) for r in lists] == [("Peak Magnitudes", "Filter", "g")]
