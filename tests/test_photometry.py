"""Light-curve summaries on hand-made curves (edge rows from SURVEY §5)."""

import re

import pytest

from transient_lake.operators import photometry as ph

SCHEMA = ("obj_id long, survey string, filter string, mjd double, mag double, mag_err double, `limit` double, "
          "fwhm double, detection int, camera string")


def _lc(spark, rows):
    return spark.createDataFrame([(1, "ztf", *r[:1], r[1], r[2], 0.1, r[3], None, r[4], "main") for r in rows], SCHEMA)


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_single_detection_has_no_rate(spark):
    r = _one(ph.latest_detections(_lc(spark, [("g", 60000.0, 18.0, 20.0, 1)])))
    assert r.mag_rate is None and r.mag == 18.0 and r.peak_mag == 18.0


def test_rate_between_last_two_detections(spark):
    lc = _lc(spark, [("g", 60000.0, 18.0, 20.0, 1), ("g", 60002.0, 17.0, 20.0, 1), ("g", 60004.0, 17.5, 20.0, 1)])
    r = _one(ph.latest_detections(lc))
    # -(17.5 - 17.0) / (60004 - 60002)
    assert r.mag_rate == pytest.approx(-0.25)
    assert r.mag == 17.5 and r.peak_mag == 17.0 and r.mjd == 60004.0


def test_valid_non_detection_before_first_detection_is_used(spark):
    # limit 19.5 >= first detection mag 18 and earlier: it becomes a point
    lc = _lc(spark, [("g", 59990.0, None, 19.5, 0), ("g", 59995.0, None, 19.8, 0), ("g", 60000.0, 18.0, 20.0, 1)])
    r = _one(ph.latest_detections(lc))
    # the latest valid non-detection (59995, limit 19.8) is the row before
    assert r.mag_rate == pytest.approx(-(18.0 - 19.8) / 5.0)


def test_shallow_non_detection_is_ignored(spark):
    lc = _lc(spark, [("g", 59995.0, None, 17.0, 0), ("g", 60000.0, 18.0, 20.0, 1)])
    assert _one(ph.latest_detections(lc)).mag_rate is None


def test_duplicate_mjd_keeps_detection(spark):
    # a non-detection at the first detection's mjd loses the tie
    lc = _lc(spark, [("g", 60000.0, None, 19.0, 0), ("g", 60000.0, 18.0, 20.0, 1)])
    assert _one(ph.latest_detections(lc)).mag_rate is None


def test_duplicate_detections_at_same_mjd(spark):
    lc = _lc(spark, [("g", 60000.0, 18.0, 20.0, 1), ("g", 60001.0, 17.0, 20.0, 1), ("g", 60001.0, 16.0, 20.0, 1)])
    r = _one(ph.latest_detections(lc))
    # canonical order keeps the brighter duplicate first
    assert r.mag == 16.0 and r.mag_rate == pytest.approx(2.0)


def test_non_detection_only_group(spark):
    lc = _lc(spark, [("r", 60000.0, None, 19.0, 0), ("r", 60003.0, None, 19.4, 0)])
    assert ph.latest_detections(lc).count() == 0
    r = _one(ph.latest_non_detections(lc))
    assert r.mag == 19.4 and r.mjd == 60003.0
    assert ph.peak_mags(lc).count() == 0


def test_null_filter_and_bad_points_are_dropped(spark):
    lc = _lc(spark, [(None, 60000.0, 18.0, 20.0, 1), ("g", 60001.0, 15.0, 20.0, -1), ("g", 60002.0, 18.5, 20.0, 1)])
    r = _one(ph.peak_mags(lc))
    assert r.filter == "g" and r.peak_mag == 18.5


def test_compat_layout_puts_peak_in_mag(spark):
    lc = _lc(spark, [("g", 60000.0, 17.0, 20.0, 1), ("g", 60002.0, 18.0, 20.0, 1)])
    r = _one(ph.latest_detections(lc, compat=True))
    assert r.mag == 17.0 and r.peak_mag == 17.0


def test_nightly_rate_on_nightly_means(spark):
    lc = _lc(spark, [("o", 60000.1, 18.0, 20.0, 1), ("o", 60000.2, 18.2, 20.0, 1), ("o", 60002.5, 17.6, 20.0, 1)])
    r = _one(ph.latest_detections(lc, nightly=True))
    # nights 60000 (mean 18.1) and 60002 (17.6): -(17.6 - 18.1) / 2
    assert r.mag_rate == pytest.approx(0.25)
    assert r.mjd == 60002.5


def test_atlas_objects_without_detection_contribute_nothing(spark):
    raw = spark.createDataFrame(
        [(1, 60000.0, 18.0, 0.1, 1.0, 1.0, "o", 1.0, 19.0, "01a1"),     # ratio 1 < 5
         (2, 60000.0, -18.0, 0.1, 50.0, 2.0, "c", 1.0, -19.0, "02a2")],  # detection, negative limit
        "obj_id long, MJD double, m double, dm double, uJy double, duJy double, F string, maj double, "
        "mag5sig double, Obs string")
    out = ph.normalise_atlas_lc(raw).collect()
    assert [(r.obj_id, r.detection, r.mag, r.camera) for r in out] == [(2, 1, -18.0, "02")]


def test_asassn_null_quality_is_kept(spark):
    raw = spark.createDataFrame([(1, 2460000.5, 15.0, 0.1, 17.0, 1.0, "V", None, "bd"),
                                 (1, 2460001.5, 15.0, 99.99, 17.0, 1.0, "V", "B", "bd")],
                                "obj_id long, jd double, mag double, mag_err double, `limit` double, fwhm double, "
                                "phot_filter string, quality string, camera string")
    out = ph.normalise_asassn_lc(raw).collect()
    assert len(out) == 1 and out[0].mjd == 60000.0 and out[0].detection == 1


def test_bucketed_store_summaries_need_no_shuffle(spark):
    from transient_lake.sources import store
    from transient_lake.sources import testdata as td

    from .conftest import SF_SMALL
    lc = td.lc_points(spark, SF_SMALL)
    name = store.write_lightcurves(lc, "tl_test_lc", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        spark.conf.set(*store.CO_PARTITION)
        stored = store.read_lightcurves(spark, name)
        out = ph.latest_detections(stored)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert sorted(out.collect()) == sorted(ph.latest_detections(lc).collect())
        spark.conf.set(*store.SORTED)
        for summary in (ph.latest_detections, ph.peak_mags, ph.latest_non_detections):
            plan = summary(store.read_lightcurves(spark, name))._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and not re.search(r"\bSort \[", plan) and plan.count("FileScan") == 1
        assert sorted(ph.latest_detections(store.read_lightcurves(spark, name)).collect()) == sorted(ph.latest_detections(lc).collect())
    finally:
        spark.conf.set(store.SORTED[0], "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")


def test_zero_divisors_do_not_fail(spark):
    raw = spark.createDataFrame([(1, 60000.0, 18.0, 0.1, 10.0, 0.0, "o", 1.0, 19.0, "01a1"),
                                 (1, 60001.0, 18.0, 0.1, 60.0, 2.0, "o", 1.0, 19.0, "01a2")],
                                "obj_id long, MJD double, m double, dm double, uJy double, duJy double, F string, "
                                "maj double, mag5sig double, Obs string")
    dets = {r.mjd: r.detection for r in ph.normalise_atlas_lc(raw).collect()}
    assert dets == {60000.0: 0, 60001.0: 1}
    lsst = spark.createDataFrame([(1, 60000.0, "g", 0.0, 5.0, 1.0)],
                                 "obj_id long, `r:midpointMjdTai` double, `r:band` string, `r:psfFlux` double, "
                                 "`r:psfFluxErr` double, `r:snr` double")
    r = ph.normalise_lsst_lc(lsst).first()
    assert r.mag is None and r.mag_err is None
