"""Light curves: survey normalisers (N3-N6), window cut (F1/J5), and the
per-(object, survey, filter) summaries (A1-A5, A7, A8, W1-W5).

Light-curve rows follow M4: ``obj_id, survey, filter, mjd, mag, mag_err,
limit, fwhm, detection, camera``; detection is 1 (detected), 0 (upper limit)
or -1 (bad).

Scale notes.  The summaries are order statistics (brightest point, earliest
and latest detection, the row before the latest, the latest non-detection).
They are computed with ``min_by``/``max_by`` aggregates, which Spark
pre-aggregates map-side, and one join back to the points for the statistics
that depend on another (the row before the latest; the deepest valid
non-detection before the first detection).  No window is partitioned by the
light-curve key, so one very long light curve never lands whole in a single
task; the join back is split by AQE when a key is skewed.  The nightly form
windows over nightly means only, whose group size is bounded by the number
of nights observed.

Ties between rows at equal ``mjd`` follow one canonical row order: ``mjd``,
then ``mag``, ``mag_err``, ``limit`` ascending with NULLs last (the
reference resolves them by arrival order, which is not reproducible).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from pyspark.sql.window import Window

from ..functions.time import jd_to_mjd, mjd_to_iso
from ..sources.config import ACTIVE_DEFAULTS

G = ["obj_id", "survey", "filter"]
LC_COLS = ["obj_id", "survey", "filter", "mjd", "mag", "mag_err", "limit", "fwhm", "detection", "camera"]

# Sort keys as SQL so they can sit inside FILTER clauses.
_FIRST = ("named_struct('mjd', mjd, 'a', mag is null, 'mag', mag, 'b', mag_err is null, 'e', mag_err,"
          " 'c', `limit` is null, 'l', `limit`)")
_LAST = ("named_struct('mjd', mjd, 'a', mag is not null, 'mag', -mag, 'b', mag_err is not null, 'e', -mag_err,"
         " 'c', `limit` is not null, 'l', -`limit`)")
_PEAK = ("named_struct('mag', mag, 'mjd', mjd, 'b', mag_err is null, 'e', mag_err,"
         " 'c', `limit` is null, 'l', `limit`)")


def _lc(df: DataFrame) -> DataFrame:
    return df.select(*LC_COLS)


# --- normalisers ---------------------------------------------------------

# ZTF filter ids and alert tags.
ZTF_FILTERS = {1: "g", 2: "r", 3: "i"}
ZTF_TAGS = {"valid": 1, "badquality": -1, "upperlim": 0}


def _lookup(mapping: dict, key) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


def normalise_ztf_lc(raw: DataFrame) -> DataFrame:
    """ZTF photometry -> M4; bad-quality and unknown tags are dropped,
    unknown filter ids become NULL filters."""
    out = raw.select(
        "obj_id",
        F.lit("ztf").alias("survey"),
        _lookup(ZTF_FILTERS, F.col("`i:fid`").try_cast("int")).alias("filter"),
        jd_to_mjd(F.col("`i:jd`")).alias("mjd"),
        F.col("`i:magpsf`").alias("mag"),
        F.col("`i:sigmapsf`").alias("mag_err"),
        F.col("`i:diffmaglim`").alias("limit"),
        F.col("`i:fwhm`").alias("fwhm"),
        _lookup(ZTF_TAGS, F.col("`d:tag`")).alias("detection"),
        F.lit("main").alias("camera"),
    )
    return out.where(F.col("detection") >= 0)


def normalise_asassn_lc(raw: DataFrame) -> DataFrame:
    """ASAS-SN photometry -> M4.  Quality ``B`` rows are dropped (a NULL
    quality is kept); mag_err > 99 marks an upper limit with NULL mag."""
    upper = F.col("mag_err") > 99
    return raw.where(~F.col("quality").eqNullSafe("B")).select(
        "obj_id",
        F.lit("asas-sn").alias("survey"),
        F.col("phot_filter").alias("filter"),
        jd_to_mjd(F.col("jd")).alias("mjd"),
        F.when(upper, None).otherwise(F.col("mag")).alias("mag"),
        F.when(upper, None).otherwise(F.col("mag_err")).alias("mag_err"),
        F.col("limit"),
        F.col("fwhm"),
        F.when(upper, 0).otherwise(1).alias("detection"),
        F.col("camera"),
    )


def normalise_atlas_lc(raw: DataFrame, sigma: float = 5.0, compat: bool = False) -> DataFrame:
    """ATLAS forced photometry -> M4.

    mag takes the sign of the limit; a point is a detection when
    uJy/duJy >= sigma.  An unknown ratio (NULL flux or zero error) is a
    non-detection, or a detection with ``compat=True`` as in the reference.
    Objects without any detection contribute no rows."""
    ratio = F.try_divide(F.col("uJy"), F.col("duJy"))  # zero error -> unknown ratio
    det = F.when(ratio.isNull(), F.lit(1 if compat else 0)).when(ratio < sigma, 0).otherwise(1)
    lc = raw.select(
        "obj_id",
        F.lit("atlas").alias("survey"),
        F.col("F").alias("filter"),
        F.col("MJD").alias("mjd"),
        (F.signum("mag5sig") * F.abs("m")).alias("mag"),
        F.col("dm").alias("mag_err"),
        F.col("mag5sig").alias("limit"),
        F.col("maj").alias("fwhm"),
        det.alias("detection"),
        F.substring("Obs", 1, 2).alias("camera"),
    )
    seen = lc.groupBy("obj_id").agg(F.max("detection").alias("_m")).where("_m = 1")
    return lc.join(seen.select("obj_id"), "obj_id", "left_semi")


# LSST flux zero point (nJy) and the 2.5/ln(10) error factor.
LSST_ZP = 31.4
MAG_ERR_FACTOR = 1.0857


def normalise_lsst_lc(raw: DataFrame) -> DataFrame:
    """LSST fluxes -> magnitudes.  Non-positive flux has no
    magnitude (NULL; the reference yields NaN)."""
    flux = F.col("`r:psfFlux`")
    return raw.select(
        "obj_id",
        F.lit("lsst").alias("survey"),
        F.col("`r:band`").alias("filter"),
        F.col("`r:midpointMjdTai`").alias("mjd"),
        F.when(flux > 0, F.log10(flux) * -2.5 + LSST_ZP).alias("mag"),
        F.abs(F.try_divide(F.col("`r:psfFluxErr`") * MAG_ERR_FACTOR, flux)).alias("mag_err"),
        F.lit(None).cast("double").alias("limit"),
        F.lit(None).cast("double").alias("fwhm"),
        F.lit(1).alias("detection"),
        F.lit("main").alias("camera"),
    )


def union_lightcurves(*lcs: DataFrame) -> DataFrame:
    """Concatenate normalised light curves."""
    out = _lc(lcs[0])
    for lc in lcs[1:]:
        out = out.unionByName(_lc(lc))
    return out


# --- F1 / J5 -------------------------------------------------------------

def default_days(source: Column, which: int, defaults: dict[str, tuple[int, int]] = ACTIVE_DEFAULTS) -> Column:
    """Days before (0) or after (1) discovery that a source's objects are
    active by default; NULL for an unknown source."""
    days = F.create_map(*[x for s, d in defaults.items() for x in (F.lit(s), F.lit(d[which]))])
    return days[source]


def active_windows(windows: DataFrame, defaults: dict[str, tuple[int, int]] = ACTIVE_DEFAULTS) -> DataFrame:
    """Per-object settings, or the defaults of its source, as an MJD
    interval.  Windows without a ``source`` column are of the first source in
    ``defaults``; an unknown source without settings gives no window."""
    source = F.col("source") if "source" in windows.columns else F.lit(next(iter(defaults)))
    return windows.select(
        "obj_id",
        (F.col("discovery_mjd") - F.coalesce("prior_days", default_days(source, 0, defaults))).alias("mjd_min"),
        (F.col("discovery_mjd") + F.coalesce("active_days", default_days(source, 1, defaults))).alias("mjd_max"))


def cut_mjd_window(lc: DataFrame, windows: DataFrame, **defaults) -> DataFrame:
    """keep points with mjd_min <= mjd <= mjd_max of their object.
    One window row per object; Spark broadcasts it when its measured size is
    below the broadcast threshold and shuffles otherwise."""
    w = active_windows(windows, **defaults)
    return (lc.join(w, "obj_id")
            .where(F.col("mjd").between(F.col("mjd_min"), F.col("mjd_max")))
            .drop("mjd_min", "mjd_max"))


# --- summaries -----------------------------------------------------------

def _points(lc: DataFrame) -> DataFrame:
    # pandas groupby drops NULL keys; -1 rows never take part
    return lc.where(F.col("filter").isNotNull() & F.col("detection").isin(0, 1))


def summarize(lc: DataFrame) -> DataFrame:
    """Per (obj_id, survey, filter): the statistics behind A1, A2, W2, W4.

    Columns: n_det, n_non_det, peak (mag, mjd), first (mjd, mag), last
    (mjd, mag), prev (mjd, mag), non_det (mjd, limit), valid_non_det
    (mjd, mag) and ``mag_rate`` (unrounded).

    One pass over each light curve: a window adds its first and last detection
    to the points, and one aggregate over the same keys takes everything else.
    Both want the points of a light curve together and in key order, which the
    bucketed store gives without a shuffle (``store.CO_PARTITION``) and, with
    ``store.SORTED``, without a sort.  A light curve is one object in one
    filter of one survey; a very long one spills in the window."""
    whole = Window.partitionBy(*G)
    row = "named_struct('mjd', mjd, 'mag', mag)"
    pts = (_points(lc)
           .withColumn("_f", F.expr(f"min_by({row}, case when detection = 1 then {_FIRST} end)").over(whole))
           .withColumn("_l", F.expr(f"max_by({row}, case when detection = 1 then {_LAST} end)").over(whole)))
    s = pts.groupBy(*G).agg(
        F.expr("count_if(detection = 1)").alias("n_det"),
        F.expr("count_if(detection = 0)").alias("n_non_det"),
        F.expr(f"min_by(named_struct('mag', mag, 'mjd', mjd), {_PEAK})"
               " filter (where detection = 1 and mag is not null)").alias("peak"),
        F.expr(f"min_by({row}, {_FIRST}) filter (where detection = 1)").alias("first"),
        F.expr(f"max_by({row}, {_LAST}) filter (where detection = 1)").alias("last"),
        F.expr(f"max_by(named_struct('mjd', mjd, 'limit', `limit`), {_LAST}) filter (where detection = 0)")
        .alias("non_det"),
        F.expr(f"max_by({row}, {_LAST}) filter (where detection = 1 and mjd < _l.mjd)").alias("prev"),
        F.expr(f"max_by(named_struct('mjd', mjd, 'mag', `limit`), {_LAST})"
               " filter (where detection = 0 and mjd <= _f.mjd and `limit` >= _f.mag)").alias("valid_non_det"),
    )
    # the valid non-detection is appended after the detections and loses an
    # mjd tie against the first detection (drop_duplicates keep="first")
    v_ok = F.col("valid_non_det").isNotNull() & (F.col("valid_non_det.mjd") < F.col("first.mjd"))
    second = F.when(F.col("prev").isNotNull(), F.col("prev")).when(v_ok, F.col("valid_non_det"))
    rate = -((F.col("last.mag") - second["mag"]) / (F.col("last.mjd") - second["mjd"]))
    return s.withColumn("mag_rate", F.when(F.col("n_det") > 0, rate))


def nightly_rate(lc: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """The rate on nightly means (night = int(mjd)) of the deduplicated
    detections plus the valid non-detection.  Returns G, night, mean_mag,
    mag_rate for the last night of each group with detections."""
    summary = summarize(lc) if summary is None else summary
    dets = (_points(lc).where("detection = 1").groupBy(*G, "mjd")
            .agg(F.expr(f"min_by(mag, {_FIRST})").alias("mag")))
    v = (summary.where(F.col("valid_non_det").isNotNull() & (F.col("valid_non_det.mjd") < F.col("first.mjd")))
         .select(*G, F.col("valid_non_det.mjd").alias("mjd"), F.col("valid_non_det.mag").alias("mag")))
    nights = (dets.unionByName(v).withColumn("night", F.floor("mjd"))
              .groupBy(*G, "night").agg(F.avg("mag").alias("mean_mag")))
    # nights per group are bounded by the survey's span in days
    w = Window.partitionBy(*G).orderBy("night")
    rated = (nights
             .withColumn("mag_rate", -((F.col("mean_mag") - F.lag("mean_mag").over(w))
                                       / (F.col("night") - F.lag("night").over(w))))
             .withColumn("_rn", F.row_number().over(w.orderBy(F.desc("night")))))
    return rated.where("_rn = 1").drop("_rn")


def peak_mags(lc: DataFrame) -> DataFrame:
    """A1: brightest detection per group (value rounded to 8 digits)."""
    s = summarize(lc).where(F.col("peak").isNotNull())
    return s.select(*G, round_half_up("peak.mag", 8).alias("peak_mag"), F.col("peak.mjd").alias("peak_mjd"),
                    mjd_to_iso(F.col("peak.mjd")).alias("date"))


def latest_non_detections(lc: DataFrame) -> DataFrame:
    """A2: limit and date of the latest upper limit per group."""
    s = summarize(lc).where(F.col("non_det").isNotNull())
    return s.select(*G, round_half_up("non_det.limit", 8).alias("mag"), F.col("non_det.mjd").alias("mjd"),
                    mjd_to_iso(F.col("non_det.mjd")).alias("date"))


def latest_detections(lc: DataFrame, nightly: bool = False, compat: bool = False) -> DataFrame:
    """Latest detection per group with its rate of change.

    ``mag`` is the latest detection's magnitude (nightly: that night's
    mean); ``compat=True`` puts the peak magnitude there instead, as the
    reference does.  ``peak_mag`` is always present."""
    s = summarize(lc).where("n_det > 0")
    if nightly:
        n = nightly_rate(lc, s).select(*G, F.col("mean_mag").alias("_lmag"), F.col("mag_rate").alias("_rate"))
        s = s.join(n, G, "left")
        latest, rate = F.col("_lmag"), F.col("_rate")
    else:
        latest, rate = F.col("last.mag"), F.col("mag_rate")
    peak = round_half_up("peak.mag", 8)
    return s.select(*G, (peak if compat else round_half_up(latest, 8)).alias("mag"), peak.alias("peak_mag"),
                    round_half_up(rate, 6).alias("mag_rate"), F.col("last.mjd").alias("mjd"),
                    mjd_to_iso(F.col("last.mjd")).alias("date"))


def nightly_means(lc: DataFrame) -> DataFrame:
    """A3: mean detected magnitude per night."""
    return (_points(lc).where("detection = 1").withColumn("night", F.floor("mjd"))
            .groupBy(*G, "night").agg(F.avg("mag").alias("mean_mag"), F.count("*").alias("n")))


def sort_key(*spec: str) -> F.Column:
    """An ascending sort key for ``min_by``: ``"col"`` ascends, ``"-col"``
    descends (numeric columns), NULLs last in both."""
    parts = []
    for s in spec:
        name = s.lstrip("-")
        c = F.col(name)
        parts += [c.isNull(), -c if s.startswith("-") else c]
    return F.struct(*parts)


def dedupe_keep_first(df: DataFrame, keys, *order: str) -> DataFrame:
    """One row per ``keys`` - the first under ``order`` (see
    ``sort_key``; it should make the order total).  An aggregate, so
    duplicates collapse map-side and a hot key is never gathered whole."""
    cols = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*cols), sort_key(*order)).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols]))


def first_per_group(df: DataFrame, keys, *order: str) -> DataFrame:
    """The first row of each group (idxmin / iloc[0] with ties broken
    by the remaining ``order`` columns)."""
    return dedupe_keep_first(df, keys, *order)


def detection_summary(lc: DataFrame) -> DataFrame:
    """A4: detections per object and its surveys, ``ATLAS + ZTF`` style."""
    return lc.groupBy("obj_id").agg(
        F.expr("count_if(detection = 1)").alias("n_detections"),
        F.array_join(F.array_sort(F.collect_set(F.upper("survey"))), " + ").alias("surveys"))


def plottable(lc: DataFrame) -> DataFrame:
    """F8: points a light-curve plot can draw."""
    return lc.where(F.col("mjd").isNotNull()
                    & (((F.col("detection") == 1) & F.col("mag").isNotNull())
                       | ((F.col("detection") == 0) & F.col("limit").isNotNull())))


def lightcurve_series(lc: DataFrame) -> DataFrame:
    """A5: plot series per (object, survey, filter): counts and first/last
    epochs of detections and limits, label ``SURVEY band``."""
    p = plottable(lc)
    return p.groupBy("obj_id", "survey", "filter").agg(
        F.expr("count_if(detection = 1)").alias("n_points"),
        F.expr("count_if(detection = 0)").alias("n_limits"),
        F.min("mjd").alias("mjd_first"), F.max("mjd").alias("mjd_last"),
    ).withColumn("label", F.concat_ws(" ", F.upper(F.coalesce("survey", F.lit("unknown"))),
                                      F.coalesce("filter", F.lit("Unknown"))))


def lightcurve_points(lc: DataFrame) -> DataFrame:
    """A5 as rows: the points of every plot series (detections with their
    errors, limits without) in time order.  A series is one light curve in one
    filter, so its numbering window is bounded by the survey."""
    det = F.col("detection") == 1
    p = plottable(lc).select(
        "obj_id", "survey", "filter", F.when(det, "detection").otherwise("limit").alias("kind"), "mjd",
        F.when(det, F.col("mag")).otherwise(F.col("limit")).alias("value"), F.when(det, F.col("mag_err")).alias("error"))
    w = Window.partitionBy("obj_id", "survey", "filter", "kind").orderBy("mjd", "value", "error")
    return p.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def count_per_source(lc: DataFrame) -> DataFrame:
    """Points, objects and objects with a detection per survey."""
    per_obj = lc.groupBy("survey", "obj_id").agg(F.count("*").alias("n"),
                                                  F.max(F.col("detection") == 1).alias("det"))
    return per_obj.groupBy("survey").agg(F.sum("n").alias("lc_count"), F.count("*").alias("n_objs"),
                                         F.expr("count_if(det)").alias("n_with_detection"))
