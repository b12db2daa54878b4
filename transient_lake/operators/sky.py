"""Spatial joins on the sky: cross-match (J1), cone search (J2), nearest
counterpart (J3).

A theta join "distance <= r" is turned into an equi-join on sky cells so
Spark can hash-partition both sides on ``(zone, cell)``:

* the sky is cut into declination zones of height ``cell`` (>= 2r);
* each zone is cut into ``n_z`` right-ascension cells, ``n_z`` chosen from
  the zone's largest |dec| so cells stay roughly square;
* the probe side keeps its one home cell; the build side is exploded into
  every cell its search circle touches (usually one), with RA wrap and
  polar caps handled, so each true pair meets in exactly one cell;
* the exact haversine distance then filters the candidates.

No pair is found twice and none is missed (brute-force test in
``tests/test_sky.py``).  Hot cells (a third of the rows in one spot) are
split by AQE's skew-join handling, which cuts the big side's partition and
replicates the matching partition of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sky import acos_sep_arcsec, angular_sep_arcsec, angular_sep_deg, dec_bucket

MIN_CELL_DEG = 1e-6


def cell_size_deg(radius_deg: float) -> float:
    """Cells of twice the radius: a search circle touches at most 2 x 2
    cells, and a dense field never puts far-apart points in one bucket."""
    return max(MIN_CELL_DEG, 2.0 * radius_deg)


def _n_ra_cells(zone: Column, cell) -> Column:
    lo = zone * cell - 90.0
    hi = (zone + 1) * cell - 90.0
    max_abs = F.least(F.lit(90.0), F.greatest(F.abs(lo), F.abs(hi)))
    n = F.floor(F.lit(360.0) * F.cos(F.radians(max_abs)) / cell)
    return F.greatest(F.lit(1).cast("long"), n)


def _zone(dec: Column, cell) -> Column:
    zmax = F.floor(F.lit(180.0) / cell)
    return F.least(zmax, F.greatest(F.lit(0).cast("long"), F.floor((dec + 90.0) / cell))).cast("long")


def _ra_cell(ra: Column, zone: Column, cell) -> Column:
    n = _n_ra_cells(zone, cell)
    return F.pmod(F.floor(F.pmod(ra, F.lit(360.0)) / (F.lit(360.0) / n)), n).cast("long")


def home_cell(df: DataFrame, ra: str, dec: str, cell) -> DataFrame:
    """Add ``_zone``/``_cell`` columns: the one cell a point falls in.
    ``cell``: size in degrees, a number or a per-row column."""
    z = _zone(F.col(dec), cell)
    return df.withColumn("_zone", z).withColumn("_cell", _ra_cell(F.col(ra), F.col("_zone"), cell))


def cover_cells(df: DataFrame, ra: str, dec: str, radius, cell) -> DataFrame:
    """Explode each row into every ``(_zone, _cell)`` its circle of
    ``radius`` degrees (a literal or a per-row column) may touch; cells of
    ``cell`` degrees (a number or a per-row column)."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    d = F.col(dec)
    zlo = _zone(d - r, cell)
    zhi = _zone(d + r, cell)
    out = df.withColumn("_zone", F.explode(F.sequence(zlo, zhi)))
    n = _n_ra_cells(F.col("_zone"), cell)
    w = F.lit(360.0) / n
    polar = (F.abs(d) + r) >= 90.0
    # half-width in RA of the circle; guarded so asin's argument stays <= 1
    delta = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(r)) / F.cos(F.radians(d)))))
    ra = F.col(ra)
    lo = F.floor((ra - delta) / w).cast("long")
    hi = F.floor((ra + delta) / w).cast("long")
    every = polar | ((hi - lo + 1) >= n)
    # fewer than n consecutive cells stay distinct after the RA wrap (pmod)
    cells = F.when(every, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.sequence(lo, hi))
    return out.withColumn("_cell", F.explode(cells)).withColumn("_cell", F.pmod(F.col("_cell"), n))


# --- J1 -------------------------------------------------------------------

PAIR_COLS = ("obj_id", "source", "ra_deg", "dec_deg", "timestamp")


def _suffix(df: DataFrame, sfx: str, cols=PAIR_COLS) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}{sfx}") for c in cols])


def salt_cells(probe: DataFrame, build: DataFrame, id_col: str, salt: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Split every cell into ``salt`` sub-keys: probe rows take one sub-key
    from a hash of their id, build rows are copied to all of them.  Each
    probe row still meets every build row of its cell, but a hot cell is
    spread over ``salt`` tasks - the skew remedy for streams, where AQE does
    not split partitions."""
    keys = ["_zone", "_cell"]
    if salt <= 1:
        return probe, build, keys
    probe = probe.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salt)).cast("int"))
    build = build.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return probe, build, keys + ["_salt"]


def crossmatch(alerts: DataFrame, radius_arcsec: float = 4.0, mode: str = "exact",
               other: DataFrame | None = None, cell_arcsec: float | None = None, salt: int = 1) -> DataFrame:
    """Pairs of detections from different surveys within ``radius_arcsec``.

    ``alerts`` has M1 columns.  Pairs are ordered ``obj_id_1 < obj_id_2``.
    ``other`` defaults to ``alerts`` (self-match, as in the stream job).

    ``mode="exact"``: sky-cell equi-join + haversine (every true pair).
    ``mode="decimal_bucket"``: the legacy predicate, dec rounded to 3
    decimals must be equal and the arccos distance must be <= radius; it
    misses pairs across a bucket edge and coincident points (kept for parity).

    ``cell_arcsec`` (default 2 x radius, the smallest valid) trades build-side
    copies (about (1 + 2r/cell)^2 per row) against candidates per cell in
    dense fields; any value >= 2 x radius gives the same pairs.  ``salt``
    spreads hot cells over more tasks (see ``salt_cells``).
    """
    other = alerts if other is None else other
    if mode == "decimal_bucket":
        # the bucket equality, on sky cells so that a bucket's strip round the sky is no key; cells are wide
        # enough for the rounding of the arccos (about 2e-8 rad, 0.005 arcsec)
        r = (radius_arcsec + 0.1) / 3600.0
        cell = cell_size_deg(r)
        a = home_cell(_suffix(alerts, "_1"), "ra_deg_1", "dec_deg_1", cell).withColumn("_b", dec_bucket("dec_deg_1"))
        b = cover_cells(_suffix(other, "_2"), "ra_deg_2", "dec_deg_2", r, cell).withColumn("_b", dec_bucket("dec_deg_2"))
        a, b, keys = salt_cells(a, b, "obj_id_1", salt)
        legacy = acos_sep_arcsec("ra_deg_1", "dec_deg_1", "ra_deg_2", "dec_deg_2")
        j = a.join(b, [*keys, "_b"]).where(
            (F.col("obj_id_1") < F.col("obj_id_2")) & (F.col("source_1") != F.col("source_2"))
            & (legacy <= radius_arcsec))
        # the predicate is the legacy one; the reported separation is the
        # numerically stable haversine value
        sep = angular_sep_arcsec("ra_deg_1", "dec_deg_1", "ra_deg_2", "dec_deg_2")
        return j.select(*[f"{c}_1" for c in PAIR_COLS], *[f"{c}_2" for c in PAIR_COLS],
                        sep.alias("sep_arcsec"))
    if mode != "exact":
        raise ValueError(f"unknown crossmatch mode {mode!r}")
    r = radius_arcsec / 3600.0
    cell = max(cell_size_deg(r), (cell_arcsec or 0.0) / 3600.0)
    a = home_cell(_suffix(alerts, "_1"), "ra_deg_1", "dec_deg_1", cell)
    b = cover_cells(_suffix(other, "_2"), "ra_deg_2", "dec_deg_2", r, cell)
    a, b, keys = salt_cells(a, b, "obj_id_1", salt)
    sep = angular_sep_arcsec("ra_deg_1", "dec_deg_1", "ra_deg_2", "dec_deg_2")
    j = a.join(b, keys).where(
        (F.col("obj_id_1") < F.col("obj_id_2")) & (F.col("source_1") != F.col("source_2"))
        & (F.abs(F.col("dec_deg_1") - F.col("dec_deg_2")) <= r) & (sep <= radius_arcsec))
    return j.select(*[f"{c}_1" for c in PAIR_COLS], *[f"{c}_2" for c in PAIR_COLS],
                    sep.alias("sep_arcsec"))


def split_pair(pairs: DataFrame) -> DataFrame:
    """Each pair row -> its two detections as M1 rows (unpivot)."""
    def side(s):
        return F.struct(*[F.col(f"{c}{s}").alias(c) for c in PAIR_COLS])
    return pairs.select(F.inline(F.array(side("_1"), side("_2"))))


# --- J2 -------------------------------------------------------------------

#: Radius classes of cones: powers of two of a degree, from this exponent on.
#: Wider cones than the last share its grid, so that a cone of the whole sky is
#: many keys and not one.
MIN_LEVEL, MAX_LEVEL = -24, 1
#: Cells of cones that may be broadcast (about 130 bytes each).
BROADCAST_CELLS = 20_000
#: Sub-cells to the side of a cell, in which objects are counted.
SUB_CELLS = 32


def _level(radius_deg: Column) -> Column:
    """Class of a radius: 2^level degrees hold it (a negative or zero radius is in the least, a very wide one in the last)."""
    up = F.ceil(F.log2(F.when(radius_deg > 0, radius_deg))).cast("int")
    return F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(MIN_LEVEL), F.coalesce(up, F.lit(MIN_LEVEL))))


def _level_cell(level: Column) -> Column:
    return F.pow(F.lit(2.0), level.cast("double"))


def cone_search(objects: DataFrame, cones: DataFrame, *, obj_id="source_id", ra="ra_deg",
                dec="dec_deg", cone_id="cone_id", cone_ra="ra", cone_dec="dec_c",
                radius_col="radius_arcsec") -> DataFrame:
    """Every object within each cone (set-at-a-time cone search).

    Output ``cone_id, obj_name, ra, dec, distance_deg``; ``obj_name`` is the
    object's source id (the name the object page resolves).  Cones are grouped
    by radius class (powers of two of a degree) and every class has its own
    grid of cells about as wide as its radius, so a wide cone among narrow ones
    does not widen their cells: a cone meets the objects of the four to nine
    cells that it touches.  Objects probe one cell for each class in use (at
    most 26; the classes are one aggregated row).  A candidate is held against
    the box round the cone first, then against the chord through the sphere:
    only within a hair of the edge does the distance itself decide, so it is
    taken of little more than the pairs that are found.  Cones without a radius,
    or with a negative one, find nothing."""
    o, c = _gridded(objects, cones, obj_id, ra, dec, cone_id, cone_ra, cone_dec, radius_col)
    return _within(o.join(c, _CELL))


def cone_cells(objects: DataFrame, cones: DataFrame, *, obj_id="source_id", ra="ra_deg",
               dec="dec_deg", cone_id="cone_id", cone_ra="ra", cone_dec="dec_c",
               radius_col="radius_arcsec") -> DataFrame:
    """The objects within each cone, counted: rows ``cone_id, distance_deg, n``
    stand for ``n`` objects of the cone, none of them further from its centre
    than ``distance_deg``; the sum of ``n`` is the number of rows that
    ``cone_search`` finds.

    Objects are gathered in sub-cells, ``SUB_CELLS`` to the side of a cell, each
    with the box round its objects' unit vectors.  A box that is inside the cone
    as a whole counts as one row; only the objects of boxes on the cone's edge
    are held against it one by one, so the work grows with the sub-cells and
    with the objects near the edge."""
    o, c = _gridded(objects, cones, obj_id, ra, dec, cone_id, cone_ra, cone_dec, radius_col)
    fine = _level_cell(F.col("_level")) / SUB_CELLS
    o = o.withColumn("_subzone", _zone(F.col("dec"), fine)).withColumn("_sub", _ra_cell(F.col("ra"), F.col("_subzone"), fine))
    key = [*_CELL, "_subzone", "_sub"]
    ends = o.groupBy(*key).agg(F.count("*").alias("_n"), *[f(f"_o{a}").alias(f"_{n}{a}") for a in "xyz" for f, n in ((F.min, "a"), (F.max, "b"))])
    size = F.sqrt(sum((F.col(f"_b{a}") - F.col(f"_a{a}")) * (F.col(f"_b{a}") - F.col(f"_a{a}")) for a in "xyz"))
    boxes = ends.select(*key, "_n", (size / 2 + 1e-15).alias("_half"), *[((F.col(f"_a{a}") + F.col(f"_b{a}")) / 2).alias(f"_m{a}") for a in "xyz"])
    gap = F.sqrt(sum((F.col(f"_m{a}") - F.col(f"_c{a}")) * (F.col(f"_m{a}") - F.col(f"_c{a}")) for a in "xyz"))
    most, least = gap + F.col("_half"), gap - F.col("_half")
    met = boxes.join(c, _CELL)
    inside = (F.col("_near") > 0) & (most * most < F.col("_near"))
    outside = (least > 0) & (least * least > F.col("_far"))
    reach = F.degrees(F.asin(F.least(F.lit(1.0), most / 2)) * 2)
    whole = met.where(inside).select("cone_id", reach.alias("distance_deg"), F.col("_n").alias("n"))
    # boxes on the edge are more than their cones by far
    edge = met.where(~inside & ~outside).select(*key, *[x for x in c.columns if x not in _CELL]).hint("merge")
    single = _within(o.join(edge, key)).select("cone_id", "distance_deg", F.lit(1).cast("long").alias("n"))
    return whole.unionByName(single).withColumn("distance_deg", F.col("distance_deg") * (1 + 1e-9) + 1e-8)


_CELL = ["_level", "_zone", "_cell"]


def _gridded(objects: DataFrame, cones: DataFrame, obj_id, ra, dec, cone_id, cone_ra, cone_dec, radius_col) -> tuple[DataFrame, DataFrame]:
    """Objects in their cell of each class in use, and cones in the cells that
    they touch, with what a pair of them is held against."""
    c = cones.select(F.col(cone_id).alias("cone_id"), F.col(cone_ra).alias("_cra"),
                     F.col(cone_dec).alias("_cdec"), (F.col(radius_col) / 3600.0).alias("_r")).where("_r >= 0")
    c = c.withColumn("_level", _level(F.col("_r")))
    levels = c.agg(F.collect_set("_level").alias("_levels"))
    o = (objects.select(F.col(obj_id).alias("obj_name"), F.col(ra).alias("ra"), F.col(dec).alias("dec"))
         .join(F.broadcast(levels), F.lit(True)).withColumn("_level", F.explode("_levels")).drop("_levels"))
    o = home_cell(o, "ra", "dec", _level_cell(F.col("_level")))
    c = cover_cells(c, "_cra", "_cdec", F.col("_r"), _level_cell(F.col("_level")))
    # half-width in right ascension; a cone over a pole has none
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.col("_r"))) / F.cos(F.radians(F.col("_cdec"))))))
    c = c.withColumn("_dra", F.when(F.abs(F.col("_cdec")) + F.col("_r") >= 89.999999, 360.0).otherwise(wide * (1 + 1e-9) + 1e-9))
    # Spark sizes the cones as they were before each became its cells (a whole sky's ten thousand), so they are
    # counted; of many, sorted by cell, those of one cell are held while its objects pass
    few = c.select("_level").limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    c = _chords(_on_sphere(c, "_cra", "_cdec", "_c")).hint("broadcast" if few else "merge")
    return _on_sphere(o, "ra", "dec", "_o"), c


def _on_sphere(df: DataFrame, ra: str, dec: str, prefix: str) -> DataFrame:
    """Adds the unit vector of a position and the cosine of its declination, which are taken once a row and not once a pair."""
    cos = F.cos(F.radians(F.col(dec)))
    return df.withColumns({f"{prefix}x": cos * F.cos(F.radians(F.col(ra))), f"{prefix}y": cos * F.sin(F.radians(F.col(ra))),
                           f"{prefix}z": F.sin(F.radians(F.col(dec))), f"{prefix}cos": cos})


def _chords(c: DataFrame) -> DataFrame:
    """Adds the squares of two chords round the one that spans ``_r``, wider apart than any rounding: a pair
    below ``_near`` is within, one above ``_far`` is not (no chord is above 2; no distance above 180 degrees)."""
    r = F.col("_r")
    chord = 2 * F.sin(F.radians(r) / 2)
    near, far = chord * (1 - 1e-9) - 1e-13, chord * (1 + 1e-9) + 1e-13
    return c.withColumns({
        "_near": F.when((r < 0) | (near < 0), -1.0).when(r >= 180, 5.0).otherwise(near * near),
        "_far": F.when(r < 0, -1.0).when(r >= 180, 5.0).otherwise(far * far)})


def _within(j: DataFrame) -> DataFrame:
    """Candidates (objects beside cones) that are inside their cone."""
    off = F.abs(F.col("ra") - F.col("_cra"))
    dx, dy, dz = (F.col(f"_o{a}") - F.col(f"_c{a}") for a in "xyz")
    chord2 = dx * dx + dy * dy + dz * dz
    # the steps of functions.sky.angular_sep_deg, in its order
    s_dec, s_ra = F.sin(F.radians(F.col("dec") - F.col("_cdec")) / 2), F.sin(F.radians(F.col("ra") - F.col("_cra")) / 2)
    h = s_dec * s_dec + F.col("_ccos") * F.col("_ocos") * s_ra * s_ra
    dist = F.degrees(F.asin(F.least(F.lit(1.0), F.sqrt(h))) * 2)
    inside = (F.abs(F.col("dec") - F.col("_cdec")) <= F.col("_r")) & ((off <= F.col("_dra")) | (off >= 360.0 - F.col("_dra")))
    found = j.where(inside & (chord2 <= F.col("_far")) & ((chord2 < F.col("_near")) | (dist <= F.col("_r"))))
    return found.select("cone_id", "obj_name", "ra", "dec", dist.alias("distance_deg"))


# --- J3 -------------------------------------------------------------------

def nearest_match(objects: DataFrame, catalogue: DataFrame, radius_arcsec: float = 5.0, *,
                  obj_id="obj_id", ra="ra_deg", dec="dec_deg", cat_id="cat_id",
                  cat_ra="ra_deg", cat_dec="dec_deg") -> DataFrame:
    """The closest catalogue row to each object within the radius.

    Ties on distance go to the smaller catalogue id.  Output:
    ``obj_id, match_id, match_ra, match_dec, sep_arcsec``.  The reduction is
    a ``min_by`` aggregate, so partial aggregation runs map-side."""
    r = radius_arcsec / 3600.0
    cell = cell_size_deg(r)
    o = home_cell(objects.select(F.col(obj_id).alias("_oid"), F.col(ra).alias("_ora"),
                                 F.col(dec).alias("_odec")), "_ora", "_odec", cell)
    c = cover_cells(catalogue.select(F.col(cat_id).alias("match_id"), F.col(cat_ra).alias("match_ra"),
                                     F.col(cat_dec).alias("match_dec")), "match_ra", "match_dec", r, cell)
    sep = angular_sep_arcsec("_ora", "_odec", "match_ra", "match_dec")
    j = (o.join(c, ["_zone", "_cell"])
         .where((F.abs(F.col("_odec") - F.col("match_dec")) <= r))
         .withColumn("sep_arcsec", sep).where(F.col("sep_arcsec") <= radius_arcsec))
    best = j.groupBy("_oid").agg(F.min_by(F.struct("match_id", "match_ra", "match_dec", "sep_arcsec"),
                                          F.struct("sep_arcsec", "match_id")).alias("m"))
    return best.select(F.col("_oid").alias(obj_id), "m.*")


# --- N1, N2 ----------------------------------------------------------------

def normalise_ztf_alert(alerts: DataFrame) -> DataFrame:
    """ZTF alert (objectId, candidate.ra/dec/jd) -> M1 detection; the
    time is the candidate's JD at millisecond precision (ISO ``isot``)."""
    from ..functions.time import jd_to_mjd, mjd_to_timestamp
    return alerts.select(F.col("objectId").cast("string").alias("obj_id"), F.lit("ztf").alias("source"),
                         F.col("candidate.ra").cast("double").alias("ra_deg"),
                         F.col("candidate.dec").cast("double").alias("dec_deg"),
                         mjd_to_timestamp(jd_to_mjd(F.col("candidate.jd"))).alias("timestamp"))


# Fixed value: TAI - UTC in seconds since 2017.
TAI_MINUS_UTC_S = 37


def normalise_lsst_alert(alerts: DataFrame, tai_to_utc: bool = False) -> DataFrame:
    """LSST alert (diaObjectId, ra, decl, lastDiaSourceMjdTai) -> M1.  The
    TAI MJD is read as UTC like the reference (D17); ``tai_to_utc=True``
    subtracts the 37 s offset instead."""
    from ..functions.time import mjd_to_timestamp
    mjd = F.col("lastDiaSourceMjdTai") - (TAI_MINUS_UTC_S / 86400.0 if tai_to_utc else 0.0)
    return alerts.select(F.col("diaObjectId").cast("string").alias("obj_id"), F.lit("lsst").alias("source"),
                         F.col("ra").cast("double").alias("ra_deg"), F.col("decl").cast("double").alias("dec_deg"),
                         mjd_to_timestamp(mjd).alias("timestamp"))
