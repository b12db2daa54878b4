"""Sky joins against brute force on edge fixtures (RA wrap, poles,
coincident points), plus coordinate-format goldens."""

import math
import random

import pytest
from pyspark.sql import functions as F

from transient_lake.functions import sky as fsky
from transient_lake.functions.numeric import round_half_up
from transient_lake.operators import search as S
from transient_lake.operators import sky


def _sep_arcsec(a, b):
    ra1, d1, ra2, d2 = map(math.radians, (a[2], a[3], b[2], b[3]))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((ra2 - ra1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(h)))) * 3600


def _fixture(n=1500, seed=7):
    rnd = random.Random(seed)
    rows = []
    centres = [(0.0, 0.0), (359.9995, 10.0), (0.0004, 10.0), (123.0, 89.9995), (45.0, -89.9992),
               (200.0, 60.0), (10.0, -45.0), (359.999, -70.0)]
    for i in range(n):
        cra, cdec = centres[i % len(centres)]
        dra = rnd.uniform(-8, 8) / 3600 / max(0.01, math.cos(math.radians(cdec)))
        ddec = rnd.uniform(-8, 8) / 3600
        dec = max(-90.0, min(90.0, cdec + ddec))
        rows.append((f"o{i:05d}", "ztf" if i % 3 else "lsst", (cra + dra) % 360.0, dec))
    # exact duplicates of position (coincident points)
    rows.append(("dupA", "ztf", 200.0, 60.0))
    rows.append(("dupB", "lsst", 200.0, 60.0))
    rows.append(("pole1", "ztf", 10.0, 90.0))
    rows.append(("pole2", "lsst", 190.0, 90.0))
    return rows


def test_crossmatch_exact_equals_brute_force(spark):
    rows = _fixture()
    df = spark.createDataFrame(rows, "obj_id string, source string, ra_deg double, dec_deg double") \
        .withColumn("timestamp", F.current_timestamp())
    got = {(r.obj_id_1, r.obj_id_2) for r in sky.crossmatch(df, 4.0).select("obj_id_1", "obj_id_2").collect()}
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            lo, hi = (a, b) if a[0] < b[0] else (b, a)
            if a[1] != b[1] and _sep_arcsec(a, b) <= 4.0:
                want.add((lo[0], hi[0]))
    assert got == want
    assert ("dupA", "dupB") in got and ("pole1", "pole2") in got
    # a wider cell gives the same pairs
    wide = {(r.obj_id_1, r.obj_id_2) for r in sky.crossmatch(df, 4.0, cell_arcsec=60.0).collect()}
    assert wide == want
    # no pair reported twice
    assert sky.crossmatch(df, 4.0).count() == len(want)


def test_decimal_bucket_misses_edge_pairs(spark):
    rows = [("a", "ztf", 10.0, 1.0004), ("b", "lsst", 10.0, 1.0006),   # 0.72" apart, different buckets
            ("c", "ztf", 20.0, 5.0), ("d", "lsst", 20.0, 5.0)]         # coincident
    df = spark.createDataFrame(rows, "obj_id string, source string, ra_deg double, dec_deg double") \
        .withColumn("timestamp", F.current_timestamp())
    exact = {(r.obj_id_1, r.obj_id_2) for r in sky.crossmatch(df, 4.0).collect()}
    legacy = {(r.obj_id_1, r.obj_id_2) for r in sky.crossmatch(df, 4.0, mode="decimal_bucket").collect()}
    assert exact == {("a", "b"), ("c", "d")}
    assert ("a", "b") not in legacy


def test_cone_search_equals_brute_force(spark):
    rows = _fixture(600, seed=3)
    objs = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "archive_id string, ra_deg double, dec_deg double")
    cones = [(1, 0.0, 0.0, 6.0), (2, 359.9999, 10.0, 10.0), (3, 123.0, 89.999, 30.0), (4, 45.0, -90.0, 12.0)]
    cdf = spark.createDataFrame(cones, "cone_id int, ra double, dec_c double, radius_arcsec double")
    got = {(r.cone_id, r.obj_name) for r in sky.cone_search(objs, cdf, obj_id="archive_id").collect()}
    want = {(c[0], r[0]) for c in cones for r in rows
            if _sep_arcsec(("", "", c[1], c[2]), r) <= c[3]}
    assert got == want


def test_nearest_match_picks_closest(spark):
    objs = spark.createDataFrame([("x", 10.0, 10.0)], "obj_id string, ra_deg double, dec_deg double")
    cat = spark.createDataFrame([("far", 10.0, 10.001), ("near", 10.0, 10.0003), ("out", 11.0, 10.0)],
                                "cat_id string, ra_deg double, dec_deg double")
    r = sky.nearest_match(objs, cat, 5.0).collect()
    assert [(x.obj_id, x.match_id) for x in r] == [("x", "near")]


@pytest.mark.parametrize("text,hours,want", [
    ("21 01 36.90", True, 315.40375), ("21:01:36.90", True, 315.40375),
    ("+68 09 48.0", False, 68.16333333), ("-00:30:00", False, -0.5), ("12.5", False, 12.5),
])
def test_sexagesimal_parse(spark, text, hours, want):
    v = spark.range(1).select(fsky.sexagesimal_to_deg(F.lit(text), hours).alias("v")).first().v
    assert abs(v - want) < 1e-6


def test_sexagesimal_garbage_is_null(spark):
    assert spark.range(1).select(fsky.sexagesimal_to_deg(F.lit("abc"), True).alias("v")).first().v is None


def test_deg_to_sexagesimal_golden(spark):
    r = spark.range(1).select(fsky.deg_to_hms(F.lit(189.6217156)).alias("ra"),
                              fsky.deg_to_dms(F.lit(39.00305725)).alias("dec"),
                              fsky.deg_to_hms(F.lit(359.99999999)).alias("wrap")).first()
    assert (r.ra, r.dec) == ("12:38:29.2117", "+39:00:11.0061")
    assert r.wrap == "00:00:00.0000"


@pytest.mark.parametrize("text,want", [
    ("21 01 36.90 +68 09 48.0", ["21 01 36.90", "+68 09 48.0"]),
    ("315.40375, 68.1633", ["315.40375", "68.1633"]),
    ("315.40375 68.1633", ["315.40375", "68.1633"]),
    ("1 2 3", None), ("", None),
])
def test_split_coordinates(spark, text, want):
    assert spark.range(1).select(fsky.split_coordinates(F.lit(text)).alias("v")).first().v == want


def test_hot_spot_third_of_rows(spark):
    """One spot on the sky holds a third of all detections (repeated alerts
    of one object): every cross-survey pair inside it is found, nothing
    outside it is lost, and collation puts the spot into one hit."""
    from transient_lake.operators import hits as H

    rnd = random.Random(11)
    rows = []
    for i in range(300):  # the hot spot: within 1 arcsec of (150, 2)
        rows.append((f"h{i:04d}", "ztf" if i % 2 else "lsst", 150.0 + rnd.uniform(-1, 1) / 3600,
                     2.0 + rnd.uniform(-1, 1) / 3600))
    for i in range(600):  # the rest of the sky, sparse
        rows.append((f"s{i:04d}", "ztf" if i % 2 else "lsst", rnd.uniform(0, 360), rnd.uniform(-80, 80)))
    df = spark.createDataFrame(rows, "obj_id string, source string, ra_deg double, dec_deg double") \
        .withColumn("timestamp", F.current_timestamp())
    pairs = sky.crossmatch(df, 4.0)
    got = {(r.obj_id_1, r.obj_id_2) for r in pairs.select("obj_id_1", "obj_id_2").collect()}
    want = {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(rows) for b in rows[i + 1:]
            if a[1] != b[1] and _sep_arcsec(a, b) <= 4.0}
    assert got == want and len(got) >= 150 * 150
    salted = {(r.obj_id_1, r.obj_id_2) for r in sky.crossmatch(df, 4.0, salt=8).select("obj_id_1", "obj_id_2").collect()}
    assert salted == want
    members, hits, _ = H.collate_hits(pairs)
    big = hits.orderBy(F.desc("n_members")).first()
    assert big.n_members == 300 and big.xmatch_id == "h0000"


def test_lsst_alert_time_scale(spark):
    import datetime as dt
    a = spark.createDataFrame([("123", 10.0, -5.0, 60000.5)],
                              "diaObjectId string, ra double, decl double, lastDiaSourceMjdTai double")
    t_ref = sky.normalise_lsst_alert(a).first().timestamp
    t_utc = sky.normalise_lsst_alert(a, tai_to_utc=True).first().timestamp
    assert (t_ref - t_utc) == dt.timedelta(seconds=37)


def test_a_cone_reads_the_files_of_its_cells(spark, tmp_path):
    from transient_lake.sources import sky_store
    rng = random.Random(8)
    rows = [(i, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(4000)]
    rows += [(9000, 0.01, 1.0), (9001, 359.99, 1.0), (9002, 10.0, 89.99), (9003, 190.0, 89.99), (9004, None, 3.0)]
    objects = spark.createDataFrame(rows, "source_id long, ra_deg double, dec_deg double")
    path = str(tmp_path / "sky")
    sky_store.write_objects(objects, path, cell_deg=10.0)
    assert spark.read.parquet(path).count() == len(rows)
    all_files = spark.read.parquet(path).select(F.input_file_name()).distinct().count()
    cones = [(0, 120.0, 33.0, 3600.0), (1, 0.0, 1.0, 60.0), (2, 100.0, 90.0, 60.0), (3, None, 1.0, 5.0)]
    frame = lambda c: spark.createDataFrame(c, "cone_id long, ra double, dec_c double, radius_arcsec double")
    for literal in (512, 0):  # as literal predicates, and joined
        got = sky_store.cone_search(spark, path, frame(cones), cell_deg=10.0, literal=literal)
        want = sky.cone_search(objects.where("ra_deg is not null"), frame(cones[:3]))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.obj_name for r in got.where("cone_id = 1").collect()} == {9000, 9001}
    one = sky_store.read_cells(spark, path, sky_store.cells_of(frame(cones[:1]), 10.0))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_zone" in plan.split("PartitionFilters: [")[1][:200]
    assert one.select(F.input_file_name()).distinct().count() <= 4 < all_files / 20
    near = sky_store.nearest_match(objects.where("source_id < 50").withColumnRenamed("source_id", "obj_id"), path, 5.0, 10.0, cat_id="source_id")
    assert {(r.obj_id, r.match_id) for r in near.collect()} == {(i, i) for i in range(50)}


def test_page_reach_lets_the_whole_page_through(spark):
    rows = [(g, float(i % 40) * 0.01 * g, f"o{i:03d}") for g in (1, 2, 7) for i in range(300)]
    hits = spark.createDataFrame([*rows, (9, 0.5, "x")], "cone_id int, distance_deg double, obj_name string")
    reach = S.page_reach(hits, page=2, size=20)
    assert {r.cone_id: r.n_pages for r in reach.collect()} == {1: 15, 2: 15, 7: 15, 9: 1}
    cut = hits.join(reach, "cone_id").where("distance_deg <= reach").select(*hits.columns)
    assert cut.count() < hits.count() / 2
    want = S.page_slice(hits, page=2, size=20).select("cone_id", "rank", "obj_name", "n_pages").collect()
    got = S.page_slice(cut, page=2, size=20, counts=reach).select("cone_id", "rank", "obj_name", "n_pages").collect()
    assert sorted(got) == sorted(want) and len(got) == 60


def test_cones_of_the_whole_sky_are_many_keys(spark):
    level = spark.createDataFrame([(180.0,), (3.0,), (0.5,)], "r double").select(sky._level(F.col("r")).alias("l"))
    assert [r.l for r in level.collect()] == [sky.MAX_LEVEL, sky.MAX_LEVEL, -1]
    objects = spark.createDataFrame([(f"o{i}", float(i % 360), i / 5.0 - 89.9) for i in range(900)],
                                    "source_id string, ra_deg double, dec_deg double")
    cones = spark.createDataFrame([(1, 10.0, 0.0, 648000.0), (2, 0.5, 89.5, 7200.0)],
                                  "cone_id int, ra double, dec_c double, radius_arcsec double")
    found = {r.cone_id: r["count"] for r in sky.cone_search(objects, cones).groupBy("cone_id").count().collect()}
    assert found[1] == 900 and found[2] >= 8


def test_cells_of_whole_sky_cones_are_not_broadcast(spark):
    objects = spark.createDataFrame([("a", 10.0, 5.0), ("b", 200.0, -89.0)], "source_id string, ra_deg double, dec_deg double")
    cones = spark.range(45).selectExpr("id as cone_id", "0.0D as ra", "0.0D as dec_c", "648000.0D as radius_arcsec")
    found = sky.cone_search(objects, cones)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert found.count() == 90
    few = sky.cone_search(objects, cones.where("cone_id = 0"))
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString() and few.count() == 2


def test_cone_edges_are_decided_by_the_distance(spark):
    """Cones whose radius is the distance of an object, or the next number to it."""
    rng = random.Random(8)
    at = [(0.0, 90.0), (123.0, -90.0), (359.9999, 0.0), (0.0, 0.0), (180.0, 0.0), (0.0, -30.0), (180.0, 30.0)]
    at += [(rng.uniform(0, 360), rng.uniform(-90, 90)) for _ in range(10)]
    at += [(r + rng.uniform(-1e-7, 1e-7), max(-90.0, min(90.0, d + rng.uniform(-1e-7, 1e-7)))) for r, d in at]
    objects = spark.createDataFrame([(str(i), r % 360, d) for i, (r, d) in enumerate(at)], "source_id string, ra_deg double, dec_deg double")
    centres = objects.selectExpr("source_id as centre", "ra_deg as ra", "dec_deg as dec_c")
    far = centres.crossJoin(objects).select("ra", "dec_c", fsky.angular_sep_deg("ra", "dec_c", "ra_deg", "dec_deg").alias("d")).collect()
    wide = [r for r in far if r.d >= 2.0]  # each has thousands of cells
    far = [r for r in far if r.d < 2.0] + [r for r in wide if r.d > 179.9][:6] + wide[::60]
    rows = [(r.ra, r.dec_c, x) for r in far for x in (r.d * 3600, math.nextafter(r.d * 3600, 0), math.nextafter(r.d * 3600, 1e9))]
    rows += [(r, d, x) for r, d in at[:8] for x in (0.0, 648000.0, 700000.0)]
    cones = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "cone_id long, ra double, dec_c double, radius_arcsec double")
    dist = fsky.angular_sep_deg("ra", "dec_c", "ra_deg", "dec_deg")
    want = (cones.crossJoin(objects).where((dist <= F.col("radius_arcsec") / 3600.0)
                                           & (F.abs(F.col("dec_deg") - F.col("dec_c")) <= F.col("radius_arcsec") / 3600.0))
            .select("cone_id", "source_id", dist.alias("d")))
    got = sky.cone_search(objects, cones).select("cone_id", "obj_name", "distance_deg")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cone_cells_count_what_the_search_finds(spark):
    rng = random.Random(4)
    at = [(rng.gauss(50, 0.3), rng.gauss(10, 0.3)) for _ in range(2500)] + [(rng.uniform(0, 360), rng.uniform(89, 90)) for _ in range(500)]
    at += [(50.0, 10.0)] * 60 + [(rng.uniform(-0.2, 0.2) % 360, -0.1) for _ in range(200)]
    objects = spark.createDataFrame([(str(i), r, d) for i, (r, d) in enumerate(at)] + [("x", None, 1.0)], "source_id string, ra_deg double, dec_deg double")
    cones = spark.createDataFrame(
        [(i, r, d, x) for i, (r, d, x) in enumerate([(50.0, 10.0, 1800.0), (50.2, 10.1, 700.0), (50.0, 10.0, 1e-3), (200.0, 89.9, 3000.0),
                                                     (0.0, -0.1, 400.0), (359.9, 0.0, 600.0), (10.0, 0.0, 648000.0), (50.0, 10.0, -1.0)])]
        + [(1, 50.2, 10.1, 700.0), (9, 1.0, 1.0, None)], "cone_id int, ra double, dec_c double, radius_arcsec double")
    found = {}
    for r in sky.cone_search(objects, cones).collect():
        found.setdefault(r.cone_id, []).append(r.distance_deg)
    cells = {}
    for r in sky.cone_cells(objects, cones).collect():
        cells.setdefault(r.cone_id, []).append((r.distance_deg, r.n))
    assert {c: sum(n for _, n in x) for c, x in cells.items()} == {c: len(x) for c, x in found.items()}
    assert len(found[0]) > 1500 and len(cells[0]) < len(found[0]) * 0.8
    for c, x in cells.items():  # up to a bound there are at least the rows that it stands for
        total = 0
        for bound, n in sorted(x):
            total += n
            assert sum(d <= bound for d in found[c]) >= total
    reach = S.page_reach(sky.cone_cells(objects, cones), page=2, size=20, rows="n")
    assert {r.cone_id: r.n_pages for r in reach.collect()} == {c: max(1, math.ceil(len(x) / 20)) for c, x in found.items()}


def test_rounding_is_binary_and_half_away_from_zero(spark):
    rng = random.Random(6)
    xs = [0.0, -0.0, -0.3, 0.49999999999999994, 36.855, 1e300, 2.0 ** 52 - 0.5, math.inf, None, *[k / 2 for k in range(-9, 10)],
          *[math.nextafter(k + 0.5, to) for k in range(-5, 5) for to in (-9, 9)], *[rng.uniform(-400, 400) for _ in range(200)]]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for p in (0, 2, 8):
        scale = float(10 ** p)
        old = F.round(F.col("x") * scale, 0) / scale  # by way of the decimal text
        both = df.select(old.cast("string").alias("a"), round_half_up("x", p).cast("string").alias("b"))
        assert all(r.a == r.b for r in both.collect())
        plan = df.select(round_half_up("x", p))._jdf.queryExecution().optimizedPlan().toString()
        assert "round(" not in plan
