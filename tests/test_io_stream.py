"""Readers, sinks and streams: round trips and multi-batch equivalence."""

import datetime as dt
import io
import os
import tempfile
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from transient_lake.operators import catalogue as cat
from transient_lake.operators import hits as H
from transient_lake.sources import io as sio
from transient_lake.sources import keyed_store
from transient_lake.sources import testdata as td
from transient_lake.streaming import jobs as J

from .conftest import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="tl-test-", dir="/tmp")


def test_public_catalogue_zip(spark):
    d = _tmp()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("tns_public_objects.csv", '"2024-01-01 00:00:00"\nname,type,ra\n2024aa,SN Ia,1.5\n2024ab,FRB,2.5\n'
                                             '2023zz,,3.0\n')
    with open(os.path.join(d, "cat.csv.zip"), "wb") as f:
        f.write(buf.getvalue())
    out = sio.read_public_catalogue(spark, d).collect()
    assert [r.name for r in out] == ["2024ab", "2024aa", "2023zz"]
    assert out[0].type == "FRB"


def test_forced_phot_text(spark):
    d = _tmp()
    with open(os.path.join(d, "obj1.txt"), "w") as f:
        f.write("###MJD m dm uJy duJy F err chi/N RA Dec x y maj min phi apfit mag5sig Sky Obs\n"
                "60000.1 18.5 0.05 120 10 o 0 1.1 10.0 -5.0 1 2 2.1 2.0 30 -0.4 19.5 20.1 01a60000o0001\n"
                "60001.2 -19.0 0.30 -15 12 c 0 0.9 10.0 -5.0 1 2 2.2 2.1 31 -0.4 19.1 20.0 02a60001o0002\n")
    rows = sio.read_forced_phot_text(spark, d).orderBy("MJD").collect()
    assert [(r.MJD, r.m, r.F, r.Obs[:2]) for r in rows] == [(60000.1, 18.5, "o", "01"), (60001.2, -19.0, "c", "02")]


def test_survey_json_and_publish_batch(spark):
    d = _tmp()
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('[{"i:jd": 2460000.5, "i:magpsf": 18.1}, {"i:jd": 2460001.5, "i:magpsf": 17.9}]')
    df = sio.read_survey_json(spark, d, "`i:jd` double, `i:magpsf` double")
    assert df.count() == 2
    msgs = sio.publish_json_batch(spark, d).collect()
    assert len(msgs) == 2 and all(m.value.startswith("{") for m in msgs)
    d2 = _tmp()
    with open(os.path.join(d2, "one.json"), "w") as f:
        f.write('{"obj_id": "2024abc"}')
    assert sio.publish_json_batch(spark, d2).count() == 1


def test_bibtex_stems(spark):
    d = _tmp()
    for stem in ("tns", "asas-sn"):
        with open(os.path.join(d, f"{stem}.bib"), "w") as f:
            f.write(f"@article{{{stem},\n title={{x}}\n}}\n")
    got = {r.stem: r.text for r in sio.read_bibtex(spark, d).collect()}
    assert set(got) == {"tns", "asas-sn"} and got["tns"].startswith("@article{tns")


def test_notice_names_fallback_to_tokens(spark):
    msgs = spark.createDataFrame([
        (1, "TNS <notices@example.org>", "<p>New: <a href='x'>2023abc</a> and <a href='y'>2025sae</a></p>"),
        (2, "TNS <notices@example.org>", "<p>objects 2024xyz and 2024qq reported; 1999aa not</p>"),
        (3, "spam@example.org", "<a href='z'>2024zzz</a>")], "message_id long, `from` string, body string")
    got = [(r.message_id, r.name) for r in sio.notice_object_names(sio.message_scan(msgs)).orderBy("message_id", "pos")
           .collect()]
    assert got == [(1, "2023abc"), (1, "2025sae"), (2, "2024xyz"), (2, "2024qq")]


def test_archive_export_import_round_trip(spark):
    meta = spark.createDataFrame([("TXV-1", 1.0, "SN"), ("TXV-2", 2.0, None)], "archive_id string, ra_deg double, t string")
    lc = spark.createDataFrame([("TXV-1", 60000.0, 18.0), ("TXV-1", 60001.0, 17.5)], "obj_id string, mjd double, mag double")
    d = os.path.join(_tmp(), "dump")
    cat.export_archive(meta, lc, d)
    for layout in ("new", "old"):
        meta_t, lc_t = cat.load_layout(spark, d, _tmp(), layout)
        assert (meta_t, lc_t) == cat.layout_tables(layout)
        assert {(r.archive_id, r.ra_deg) for r in spark.table(meta_t).collect()} == {("TXV-1", 1.0), ("TXV-2", 2.0)}
        assert spark.table(lc_t).count() == 2
        d2 = os.path.join(_tmp(), "dump2")
        cat.export_layout(spark, d2, layout, limit=1)
        m2, lc2 = cat.import_archive(spark, d2)
        assert [r.archive_id for r in m2.collect()] == ["TXV-1"] and lc2.count() == 2


def test_stream_crossmatch_equals_batch(spark):
    stream = J.crossmatch_stream(td.sky_alerts(spark, SF_SMALL, stream=True), 4.0)
    got = {(r.obj_id_1, r.obj_id_2) for r in spark.read.parquet(J.run_available_now(stream, "t")).collect()}
    batch = J.crossmatch_stream(td.sky_alerts(spark, SF_SMALL), 4.0)
    assert got == {(r.obj_id_1, r.obj_id_2) for r in batch.collect()}
    salted = J.crossmatch_stream(td.sky_alerts(spark, SF_SMALL, stream=True), 4.0, salt=4)
    assert got == {(r.obj_id_1, r.obj_id_2) for r in spark.read.parquet(J.run_available_now(salted, "t")).collect()}


def test_incremental_collation_over_many_batches_equals_batch(spark):
    # the chain fixture replayed in time order, three micro-batches
    # (rows older than the 120 h watermark would be dropped as late)
    src = _tmp()
    ev = td.table(spark, SF_SMALL, "events")
    for k in range(3):
        week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7)
        ev.where(week == k if k < 2 else week >= k).coalesce(1).write.parquet(os.path.join(src, f"week{k}"))
    base = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True) \
        .parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    chain = base.selectExpr(
        "concat('C', event_id) as obj_id",
        "case event_id % 3 when 0 then 'ztf' when 1 then 'lsst' else 'atlas' end as source",
        "(((div(event_id, 6)) * 137) % 360000) / 1000.0D as ra_deg",
        "((((div(event_id, 6)) * 71) % 140001) * 3600 + (event_id % 6) * 3000) / 3600000.0D - 70.0D as dec_deg",
        "ts as timestamp")
    pairs = J.crossmatch_stream(chain, 4.0)
    d = _tmp()
    q = J.collate_hits_stream(pairs, os.path.join(d, "hits"), os.path.join(d, "ck"), buckets=4)
    q.awaitTermination()
    streamed = J.HitTables(spark, os.path.join(d, "hits"), 4).members.read()
    # the same time-bounded pairs, computed in one batch
    members, _, _ = H.collate_hits(J.crossmatch_stream(td.sky_chain(spark, SF_SMALL), 4.0))
    # the same hits; a streamed hit keeps the id it was published with
    as_hits = lambda df: sorted(sorted(r.m) for r in df.groupBy("xmatch_id").agg(F.collect_set("obj_id").alias("m")).collect())
    assert as_hits(streamed) == as_hits(members)


def test_collation_stream_keeps_join_state_on_disk(spark):
    src, d = _tmp(), _tmp()
    at = dt.datetime(2024, 1, 5)
    rows = [("a", "ztf", 10.0, 5.0, at), ("b", "lsst", 10.0005, 5.0, at), ("c", "atlas", 200.0, -3.0, at)]
    alerts = spark.createDataFrame(rows, "obj_id string, source string, ra_deg double, dec_deg double, timestamp timestamp")
    alerts.coalesce(1).write.parquet(os.path.join(src, "alerts"))
    stream = spark.readStream.schema(alerts.schema).parquet(os.path.join(src, "alerts"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    q = J.collate_hits_stream(J.crossmatch_stream(stream, 4.0), os.path.join(d, "hits"), os.path.join(d, "ck"), buckets=4)
    q.awaitTermination()
    state = q.recentProgress[0]["stateOperators"][0]
    assert state["numRowsTotal"] > 0 and any(k.startswith("rocksdb") for k in state["customMetrics"])
    assert spark.conf.get(store) == before  # other streams of the session start as they did
    members = J.HitTables(spark, os.path.join(d, "hits"), 4).members.read().collect()
    assert sorted(m.obj_id for m in members) == ["a", "b"] and len({m.xmatch_id for m in members}) == 1


def test_stream_join_state_is_evicted(spark):
    """Replayed week by week, the cross-match stream drops join state older
    than the watermark and still finds every bounded pair."""
    src = _tmp()
    ev = td.table(spark, SF_SMALL, "events")
    for k in range(3):
        week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7)
        ev.where(week == k if k < 2 else week >= k).coalesce(1).write.parquet(os.path.join(src, f"week{k}"))
    base = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True) \
        .parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    alerts = base.selectExpr(
        "concat(case when event_id % 2 = 0 then 'Z' else 'L' end, event_id) as obj_id",
        "case when event_id % 2 = 0 then 'ztf' else 'lsst' end as source",
        "(((div(event_id, 2)) * 137 * 3600 + (event_id % 2) * (((event_id * 7919) % 13) - 6) * 700"
        " + 2592000000000) % 1296000000) / 3600000.0D as ra_deg",
        "((((div(event_id, 2)) * 71) % 140001) * 3600 + (event_id % 2) * (((event_id * 104729) % 11) - 5) * 700)"
        " / 3600000.0D - 70.0D as dec_deg", "ts as timestamp")
    d = _tmp()
    q = (J.crossmatch_stream(alerts, 4.0).writeStream.format("parquet").option("checkpointLocation", d + "/ck")
         .trigger(availableNow=True).start(d + "/out"))
    q.awaitTermination()
    removed = sum(p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress if p["stateOperators"])
    assert removed > 0
    got = {(r.obj_id_1, r.obj_id_2) for r in spark.read.parquet(d + "/out").collect()}
    want = {(r.obj_id_1, r.obj_id_2) for r in J.crossmatch_stream(td.sky_alerts(spark, SF_SMALL), 4.0).collect()}
    assert got == want


def test_refresh_requests_published_as_messages(spark):
    from transient_lake.sources import config as cfg
    reqs = cat.refresh_requests(td.public_catalogue(spark, SF_SMALL).select(F.col("name").alias("source_id")),
                                td.objects(spark, SF_SMALL), td.active_settings(spark, SF_SMALL), cfg.SOURCE_CONFIG,
                                "1998-08-01")
    out = os.path.join(_tmp(), "outbox")
    J.publish_requests(reqs, fmt="json", path=out)
    msgs = spark.read.json(out)
    assert msgs.count() == reqs.count()
    queues = {r.q for r in msgs.select(F.get_json_object("value", "$.queue").alias("q")).distinct().collect()}
    assert queues <= {"bulk", "update", "refresh"} and "bulk" in queues


PAIRS = ("obj_id_1 string, source_1 string, ra_deg_1 double, dec_deg_1 double, timestamp_1 timestamp, "
         "obj_id_2 string, source_2 string, ra_deg_2 double, dec_deg_2 double, timestamp_2 timestamp, sep_arcsec double")


def _pairs(spark, *links, year=2024):
    t0 = dt.datetime(year, 1, 1)
    return spark.createDataFrame([(a, "ztf", 1.0, 1.0, t0, b, "lsst", 1.0, 1.0, t0, 0.0) for a, b in links], PAIRS)


def _hits(spark, table):
    t = J.HitTables(spark, table, 4)
    out = {}
    for r in t.members.read().collect():
        out.setdefault(r.xmatch_id, []).append(r.obj_id)
    owners = {r.obj_id: r.xmatch_id for r in t.owners.read().collect()}
    assert owners == {o: h for h, ids in out.items() for o in ids}  # both tables agree, an object has one hit
    return {h: sorted(ids) for h, ids in out.items()}


def test_hits_get_yearly_ids_and_merges_keep_the_oldest(spark):
    table = os.path.join(_tmp(), "hits")
    fold = J.hit_folder(table, buckets=4)
    fold(_pairs(spark, ("a", "b")), 0)
    fold(_pairs(spark, ("c", "d"), ("e", "f")), 1)
    first = _hits(spark, table)
    assert sorted(first) == ["TXV-2024-000001", "TXV-2024-000002", "TXV-2024-000003"] and first["TXV-2024-000001"] == ["a", "b"]
    fold(_pairs(spark, ("b", "c"), ("c", "e")), 2)  # three hits are one, the oldest id stays
    fold(_pairs(spark, ("x", "y"), year=2025), 3)
    fold(_pairs(spark, ("p", "q")), 4)
    assert _hits(spark, table) == {"TXV-2024-000001": list("abcdef"), "TXV-2025-000001": ["x", "y"],
                                   "TXV-2024-000004": ["p", "q"]}  # numbers of merged hits are not given again


def test_replayed_batch_changes_nothing(spark):
    table = os.path.join(_tmp(), "hits")
    fold = J.hit_folder(table, buckets=4)
    for i, links in enumerate([[("a", "b")], [("b", "c"), ("m", "n")], [("n", "o")]]):
        fold(_pairs(spark, *links), i)
    before = _hits(spark, table)
    for i, links in ((2, [("n", "o")]), (1, [("b", "c"), ("m", "n")])):
        fold(_pairs(spark, *links), i)
        assert _hits(spark, table) == before


@pytest.mark.parametrize("cut", ["members", "owners", "applied"])
def test_batch_cut_short_is_finished_with_the_same_ids(spark, monkeypatch, cut):
    """The driver dies before one of the tables of a batch is written; the
    batch run again ends in the state of an unbroken run."""
    links = [[("a", "b"), ("c", "d")], [("b", "c"), ("g", "h")]]
    broken = os.path.join(_tmp(), "hits")
    fold = J.hit_folder(broken, buckets=4)
    fold(_pairs(spark, *links[0]), 0)
    put, done = keyed_store.KeyedStore._put, J.set_last_batch

    def dies(self, rows, buckets, batch_id):
        if self.path.endswith(cut):
            raise RuntimeError("killed")
        put(self, rows, buckets, batch_id)

    def dies_last(spark, path, batch_id):
        if path.endswith("/applied") and cut == "applied":
            raise RuntimeError("killed")
        done(spark, path, batch_id)
    with monkeypatch.context() as m:
        m.setattr(keyed_store.KeyedStore, "_put", dies)
        m.setattr(J, "set_last_batch", dies_last)
        with pytest.raises(RuntimeError):
            fold(_pairs(spark, *links[1]), 1)
    fold(_pairs(spark, *links[1]), 1)
    # a-b and c-d have the numbers 1 and 2 in MD5 order; g-h takes the next, once
    assert _hits(spark, broken) == {"TXV-2024-000001": list("abcd"), "TXV-2024-000003": ["g", "h"]}


def test_a_bucket_lost_in_the_middle_of_a_write_comes_back(spark):
    """A partition was taken away and its new contents never arrived: the
    batch run again puts them there."""
    path = os.path.join(_tmp(), "t")
    store = keyed_store.KeyedStore(spark, path, ("k",), "k long, v string", 4)
    store.upsert(spark.range(40).selectExpr("id as k", "'old' as v"), batch_id=0)
    change = spark.range(20).selectExpr("id as k", "'new' as v")
    real = keyed_store.set_last_batch
    keyed_store.set_last_batch = lambda s, p, b: None if p.endswith("_last") else real(s, p, b)
    try:
        store.upsert(change, batch_id=1)
    finally:
        keyed_store.set_last_batch = real
    lost = os.path.join(path, "bucket=2")
    os.rename(lost, os.path.join(_tmp(), "gone"))
    assert store.read().count() < 40
    store.upsert(change, batch_id=1)
    assert {r.k: r.v for r in store.read().collect()} == {k: "new" if k < 20 else "old" for k in range(40)}


def test_unreadable_store_raises(spark):
    table = os.path.join(_tmp(), "hits")
    J.hit_folder(table, buckets=4)(_pairs(spark, ("a", "b")), 0)
    for folder, _, names in os.walk(os.path.join(table, "members")):
        for name in names:
            if name.endswith(".parquet"):
                with open(os.path.join(folder, name), "wb") as f:
                    f.write(b"not parquet")
    with pytest.raises(Exception):
        _hits(spark, table)
    with pytest.raises(Exception):
        J.hit_folder(table, buckets=4)(_pairs(spark, ("a", "b")), 1)


def _files(store):
    return {os.path.join(d, f) for d, _, names in os.walk(store.path) for f in names if f.endswith(".parquet")}


def test_a_change_rewrites_its_buckets_only_and_reads_do_not_grow(spark):
    store = keyed_store.KeyedStore(spark, os.path.join(_tmp(), "t"), ("k",), "k long, v long", 16)
    store.upsert(spark.range(1000).selectExpr("id as k", "0L as v"))
    files, seen = _files(store), []
    assert len(files) == 16
    for i in range(6):
        change = spark.createDataFrame([(7, i), (5000 + i % 2, i)], "k long, v long")
        buckets = store.touched(change)
        store.upsert(change, batch_id=i)
        now = _files(store)
        assert len(now) == 16 and len(now - files) == len(buckets) <= 2
        files = now
        read = store.read(spark.createDataFrame([(7,)], "k long"))
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert f"PartitionFilters: [(bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan, plan
        seen.append(store._rows(store.touched(spark.createDataFrame([(7,)], "k long"))).select(F.input_file_name().alias("f")).distinct().count())
        assert [tuple(r) for r in read.collect()] == [(7, i)]
    assert seen == [1] * 6 and store.read().count() == 1002


def test_store_groups_fields_and_empty_buckets(spark):
    store = keyed_store.KeyedStore(spark, os.path.join(_tmp(), "t"), ("o", "s"), "o long, s string, v double, w string", 2)
    assert store.read().count() == 0
    df = lambda rows: spark.createDataFrame(rows, "o long, s string, v double, w string")
    store.replace(df([(1, "z", 1.0, "a"), (1, "z", 2.0, "a"), (1, "l", 3.0, None), (None, None, 9.0, "lost"), (None, "z", 4.0, "b")]),
                  df([]).select("o", "s"))
    assert store.read().count() == 4  # a row without any key column cannot be addressed
    ch = spark.createDataFrame([(1, "z", None, True, 1), (1, "z", 8.0, True, 2), (1, "l", 5.0, False, 3), (9, "z", 1.0, True, 1)],
                               "o long, s string, v double, set_v boolean, at int")
    store.set_fields(ch, ["v"], "at")
    rows = lambda: sorted(((r.o, r.s, r.v, r.w) for r in store.read().collect()), key=str)
    assert rows() == sorted([(1, "z", 8.0, "a"), (1, "z", 8.0, "a"), (1, "l", 3.0, None), (None, "z", 4.0, "b")], key=str)
    everything = store.read().select("o", "s")
    store.replace(df([]), everything.where("o is not null"))
    assert [tuple(r)[:2] for r in store.read().collect()] == [(None, "z")]


def test_several_changes_of_a_key_make_one_document(spark):
    target = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y")], "k long, v double, t string")
    ch = spark.createDataFrame([(1, 5.0, True, "p", False, 1), (1, 6.0, True, "q", True, 2), (1, None, False, "r", True, 1)],
                               "k long, v double, set_v boolean, t string, set_t boolean, at int")
    got = sorted(map(tuple, cat.set_fields(target, ch, "k", ["v", "t"], "at").collect()))
    assert got == [(1, 6.0, "q"), (2, 2.0, "y")]
    assert sorted(map(tuple, cat.set_fields(target, ch, "k", ["v", "t"]).collect())) == [(1, 6.0, "r"), (2, 2.0, "y")]
    same = spark.createDataFrame([(1, 7.0, "a", 1), (1, 8.0, "b", 1), (3, 1.0, "n", 1)], "k long, v double, t string, at int")
    assert sorted(map(tuple, cat.upsert(target, same, "k", "at").collect())) == [(1, 8.0, "b"), (2, 2.0, "y"), (3, 1.0, "n")]


def test_nested_link_texts_and_mail_parts(spark):
    html = '<a href="x"><b>2024abc</b></a> <a href="y">2024xyz</a><a href="z"><img></a>'
    msgs = spark.createDataFrame([(1, "TNS <notices@example.org>", html)], "message_id long, `from` string, body string")
    assert [r.name for r in sio.notice_object_names(msgs).orderBy("pos").collect()] == ["2024abc", "2024xyz"]
    raw = ("From: n@x\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=b\n\n--b\n"
           "Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\nnova =E9toile 2024abc\n--b--\n")
    got = spark.createDataFrame([(raw.encode(),), (None,)], "raw binary").select(sio.message_body("raw").alias("b")).collect()
    assert got[0].b.strip() == "nova étoile 2024abc" and got[1].b is None


def test_documents_are_ingested_and_updated(spark, tmp_path):
    """ST3: documents and messages of alerts; an update replaces the points of
    the surveys whose source returned metadata and keeps the others."""
    schema = "obj_id long, survey string, filter string, mjd double, mag double, mag_err double, limit double, " \
             "fwhm double, detection int, camera string"
    point = lambda o, s, mjd, mag: (o, s, "g", mjd, mag, 0.1, None, None, 1, "main")
    lc = spark.createDataFrame([point(1, "ztf", 100.0, 18.0), point(1, "lsst", 101.0, 19.0), point(1, "ztf", 500.0, 17.0),
                                point(2, "ztf", 100.0, 18.5)], schema)
    windows = spark.createDataFrame([(1, 100.0, None, None), (2, 100.0, None, None)],
                                    "obj_id long, discovery_mjd double, prior_days int, active_days int")
    envelope = spark.createDataFrame([(1, "TXV-1"), (2, "TXV-2")], "obj_id long, archive_id string")
    ztf = spark.createDataFrame([(1, "ZTF1")], "obj_id long, object_id string")
    tns = spark.createDataFrame([(1, "a"), (2, "b")], "obj_id long, name string")
    table, outbox = str(tmp_path / "documents"), str(tmp_path / "outbox")

    def run(ids, name, sources, points, **kw):
        feed = tmp_path / "feed"
        spark.createDataFrame([(i,) for i in ids], "obj_id long").coalesce(1).write.mode("append").parquet(str(feed))
        stream = spark.readStream.schema("obj_id long").parquet(str(feed))
        J.ingest_documents_stream(stream, envelope, sources, windows, points, table, outbox, str(tmp_path / "ck"),
                                  **kw).awaitTermination()
        got = J.document_store(envelope, points, table).read().collect()
        return {r["obj_id"]: (sorted(r["data_sources"].items()), [(p["survey"], p["mjd"], p["mag"]) for p in r["lightcurve"]])
                for r in got}
    first = run([1, 2, 2, 9], "a", {"fink_ztf": ztf, "tns": tns}, lc)
    assert first == {1: ([("fink_ztf", '{"object_id":"ZTF1"}'), ("tns", '{"name":"a"}')],
                         [("ztf", 100.0, 18.0), ("lsst", 101.0, 19.0)]),
                     2: ([("tns", '{"name":"b"}')], [("ztf", 100.0, 18.5)])}
    assert sorted(r["key"] for r in spark.read.parquet(outbox).collect()) == ["1", "2"]
    assert [(r["obj_id"], r["reason"]) for r in spark.read.parquet(table + "_rejected").collect()] == [(9, "no envelope")]
    store = keyed_store.KeyedStore(spark, str(tmp_path / "points"), ("obj_id",), lc.schema, 4)
    store.replace(lc, lc.select("obj_id"))
    newer = spark.createDataFrame([(1, "ZTF1b")], "obj_id long, object_id string")
    pull = spark.createDataFrame([point(1, "ztf", 102.0, 18.2), point(2, "ztf", 103.0, 16.0)], schema)
    second = run([1, 2, 9], "b", {"fink_ztf": newer}, pull, surveys={"fink_ztf": "ztf"}, updates=True)
    assert second == {1: ([("fink_ztf", '{"object_id":"ZTF1b"}'), ("tns", '{"name":"a"}')],
                          [("lsst", 101.0, 19.0), ("ztf", 102.0, 18.2)]), 2: first[2]}
    assert spark.read.parquet(outbox).count() == 2
    # the same alerts with the points in a keyed store
    table, outbox = str(tmp_path / "documents2"), str(tmp_path / "outbox2")
    feed2 = spark.readStream.schema("obj_id long").parquet(str(tmp_path / "feed"))
    J.ingest_documents_stream(feed2, envelope, {"fink_ztf": ztf, "tns": tns}, windows, store, table, outbox,
                              str(tmp_path / "ck2")).awaitTermination()
    again = J.document_store(envelope, store, table).read().collect()
    assert {r["obj_id"]: [(p["survey"], p["mjd"], p["mag"]) for p in r["lightcurve"]] for r in again} == {
        k: v[1] for k, v in first.items()}


def test_stream_join_keeps_few_copies_of_a_row(spark):
    n = td.sky_alerts(spark, SF_SMALL).count()
    base = tempfile.mkdtemp()
    q = (J.crossmatch_stream(td.sky_alerts(spark, SF_SMALL, stream=True), 4.0).writeStream.format("parquet")
         .option("checkpointLocation", base + "/ck").trigger(availableNow=True).start(base + "/out"))
    q.awaitTermination()
    assert n < max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) < 5 * n


def test_timers_of_many_objects_in_one_call():
    class State:
        exists, hasTimedOut, kept, wakes = False, False, None, None

        def getCurrentWatermarkMs(self):
            return self.clock

        def update(self, kept):
            self.exists, self.kept = True, kept

        def remove(self):
            self.exists, self.kept = False, None

        def setTimeoutTimestamp(self, at):
            self.wakes = at

        get = property(lambda self: self.kept)
    day, state = 86_400_000, State()
    run = J._timers([("a", 1), ("b", 3)], 0)
    state.clock = day
    first = next(run((5,), iter([pd.DataFrame({"archive_id": ["x", "y", "x"], "update_ms": [0, day, -day]})]), state))
    assert [*zip(first["archive_id"], first["source_name"])] == [("x", "a")]  # y is due on the second day, x's older update is left out
    assert state.wakes == 2 * day - 1
    state.clock, state.hasTimedOut = 4 * day, True
    then = next(run((5,), iter([]), state))
    assert sorted(zip(then["archive_id"], then["source_name"])) == [("x", "b"), ("y", "a"), ("y", "b")]
    assert not state.exists
