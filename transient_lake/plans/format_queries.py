"""Registered queries of the file readers.

Each writes one of the driver's tables in the reader's format into the shared
folder (zips and mails, which Spark does not write, are made as rows of files)
and reads it back with the reader."""

from __future__ import annotations

import csv
import io
import os
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import catalogue as cat
from ..session import scratch_path
from ..sources import io as sio
from ..sources import testdata as td
from .registry import register


def _zips(pdf: pd.DataFrame) -> pd.DataFrame:
    """A catalogue zip of two members with their columns in two orders, from the rows of one file number."""
    buf, file = io.BytesIO(), pdf["file"].iloc[0]
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for member, names in (("a.csv", ["name", "type", "note"]), ("b.csv", ["note", "name", "day"])):
            text = io.StringIO()
            w = csv.writer(text)
            w.writerow(["2024-01-01 00:00:00"])
            w.writerow(names)
            rows = pdf[pdf["member"] == member[0]].sort_values("name")
            w.writerows(rows[names].itertuples(index=False, name=None))
            z.writestr(member, text.getvalue())
    return pd.DataFrame({"path": [f"catalogue-{file}.zip"], "content": [buf.getvalue()]})


@register("public_catalogue_zips", sql="""
select cast(p_partkey as varchar) as name, case when p_partkey % 2 = 0 then p_type end as type,
       p_brand || chr(10) || '"' || p_name || '", quoted' as note,
       case when p_partkey % 2 = 1 then cast(p_size as varchar) end as day from part
""")
def q_public_catalogue_zips(spark, sf_dir):
    """S3: zipped catalogues with different headers and quoted line breaks."""
    part = td.table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 7).alias("file"), F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("member"),
        F.col("p_partkey").cast("string").alias("name"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("day"),
        F.concat("p_brand", F.lit('\n"'), "p_name", F.lit('", quoted')).alias("note"))
    files = part.groupBy("file").applyInPandas(_zips, "path string, content binary")
    return sio.catalogue_rows(files).select("name", "type", "note", "day")


@register("forced_phot_text", sql="""
select obj_id % 8 as file, mjd as "MJD", mag as m, mag_err as dm, filter as "F", case when obj_id % 2 = 0 then cast(detection as double) end as maj
from lc_points where mjd is not null and mag is not null and mag_err is not null and filter is not null
""", views=("lc_points",))
def q_forced_phot_text(spark, sf_dir):
    """Photometry texts, one header a file, columns in two orders."""
    path = os.path.join(scratch_path(spark, "forced"), "texts")
    lc = td.lc_points(spark, sf_dir).where(
        "mjd is not null and mag is not null and mag_err is not null and filter is not null")
    even = F.col("obj_id") % 2 == 0
    line = F.when(even, F.concat_ws("  ", "mjd", "mag", "mag_err", "filter", "detection")).otherwise(F.concat_ws(" ", "filter", "mjd", "mag", "mag_err"))
    body = lc.select((F.col("obj_id") % 8).alias("file"), F.lit(1).alias("n"), line.alias("value"))
    head = spark.range(8).select(F.col("id").alias("file"), F.lit(0).alias("n"), F.when(
        F.col("id") % 2 == 0, "###MJD m dm F maj").otherwise("###F MJD m dm").alias("value"))
    (body.unionByName(head).repartition("file").sortWithinPartitions("file", "n").select("file", "value")
     .write.partitionBy("file").text(path))
    got = sio.read_forced_phot_text(spark, path)
    return got.select(F.regexp_extract("file", r"file=(\d+)", 1).cast("long").alias("file"), "MJD", "m", "dm", "F", "maj")


def _json_lists(spark, sf_dir, name):
    """Orders as lists of JSON objects, one list a file, NULL fields written."""
    path = os.path.join(scratch_path(spark, name), "lists")
    o = td.table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 16).alias("file"), F.to_json(F.struct(
            F.col("o_orderkey").alias("i:id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("d:tag"),
            F.struct(F.col("o_custkey").alias("by"), F.array("o_orderstatus", F.lit(None).cast("string")).alias("s")).alias("x")),
            {"ignoreNullFields": "false"}).alias("v"))
    o.groupBy("file").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("v"), ",\n"), F.lit("]")).alias("value")) \
        .write.partitionBy("file").text(path)
    return path


@register("survey_json", sql="""
select o_orderkey as "i:id", case when o_orderkey % 3 > 0 then o_orderpriority end as "d:tag" from orders
""")
def q_survey_json(spark, sf_dir):
    """JSON lists of objects with prefixed keys."""
    return sio.read_survey_json(spark, _json_lists(spark, sf_dir, "survey"), "`i:id` long, `d:tag` string").select("i:id", "d:tag")


@register("json_batch_messages", sql="""
select cast(null as varchar) as key, '{"d:tag":' || case when o_orderkey % 3 > 0 then '"' || o_orderpriority || '"' else 'null' end
  || ',"i:id":' || o_orderkey || ',"x":{"by":' || o_custkey || ',"s":["' || o_orderstatus || '",null]}}' as value from orders
""")
def q_json_batch_messages(spark, sf_dir):
    """One message an object of the lists, JSON nulls kept."""
    return sio.publish_json_batch(spark, _json_lists(spark, sf_dir, "batch"))


@register("archive_round_trip", sql="""
select 'meta' as kind, w.obj_id, w.discovery_mjd, w.prior_days, cast(null as varchar) as survey, cast(null as varchar) as filter,
       cast(null as double) as mjd, cast(null as double) as mag, cast(null as double) as "limit" from mjd_windows w
union all
select 'point', p.obj_id, null, null, p.survey, p.filter, p.mjd, p.mag, p."limit" from lc_points p join mjd_windows w using (obj_id)
""", views=("lc_points", "mjd_windows"))
def q_archive_round_trip(spark, sf_dir):
    """S6 + S7: the archive exported as JSON lines and imported again."""
    path = os.path.join(scratch_path(spark, "archive"), "dump")
    cat.export_archive(td.mjd_windows(spark, sf_dir), td.lc_points(spark, sf_dir), path, key="obj_id")
    meta, lc = cat.import_archive(spark, path, key="obj_id")
    return (meta.select(F.lit("meta").alias("kind"), "obj_id", "discovery_mjd", F.col("prior_days").cast("int").alias("prior_days"))
            .unionByName(lc.select(F.lit("point").alias("kind"), "obj_id", "survey", "filter", "mjd", "mag", "limit"),
                         allowMissingColumns=True))


@register("archive_documents", sql="""
select w.obj_id, cast(w.discovery_mjd as double) as discovery_mjd, w.prior_days is null as no_setting, coalesce(n, 0) as n_points
from mjd_windows w left join (select obj_id, count(*) as n from lc_points group by obj_id) using (obj_id)
""", views=("lc_points", "mjd_windows"))
def q_archive_documents(spark, sf_dir):
    """S7 over VARIANT: the dump's open documents, NULL fields included."""
    path = os.path.join(scratch_path(spark, "variant"), "dump")
    cat.export_archive(td.mjd_windows(spark, sf_dir), td.lc_points(spark, sf_dir), path, key="obj_id")
    d = cat.import_documents(spark, path, key="obj_id")
    return d.select(F.col("obj_id").cast("long").alias("obj_id"),
                    F.variant_get("meta", "$.discovery_mjd", "double").alias("discovery_mjd"),
                    F.to_json("meta").contains('"prior_days":null').alias("no_setting"),
                    F.coalesce(F.size(F.variant_get("lc", "$", "array<variant>")), F.lit(0)).cast("long").alias("n_points"))


@register("bibtex_stems", sql="""
select n_name as stem, '@article{' || n_name || ',' || chr(10) || ' note={' || n_regionkey || '}}' as text from nation
union all select null, cast(n_regionkey as varchar) from nation where n_nationkey < 3
""")
def q_bibtex_stems(spark, sf_dir):
    """Citation texts keyed by file stem; other files have none."""
    n = td.table(spark, sf_dir, "nation")
    text = F.concat(F.lit("@article{"), "n_name", F.lit(",\n note={"), F.col("n_regionkey").cast("string"), F.lit("}}"))
    files = n.select(F.concat("n_name", F.lit(".bib")).alias("file_name"), text.alias("value")).unionByName(
        n.where("n_nationkey < 3").select(F.concat("n_name", F.lit(".txt")).alias("file_name"), F.col("n_regionkey").cast("string").alias("value")))
    return sio.bibtex_stems(files)


@register("message_bodies", sql="""
select message_id, case when message_id % 3 = 0 then 'plain ' || subject else body end as body from notices
""", views=("notices",))
def q_message_bodies(spark, sf_dir):
    """Bodies of raw mails, a single HTML part or the first of two parts."""
    n = td.notices(spark, sf_dir)
    html = F.concat(F.lit("From: n@example.org\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"),
                    F.base64(F.col("body").cast("binary")))
    plain = F.concat(F.lit("From: n@example.org\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=xx\n\n--xx\n"
                           "Content-Type: text/plain; charset=utf-8\n\nplain "), F.col("subject"),
                     F.lit("\n--xx\nContent-Type: text/html\n\n<p>later</p>\n--xx--\n"))
    raw = F.when(F.col("message_id") % 3 == 0, plain).otherwise(html).cast("binary")
    return n.select("message_id", sio.message_body(raw).alias("body"))
