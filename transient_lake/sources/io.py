"""Readers and sinks (S1-S9, S12, S13) and notice parsing.

Streams use Kafka when its connector is on the classpath; every decode /
encode step is a plain DataFrame function, so the same code runs on a file
source in tests and on batch frames.
"""

from __future__ import annotations

import csv
import email
import html
import io
import itertools
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# M1: the detection message schema (coordinates widened to double, D13).
DETECTION_SCHEMA = T.StructType([
    T.StructField("obj_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("ra_deg", T.DoubleType()),
    T.StructField("dec_deg", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
])


# --- S1 / S2 -------------------------------------------------------------

# Messages carry timestamps with microseconds and an explicit offset.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def decode_detections(raw: DataFrame, value: str = "value", schema: T.StructType = DETECTION_SCHEMA) -> DataFrame:
    """JSON message bytes/text -> M1 rows; malformed JSON -> NULL fields."""
    return raw.select(F.from_json(F.col(value).cast("string"), schema, JSON_OPTIONS).alias("data")).select("data.*")


def read_detections_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
                           **options) -> DataFrame:
    """A streaming frame of detections.  ``fmt="kafka"`` reads a topic
    (``subscribe=...``, ``kafka.bootstrap.servers=...``); ``fmt="text"``
    reads one JSON message per line from files (tests, replays)."""
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
    else:
        raw = spark.readStream.options(**options).text(path)
    return decode_detections(raw)


def encode_messages(df: DataFrame, key: str | None = "obj_id_1") -> DataFrame:
    """Rows -> (key, value) with the row as compact JSON."""
    k = F.col(key).cast("string") if key else F.lit(None).cast("string")
    return df.select(k.alias("key"), F.to_json(F.struct(*[F.col(c) for c in df.columns]), JSON_OPTIONS).alias("value"))


def write_messages_stream(df: DataFrame, checkpoint: str, fmt: str = "kafka", path: str | None = None,
                          key: str | None = "obj_id_1", **options):
    """Append the encoded rows to a topic (or to JSON files) with a
    durable checkpoint, so a restart resumes instead of re-sending."""
    enc = encode_messages(df, key)
    w = enc.writeStream.outputMode("append").option("checkpointLocation", checkpoint).options(**options)
    if fmt == "kafka":
        return w.format("kafka").start()
    return w.format("json").start(path)


# --- S3 ------------------------------------------------------------------

def _records(content: bytes) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """(member, records) of a zip; a member is decompressed as it is read and
    a quoted field may hold line breaks."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for member in z.namelist():
            with z.open(member) as raw:
                yield member, csv.reader(io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline=""))


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            for member, records in _records(content):
                next(records, None)  # the banner
                names = next(records, [])
                yield pd.DataFrame({"path": path, "member": member, "pos": range(len(names)), "name": names})


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            for _, records in _records(content):
                next(records, None)
                names = next(records, [])
                while rows := list(itertools.islice(records, CATALOGUE_BATCH)):
                    yield pd.DataFrame({"m": [{n: v for n, v in zip(names, r) if v != ""} for r in rows if r]})


#: Catalogue rows that a task holds at a time.
CATALOGUE_BATCH = 10_000


def catalogue_rows(files: DataFrame) -> DataFrame:
    """S3: rows of zipped CSV catalogues (path, content).  In every member the
    first record is a banner and the second its own header: columns are found
    by name, whatever their order, and a column that a member lacks is NULL
    there, as is an empty field.  A zip is read by one task (it cannot be
    split), a batch of rows at a time."""
    named = files.select("path", "content").mapInPandas(_headers, "path string, member string, pos long, name string")
    first = named.groupBy("name").agg(F.min(F.struct("path", "member", "pos")).alias("at"))
    names = [r["name"] for r in first.orderBy("at").collect()]  # as many as there are columns
    if not names:
        return files.sparkSession.createDataFrame([], "name string")
    rows = files.select("path", "content").mapInPandas(_rows, "m map<string,string>")
    return rows.select(*[F.col("m")[n].alias(n) for n in names])


def read_public_catalogue(spark: SparkSession, path: str, sort_col: str = "name") -> DataFrame:
    """S3: zipped CSV catalogues under ``path`` (see ``catalogue_rows``),
    sorted by ``sort_col`` descending."""
    return catalogue_rows(spark.read.format("binaryFile").load(path)).orderBy(F.col(sort_col).desc())


# --- S4, S5 --------------------------------------------------------------

def read_forced_phot_text(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated photometry files whose header line starts
    with ``###``.  Each file's header is read per file (joined on the file
    name), values are split on runs of whitespace and typed as doubles
    except the text columns ``F`` and ``Obs``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    head = lines.where(F.col("value").startswith("###")).select(
        "file", F.split(F.trim(F.regexp_replace("value", "###", "")), r"\s+").alias("cols"))
    body = lines.where(~F.col("value").startswith("###") & (F.length(F.trim("value")) > 0)).select(
        "file", F.split(F.trim("value"), r"\s+").alias("vals"))
    m = body.join(head, "file").select("file", F.map_from_arrays("cols", "vals").alias("m"))
    text_cols = {"F", "Obs"}
    wanted = ["MJD", "m", "dm", "uJy", "duJy", "F", "err", "chi/N", "RA", "Dec", "x", "y", "maj", "min", "phi",
              "apfit", "mag5sig", "Sky", "Obs"]
    return m.select("file", *[(F.col("m")[c] if c in text_cols else F.col("m")[c].try_cast("double")).alias(c)
                              for c in wanted])


def read_survey_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Survey API dumps - a JSON array of objects with prefixed keys."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


# --- S8, S9 --------------------------------------------------------------

def json_documents(texts: DataFrame, value: str = "value") -> DataFrame:
    """Every document of JSON texts that hold one object or a list of them, as
    a VARIANT column ``doc`` beside the other columns: JSON nulls, nesting and
    number forms stay as they are, no schema is inferred."""
    v = F.parse_json(F.col(value))
    one = F.array(v)
    many = F.when(F.substring(F.ltrim(F.col(value)), 1, 1) == "[", v.cast("array<variant>")).otherwise(one)
    return texts.select(*[c for c in texts.columns if c != value], F.posexplode(many).alias("pos", "doc"))


def publish_json_batch(spark: SparkSession, path: str) -> DataFrame:
    """Files holding one JSON object or a list of them -> one message
    per object, sent as it is (NULL fields included)."""
    docs = json_documents(spark.read.text(path, wholetext=True))
    return docs.select(F.lit(None).cast("string").alias("key"), F.to_json("doc").alias("value"))


def topic_offsets(messages: DataFrame) -> DataFrame:
    """Per partition the low offset, the high watermark (max + 1) and
    the message count max(0, high - low)."""
    g = messages.groupBy("partition").agg(F.min("offset").alias("low_offset"),
                                          (F.max("offset") + 1).alias("high_offset"))
    return g.withColumn("message_count", F.greatest(F.lit(0).cast("long"), F.col("high_offset") - F.col("low_offset")))


# --- S12 -----------------------------------------------------------------

def bibtex_stems(files: DataFrame) -> DataFrame:
    """(file_name, value) -> (stem, text); files of other kinds have no stem."""
    stem = F.regexp_extract(F.col("file_name"), r"^(.*)\.bib$", 1)
    return files.select(F.nullif(stem, F.lit("")).alias("stem"), F.col("value").alias("text"))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """One citation text per ``.bib`` file, keyed by the file stem."""
    return bibtex_stems(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value"))


# --- S13, C18 ------------------------------------------------------------

# Configuration: the notice service's sender address (set per deployment).
NOTICE_SENDER = "notices@example.org"
# Fixed value: the object-name pattern searched in notice bodies.
NAME_PATTERN = r"\b(20\d{2}[a-z]{2,3})\b"
ANCHOR_PATTERN = r"(?s)<a\s[^>]*href[^>]*>(.*?)</a>"


def message_scan(messages: DataFrame, sender: str = NOTICE_SENDER) -> DataFrame:
    """Notices whose From header contains the configured sender."""
    return messages.where(F.col("from").contains(sender))


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Entity-decoded text (``&amp;`` -> ``&``) - a per-value helper."""
    return s.map(lambda v: None if v is None else html.unescape(v))


def notice_object_names(messages: DataFrame, body: str = "body") -> DataFrame:
    """Object names in each notice: the texts of its links (markup inside
    a link is dropped), or, when no link has text, every ``20YYabc`` token of
    the body.  One row per name."""
    links = F.regexp_extract_all(F.col(body), F.lit(ANCHOR_PATTERN), 1)
    anchors = F.filter(F.transform(links, lambda t: F.regexp_replace(t, "<[^>]*>", "")), lambda t: F.length(t) > 0)
    tokens = F.regexp_extract_all(F.col(body), F.lit(NAME_PATTERN), 1)
    names = F.when(F.size(anchors) > 0, anchors).otherwise(tokens)
    out = messages.select("message_id", F.posexplode(names).alias("pos", "raw"))
    return out.select("message_id", F.col("pos").cast("long").alias("pos"), html_text("raw").alias("name"))


@F.pandas_udf(T.StringType())
def message_body(raw: pd.Series) -> pd.Series:
    """The body of a raw mail: its first HTML or plain-text part, decoded
    by the part's charset (UTF-8 without one) - a per-value helper."""
    def body(data) -> str | None:
        if data is None:
            return None
        for part in email.message_from_bytes(bytes(data)).walk():
            if part.get_content_type() in ("text/html", "text/plain"):
                payload = part.get_payload(decode=True)
                if payload:
                    try:
                        return payload.decode(part.get_content_charset() or "utf-8", errors="replace")
                    except LookupError:  # a charset that nobody knows
                        return payload.decode("utf-8", errors="replace")
        return ""
    return raw.map(body)
