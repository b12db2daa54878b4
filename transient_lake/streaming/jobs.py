"""Structured Streaming jobs: ST1-ST5.

* ST1 ``crossmatch_stream``: stream-stream self join on sky cells with a
  watermark on both sides and a +-120 h time bound, so join state is
  evicted (the legacy job kept state for ever);
* ST5 ``dedupe_pairs``: at-least-once delivery repaired with
  ``dropDuplicatesWithinWatermark`` on the pair key;
* ST2 ``collate_hits_stream``: ``foreachBatch`` folds each micro-batch of
  pairs into the hit table (only hits touched by the batch are recomputed);
* ST3 ``ingest_documents_stream``: ``foreachBatch`` assembles metadata and
  windowed light curve of the objects named in the batch, upserts their
  documents and sends one message each; ``ingest_alert_stream`` recomputes
  their light-curve summaries;
* ST4 ``filter_alert_stream``: the alert conditions as a stateless filter.

Tables written by ``foreachBatch`` are keyed stores (``sources.keyed_store``):
partitioned by a hash bucket of their key, a batch rewrites the buckets that it
touches.  What a batch changes is written once under its batch id, so a batch
that is run again, complete or cut short, has the same effect as one run.
Checkpoints and tables live under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType, TimestampType

from ..operators import catalogue as cat
from ..operators import hits as H
from ..operators import photometry as ph
from ..operators import sky
from ..operators.numbering import number_by_digest
from ..operators.search import match_alert_conditions
from ..session import checkpoint_dir, scratch_path
from ..sources.io import encode_messages
from ..sources.keyed_store import DEFAULT_BUCKETS, KeyedStore, last_batch, set_last_batch, written_once

XMATCH_WINDOW = "120 hours"
#: Width of a sky cell in stream joins, in radii, and of a slice of time, in windows: a row of join state
#: has about (1 + 2 / STREAM_CELL)^2 * (1 + 2 / STREAM_SLICE) copies.
STREAM_CELL = 16
STREAM_SLICE = 4

#: State kept on the executors' disks under a bound of memory (MB an executor), in one store a partition; Spark's
#: own store holds every row of join state in the heap, some 300 bytes each.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state as ``DISK_STATE`` says (a stream takes the session's settings
    when it starts; one that goes on from a checkpoint keeps the store it began with).  If the session names a
    store of its own, nothing is changed."""
    named = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    if named is not None and not named.endswith(".HDFSBackedStateStoreProvider"):
        yield
        return
    before = {k: spark.conf.get(k, None) for k in DISK_STATE}
    try:
        for k, v in DISK_STATE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _slice(at, window: str) -> Column:
    """Slice of time (``STREAM_SLICE`` windows long) that an instant falls in."""
    at = F.col(at) if isinstance(at, str) else at
    epoch = F.timestamp_micros(F.lit(0))
    return F.floor(F.unix_micros(at) / (F.unix_micros(epoch + F.expr(f"interval {window}")) * STREAM_SLICE))


def crossmatch_stream(alerts: DataFrame, radius_arcsec: float = 4.0, window: str = XMATCH_WINDOW,
                      other: DataFrame | None = None, salt: int = 1,
                      define_watermark: bool = True) -> DataFrame:
    """ST1: cross-survey pairs within the radius whose detection times lie
    within ``window`` of each other.  Works on streaming and batch frames.

    Rows meet by sky cell and slice of time.  Both are wider than what they
    must hold, for every copy of a row is a row of join state; the slices
    spread a spot that is seen again and again over state partitions (AQE does
    not split skewed partitions in streaming).  ``salt`` spreads a cell further
    over so many of them, for as many copies of the build side.
    ``define_watermark=False`` is for detections that carry a watermark
    already (``dedupe_detections``)."""
    other = alerts if other is None else other
    r = radius_arcsec / 3600.0
    cell = max(sky.cell_size_deg(r), STREAM_CELL * r)
    a = sky.home_cell(sky._suffix(alerts, "_1"), "ra_deg_1", "dec_deg_1", cell)
    b = sky.cover_cells(sky._suffix(other, "_2"), "ra_deg_2", "dec_deg_2", r, cell)
    if define_watermark:
        a, b = a.withWatermark("timestamp_1", window), b.withWatermark("timestamp_2", window)
    a, b, keys = sky.salt_cells(a, b, "obj_id_1", salt)
    a = a.withColumn("_slice", _slice("timestamp_1", window))
    reach = F.expr(f"interval {window}")
    b = b.withColumn("_slice", F.explode(F.sequence(_slice(F.col("timestamp_2") - reach, window),
                                                    _slice(F.col("timestamp_2") + reach, window))))
    keys = [*keys, "_slice"]
    sep = sky.angular_sep_arcsec("ra_deg_1", "dec_deg_1", "ra_deg_2", "dec_deg_2")
    bound = F.expr(f"timestamp_2 between timestamp_1 - interval {window} and timestamp_1 + interval {window}")
    j = a.join(b, keys).where(
        (F.col("obj_id_1") < F.col("obj_id_2")) & (F.col("source_1") != F.col("source_2"))
        & (F.abs(F.col("dec_deg_1") - F.col("dec_deg_2")) <= r) & (sep <= radius_arcsec) & bound)
    return j.select(*[f"{c}_1" for c in sky.PAIR_COLS], *[f"{c}_2" for c in sky.PAIR_COLS], sep.alias("sep_arcsec"))


def dedupe_detections(alerts: DataFrame, window: str = XMATCH_WINDOW) -> DataFrame:
    """ST5: drop re-delivered detections (same object, survey and time) before
    the join, so that neither pairs nor join state multiply."""
    return alerts.withWatermark("timestamp", window).dropDuplicatesWithinWatermark(["obj_id", "source", "timestamp"])


def dedupe_pairs(pairs: DataFrame, window: str = XMATCH_WINDOW, define_watermark: bool = True) -> DataFrame:
    """ST5: drop re-delivered pairs (same id pair) within the watermark.
    Pairs read back from a topic need a watermark; pairs coming straight
    out of ``crossmatch_stream`` already carry one (``define_watermark=False``)."""
    if define_watermark:
        pairs = pairs.withWatermark("timestamp_1", window)
    else:
        # keep one event-time column: timestamp_2 becomes a plain value
        pairs = pairs.withColumn("timestamp_2", F.timestamp_micros(F.unix_micros("timestamp_2")))
    return pairs.dropDuplicatesWithinWatermark(["obj_id_1", "obj_id_2"])


def run_available_now(df: DataFrame, name: str, fmt: str = "parquet", base: str | None = None) -> str:
    """Run a streaming frame over everything available, into a fresh table
    under the shared checkpoint folder; returns the table path.  ``base``: the
    folder of an earlier run, which goes on."""
    spark = df.sparkSession
    base = base or scratch_path(spark, name)
    out, ck = os.path.join(base, "table"), os.path.join(base, "checkpoint")
    q = (df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", ck)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return out


# --- ST2: hits in keyed tables ---------------------------------------------

HIT_SCHEMA = ("xmatch_id string, obj_id string, source string, ra_deg double, dec_deg double, ra_hms string, "
              "dec_dms string, timestamp timestamp")


@dataclass(frozen=True)
class HitTables:
    """Members by hit, the hit of every object, and the last number of every year."""

    spark: SparkSession
    base: str
    buckets: int = DEFAULT_BUCKETS

    @property
    def members(self) -> KeyedStore:
        return KeyedStore(self.spark, f"{self.base}/members", ("xmatch_id",), HIT_SCHEMA, self.buckets)

    @property
    def owners(self) -> KeyedStore:
        return KeyedStore(self.spark, f"{self.base}/owners", ("obj_id",), "obj_id string, xmatch_id string", self.buckets)

    @property
    def years(self) -> KeyedStore:
        return KeyedStore(self.spark, f"{self.base}/years", ("year",), "year int, last long", 1)

    def touched(self, ids: DataFrame) -> DataFrame:
        """All members of the hits that contain any of ``ids`` (obj_id): two
        reads that prune to buckets."""
        return self.members.read(self.owners.read(ids).select("xmatch_id"))


def _folded(tables: HitTables, pairs: DataFrame) -> DataFrame:
    """Members of every hit that the pairs touch, with their hit's id after
    the batch and before it (``old_id``); new hits get the next numbers of the
    year of their first detection, in the MD5 order of their smallest member."""
    existing = tables.touched(sky.split_pair(pairs).select("obj_id")).checkpoint()
    changed, _merges = H.update_hits(existing, pairs)
    fresh = (changed.join(existing.select("xmatch_id").distinct(), "xmatch_id", "left_anti")
             .groupBy("xmatch_id").agg(F.year(F.min("timestamp")).alias("year")))
    numbered = (number_by_digest(fresh, ["year"], "xmatch_id", "_k").join(tables.years.read(), "year", "left")
                .select("xmatch_id", "year", (F.coalesce("last", F.lit(0)) + F.col("_k")).alias("number")))
    given = F.when(F.col("number") < 36 ** cat.ID_LEN, cat.yearly_id("year", "number")).when(
        F.col("number").isNotNull(), F.raise_error(F.lit("a year is out of hit numbers")))
    old = existing.select("obj_id", F.col("xmatch_id").alias("old_id"))
    return (changed.join(numbered, "xmatch_id", "left").withColumn("xmatch_id", F.coalesce(given, F.col("xmatch_id")))
            .join(old, "obj_id", "left"))


def hit_folder(table: str, buckets: int = DEFAULT_BUCKETS):
    """The ``foreachBatch`` function of ST2: fold one micro-batch of pairs
    into the hit tables under ``table`` (see ``HitTables``).  What the batch
    changes is written once and then put into the tables, so a batch that is
    run again keeps its ids and changes nothing more."""
    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checkpoint_dir(spark)
        if batch_id <= last_batch(spark, f"{table}/applied"):
            return  # applied in full before
        columns = [f"{c}_1" for c in sky.PAIR_COLS[1:]] + [f"{c}_2" for c in sky.PAIR_COLS[1:]]
        new_pairs = (batch.groupBy("obj_id_1", "obj_id_2")
                     .agg(F.min_by(F.struct(*columns), F.struct("timestamp_1", "timestamp_2", *columns)).alias("_p"))
                     .select("obj_id_1", "obj_id_2", "_p.*").checkpoint())
        if new_pairs.isEmpty():
            return
        tables = HitTables(spark, table, buckets)
        changed = written_once(spark, f"{table}/changed", batch_id, lambda: _folded(tables, new_pairs))
        tables.members.replace(changed, changed.select(F.col("old_id").alias("xmatch_id")), batch_id)
        tables.owners.upsert(changed, batch_id=batch_id)
        tables.years.upsert(changed.where("number is not null").groupBy("year").agg(F.max("number").alias("last")),
                            batch_id=batch_id)
        set_last_batch(spark, f"{table}/applied", batch_id)
    return fold


def collate_hits_stream(pairs: DataFrame, table: str, checkpoint: str, buckets: int = DEFAULT_BUCKETS,
                        trigger: dict | None = None):
    """ST2: fold every micro-batch of pairs into the hit tables.  ``trigger``:
    arguments of the stream's trigger; by default all that is available now, a
    service passes ``{"processingTime": "1 minute"}``.  The join state of the
    pairs is kept on disk (``disk_state``): the folding needs the heap."""
    with disk_state(pairs.sparkSession):
        return (pairs.writeStream.foreachBatch(hit_folder(table, buckets)).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())


# --- ST3: summaries and documents -------------------------------------------

SUMMARY_SCHEMA = ("obj_id long, survey string, filter string, mag double, peak_mag double, mag_rate double, "
                  "mjd double, date string")


def summary_store(spark: SparkSession, table: str, buckets: int = DEFAULT_BUCKETS) -> KeyedStore:
    """Light-curve summaries, the rows of an object in one bucket."""
    return KeyedStore(spark, table, ("obj_id",), SUMMARY_SCHEMA, buckets)


def _of(frame: DataFrame | KeyedStore, ids: DataFrame) -> DataFrame:
    """Rows of the ids: a keyed store reads their buckets only."""
    return frame.read(ids) if isinstance(frame, KeyedStore) else frame.join(ids, "obj_id", "left_semi")


def _send(messages: DataFrame, outbox: str, batch_id: int) -> None:
    """Messages of a batch in a partition of their own; sent again, they take the place of the first."""
    (messages.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(outbox))


def ingest_alert_stream(alert_ids: DataFrame, lc: DataFrame | KeyedStore, table: str, outbox: str, checkpoint: str,
                        buckets: int = DEFAULT_BUCKETS, trigger: dict | None = None):
    """ST3: for every micro-batch of alerted object ids, recompute those
    objects' summaries from their full light curves, replace them in the
    summary store and append one outgoing message per object.  The summaries
    are computed once: store and messages take them from the written batch.
    With ``lc`` a keyed store by obj_id only the touched buckets are read."""
    def ingest(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= last_batch(spark, f"{table}_applied"):
            return
        ids = written_once(spark, f"{table}_ids", batch_id, lambda: batch.select("obj_id").distinct())
        summaries = written_once(spark, f"{table}_new", batch_id, lambda: ph.latest_detections(_of(lc, ids)))
        msgs = summaries.groupBy("obj_id").agg(F.count("*").alias("n_filters"), F.max("mjd").alias("latest_mjd"))
        _send(msgs.select(F.col("obj_id").cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")), outbox, batch_id)
        summary_store(spark, table, buckets).replace(summaries, ids, batch_id)
        set_last_batch(spark, f"{table}_applied", batch_id)
    return (alert_ids.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _curves(points: DataFrame) -> DataFrame:
    """(obj_id, lightcurve): the points of an object as one array, by mjd."""
    cols = ["mjd", *[c for c in points.columns if c not in ("obj_id", "mjd")]]
    return points.groupBy("obj_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("lightcurve"))


def document_schema(envelope: DataFrame, lc: DataFrame | KeyedStore) -> StructType:
    """Columns of a document: the envelope's, data_sources, update_date, lightcurve."""
    point = lc.columns if isinstance(lc, KeyedStore) else lc.schema
    by_name = {f.name: f for f in point.fields}
    cols = ["mjd", *[n for n in by_name if n not in ("obj_id", "mjd")]]
    curve = StructType([StructField(c, by_name[c].dataType) for c in cols])
    return StructType([*[StructField(f.name, f.dataType) for f in envelope.schema.fields],
                       StructField("data_sources", MapType(StringType(), StringType())), StructField("update_date", TimestampType()),
                       StructField("lightcurve", ArrayType(curve))])


def document_store(envelope: DataFrame, lc: DataFrame | KeyedStore, table: str, buckets: int = DEFAULT_BUCKETS) -> KeyedStore:
    """The documents that ``ingest_documents_stream`` keeps, one row an object."""
    return KeyedStore(envelope.sparkSession, table, ("obj_id",), document_schema(envelope, lc), buckets)


REJECT_REASON = "no envelope"


def ingest_documents_stream(alert_ids: DataFrame, envelope: DataFrame, sources: dict[str, DataFrame], windows: DataFrame,
                            lc: DataFrame | KeyedStore, table: str, outbox: str, checkpoint: str,
                            surveys: dict[str, str] | None = None, updates: bool = False, update_date=None,
                            buckets: int = DEFAULT_BUCKETS, trigger: dict | None = None):
    """ST3: for every micro-batch of object ids, assemble the metadata of
    those objects (J4 over ``envelope`` and ``sources``, one row per obj_id
    each), cut their points of ``lc`` to the active window (F1), and upsert
    one document per object (S10): the envelope's columns, data_sources,
    update_date and lightcurve.  Ids without an envelope give no document but
    a row (obj_id, reason) under ``<table>_rejected`` (D9).

    Alerts replace the whole document and send its metadata as one message
    per object (S2).  With ``updates`` only stored objects are refreshed:
    payloads of ``sources`` (those that are due) replace the stored ones, and
    where a source returned metadata the points of its survey
    (``surveys``: source -> survey) are replaced (U2); nothing is sent.

    Documents live in a keyed store: a batch reads and rewrites the buckets of
    its objects and no others (``lc`` as a keyed store likewise)."""
    def ingest(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= last_batch(spark, f"{table}_applied"):
            return
        store = document_store(envelope, lc, table, buckets)
        ids = written_once(spark, f"{table}_ids", batch_id, lambda: batch.select("obj_id").distinct())

        def assembled() -> DataFrame:
            found = {name: _of(df, ids) for name, df in sources.items()}
            points = ph.cut_mjd_window(_of(lc, ids), _of(windows, ids))
            if updates:
                stored = store.read(ids)
                kept = stored.withColumnRenamed("data_sources", "_old").drop("update_date", "lightcurve")
                new = F.col("data_sources")
                meta = cat.assemble_metadata(kept, found, "obj_id").withColumn("data_sources", F.map_concat(
                    F.map_filter("_old", lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)).drop("_old")
                pulled, points = points, stored.select("obj_id", F.inline("lightcurve")).select(*points.columns)
                for name, survey in (surveys or {}).items():
                    if name in found:
                        fresh = pulled.where(F.col("survey") == survey).join(found[name], "obj_id", "left_semi")
                        points = cat.replace_survey_points(points, fresh, found[name], survey)
            else:
                meta = cat.assemble_metadata(_of(envelope, ids), found, "obj_id")
            curves = _curves(points)
            return (meta.withColumn("update_date", F.current_timestamp() if update_date is None else update_date)
                    .join(curves, "obj_id", "left")
                    .withColumn("lightcurve", F.coalesce("lightcurve", F.array().cast(curves.schema["lightcurve"].dataType)))
                    .select(*store.columns.names))
        docs = written_once(spark, f"{table}_new", batch_id, assembled)
        if not updates:
            _send(encode_messages(docs.drop("lightcurve"), key="obj_id"), outbox, batch_id)
            _send(ids.join(docs, "obj_id", "left_anti").withColumn("reason", F.lit(REJECT_REASON)), f"{table}_rejected", batch_id)
        store.upsert(docs, batch_id=batch_id)
        set_last_batch(spark, f"{table}_applied", batch_id)
    return (alert_ids.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def filter_alert_stream(docs: DataFrame, conditions: dict) -> DataFrame:
    """ST4: alert documents (stream or batch) that meet the conditions."""
    return match_alert_conditions(docs, conditions)


def publish_requests(requests: DataFrame, fmt: str = "kafka", path: str | None = None, **options) -> None:
    """ST6 output: the refresh work list (``object_id, queue, source_name``)
    sent as keyed JSON messages, one per request - to a topic
    (``topic=...``, ``kafka.bootstrap.servers=...``) or to JSON files."""
    msgs = encode_messages(requests, key="object_id")
    if fmt == "kafka":
        msgs.write.format("kafka").options(**options).save()
    else:
        msgs.write.mode("overwrite").json(path)


# --- ST6: timers -----------------------------------------------------------

REQUEST_SCHEMA = "archive_id string, source_name string, due_at timestamp, fired_at timestamp"


_DAY_MS = 86_400_000
#: Slices of the objects that keep their timers together; for 100 TB as many as give slices of some thousand objects.
TIMER_SLICES = 2048


def _timers(config: list[tuple[str, int]], behind: int):
    """The timers of a slice of objects: an update sets an object's timers
    anew, the clock (the watermark, which is ``behind`` milliseconds late)
    fires each once."""
    names, waits = [name for name, _ in config], np.array([days * _DAY_MS for _, days in config], dtype=np.int64)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if key[0] is None or key[0] != key[0]:
            return  # the clock's ticks only move the watermark
        now = state.getCurrentWatermarkMs() + behind
        ids, updates, fired = state.get if state.exists else ([], [], [])
        kept = pd.DataFrame({"archive_id": pd.Series(ids, dtype=object), "update_ms": np.array(updates, dtype=np.int64),
                             "fired_ms": np.array(fired, dtype=np.int64)})
        if not state.hasTimedOut:
            new = pd.concat([b[["archive_id", "update_ms"]] for b in batches], ignore_index=True)
            new["update_ms"] = new["update_ms"].astype(np.int64)
            new["fired_ms"] = new["update_ms"] - 1
            # the newest update of an object; of equal ones the kept one, which knows what has fired
            kept = (pd.concat([kept, new], ignore_index=True).sort_values("update_ms", ascending=False, kind="stable")
                    .drop_duplicates("archive_id"))
        due = kept["update_ms"].to_numpy()[:, None] + waits
        at, which = np.nonzero((due > kept["fired_ms"].to_numpy()[:, None]) & (due <= now))
        waiting = due > now
        rest = waiting.any(axis=1)
        if rest.any():
            left = kept[rest]
            state.update((left["archive_id"].tolist(), left["update_ms"].tolist(), np.maximum(left["fired_ms"], now).tolist()))
            # it fires when the watermark is beyond it
            state.setTimeoutTimestamp(max(int(due[waiting].min()) - 1, now) - behind)
        else:
            state.remove()
        yield pd.DataFrame({"archive_id": kept["archive_id"].to_numpy()[at], "source_name": np.array(names, dtype=object)[which],
                            "due_at": pd.to_datetime(due[at, which], unit="ms"),
                            "fired_at": pd.to_datetime(np.full(len(at), now, dtype=np.int64), unit="ms")})
    return run


def refresh_timers(updates: DataFrame, clock: DataFrame, source_config, lateness_days: int = 3650,
                   slices: int = TIMER_SLICES) -> DataFrame:
    """ST6 as a stream: every (object, source) pair has a timer that fires once
    ``update_date`` + the source's ``update_frequency`` days are reached by the
    clock.  ``updates``: (archive_id, update_date), a later one sets the timers
    anew; ``clock``: (now) ticks.  Rows are the work list, each request once per
    update, with the clock time at which it was found due.

    The clock is the largest time seen in ticks and updates.  The watermark
    stays ``lateness_days`` behind it, so an update may arrive that long after
    its date; older ones are dropped as late.  State is two numbers an object,
    gone when its last timer has fired, kept by slices (a hash of the object's
    id): a call works on all due timers of a slice.  Updates without an
    archive_id are left out."""
    dated = F.col("update_date").cast("timestamp")
    rows = updates.where("update_date is not null").select("archive_id", F.unix_millis(dated).alias("update_ms"), dated.alias("at"))
    ticks = clock.select(F.lit(None).cast("string").alias("archive_id"), F.lit(None).cast("long").alias("update_ms"),
                         F.col("now").cast("timestamp").alias("at"))
    timed = rows.unionByName(ticks).withWatermark("at", f"{lateness_days} days")
    # no filter on the ticks: Spark would push it below the watermark
    part = F.when(F.col("archive_id").isNotNull(), F.pmod(F.xxhash64("archive_id"), F.lit(slices)))
    return timed.withColumn("slice", part).groupBy("slice").applyInPandasWithState(
        _timers([(name, days) for name, _, _, days in source_config], lateness_days * _DAY_MS), REQUEST_SCHEMA,
        "archive_id array<string>, update_ms array<long>, fired_ms array<long>", "append", GroupStateTimeout.EventTimeTimeout)
