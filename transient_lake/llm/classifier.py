"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (one and two words, ``BUCKETS``
buckets, add-one smoothing): the target model from labelled good documents,
the raw model from every document.  A document's weight is the mean log ratio
of target to raw probability over its n-grams and ``NEUTRAL`` n-grams of ratio
one (so a few odd words don't condemn a short text), times ``SCALE``: the log
weight of a document of that many n-grams with its composition, so documents
are not judged by their length.  Documents are sampled without replacement by
Gumbel top-k: a hash-seeded Gumbel number is added to every log weight and the
k largest stay.

k is as large as the number of documents whose weight reaches the level that
all but ``1 - keep_good`` of held-out labelled good documents reach.

The target model is fitted on a bounded sample of labelled rows
(``LABELLED``), half of it held out for the level.  Counts of the raw model,
weights and the choice of the k-th largest cover all documents.  A row counts
in the raw model by 1 / the rows whose normalised text equals its own (the
classes of exact dedup), at every size of class and table, so copies and case
variants together count as one document and do not make their text look raw;
near copies are texts of their own.  Rows meet their class size by (hash,
``SALT`` parts of the ids), so a class of any size is dealt over many tasks.
Whatever goes to the driver or is broadcast is bounded: ``BUCKETS`` ratios,
``LABELLED`` ids, 65,536 counts of a histogram step.

Defined results: documents without words have weight 0 and a Gumbel number
like any other; rows that tie with the k-th stay; repeated rows have equal
keys; rows without labels are fine, without any labelled good row every
document stays; null labels are no labels; an empty table gives no rows;
clashing columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_dir, scratch_path
from .exact_dedup import content_hash, normalised
from .tokenize import RecentCache, hold, is_short

BUCKETS = 1 << 16
SCALE = 200.0
NEUTRAL = 50
LABELLED = 20_000
SALT = 32
KEEP_GOOD = 0.995
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WORDS = 100_000  # hashes of words that a generation of a worker's cache keeps


def _word_hash(word: bytes) -> bytes:
    return xxhash.xxh64_digest(word, 7)


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of the words and word pairs of a whole text."""
    w = (text or "").encode().split()
    if not w:
        return np.empty(0, dtype=np.int64)
    got = hold("words", lambda: RecentCache(WORDS)).all(w, _word_hash, is_short)
    one = np.frombuffer(b"".join(got), dtype=">u8").astype(np.uint64)
    two = (one[:-1] * _MIX ^ one[1:]) * _SPREAD
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    return (np.concatenate([one, two]) >> shift).astype(np.int64)


def _shares(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_id, t, share) of every row; share: 1 / the rows of equal normalised text."""
    keyed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t")).withColumns({
        "_h": content_hash(normalised(F.col("t"))), "_part": F.pmod(F.xxhash64("_id"), F.lit(SALT)).cast("int")})
    # counts combine map-side; a window holds the parts of one class, SALT rows at most
    parts = keyed.groupBy("_h", "_part").agg(F.count("*").alias("n"))
    copied = parts.select("_h", "_part", F.sum("n").over(Window.partitionBy("_h")).alias("copies")).where("copies > 1")
    return keyed.join(copied, ["_h", "_part"], "left").select("_id", "t", (1.0 / F.coalesce("copies", F.lit(1))).alias("share"))


def _labelled(labels: DataFrame, doc_id: str) -> DataFrame:
    """At most ``LABELLED`` good rows (quality 1, not toxic), by the hash of their id."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(doc_id).alias("_id")).where("_id is not null")
    return good.distinct().orderBy(F.xxhash64("_id"), "_id").limit(LABELLED)


def log_ratios(docs: DataFrame, good: DataFrame, doc_id: str, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of target to raw probability of every bucket; ``good`` has
    the ids of the target documents (bounded)."""
    flagged = (_shares(docs, doc_id, text).join(F.broadcast(good.withColumn("target", F.lit(1))), "_id", "left")
               .select("t", F.coalesce("target", F.lit(0)).alias("target"), "share"))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(buckets), np.zeros(buckets)
        for b in batches:
            for t, is_target, share in zip(b["t"], b["target"], b["share"]):
                f = ngram_buckets(t, buckets)
                np.add.at(raw, f, share)
                if is_target:
                    np.add.at(target, f, 1.0)
        met = np.flatnonzero(raw)
        if len(met):
            yield pd.DataFrame({"bucket": met, "raw": raw[met], "target": target[met]})

    counted = flagged.mapInPandas(tally, "bucket int, raw double, target double")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[sums["bucket"]] += sums["raw"]
    target[sums["bucket"]] += sums["target"]
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel number from the hash of an id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest number of a column (None: all stay): counts of 65,536
    equal steps between the least and the largest number, then of the step
    that holds the k-th, until that step is one number or ends with the k-th."""
    v, above = F.col(column), 0
    while True:
        low, high, n = values.agg(F.min(v), F.max(v), F.count(v)).first()
        if not n or above + n <= k:
            return low
        if low == high:
            return low
        step = F.least(F.floor((v - low) / ((high - low) / 65536)), F.lit(65535))
        for r in sorted(values.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
                        .collect(), key=lambda r: -r["s"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        if above + r["n"] == k:
            return r["low"]
        values = values.where((v >= r["low"]) & (v <= r["high"]))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 23, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``docs`` with log_weight, gumbel_key and kept (among the k largest keys)."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    good = _labelled(labels, doc_id).withColumn("held_out", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)) == 1)
    good = good.checkpoint()
    table = spark.sparkContext.broadcast(log_ratios(docs, good.where("not held_out").select("_id"), doc_id, text))

    @F.pandas_udf("double")
    def weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratio = table.value
        for texts in batches:
            found = (ngram_buckets(t, len(ratio)) for t in texts)
            yield pd.Series([float(ratio[f].sum(dtype=np.float64)) / (len(f) + NEUTRAL) * SCALE for f in found], dtype="float64")

    scored = (docs.drop("log_weight", "gumbel_key", "kept").withColumn("log_weight", weight(F.col(text)))
              .withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col(doc_id), seed)))
    path = scratch_path(spark, "weights")
    scored.select(F.col(doc_id).alias("_id"), "log_weight", "gumbel_key").write.parquet(path)
    weights = spark.read.parquet(path)
    if k is None:
        held = [r[0] for r in weights.join(F.broadcast(good.where("held_out")), "_id").select("log_weight").limit(LABELLED).collect()]
        k = weights.where(F.col("log_weight") >= float(np.quantile(held, 1 - KEEP_GOOD))).count() if held else weights.count()
    least = kth_largest(weights.select("gumbel_key"), "gumbel_key", k) if k > 0 else None
    return scored.withColumn("kept", F.lit(False) if least is None else F.col("gumbel_key") >= least)
