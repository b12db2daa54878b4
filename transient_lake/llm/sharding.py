"""Sharding by jump consistent hashing.

A stable key jumps through a growing number of buckets; the jump after bucket
b is to ``floor((b + 1) / r)`` where r in (0, 1] is the key's random number for
b, and the last bucket below the shard count is the key's shard.  Nothing but
the key and the count decides, no ring table is kept, and one more shard takes
from every old shard about one key in ``n + 1``, all into itself.

The random numbers come from ``xxhash64(key, b)``: the upper 31 bits plus one,
over 2^31.  A key takes about ln(n) jumps; the jumps are a fold over
``STEPS`` steps, and the rare key that needs more goes on over the full count.

Slots number the rows of a shard without gaps.  Rows go by (shard, hash bucket
of the whole row), the sizes of these - shards x buckets rows - give each
bucket's first slot, so neither a shard nor the rows of one key or of null
keys are numbered by one task.  There are ``BUCKETS`` buckets, or more so that
a bucket of a shard has about ``GROUP_ROWS`` rows whatever the table.

Defined results: a null key hashes like any value (all null keys share a
shard); null texts have no bytes; repeated keys share a shard and take slots
of their own; ties in a bucket go by text checksum and then by the hash of the
whole row; an empty table gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEPS = 32
BUCKETS = 64
GROUP_ROWS = 10_000


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a key among ``shards``, 0 at first."""
    def step(s: Column, _: Column) -> Column:
        r = (F.shiftrightunsigned(F.xxhash64(key, s["j"]), 33) + 1).cast("double") / F.lit(float(1 << 31))
        jump = F.floor((s["j"] + 1).cast("double") / r).cast("long")
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), jump.alias("j"))).otherwise(s)

    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    few = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, STEPS))), start, step)
    if shards <= STEPS:
        return few["b"].cast("int")
    # one fold at most is evaluated twice: a state that is not yet past the last shard goes on
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
    return F.when(few["j"] >= shards, few["b"]).otherwise(rest["b"]).cast("int")


def to_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text",
              buckets: int | None = None) -> DataFrame:
    """``docs`` with size (UTF-8 bytes of the text plus 16), shard, slot,
    grown_shard (its shard with one more) and law ``key``, one task per
    (shard, bucket) group."""
    key = F.col(doc_id)
    buckets = buckets or max(BUCKETS, -(-docs.count() // (shards * GROUP_ROWS)))
    docs = docs.drop("size", "law", "shard", "slot", "grown_shard")
    row = [F.col(c) for c in docs.columns]
    placed = docs.withColumns({
        "size": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16,
        "law": F.lit("key"), "shard": jump_shard(key, shards), "grown_shard": jump_shard(key, shards + 1),
        "_bucket": F.pmod(F.xxhash64(F.lit("slot"), *row), F.lit(buckets)).cast("int")})
    # shards x buckets rows: one for about GROUP_ROWS rows of the table
    sizes = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    if shards * buckets <= 1_000_000:
        first = F.broadcast(first)
    within = Window.partitionBy("shard", "_bucket").orderBy(
        key, F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.xxhash64(*row))
    return (placed.withColumn("_nth", F.row_number().over(within)).join(first, ["shard", "_bucket"])
            .withColumn("slot", F.col("_first") + F.col("_nth") - 1).drop("_bucket", "_nth", "_first"))


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes of a text (null: empty)."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
