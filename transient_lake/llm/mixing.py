"""Mixing sources to target weights by Poisson replication, DataFrame functions only.

Every source gets a mean repetition rate that brings its bytes to its share of
the target size.  A document's count is a Poisson number with that mean, made
by inversion: a uniform number from the hash of (seed, MD5 of the whole row,
its number among equal rows) is looked up in the distribution's running sums.
Rates over ``STEP`` are drawn as a sum of independent counts of equal smaller
means.  Documents are repeated by their count (0: not in the mix) and the
copies are shuffled globally by their place, another hash of the same and the
replica, so the mix is the same on every run and every cluster, and rows that
share an id, or have none, draw and move for themselves.

Equal rows are first grouped (combined map-side) and numbered when the group is
taken apart again, a group of more than ``PART`` rows in parts that are dealt
out, so a row that makes up a third of the table is no hot key.

The running sums are made once for each source and joined to its rows; a hot
source is only many rows with one small join partner.  Sizes are summed
map-side.

Defined results: size of a document is its UTF-8 bytes plus one (null text:
one); null is a source of its own; sources without a given weight have weight
zero; repeated rows, repeated and null ids draw a count each; the columns must
be of groupable types (no maps); an empty table gives no rows; clashing columns
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

STEP = 16.0
#: Running sums kept; beyond them a Poisson distribution of mean ``STEP`` has less than 2^-64.
TERMS = 80
BROADCAST_SOURCES = 50_000
#: Equal rows that one task takes apart at a time.
PART = 1_024


def uniform(*parts: Column) -> Column:
    """Number in (0, 1) from the first 52 bits of the MD5 of the joined parts."""
    return (hash52(*parts).cast("double") + 0.5) / float(1 << 52)


def hash52(*parts: Column) -> Column:
    """The first 52 bits of the MD5 of the joined parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 13)
    return F.conv(digits, 16, 10).cast("long")


def numbered_rows(docs: DataFrame, part: int = PART) -> DataFrame:
    """``docs`` with _key (MD5 of the whole row) and _nth (from 0 among equal rows)."""
    cols = docs.columns
    shown = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols]
    rows = docs.groupBy(*cols).agg(F.count("*").alias("_n")).withColumn("_key", F.md5(F.concat_ws("|", *shown)))
    few = rows.where(F.col("_n") <= part).withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    begins = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(part).cast("long"))
    many = (rows.where(F.col("_n") > part).withColumn("_at", F.explode(begins)).repartition("_key", "_at")
            .withColumn("_nth", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + part, F.col("_n")) - 1))))
    return few.drop("_n").unionByName(many.drop("_n", "_at"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0,
                 source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate): mean repetitions so that the mix has ``epochs`` times
    the bytes of ``docs``, shared out by ``weights``, or without them by the
    sources' sizes to ``power``."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    by = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("size"))
    if weights is None:
        by = by.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        by = by.withColumn("w", F.coalesce(given[F.col("_source")].cast("double"), F.lit(0.0)))
    total = by.agg(F.sum("w").alias("all_w"), F.sum("size").alias("all_size"))  # one row
    return by.join(F.broadcast(total), F.lit(True)).select(
        "_source", (F.col("w") / F.col("all_w") * F.col("all_size") * epochs / F.col("size")).alias("rate"))


def running_sums(rate: Column) -> Column:
    """Poisson distribution function of mean ``rate`` at 0, 1, ..., ``TERMS``."""
    p0 = F.exp(-rate)
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"),
                                 F.concat(s["sums"], F.array(s["c"] + s["p"] * rate / k)).alias("sums"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)),
                       F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("sums")), step, lambda s: s["sums"])


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0,
                seed: int = 17, source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` in mixed proportions and global random order, with rate (of
    the source), repeats (of the document), replica (from 0) and place (the
    52-bit hash that the order follows within a task and the dealing between them)."""
    checkpoint_dir(docs.sparkSession)
    rates = source_rates(docs, weights, power, epochs, source, text).where("rate > 0")
    rates = (rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
             .withColumn("sums", running_sums(F.col("rate") / F.col("draws"))).checkpoint())
    if rates.count() <= BROADCAST_SOURCES:  # under 700 bytes a source
        rates = F.broadcast(rates)
    draws = F.transform(F.sequence(F.lit(0), F.col("draws") - 1), lambda j: uniform(F.lit(seed), F.col("_key"), F.col("_nth"), j))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(F.col("sums"), lambda c: c < u)))
    drawn = (numbered_rows(docs.drop("rate", "repeats", "replica", "place"))
             .join(rates, F.col(source).eqNullSafe(F.col("_source"))).withColumn("repeats", count).where("repeats > 0"))
    copies = drawn.withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    copies = copies.withColumn("place", hash52(F.lit(seed), F.lit("place"), F.col("_key"), F.col("_nth"), F.col("replica")))
    return (copies.drop("_source", "draws", "sums", "_key", "_nth").repartition("place").sortWithinPartitions("place"))
