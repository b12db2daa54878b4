"""Exact dedup: 128-bit content hash groups with their bytes compared.

Texts are equal when their normalised bytes are equal.  Rows are grouped by
the 128-bit hash of the normalised text *and* the text itself: the aggregate
hashes on both and compares the bytes of rows that meet, so two texts with one
hash never share a group.  It combines within a task before the shuffle, so a
group of any size sends one row per task and each distinct text moves once.
A class is then named by (128-bit hash, SHA-256); the name is checked to be
unique, so rows find their class by name and no text moves again.

Defined results: null counts as empty; ties between rows with the same id and
text are one id (each row is returned, each marked like its id); an empty
table gives no rows; columns of the input that clash with the new ones are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty; A-Z in lower case, nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def content_hash(text: Column) -> Column:
    """128-bit hash of a text."""
    return F.md5(text)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest",
                 hash128=content_hash) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256.  ``keep``:
    the smallest or the largest id of equal texts stays."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    key = normalised(F.col(text))
    slim = docs.select(F.col(doc_id).alias("_id"), hash128(key).alias("_h"), key.alias("_t"))
    classes = (slim.groupBy("_h", "_t").agg(pick("_id").alias("keep_id"), F.count("*").alias("group_size"))
               .select("_h", F.sha2(F.col("_t"), 256).alias("_s"), "keep_id", "group_size"))
    named = (classes.groupBy("_h", "_s").agg(
        F.count("*").alias("_n"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
        .withColumn("group_size", F.when(F.col("_n") == 1, F.col("group_size"))
                    .otherwise(F.raise_error(F.lit("two texts share both hashes")).cast("long"))))
    rows = (docs.drop("keep_id", "group_size", "kept", "text_sha256")
            .withColumns({"_h": hash128(key), "text_sha256": F.sha2(key, 256)}))
    return (rows.join(named.select("_h", F.col("_s").alias("text_sha256"), "keep_id", "group_size"),
                      ["_h", "text_sha256"])
            .withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id"))).drop("_h"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``.  Of
    repeated rows of the id that stays, the one with the smallest hash of all
    its columns."""
    key = normalised(F.col(text))
    stays = exact_groups(docs, doc_id, text, keep).where("kept")
    one = Window.partitionBy(content_hash(key), "text_sha256").orderBy(F.xxhash64(*[F.col(c) for c in docs.columns]))
    return stays.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select(*docs.columns)
