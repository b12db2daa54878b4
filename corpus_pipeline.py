"""Corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from transient_lake.llm import classifier, exact_dedup, mixing, packing, simhash
from transient_lake.llm.queries import table, tokenizer_path
from transient_lake.session import scratch_path

#: Rows of whole texts that a Python worker gets at a time; Spark's default of 10,000 holds some 100 MB of them twice.
TEXT_ROWS = 2_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a worker holds of the texts (a session setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    small_batches(spark)
    return classifier.resample(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts, the smallest id."""
    return exact_dedup.drop_copies(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the smallest id."""
    small_batches(spark)
    return simhash.one_of_each(docs, k=3, distance=3).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target shares of their sources, in global random order."""
    return mixing.poisson_mix(docs, power=0.5, epochs=1.0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in packed sequences."""
    small_batches(spark)
    return packing.digest(packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: The classifier, SimHash and the library tokeniser have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
