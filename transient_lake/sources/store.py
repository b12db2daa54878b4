"""Bucketed light-curve store.

Light curves are the largest table of the archive and every summary groups
them by object.  Written bucketed (and sorted) by ``obj_id``, the
per-object aggregates of ``operators.photometry`` read each bucket as one
partition and need no shuffle of the points; only the small per-group
results move.  Tables live under the shared checkpoint folder (or a path
the caller names) and are registered in the session catalog.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

DEFAULT_BUCKETS = 512


def write_lightcurves(lc: DataFrame, table: str, path: str | None = None, buckets: int | None = None) -> str:
    """Write M4 points bucketed by object, sorted by (obj_id, survey,
    filter, mjd); returns the table name."""
    spark = lc.sparkSession
    path = path or os.path.join(checkpoint_dir(spark), "tables", table)
    if buckets is None:
        buckets = max(DEFAULT_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a file a bucket, so a bucket is read in its sort order
    (lc.repartition(buckets, "obj_id").write.bucketBy(buckets, "obj_id").sortBy("obj_id", "survey", "filter", "mjd")
     .option("path", path).mode("overwrite").saveAsTable(table))
    return table


#: Session setting under which joins and aggregates reuse the ``obj_id`` bucketing even when their keys are
#: (obj_id, survey, filter); the whole summary then runs without any shuffle.  The caller's to set.
CO_PARTITION = ("spark.sql.requireAllClusterKeysForCoPartition", "false")
#: Session setting under which a bucket of one file is known to be sorted; the summary then needs no sort either.
SORTED = ("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


def read_lightcurves(spark: SparkSession, table: str) -> DataFrame:
    """The stored light curves (see ``CO_PARTITION``)."""
    return spark.table(table)
