"""Backup snapshot retention (W7): grandfather-father-son rotation.

Keep every snapshot of the last ``daily`` days, the newest of each 7-day
bucket up to ``weekly`` days, the newest of each calendar month up to
``monthly`` days, and nothing older.  Week buckets are the proleptic
ordinal day number divided by 7 (as Python's ``date.toordinal() // 7``).
The newest snapshot per bucket is a ``max_by`` aggregate joined back, so a
bucket with very many files is reduced map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Retention windows in days and the snapshot file pattern.
KEEP_DAILY_DAYS = 7
KEEP_WEEKLY_DAYS = 90
KEEP_MONTHLY_DAYS = 365
SNAPSHOT_PATTERN = r"^(.*)-(\d{8})-(\d{6})\.json$"


def snapshot_table(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """File names -> (path, prefix, snapshot_date, ts); others dropped."""
    name = F.substring_index(F.col(path_col), "/", -1)
    # one pattern test; the stamp has a fixed width at the end of the name
    ok = name.rlike(SNAPSHOT_PATTERN)
    n = F.length(name)
    day = F.substring(name, -20, 8)
    clock = F.substring(name, -11, 6)
    return paths.where(ok).select(
        F.col(path_col).alias("path"), name.substr(F.lit(1), n - 21).alias("prefix"),
        F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date").alias("snapshot_date"),
        F.try_to_timestamp(F.concat(day, clock), F.lit("yyyyMMddHHmmss")).alias("ts")).where(
        F.col("snapshot_date").isNotNull())


def snapshot_retention(snaps: DataFrame, today: str, daily: int = KEEP_DAILY_DAYS, weekly: int = KEEP_WEEKLY_DAYS,
                       monthly: int = KEEP_MONTHLY_DAYS) -> DataFrame:
    """Every snapshot with its tier, bucket and ``keep`` decision."""
    age = F.datediff(F.to_date(F.lit(today)), F.col("snapshot_date"))
    tier = (F.when(age <= daily, "daily").when(age <= weekly, "weekly").when(age <= monthly, "monthly")
            .otherwise("expired"))
    ordinal = F.datediff(F.col("snapshot_date"), F.to_date(F.lit("0001-01-01"))) + 1
    bucket = (F.when(F.col("tier") == "weekly", F.floor(ordinal / 7))
              .when(F.col("tier") == "monthly", F.year("snapshot_date") * 12 + F.month("snapshot_date")))
    s = snaps.withColumn("age_days", age).withColumn("tier", tier).withColumn("bucket", bucket.cast("long"))
    # daily and expired snapshots have no bucket and take no part in the join
    others = s.where(~F.col("tier").isin("weekly", "monthly")).withColumn("keep", F.col("tier") == "daily")
    s = s.where(F.col("tier").isin("weekly", "monthly"))
    newest = (s.groupBy("prefix", "tier", "bucket").agg(F.max(F.struct("ts", "path")).alias("_n"))
              .select("prefix", "tier", "bucket", F.col("_n.path").alias("_keep_path")))
    cols = ["path", "prefix", "snapshot_date", "age_days", "tier", "bucket", "keep"]
    j = s.join(newest, ["prefix", "tier", "bucket"], "left").withColumn("keep", F.col("path") == F.col("_keep_path"))
    return j.select(*cols).unionByName(others.select(*cols))
