"""Time conversions (C1-C3).  MJD 40587 is the Unix epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# MJD of 1970-01-01 and JD - MJD offset.
MJD_UNIX_EPOCH = 40587
JD_MJD_OFFSET = 2400000.5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mjd_to_timestamp(mjd) -> Column:
    """MJD -> UTC timestamp at millisecond precision."""
    ms = F.round((_c(mjd) - MJD_UNIX_EPOCH) * 86400000.0).cast("long")
    return F.timestamp_millis(ms)


def mjd_to_iso(mjd) -> Column:
    """MJD -> ``yyyy-MM-dd HH:mm:ss.SSS`` (UTC)."""
    return F.date_format(mjd_to_timestamp(mjd), "yyyy-MM-dd HH:mm:ss.SSS")


def jd_to_mjd(jd) -> Column:
    """C2."""
    return _c(jd) - JD_MJD_OFFSET


def timestamp_to_mjd(ts) -> Column:
    """Timestamp (or ISO string) -> MJD."""
    return F.unix_micros(_c(ts).cast("timestamp")) / 86400000000.0 + MJD_UNIX_EPOCH
