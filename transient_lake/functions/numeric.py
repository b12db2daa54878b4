"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(col, p: int) -> Column:
    """Round to ``p`` decimals, half away from zero, on the binary
    product ``x * 10**p`` - the archive's ``precision()`` rule.  Spark's
    ``round(x, p)`` instead rounds the shortest decimal form of ``x``, which
    differs when the product lands just below a tie (36.855 -> 36.85 here,
    36.86 there).  NULL stays NULL, zero has no sign.  The product is rounded
    as a binary number, not by way of its decimal text (Spark's ``round``),
    which takes longer than the distances that are rounded."""
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** p)
    x = c.cast("double") * scale
    even = F.rint(F.abs(x))
    away = even + (F.abs(x) - even == 0.5).cast("double")  # a tie that went down to the even number
    return (F.signum(x) * away + 0.0) / scale
