"""Text helpers.

``py_format(spec)`` formats doubles exactly as Python's ``format(x, spec)``
(rounding of the exact binary value, ties to even), which Spark's
``format_string`` cannot reproduce: Java rounds the shortest decimal form
half-up (14.35 -> "14.4" in Java, "14.3" in Python).  It is an Arrow-batched
pandas UDF, used only for display strings.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=None)
def _formatter(spec: str):
    @F.pandas_udf(T.StringType())
    def fmt(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or pd.isna(v) else format(float(v), spec))
    return fmt


def py_format(col, spec: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return _formatter(spec)(c.cast("double"))
