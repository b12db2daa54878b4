"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables
(through the adapter views).  ``register`` records the function and,
when the operator is SQL-expressible, the oracle text with the adapter CTEs
it needs.  Timestamp columns are returned as ``timestamp_ntz`` so they
compare with DuckDB's naive TIMESTAMP.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _finish(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # instants are UTC throughout (naive parquet timestamps are UTC)
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _finish(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql, *views) if views else sql.strip()
        return fn
    return deco
