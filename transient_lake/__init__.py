"""Transient Lake: a Spark-native archive for astronomical transients.

Every public operator takes and returns DataFrames built from Spark's own
functions.  Sub-packages:

* ``functions``  - column -> column helpers (time, sky coordinates, text)
* ``sources``    - readers, sinks and the test-data adapter views
* ``operators``  - joins, aggregations and window operators of the archive
* ``streaming``  - Structured Streaming forms of the cross-match and ingest
* ``plans``      - named end-to-end queries plus their DuckDB oracle SQL
"""

from .session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
