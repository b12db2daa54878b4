"""Written tables and running totals for groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, key: str, order: list[Column], name: str, xor: tuple[str, ...] = (),
            drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns ``drop``, with ``nth`` (place of a row in its ``key`` group by ``order``,
    from 0) and, in place of the long columns ``xor``, their running XOR, the
    row itself included.

    Rows are dealt by ranges of (key, order), so a group may span many tasks;
    each task counts its own rows, and the few groups at the edges of tasks
    (two at most for a task) get the totals of the tasks before theirs."""
    ranged = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).drop(*drop)
    schema = StructType([*ranged.schema.fields, StructField("nth", LongType()), StructField("part", IntegerType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, count, held = TaskContext.get().partitionId(), None, 0, [0] * len(xor)
        for b in batches:
            if not len(b):
                continue
            k = b[key].to_numpy()
            begin = np.append(k[0] != last, k[1:] != k[:-1])
            first = np.flatnonzero(begin)
            at = np.arange(len(b))
            start = np.maximum.accumulate(np.where(begin, at, -1))
            b["nth"] = np.where(start < 0, at + count, at - start)
            for j, c in enumerate(xor):
                v = b[c].to_numpy()
                total = np.bitwise_xor.accumulate(v)
                before = np.where(start > 0, total[np.maximum(start - 1, 0)], 0)  # of the earlier groups
                b[c] = np.where(start < 0, total ^ held[j], total ^ before)
                held[j] = int(b[c].iloc[-1])
            last, count = k[-1], int(b["nth"].iloc[-1]) + 1
            b["part"] = np.int32(part)
            yield b

    out = written(ranged.mapInPandas(scan, schema), name)
    edges = out.groupBy("part").agg(F.min(key).alias("a"), F.max(key).alias("b"))  # a row a task
    edges = edges.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    # the last row of a group in a task holds the task's totals
    ends = (out.join(F.broadcast(edges), key).groupBy(key, "part")
            .agg(F.max(F.struct("nth", *xor)).alias("end")))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select(key, "part", F.sum(F.col("end.nth") + 1).over(before).alias("_n"),
                       *[F.bit_xor(f"end.{c}").over(before).alias(f"_{c}") for c in xor]).where("_n > 0")
    moved = out.join(F.broadcast(base), [key, "part"], "left")
    return moved.withColumns({"nth": F.col("nth") + F.coalesce("_n", F.lit(0)),
                              **{c: F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))) for c in xor}}).select(
        *ranged.columns, "nth")
