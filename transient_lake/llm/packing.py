"""Best-fit packing by large-item matching, planned on the length histogram.

Pieces of at most ``capacity`` tokens are packed into as few sequences as the
method finds.  Lengths are integers up to the capacity, so the whole plan is
made from the number of pieces of each length (at most ``capacity`` numbers,
whatever the corpus):

1. pieces above a third of the capacity fit at most twice into a sequence;
   from the longest down, each is paired with the longest one that still fits;
2. smaller pieces, longest first, go into the smallest gap that holds them,
   and open a new sequence where none does.

The plan is a short list of runs: so many alike sequences, this length at this
offset.  The k-th piece of a length takes the k-th place of that length; k is
the piece's number within its task plus the pieces of that length in earlier
tasks, so nothing is sorted or gathered, and a length that a third of all
pieces share is no hot key.  The pieces are written once to the shared folder,
which also fixes their numbers when an executor is lost.

Defined results: a null or empty text is one piece with the end id alone;
repeated rows and ids are packed as rows of their own; a longer document is
cut from its end into full pieces, so its first piece may be shorter; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .tokenize import encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"
#: Rows of the table of numbers per task and length that may be broadcast (about 24 bytes each).
BROADCAST_ROWS = 1_000_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """Token ids of every document with ``end_id`` behind them, cut into
    pieces; ``nth`` numbers the pieces of a length within their task."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    full = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(tokenizer), TaskContext.get().partitionId()
        met = [0] * (capacity + 1)
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = e.encode(t) + end
                at, k, first = 0, 0, len(ids) % full or full
                while at < len(ids):
                    to = at + (full if k else first)
                    n = (to - at) // 4
                    rows.append((d, k, at // 4, n, ids[at:to], part, met[n]))
                    met[n] += 1
                    at, k = to, k + 1
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, how many, first sequence, offset) for so
    many pieces of each length: piece number ``first + r`` of that length goes
    to sequence ``first sequence + r`` at ``offset``."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    groups: dict[int, list] = {}  # gap -> [(alike sequences, their runs (length, first number, offset))]
    done: list = []

    def place(length: int, sequences: int, each: int, offset: int) -> list:
        first = used[length]
        used[length] += sequences * each
        left[length] -= sequences * each
        return [(length, first + j * sequences, offset + j * length) for j in range(each)]

    def put(gap: int, sequences: int, runs: list) -> None:
        (groups.setdefault(gap, []) if gap else done).append((sequences, runs))

    def later(runs: list, by: int) -> list:
        return [(length, first + by, offset) for length, first, offset in runs]

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and left[x] > (x == a)), None)
            if b is None:
                n = left[a]
                put(capacity - a, n, place(a, n, 1, 0))
            elif b == a:
                n = left[a] // 2
                put(capacity - 2 * a, n, place(a, n, 2, 0))
            else:
                n = min(left[a], left[b])
                put(capacity - a - b, n, place(a, n, 1, 0) + place(b, n, 1, a))

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            gap = min((g for g in groups if g >= length), default=None)
            if gap is None:
                gap, runs, n = capacity, [], -(-left[length] // (capacity // length))
            else:
                n, runs = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap]
            each = gap // length  # the smallest gap stays the smallest until it is shorter than the piece
            whole = min(n, left[length] // each)
            offset = capacity - gap
            if whole:
                put(gap - each * length, whole, runs + place(length, whole, each, offset))
            if whole < n and left[length]:
                rest = left[length]
                put(gap - rest * length, 1, later(runs, whole) + place(length, 1, rest, offset))
                whole += 1
            if whole < n:
                put(gap, n - whole, later(runs, whole))
    out, sequence = [], 0
    for n, runs in [*done, *(g for gap in sorted(groups) for g in groups[gap])]:
        out += [(length, first, n, sequence, offset) for length, first, offset in runs]
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length,
    ids (binary), sequence_id, offset."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    pieces(docs, tokenizer, end_id, capacity, doc_id, text).write.option("compression", "zstd").parquet(path)
    cut = spark.read.schema(PIECE_SCHEMA).parquet(path)

    per_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if cut.select("part").distinct().count() * len(total) <= BROADCAST_ROWS:
        base = F.broadcast(base)

    runs = np.asarray(sorted(plan(total, capacity)), dtype=np.int64).reshape(-1, 5)
    runs = spark.sparkContext.broadcast(runs)  # at most a few runs for each length, whatever the corpus

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        r, n, k = runs.value, length.to_numpy(), number.to_numpy()
        span = int(r[:, 1].max()) + 1 if len(r) else 1  # one sorted key for (length, first number)
        at = np.searchsorted(r[:, 0] * span + r[:, 1], n.astype(np.int64) * span + np.minimum(k, span - 1), "right") - 1
        return pd.DataFrame({"sequence_id": r[at, 3] + k - r[at, 1], "offset": r[at, 4]})

    placed = cut.join(base, ["part", "length"]).withColumn("at", place("length", F.col("base") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids",
                         "at.sequence_id", "at.offset")


def digest(packed: DataFrame) -> DataFrame:
    """The packed pieces with ids_crc32 in place of their ids."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
