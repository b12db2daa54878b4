"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits; two link at ``distance`` or fewer differing bits.
The 64 bits are seen as two halves: a link has at most ``distance // 2``
differing bits in one of them, which is that half's threshold.  The anchors of
a half are the words of a covering code of length 32: the perfect Hamming code
[31, 26] of covering radius 1 on its lower 31 bits beside its top bit as it
is.  Every fingerprint goes to its own anchor (the code word within the radius)
and to every anchor within radius plus threshold - about 17 of 2^27 a half for
a threshold of 1.  Two linked fingerprints meet at the own anchor of each,
where all 64 bits are compared.

Copies of one fingerprint are one class from the start, so a group of copies
of any size is one point.  Within an anchor only links that join what is not
yet joined there are kept (a spanning forest), never all pairs of a group.
Anchors with over ``CROWD`` fingerprints are compared exactly in pairs of
blocks, one task's memory holding two blocks.  The forests of all anchors give
the components.

Defined results: lower case A-Z; words are runs of other than ASCII white
space; shingles of ``k`` words with repeats, the whole sequence if there are
fewer words; null, empty and wordless texts have fingerprint zero, linked like
any other; a fingerprint bit is 1 if set in over half of the shingle hashes.
The component id is the smallest id reachable (rows without an id do not name
a component).  An empty table gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_components
from ..session import checkpoint_dir, scratch_path
from .tokenize import hold

#: Fingerprints of an anchor that are compared at once.
CROWD = 20_000
SEED = 42
#: The five parity checks of the Hamming code: bit i - 1 is in check c if bit c of i is set.
_CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> c & 1) for c in range(5)]
_CHUNK = 1 << 17


def fingerprint(text: str | None, k: int = 3) -> int:
    """SimHash of one text as an unsigned 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(k))) if len(words) >= k else [words]
    total, n, chunk = np.zeros(64, dtype=np.int64), 0, []

    def add() -> int:
        bits = np.unpackbits(np.frombuffer(b"".join(chunk), dtype=np.uint8).reshape(-1, 8), axis=1)
        total.__iadd__(bits.sum(axis=0, dtype=np.int64))
        return len(bits)

    for s in shingles:
        chunk.append(xxhash.xxh64_digest(b" ".join(s), SEED))
        if len(chunk) == _CHUNK:
            n += add()
            chunk.clear()
    if chunk:
        n += add()
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3, text: str = "text") -> Column:
    """Column of signed 64-bit fingerprints of ``text``."""
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold("simhash", object)
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, k) for t in texts], dtype=np.uint64).view(np.int64))

    return simhash(F.col(text))


def at_anchors(points: DataFrame, threshold: int, fp: str = "fp") -> DataFrame:
    """A row for each fingerprint and anchor within radius plus ``threshold``
    (0 or 1): half, anchor, fp, own (its own anchor of that half)."""
    if threshold not in (0, 1):
        raise ValueError("halves take a threshold of 0 or 1: a distance of 0 to 3")
    halves = points.select(F.col(fp).alias("fp"), F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)).alias("w")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned(F.col(fp), 32).alias("w")))).alias("h")).select(
            "fp", "h.half", "h.w")
    s = halves.withColumn("s", F.expr(" + ".join(f"shiftleft(bit_count(w & {m}L) % 2, {c})" for c, m in enumerate(_CHECKS))))
    s = s.withColumn("home", F.expr("w ^ if(s > 0, shiftleft(1L, s - 1), 0L)"))
    if threshold == 0:
        return s.select("half", F.col("home").alias("anchor"), "fp", F.lit(True).alias("own"))
    # code words two flips away: the pairs i < j with i xor j = s; and the own anchor with the top bit flipped
    pairs = F.expr("transform(filter(sequence(1, 31), i -> (i ^ s) > i), "
                   "i -> w ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))")
    own = F.struct(F.col("home").alias("a"), F.lit(True).alias("own"))
    top = F.struct(F.col("home").bitwiseXOR(F.lit(1 << 31)).alias("a"), F.lit(False).alias("own"))
    far = F.transform(pairs, lambda a: F.struct(a.alias("a"), F.lit(False).alias("own")))
    rows = s.withColumn("x", F.explode(F.concat(F.array(own, top), far)))
    return rows.select("half", F.col("x.a").alias("anchor"), "fp", "x.own")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _forest(fp: np.ndarray, own: np.ndarray, block: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one anchor, as positions: each own
    fingerprint against all, one row at a time, links between joined ones left out."""
    label = np.arange(len(fp))
    cross = block.max() > block.min() if len(block) else False
    out = []
    for i in np.flatnonzero(own):
        near = _distance(fp, fp[i]) <= distance
        if cross:
            near &= block != block[i]  # within a block they are compared in that block's own group
            near[i] = True
        met = label[near]
        least = met.min()
        if met.max() == least:
            continue
        for other in np.unique(met):
            if other != label[i]:
                j = np.flatnonzero(near & (label == other))[0]
                out.append((i, j))
        label[np.isin(label, met)] = least
    return out


def _links(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Forests of the anchors of one task; rows come sorted by key, an anchor
    may run over several batches."""
    keys = ["half", "anchor", "first", "second"]
    held: list[pd.DataFrame] = []

    def compare(rows: pd.DataFrame) -> pd.DataFrame | None:
        change = np.ones(len(rows), dtype=bool)
        k = rows[keys].to_numpy()
        change[1:] = (k[1:] != k[:-1]).any(axis=1)
        start = np.flatnonzero(change)
        size = np.diff(np.append(start, len(rows)))
        fp, own, block = rows["fp"].to_numpy().view(np.uint64), rows["own"].to_numpy(), rows["block"].to_numpy()
        a, b = [], []
        two = start[size == 2]  # most anchors with company have two
        near = (_distance(fp[two], fp[two + 1]) <= distance) & (own[two] | own[two + 1])
        near &= (rows["first"].to_numpy()[two] == rows["second"].to_numpy()[two]) | (block[two] != block[two + 1])
        a.append(two[near])
        b.append(two[near] + 1)
        for at, n in zip(start[size > 2], size[size > 2]):
            s = slice(at, at + n)
            if own[s].any():
                links = np.array(_forest(fp[s], own[s], block[s], distance), dtype=np.int64).reshape(-1, 2) + at
                a.append(links[:, 0])
                b.append(links[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)}) if len(a) else None

    for batch in batches:
        if not len(batch):
            continue
        last = batch[keys].iloc[-1]
        tail = int((batch[keys] == last).all(axis=1).to_numpy()[::-1].argmin()) or len(batch)
        if tail == len(batch) and (not held or (held[-1][keys].iloc[-1] == last).all()):
            held.append(batch)
            continue
        cut = len(batch) - tail
        if tail == len(batch):  # a new anchor begins with this batch
            ready, held = held, [batch]
        else:
            ready, held = [*held, batch.iloc[:cut]], [batch.iloc[cut:]]
        found = compare(pd.concat(ready, ignore_index=True))
        if found is not None:
            yield found
    if held:
        found = compare(pd.concat(held, ignore_index=True))
        if found is not None:
            yield found


def links(points: DataFrame, distance: int = 3, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that span every group
    of fingerprints linked within ``distance``."""
    placed = at_anchors(points, distance // 2)
    key = ["half", "anchor"]
    # anchors without company or without an own fingerprint give no link; counts combine map-side
    n = placed.groupBy(*key).agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 and owned").drop("owned")
    # Spark sizes both sides like the points, before each became some 34 rows, and would broadcast them
    met = placed.hint("merge").join(n, key)
    blocks = F.ceil(F.col("n") / crowd).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    with_block = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = met.withColumn("other", F.explode(with_block)).select(
        *key, F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "fp", "own", "block")
    sort = [*key, "first", "second"]
    # dealt by the whole key: a crowded anchor is many keys
    return (dealt.repartition(*[F.col(c) for c in sort]).sortWithinPartitions(*sort, "fp")
            .mapInPandas(lambda it: _links(it, distance), "a long, b long").distinct())


def _grouped(docs: DataFrame, k: int, distance: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc id, fp) of every row, and (fp, label, component_id) of every fingerprint."""
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    docs.select(F.col(doc_id), fingerprints(docs, k, text).alias("fp")).write.parquet(path)
    rows = spark.read.parquet(path)
    return rows, _named(rows, distance, doc_id)


def _named(rows: DataFrame, distance: int, doc_id: str) -> DataFrame:
    """(fp, label, component_id) of every fingerprint of ``rows`` (doc id, fp)."""
    checkpoint_dir(rows.sparkSession)
    points = rows.groupBy("fp").agg(F.min(doc_id).alias("least")).checkpoint()  # copies are one point
    comp = star_components(links(points, distance), "a", "b")
    named = points.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return named.select("fp", "label").join(ids, "label")


def near_groups(docs: DataFrame, k: int = 3, distance: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc id, fp, component_id) of every row."""
    rows, by_point = _grouped(docs, k, distance, doc_id, text)
    return rows.join(by_point, "fp").select(doc_id, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, k: int = 3, distance: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the columns of ``docs``: the one with
    the smallest id (of repeated ids the row with the smallest hash of all its
    columns, of wholly equal rows any one).  A group of rows without ids keeps
    one of them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "rows")
    columns = [F.col(c) for c in docs.columns]
    # 128 bits of the whole row; the hash passes over nulls, so the second half holds their places too
    hashes = {"_row": F.xxhash64(*columns), "_row2": F.xxhash64(F.lit(1), *[c.isNull() for c in columns], *columns)}
    docs.select(F.col(doc_id).alias("_id"), *[h.alias(n) for n, h in hashes.items()],
                fingerprints(docs, k, text).alias("fp")).write.parquet(path)
    rows = spark.read.parquet(path)
    # one row a group, picked map-side; rows with an id before those without
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", *hashes))
    stays = rows.join(_named(rows, distance, "_id"), "fp").groupBy("label").agg(first.alias("s")).select("s._row", "s._row2")
    return docs.withColumns(hashes).join(stays, [*hashes], "left_semi").dropDuplicates([*hashes]).select(*docs.columns)
