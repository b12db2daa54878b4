"""Phrase collocation mining by stripes.

A stripe is a prefix (one word or two) with an associative counter of what
follows it; the end of a piece follows too (null).  Tasks count stripes of
``CHUNK`` words at a time with numpy and send them as rows (lang, prefix,
followers, counts); Spark shuffles them by prefix and merges them elementwise:

* pass 1, one-word prefixes: an entry is f(x y), a stripe's total f(x), the sum
  of all totals n.  Followers met fewer than ``min_count`` times are folded into
  one rest entry once they are merged;
* pass 2, two-word prefixes: an entry is f(x y z).  A phrase of three words can
  be frequent only if both its pairs are; windows with another pair are passed
  over.  Tasks know frequent pairs by a bit table of fixed size (``BITS``): a
  false hit costs a row, never a count.  The largest entry of a stripe is its
  subsumption maximum; a second maximum, by the last two words, comes from the
  same entries.

No stripe is gathered: a merge is a grouped sum over (prefix, follower).  The
stripes of frequent prefixes (at most ``HOT`` of them, found on a bounded sample
for words, exactly for pairs; the choice moves rows, not results) are dealt to
``SPLIT`` places by their followers, a row holds at most ``ROW`` entries, and a
task holds one chunk.

Defined results: null texts are empty, null languages ``und``; a text is read
whole (a very long one in several chunks); repeated rows count as often as they
come; ties are ordered by phrase in UTF-8 byte order; a language without a
frequent phrase, or an empty table, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path

#: Words that a task counts at a time; its numbers take about 150 bytes a word at the peak.
CHUNK = 2_000_000
ROW = 512
SPLIT = 64
HOT = 1_000
SAMPLE_ROWS = 2_000
BITS = 1 << 26

_BREAKS = bytes.maketrans(b",;:!?\n\v\f\r", b".........")
_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Numbers(dict):
    """Numbers of words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _tokens(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case, with ``.`` at every end of a piece."""
    return text.encode().lower().translate(_BREAKS).replace(b".", b" . ").split()


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _slots(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Place of a pair in the bit table, from the hashes of its words."""
    mixed = (first ^ (first >> np.uint64(31))) * _ODD1 + second * _ODD2
    return (mixed ^ (mixed >> np.uint64(29))) * _ODD1 >> np.uint64(64 - int(bits).bit_length() + 1)


def _stripes(ids: np.ndarray, words: list[bytes], lang: str, prefix: int, hot: frozenset, known: np.ndarray | None
             ) -> Iterator[pa.RecordBatch]:
    """Stripes of a chunk; number 0 is the end of a piece."""
    if prefix == 1:
        x, y = ids[:-1], ids[1:]
        keep = x != 0
        keys, last = x[keep].astype(np.uint64), y[keep].astype(np.uint64)
    else:
        x, y, z = ids[:-2], ids[1:-1], ids[2:]
        keep = np.flatnonzero((x != 0) & (y != 0) & (z != 0))
        h, bits = _hashes(words, lang), len(known) * 8
        pair = np.zeros(len(ids) - 1, dtype=bool)
        both = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
        at = _slots(h[ids[both]], h[ids[both + 1]], bits)
        pair[both] = (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        keep = keep[pair[keep] & pair[keep + 1]]
        keys = (x[keep].astype(np.uint64) << np.uint64(21)) | y[keep].astype(np.uint64)
        last = z[keep].astype(np.uint64)
    if not len(keys):
        return
    entries, counts = np.unique((keys << np.uint64(21)) | last, return_counts=True)
    keys, last = entries >> np.uint64(21), (entries & np.uint64((1 << 21) - 1)).astype(np.int64)
    place = np.zeros(len(keys), dtype=np.int32)
    if hot:
        number = {w: i for i, w in enumerate(words)}
        hot_keys = [number[p[0]] if prefix == 1 else (number[p[0]] << 21) | number[p[1]]
                    for at, *p in hot if at == lang and all(w in number for w in p)]
        mine = np.isin(keys, np.asarray(hot_keys, dtype=np.uint64))
        if mine.any():
            end = np.fromiter((xxhash.xxh3_64_intdigest(w) % SPLIT for w in words), dtype=np.int32, count=len(words))
            place[mine] = end[last[mine]]
            order = np.lexsort((place, keys))
            keys, last, counts, place = keys[order], last[order], counts[order], place[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (place[1:] != place[:-1]))
    begin = np.flatnonzero(new)
    within = np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys))))
    begin = np.flatnonzero(new | (within % ROW == 0))
    spelled = pa.array([None, *words[1:]], pa.binary()).cast(pa.string())
    for a in range(0, len(begin), 50_000):
        rows = begin[a:a + 50_000]
        end = begin[a + 50_000] if a + 50_000 < len(begin) else len(keys)
        offsets = pa.array(np.append(rows, end) - rows[0], pa.int32())
        part = slice(rows[0], end)
        first = [keys[rows]] if prefix == 1 else [keys[rows] >> np.uint64(21), keys[rows] & np.uint64((1 << 21) - 1)]
        cols = [pa.array([lang] * len(rows), pa.string()), *[spelled.take(pa.array(f.astype(np.int64))) for f in first],
                pa.array(place[rows], pa.int32()),
                pa.ListArray.from_arrays(offsets, spelled.take(pa.array(last[part]))),
                pa.ListArray.from_arrays(offsets, pa.array(counts[part], pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["lang", *"xy"[:prefix], "place", "followers", "counts"])


def stripes(docs: DataFrame, prefix: int, hot: frozenset = frozenset(), known=None, text: str = "text", lang: str = "lang",
            chunk: int = CHUNK) -> DataFrame:
    """Partial stripes (lang, prefix words, place, followers, counts) of all texts."""
    names = "xy"[:prefix]
    schema = "lang string, " + "".join(f"{c} string, " for c in names) + "place int, followers array<string>, counts array<long>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbers, list]] = {}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for at, (numbers, parts) in held.items():
                yield from _stripes(np.concatenate(parts), list(numbers), at, prefix, hot, known.value if known else None)
            held.clear()

        for b in batches:
            for t, at in zip(b.column(0), b.column(1)):
                t, at = t.as_py(), at.as_py()
                if not t:
                    continue
                numbers, parts = held.setdefault("und" if at is None else at, (_Numbers({b".": 0}), []))
                tokens = _tokens(t)
                while len(tokens) > chunk:  # a very long text goes in pieces that overlap by a prefix
                    own = _Numbers({b".": 0})
                    ids = np.fromiter(map(own.__getitem__, tokens[:chunk + prefix]), dtype=np.int64)
                    yield from _stripes(ids, list(own), "und" if at is None else at, prefix, hot, known.value if known else None)
                    tokens = tokens[chunk:]
                parts.append(np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int64, count=len(tokens)))
                parts.append(np.zeros(1, dtype=np.int64))
                size += len(tokens) + 1
                if size >= chunk:
                    yield from emit()
                    size = 0
        yield from emit()

    return docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).mapInArrow(count, schema)


def merged(parts: DataFrame, prefix: int) -> DataFrame:
    """Stripes merged elementwise: (lang, prefix words, place, follower, f)."""
    key = ["lang", *"xy"[:prefix], "place"]
    entry = F.explode(F.arrays_zip("followers", "counts")).alias("e")
    return (parts.repartition(*key).select(*key, entry)
            .groupBy(*key, F.col("e.followers").alias("follower")).agg(F.sum("e.counts").alias("f")))


def hot_words(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> frozenset:
    """Words that make up a thousandth or more of at most ``rows`` rows (whole texts): (lang, word)."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, int] = {}
            for t, at in zip(b.column(0), b.column(1)):
                for w in _tokens(t.as_py() or ""):
                    if w != b".":
                        k = (at.as_py() or "und", w.decode())
                        seen[k] = seen.get(k, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                                              pa.array(list(seen.values()), pa.int64())], ["lang", "x", "n"])

    sample = docs.select(F.col(text), F.col(lang).cast("string")).limit(rows)
    n = sample.mapInArrow(tally, "lang string, x string, n long").groupBy("lang", "x").agg(F.sum("n").alias("n"))
    top = n.withColumn("all", F.sum("n").over(Window.partitionBy())).where(F.col("n") * HOT >= F.col("all"))
    return frozenset((r["lang"], r["x"].encode()) for r in top.collect())


def pair_table(pairs: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bit table of pairs (lang, x, y), ``bits`` / 8 bytes whatever their number."""
    def place(batches: Iterator) -> Iterator:
        for b in batches:
            slots = []
            for at, g in b.groupby("lang", sort=False):
                slots.append(_slots(_hashes([w.encode() for w in g["x"]], at), _hashes([w.encode() for w in g["y"]], at), bits))
            b = b.iloc[:0][[]].reindex(range(sum(map(len, slots))))
            all_slots = np.concatenate(slots) if slots else np.empty(0, np.uint64)
            b["cell"], b["bit"] = (all_slots >> np.uint64(6)).astype(np.int64), (all_slots & np.uint64(63)).astype(np.int32)
            yield b

    cells = (pairs.select("lang", "x", "y").mapInPandas(place, "cell long, bit int")
             .select("cell", F.expr("shiftleft(1L, bit)").alias("v")).groupBy("cell").agg(F.bit_or("v").alias("v")))
    table = np.zeros(bits // 64, dtype=np.int64)
    got = cells.toArrow()  # at most bits / 64 rows, 16 bytes each; toPandas makes Python rows of them where Arrow is off
    table[got["cell"].to_numpy()] = got["v"].to_numpy()
    return table.view(np.uint8)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in decimals: exact up to counts of 10^15."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.floor(F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)).cast("long")


def _written(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def mine(docs: DataFrame, min_count: int = 10, subsume: int = 50, top: int = 2000, max_words: int = 3, text: str = "text",
         lang: str = "lang", bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_words`` (2 or 3) words that
    occur ``min_count`` times or more: lang, rank, phrase, a, l, r, n, score.
    A phrase inside a longer one of at least ``subsume`` % of its count is left
    out."""
    spark = docs.sparkSession
    rest = F.when(F.col("f") >= min_count, F.col("follower"))
    one = _written(merged(stripes(docs, 1, hot_words(docs, text, lang), None, text, lang, chunk), 1)
                   .groupBy("lang", "x", "place", rest.alias("y")).agg(F.sum("f").alias("f")), spark, "stripes-1")
    words = one.groupBy("lang", "x").agg(F.sum("f").alias("f"))  # combined map-side, a place of a word each
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = _written(words.where(F.col("f") >= min_count), spark, "words")
    pairs = one.where("y is not null").where(F.col("f") >= min_count).select("lang", "x", "y", F.col("f").alias("a"))

    def f_of(name: str, as_name: str) -> DataFrame:
        return frequent.select("lang", F.col("x").alias(name), F.col("f").alias(as_name))

    two = (pairs.join(f_of("x", "l"), ["lang", "x"]).join(f_of("y", "r"), ["lang", "y"])
           .select("lang", "x", "y", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score")))
    if max_words == 3:
        share = total.select("lang", "n")
        hot = pairs.join(F.broadcast(share), "lang").where(F.col("a") * HOT >= F.col("n")).select("lang", "x", "y").collect()
        hot = frozenset((r["lang"], r["x"].encode(), r["y"].encode()) for r in hot)  # at most HOT a language
        table = spark.sparkContext.broadcast(pair_table(pairs, bits))
        triples = merged(stripes(docs, 2, hot, table, text, lang, chunk), 2).where(F.col("f") >= min_count)
        triples = _written(triples.select("lang", "x", "y", F.col("follower").alias("z"), F.col("f").alias("a")), spark, "stripes-2")
        largest = (triples.select("lang", "x", "y", "a").unionByName(triples.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), "a"))
                   .groupBy("lang", "x", "y").agg(F.max("a").alias("longer")))
        two = (two.join(largest, ["lang", "x", "y"], "left")
               .where(F.col("longer").isNull() | (100 * F.col("longer") < subsume * F.col("a"))).drop("longer"))
        f_pair = pairs.withColumnRenamed("a", "f")
        three = (triples.join(f_pair.select("lang", "x", "y", F.col("f").alias("xy")), ["lang", "x", "y"])
                 .join(f_pair.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("f").alias("yz")), ["lang", "y", "z"])
                 .join(f_of("x", "fx"), ["lang", "x"]).join(f_of("z", "fz"), ["lang", "z"]))
        cut = F.array_min(F.array(*[F.struct(_score(F.col("a"), F.col(p), F.col(q)).alias("score"), F.lit(k).alias("k"),
                                             F.col(p).alias("l"), F.col(q).alias("r"))
                                    for k, p, q in ((1, "fx", "yz"), (2, "xy", "fz"))]))
        three = three.withColumn("cut", cut)
        found = (two.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", "l", "r", "score")
                 .unionByName(three.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")))
    else:
        found = two.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", "l", "r", "score")
    # Spark keeps the first rows of a language within a task before it shuffles
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
