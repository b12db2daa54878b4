"""Token-id output: Re-Pair grammar compression with random access.

Documents are encoded, an end id appended, and written in ascending id order
as a Parquet data set of blocks.  A block holds the ids of consecutive
documents (about ``block_tokens`` of them, so memory is bounded) compressed by
its own grammar: frequent id pairs are replaced by nonterminals, again and
again, down to the number of occurrences at which a rule costs more bytes than
it saves (7 for 16-bit symbols), and while symbols still fit into 16 bits (wider
ones would double the body).  One round replaces many pairs
at once: of overlapping occurrences the one of the more frequent pair wins,
runs of one id are taken from the left, and a pair that lost too many of its
occurrences waits for the next round.

File format (one row per block; integers little-endian, unsigned):

* part, block: place in the order; part_start: ids of the part before it;
* first_id, last_id: the smallest and largest id, by which a reader skips blocks;
* doc_ids (array, null ids first), doc_lengths: 32 bits each, end id included;
* vocabulary: the first nonterminal's number;
* rules: for nonterminal ``vocabulary + i`` its two symbols, 32 bits each;
* rule_lengths: ids that nonterminal i expands to, 32 bits each;
* body: symbols of ``body_bytes`` (2 or 4) bytes; n_tokens: their ids.

Random access needs the running expansion lengths of the body only:
``read_slice`` expands the symbols that cover a slice and no others.

Defined results: null and empty texts hold the end id alone; repeated rows and
ids are written as often as they come; an empty table writes a data set
without rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokenize import encoder

SCHEMA = ("part int, block int, part_start long, n_docs int, first_id long, last_id long, doc_ids array<long>, doc_lengths binary, vocabulary int, "
          "rules binary, rule_lengths binary, body_bytes int, body binary, n_tokens long")
BLOCK_TOKENS = 2_000_000
#: Bytes of a rule in the file: two symbols and its length.
RULE_BYTES = 12
#: Occurrences from which pairs are replaced, step by step, before the least that pays.
STEPS = (64, 20)
#: A step is over when a round would replace less than 1 / TAIL of the symbols.
TAIL = 50
_NONE = np.iinfo(np.int32).max


def _pairs(seq: np.ndarray, bits: int) -> np.ndarray:
    kind = np.uint32 if bits == 16 else np.uint64
    return (seq[:-1].astype(kind) << kind(bits)) | seq[1:].astype(kind)


def _known_pairs(pairs: np.ndarray, by_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks) of the pairs that are among ``by_rank`` (best first).
    Looked up in a hash table with one pair a slot; of pairs that share a slot
    the best is found, the others wait for the next round."""
    kind, log = by_rank.dtype.type, max(8, int(len(by_rank) * 8).bit_length())
    odd, shift = (kind(0x9E3779B1), kind(32 - log)) if kind is np.uint32 else (kind(0x9E3779B97F4A7C15), kind(64 - log))
    slot = (by_rank[::-1] * odd) >> shift
    held, rank = np.zeros(1 << log, dtype=kind), np.full(1 << log, _NONE, dtype=np.int32)
    held[slot] = by_rank[::-1]  # of equal slots the last, the best, stays
    rank[slot] = np.arange(len(by_rank) - 1, -1, -1, dtype=np.int32)
    at = pairs * odd
    at >>= shift
    at = at.astype(np.intp)
    places = np.flatnonzero(np.take(held, at, mode="clip") == pairs)
    ranks = np.take(rank, at[places], mode="clip")
    real = ranks != _NONE  # an empty slot looks like the pair (0, 0)
    return (places, ranks) if real.all() else (places[real], ranks[real])


def _frequent(pairs: np.ndarray, min_count: int) -> np.ndarray:
    """Pairs that occur ``min_count`` times or more, the most frequent first."""
    ordered = np.sort(pairs)
    first = np.flatnonzero(ordered[1:] != ordered[:-1])
    first = np.concatenate([[0], first + 1])
    count = np.diff(first, append=len(ordered))
    frequent = count >= min_count
    known = ordered[first[frequent]]
    return known[np.argsort(-count[frequent], kind="stable")]


def _chosen(places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Which occurrences are replaced: those that no overlapping one beats by
    its rank; of a run of one id every second, from its left."""
    beside = places[1:] == places[:-1] + 1
    alike = beside & (ranks[1:] == ranks[:-1])
    out = np.ones(len(places), dtype=bool)
    out[1:] &= ~beside | (ranks[:-1] >= ranks[1:])
    out[:-1] &= ~beside | (ranks[:-1] <= ranks[1:])
    if alike.any():
        at = np.arange(len(places))
        run = np.maximum.accumulate(np.where(np.append(True, ~alike), at, 0))
        out &= (at - run) % 2 == 0
    return out


def compress(ids: np.ndarray, vocabulary: int, min_count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(body, rules) of a sequence of ids below ``vocabulary``; rules has two
    symbols a row.  Pairs are replaced down to ``min_count`` occurrences; by
    default down to where a rule costs more bytes than it saves, and while
    symbols fit into the bytes of the vocabulary's own."""
    seq, rules, next_symbol = ids.astype(np.uint32), [], vocabulary
    narrow = vocabulary < 1 << 16
    room = (1 << 16) - vocabulary if narrow and min_count is None else np.iinfo(np.int32).max
    least = RULE_BYTES // (2 if narrow else 4) + 1 if min_count is None else min_count
    steps = [c for c in STEPS if c > least and min_count is None] + [least]
    while len(seq) > 1 and room > 0:
        bits = 16 if next_symbol <= 1 << 16 else 32
        pairs = _pairs(seq, bits)
        by_rank = _frequent(pairs, steps[0])
        if not len(by_rank):
            if len(steps) == 1:
                break
            steps.pop(0)
            continue
        places, ranks = _known_pairs(pairs, by_rank)
        use = _chosen(places, ranks)
        where, ranks = places[use], ranks[use]
        kept = np.bincount(ranks, minlength=len(by_rank)) >= max(2, steps[0] // 2)
        if len(steps) > 1 and np.count_nonzero(kept[ranks]) * TAIL < len(seq):
            steps.pop(0)  # the next threshold has more to replace, these among them
            continue
        if not kept.any():  # overlaps left too few uses of each: the best pair goes alone
            by_rank = by_rank[:1]
            where = places[_alone(places, pairs, by_rank[0])]
            ranks, kept = np.zeros(len(where), dtype=np.int32), np.ones(1, dtype=bool)
            if len(where) < 2:
                break
        kept &= np.cumsum(kept) <= room
        where, ranks = where[kept[ranks]], ranks[kept[ranks]]
        symbol = next_symbol + np.cumsum(kept) - 1  # by rank
        pair = by_rank[kept].astype(np.uint64)
        rules.append(np.column_stack([pair >> np.uint64(bits), pair & np.uint64((1 << bits) - 1)]).astype(np.uint32))
        next_symbol += int(kept.sum())
        room -= int(kept.sum())
        seq[where] = symbol[ranks]
        stays = np.ones(len(seq), dtype=bool)
        stays[where + 1] = False
        seq = seq[stays]
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), dtype=np.uint32)


def _alone(places: np.ndarray, pairs: np.ndarray, pair: np.generic) -> np.ndarray:
    """Indexes into ``places`` of the occurrences of one pair that do not overlap."""
    own = np.flatnonzero(pairs[places] == pair)
    return own[_chosen(places[own], np.zeros(len(own), dtype=np.int32))]


def rule_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids that each nonterminal expands to."""
    out = np.zeros(len(rules), dtype=np.int64)
    waiting = np.arange(len(rules))
    while len(waiting):  # rules of one round refer to earlier rounds only
        sub = rules[waiting].astype(np.int64) - vocabulary
        n = np.where(sub < 0, 1, out[np.maximum(sub, 0)])
        ready = (n > 0).all(axis=1)
        out[waiting[ready]] = n[ready].sum(axis=1)
        waiting = waiting[~ready]
    return out


class Grammar:
    """Expansion of the symbols of one block."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, vocabulary: int):
        self.size = np.concatenate([np.ones(vocabulary, dtype=np.int64), lengths.astype(np.int64)])
        self.start = np.cumsum(self.size) - self.size
        whole = np.arange(vocabulary + len(rules), dtype=np.uint32)  # every symbol, its nonterminals replaced until none is left
        while (deep := whole >= vocabulary).any():
            ends = np.cumsum(deep + 1)
            out = np.empty(ends[-1], dtype=np.uint32)
            out[ends[~deep] - 1] = whole[~deep]
            out[ends[deep] - 2], out[ends[deep] - 1] = rules[whole[deep] - vocabulary].T
            whole = out
        self.ids = whole

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a run of symbols."""
        size = self.size[symbols]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[symbols] - (ends - size), size) + np.arange(total)]


def slice_ids(body: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int, start: int, length: int) -> np.ndarray:
    """Ids ``start`` to ``start + length`` of a body, expanding only the symbols over them."""
    size = np.ones(len(body), dtype=np.int64)
    deep = body >= vocabulary
    size[deep] = lengths[body[deep] - vocabulary]
    ends = np.cumsum(size)
    a = int(np.searchsorted(ends, start, "right"))
    b = int(np.searchsorted(ends, start + length - 1, "right")) + 1 if length > 0 else a
    skip = start - (int(ends[a - 1]) if a else 0)
    part = body[a:b].astype(np.uint32)
    while (deep := part >= vocabulary).any():
        at = np.cumsum(deep + 1)
        out = np.empty(at[-1], dtype=np.uint32)
        out[at[~deep] - 1] = part[~deep]
        out[at[deep] - 2], out[at[deep] - 1] = rules[part[deep] - vocabulary].T
        part = out
    return part[skip:skip + length]


def _row(part: int, block: int, part_start: int, ids: list, texts: list[bytes], vocabulary: int, min_count: int | None) -> tuple:
    flat = np.frombuffer(b"".join(texts), dtype="<u4")
    body, rules = compress(flat, vocabulary, min_count)
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 4
    known = [i for i in ids if i is not None]
    return (part, block, part_start, len(ids), min(known, default=None), max(known, default=None), ids, np.asarray([len(t) // 4 for t in texts], dtype="<u4").tobytes(),
            vocabulary, rules.astype("<u4").tobytes(), rule_lengths(rules, vocabulary).astype("<u4").tobytes(), width,
            body.astype(f"<u{width}").tobytes(), len(flat))


_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(),
          pa.binary(), pa.int32(), pa.binary(), pa.int64())
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
              block_tokens: int = BLOCK_TOKENS, min_count: int | None = None) -> None:
    """Encode all documents in ascending id order and write them to ``path``."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(tokenizer), TaskContext.get().partitionId()
        vocabulary = max(e.tok.get_vocab_size(with_added_tokens=True), end_id + 1)
        ids, texts, size, block, start = [], [], 0, 0, 0

        def emit() -> pa.RecordBatch:
            row = _row(part, block, start, ids, texts, vocabulary, min_count)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], _NAMES)

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(d)
                texts.append(e.encode(t) + end)
                size += len(texts[-1]) // 4
                if size >= block_tokens:
                    yield emit()
                    block, start = block + 1, start + size
                    ids, texts, size = [], [], 0
        if ids:
            yield emit()

    by = F.col(doc_id).cast("long")
    (docs.select(by.alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id")
     .sortWithinPartitions("doc_id").mapInArrow(blocks, SCHEMA)
     .write.option("compression", "zstd").parquet(path))


def _block(row: dict) -> tuple[np.ndarray, Grammar, np.ndarray]:
    rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
    grammar = Grammar(rules, np.frombuffer(row["rule_lengths"], dtype="<u4"), row["vocabulary"])
    return (np.frombuffer(row["body"], dtype=f"<u{row['body_bytes']}"), grammar,
            np.frombuffer(row["doc_lengths"], dtype="<u4").astype(np.int64))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents
    before it), n_tokens and ids (binary)."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    # ids before each part: as many rows as the data set has files with rows
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = "doc_id long, start long, n_tokens long, ids binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                body, grammar, lengths = _block(row)
                ids = grammar.expand(body)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                flat = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"] + row["part_start"], pa.int64()),
                     pa.array(lengths, pa.int64()),
                     pa.array([flat[4 * s:4 * t] for s, t in zip(starts.tolist(), ends.tolist())], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return stored.join(F.broadcast(base) if _few(parts) else base, "part").mapInArrow(decode, out)


def _few(parts: DataFrame, most: int = 1_000_000) -> bool:
    return parts.limit(most + 1).count() <= most


def read_slice(spark: SparkSession, path: str, doc_id: int, start: int = 0, length: int | None = None) -> list[int]:
    """Ids of part of one document (the first of that id; none for an unknown
    id).  Blocks are skipped by their id ranges, and of the block found only
    the symbols over the slice are expanded."""
    rows = (spark.read.schema(SCHEMA).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
            .where(F.array_contains("doc_ids", doc_id)).orderBy("part", "block").limit(1).collect())
    if not rows:
        return []
    row = rows[0].asDict()
    lengths = np.frombuffer(row["doc_lengths"], dtype="<u4").astype(np.int64)
    at = row["doc_ids"].index(doc_id)
    n = int(lengths[at])
    start, stop = min(start, n), n if length is None else min(start + length, n)
    return slice_ids(np.frombuffer(row["body"], dtype=f"<u{row['body_bytes']}"), np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2),
                     np.frombuffer(row["rule_lengths"], dtype="<u4").astype(np.int64), row["vocabulary"],
                     int(lengths[:at].sum()) + start, max(0, stop - start)).tolist()
