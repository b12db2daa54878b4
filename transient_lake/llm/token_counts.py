"""Token counts: a map-side two-tier lookup, no pre-token shuffle.

Tier one is a compact table of frequent pre-token lengths that Spark
broadcasts: at most ``FREQUENT`` pre-tokens of at most ``LONGEST`` bytes each
(so under 5 MB), taken from a bounded sample of rows.  Tier two is a cache in
every Python worker for what the table lacks; misses of both are encoded by
the library.  The table only saves work: counts are exact whatever it holds.

Defined results: null and empty texts have 0 tokens; very long texts are
counted whole; repeated rows and repeated ids give a row each; extra columns
pass through (clashing names of the new columns are replaced); an empty table
gives no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenize import _RUNS, PieceEncoder, RecentCache, byte_pieces, encoder, hold, is_short

FREQUENT = 65_536
LONGEST = 64
SAMPLE_ROWS = 2_000


class CountEncoder:
    """Number of ids of a text: the broadcast lengths, then the worker's own,
    then the library."""

    def __init__(self, path: str, frequent: dict[bytes, int]):
        self.ids = PieceEncoder(path)
        self.frequent = frequent
        self.own = RecentCache()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        e = self.ids
        if e.by_word:
            return sum(self._known(e.word_pieces(text)))
        if e.at_special is not None and e.at_special.search(text):
            parts = e.at_special.split(text)
            return sum(1 if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings; runs of white space are
        cut out, the words between them go through the table."""
        if not _RUNS.search(text):
            return self._single_spaced(text)
        parts = _RUNS.split(text)  # words, run, words, run, ..., words
        n = self._single_spaced(parts[0])
        for run, words in zip(parts[1::2], parts[2::2]):
            n += self._run(run[:-1] if words else run)
            if words:
                n += self._single_spaced(run[-1] + words)
        return n

    def _run(self, run: str) -> int:
        key = b"\n\n" + run.encode()  # no piece has two line feeds
        got = self.own.find(key)
        if got is None:
            got = len(self.ids.tok.encode(run, add_special_tokens=False).ids)
            if is_short(key):
                self.own.put(key, got)
        return got

    def _single_spaced(self, text: str) -> int:
        if len(text) < 2 or "\x01" in text:
            return self._run(text) if text else 0
        return sum(self._known(byte_pieces(text))) - 1  # without the added line feed

    def _known(self, pieces: list[bytes]) -> list[int]:
        got = list(map(self.frequent.get, pieces))
        if None in got:
            missed = [p for p, v in zip(pieces, got) if v is None]
            own = self.own.all(missed, self._make, is_short)
            return [v for v in got if v is not None] + own
        return got

    def _make(self, piece: bytes) -> int:
        return len(self.ids.ids_of(piece)) // 4


def frequent_lengths(docs: DataFrame, tokenizer: str, text: str = "text", rows: int = SAMPLE_ROWS,
                     fraction: float = 0.1, seed: int = 7) -> tuple[str, bytes, np.ndarray, np.ndarray]:
    """Frequent pre-tokens of a sample: (a name of the table, all keys in one
    string, their sizes, their token counts).  A task stops after ``rows`` sampled rows and sends
    its ``FREQUENT`` most frequent pre-tokens; only first tasks run."""
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, left = Counter(), rows
        e = encoder(tokenizer)
        for b in batches:
            for t in b["t"].iloc[:left]:
                if t and e.by_word:
                    seen.update(e.word_pieces(t))
                elif t:
                    parts = _RUNS.split(t)
                    seen.update(byte_pieces(parts[0]) if "\x01" not in t else [])
                    for run, words in zip(parts[1::2], parts[2::2]):
                        if words and "\x01" not in t:
                            seen.update(byte_pieces(run[-1] + words))
            left -= len(b)
            if left <= 0:
                break
        top = [(k, n) for k, n in seen.most_common(FREQUENT) if len(k) <= LONGEST]
        sizes = [len(x.ids) for x in e.tok.encode_batch_fast([e._text(k) for k, _ in top], add_special_tokens=False)]
        yield pd.DataFrame({"k": [k for k, _ in top], "n": [n for _, n in top], "tokens": sizes})

    sample = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).sample(fraction, seed)
    got = sample.mapInPandas(tally, "k binary, n long, tokens int").take(FREQUENT)
    table = {bytes(r["k"]): r["tokens"] for r in got}
    return (uuid.uuid4().hex, b"".join(table), np.fromiter(map(len, table), np.uint8, len(table)),
            np.fromiter(table.values(), np.uint16, len(table)))


def _unpack(packed: tuple[str, bytes, np.ndarray, np.ndarray]) -> dict[bytes, int]:
    _, blob, sizes, counts = packed
    ends = np.cumsum(sizes, dtype=np.int64)
    return {blob[e - s:e]: int(c) for e, s, c in zip(ends.tolist(), sizes.tolist(), counts.tolist())}


def _counter(tokenizer: str, table: Broadcast) -> CountEncoder:
    return hold(("counts", tokenizer, table.value[0]), lambda: CountEncoder(tokenizer, _unpack(table.value)))


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more tokens
    than ``limit``); one map over the rows, nothing is shuffled."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer, text))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = _counter(tokenizer, table)
        for texts in batches:
            yield pd.Series([c.count(t) for t in texts], dtype="int64")

    out = docs.withColumn("n_tokens", n_tokens(F.col(text)))
    return (out.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
