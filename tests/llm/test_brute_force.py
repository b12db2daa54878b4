"""Queries held against brute-force versions on the small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from transient_lake.llm.queries import ORACLE, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def byte_ids(docs):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return {d: e.ids for d, e in zip(docs, t.encode_batch(list(docs.values()), add_special_tokens=False))}


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_token_counts(spark, docs, byte_ids):
    got = {r["doc_id"]: r for r in QUERIES["op1_token_counts"](spark, SF).collect()}
    assert set(got) == set(docs)
    for d, r in got.items():
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (
            len(docs[d].encode()), len(byte_ids[d]), len(byte_ids[d]) > 512)


def test_packing(spark, docs, byte_ids):
    rows = QUERIES["op2_best_fit_packing"](spark, SF).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for d, pieces in by_doc.items():
        ids, at = [*byte_ids[d], 2], 0
        pieces.sort(key=lambda r: r["piece"])
        for i, r in enumerate(pieces):
            assert r["piece"] == i and r["start"] == at
            assert r["ids_crc32"] == crc(ids[at:at + r["length"]])
            assert r["length"] == 1024 or i == 0
            at += r["length"]
        assert at == len(ids)
        assert len(pieces) == -(-len(ids) // 1024)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_sequence) <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


def fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op7_simhash"](spark, SF).collect()}
    fp = {d: fingerprint(t) for d, t in docs.items()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{v:016x}" for d, v in fp.items()}
    ids = sorted(fp)
    values = np.array([fp[d] for d in ids], dtype=np.uint64)
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        for i in range(len(ids)):
            near = np.bitwise_count(values ^ values[i]) <= 3
            new[i] = min(new[i], label[near].min())
        if (new == label).all():
            break
        label = new
    assert {d: r["component_id"] for d, r in got.items()} == {d: ids[label[i]] for i, d in enumerate(ids)}


def jump(key, n):
    b = j = 0
    while j < n:
        b = j
        seed = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(int(j).to_bytes(8, "little", signed=True), seed)
        j = int((b + 1) / (((h >> 33) + 1) / float(1 << 31)))
    return b


def test_sharding(spark, docs):
    rows = QUERIES["op9_jump_sharding"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 16, zlib.crc32(text), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 40), jump(r["doc_id"], 41))
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_grammar_store(spark, docs):
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in QUERIES["op10_grammar_store"](spark, SF).collect()}
    at = 0
    for d in sorted(docs):
        ids = [*t.encode(docs[d], add_special_tokens=False).ids, 1]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(docs)


def test_exact_dedup_against_hashing(spark, docs):
    groups = defaultdict(list)
    lower = {d: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode() for d, t in docs.items()}
    for d, t in lower.items():
        groups[t].append(d)
    for r in QUERIES["op5_exact_dedup"](spark, SF).collect():
        g = groups[lower[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (
            max(g), len(g), r["doc_id"] == max(g), hashlib.sha256(lower[r["doc_id"]]).hexdigest())


def test_warc_derivatives(spark):
    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    rows = QUERIES["op3_warc_derivatives"](spark, SF).collect()
    assert Counter(r["page_id"] for r in rows) == {p: 2 for p in pages}
    pairs = defaultdict(set)
    for r in rows:
        assert r["content_crc32"] == zlib.crc32(r["content"].encode())
        assert r["source_payload_digest"].startswith("sha1:")
        pairs[r["page_id"]].add(r["refers_to"])
        if r["record_type"] == "conversion":
            assert "<p>" not in r["content"] and "&amp;" not in r["content"] and "track(" not in r["content"]
    assert all(len(s) == 1 for s in pairs.values())


def test_classifier_held_out(spark):
    labels = {r["doc_id"]: r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op6_quality_classifier"](spark, SF).collect()}
    good = [kept[d] for d, r in labels.items() if r["quality"] == 1 and not r["toxic"] and d in kept]
    low = [kept[d] for d, r in labels.items() if r["quality"] == 0 and d in kept]
    assert np.mean(good) > 0.97
    assert np.mean(low) < 0.3


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    import duckdb

    from tools.oracle_check import rows_of

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want_columns, want = rows_of(con.execute(ORACLE[name]).df())
    columns, got = rows_of(QUERIES[name](spark, SF).toPandas())
    assert columns == want_columns
    assert len(got) == len(want)
    assert got == want


def test_quality_classifier(spark):
    """Weights, Gumbel keys, k and the rows kept, from the definitions."""
    import struct

    from transient_lake.llm import classifier as C

    sf = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pylist()

    def h(value: bytes, seed: int) -> int:
        return xxhash.xxh64_intdigest(value, seed)

    def of_id(d: int, seed: int) -> int:
        return h(struct.pack("<q", d), seed)

    def buckets(text):
        w = [h(x, 7) for x in (text or "").encode().split()]
        mix, spread, m = int(C._MIX), int(C._SPREAD), 2 ** 64
        return [x >> 48 for x in w + [((a * mix % m) ^ b) * spread % m for a, b in zip(w, w[1:])]]

    good = sorted({r["doc_id"] for r in labels if r["quality"] == 1 and not r["toxic"]})
    held = {d for d in good if h(b"half", of_id(d, 42)) & 1}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    copies = Counter((r["text"] or "").translate(fold) for r in rows)
    found = {r["doc_id"]: buckets(r["text"]) for r in rows}
    raw, target = np.ones(C.BUCKETS), np.ones(C.BUCKETS)
    fitted = set(good) - held
    for r in rows:
        share = 1 / copies[(r["text"] or "").translate(fold)]
        for b in found[r["doc_id"]]:
            raw[b] += share
            target[b] += r["doc_id"] in fitted
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    weight = {d: ratio[f].sum() / (len(f) + C.NEUTRAL) * C.SCALE for d, f in found.items()}
    start = h(struct.pack("<i", 23), 42)
    key = {d: w - np.log(-np.log(((of_id(d, start) >> 11) + 0.5) / 2 ** 53)) for d, w in weight.items()}
    level = np.quantile([weight[d] for d in held if d in weight], 1 - C.KEEP_GOOD)
    k = sum(w >= level for w in weight.values())
    least = sorted(key.values())[-k]
    got = {r["doc_id"]: r for r in QUERIES["op6_quality_classifier"](spark, sf).collect()}
    assert set(got) == set(weight)
    for d, r in got.items():
        assert r["log_weight"] == pytest.approx(weight[d], abs=1e-3)
        assert r["gumbel_key"] == pytest.approx(key[d], abs=1e-3)
        assert r["kept"] == (key[d] >= least) or abs(key[d] - least) < 1e-3
    assert abs(sum(r["kept"] for r in got.values()) - k) <= 1
