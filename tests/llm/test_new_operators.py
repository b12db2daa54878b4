"""Collocations, prefix trie and licence scan against brute force; edge rows,
very long groups and the parts of their methods."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from transient_lake.llm import collocations, license_scan, prefix_trie, tables
from transient_lake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
TURNS = "conv_id long, turn long, role string, text string"


# collocations

def brute_collocations(rows, min_count, subsume, top, longest=3):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\n\v\f\r]", text):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if 2 <= len(p) <= longest and a >= min_count}
        inside = defaultdict(int)
        for p, a in cand.items():
            for q in {p[i:i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}:
                inside[q] = max(inside[q], a)
        found = []
        for p, a in cand.items():
            if 100 * inside.get(p, 0) >= subsume * a and p in inside:
                continue
            score, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def text_of(rng, words):
    return "".join(rng.choice(["alpha", "Beta", "gamma", "ÉTÉ", "d-e", "new york", "new york city", "new york"])
                   + rng.choice([" ", "  ", "\t", ", ", ".\n", " ", " "]) for _ in range(words))


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(3)
    rows = [(i, text_of(rng, rng.randint(0, 60)), rng.choice(["en", "de", None, "und"]), "s") for i in range(300)]
    return rows + [(None, None, "en", "s"), (1, "", None, None), (2, " .,;", "xx", None), (3, "one two", "yy", None)]


@pytest.mark.parametrize("chunk,bits", [(2_000_000, 1 << 26), (500, 1 << 12), (7, 64)])
def test_collocations_brute(spark, spoken, chunk, bits):
    docs = spark.createDataFrame(spoken, DOCS).repartition(3)
    got = collocations.mine(docs, min_count=3, top=40, chunk=chunk, bits=bits)
    assert sorted(map(tuple, got.collect())) == brute_collocations([(r[1], r[2]) for r in spoken], 3, 50, 40)


def test_collocations_pairs_only_and_clashes(spark, spoken):
    docs = spark.createDataFrame(spoken, DOCS).withColumns({c: F.lit("old") for c in ("x", "y", "f", "rank", "phrase")})
    got = collocations.mine(docs, min_count=2, top=10, max_words=2)
    assert sorted(map(tuple, got.collect())) == brute_collocations([(r[1], r[2]) for r in spoken], 2, 50, 10, 2)


def test_collocations_empty(spark):
    got = collocations.mine(spark.createDataFrame([], DOCS))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0


def test_very_long_text_and_hot_prefix(spark):
    rng = random.Random(5)
    long = " ".join("hot " + f"w{rng.randint(0, 400)}" for _ in range(20_000))
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, "hot w1 hot w1", "en", "s")], DOCS)
    assert ("en", b"hot") in collocations.hot_words(docs)
    got = collocations.mine(docs, min_count=10, top=100_000, chunk=3_000)
    assert sorted(map(tuple, got.collect())) == brute_collocations([(long, "en"), ("hot w1 hot w1", "en")], 10, 50, 100_000)


def test_hot_stripe_is_dealt_to_many_places(spark):
    text = " ".join(f"hot w{i}" for i in range(5_000))
    docs = spark.createDataFrame([(1, text, "en", "s")], DOCS)
    parts = collocations.stripes(docs, 1, frozenset({("en", b"hot")}))
    rows = parts.where("x = 'hot'").collect()
    assert len({r["place"] for r in rows}) > 50
    assert max(len(r["followers"]) for r in rows) <= collocations.ROW
    assert sum(sum(r["counts"]) for r in rows) == 5_000


def test_counts_beyond_64_bits_score_exactly(spark):
    a, left, right = 3_037_000_500, 3_037_000_507, 3_037_000_511
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    got = row.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1_000_000 * a * a // (left * right)


# conversations

def brute_trie(rows, heads=True):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = f"{len(role or '')}:{role or ''}{text or ''}"
            by[c].append((turn is not None, turn or 0, role or "", hashlib.md5(key.encode()).hexdigest(), text or ""))
    by = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in by.items()}
    members, ends, kids, out = defaultdict(list), defaultdict(list), defaultdict(list), {}
    for c in sorted(by):
        h = zlib.crc32(str(c).encode()) % 6 if heads else 0
        seq = by.get(c - c % 100, [])[:h] + by[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        out[p] = (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]),
                  sum(out[k][5] for k in kids[p]) or 1,
                  sum(out[k][6] for k in kids[p]) + (len(m) - 1) * (len(p[-1][1]) if p else 0),
                  hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
    return sorted(out.values(), key=lambda r: r[:2])


def trie_rows(spark, rows, heads=True, local=prefix_trie.LOCAL, parts=3):
    c = F.col("c")
    args = (prefix_trie.head_turns(c), prefix_trie.block_start(c)) if heads else ()
    got = prefix_trie.report(spark.createDataFrame(rows, TURNS).repartition(parts), *args, local=local)
    return sorted(map(tuple, got.collect()), key=lambda r: r[:2])


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, QUERIES["op12_prefix_trie"](spark, SF).collect()), key=lambda r: r[:2])
    assert got == brute_trie(rows)


def test_trie_edges(spark):
    rows = [(1, 0, "u", "a"), (1, 1, None, "b"), (1, None, "u", None), (2, 0, "u", "a"), (2, 1, "", "b"), (None, 0, "u", "lost"),
            (3, 5, "u", "tie"), (3, 5, "u", "tie"), (3, 5, "b", "tie"), (100, 0, "u", "x"), (101, 7, "u", "only"), (103, 1, "u", "y"),
            (250, 0, "u", "no base"), (250, 1, "u", "still"), (9007199254740993, 0, "u", "big"), (4, 0, "u", "ü😀" * 50_000)]
    assert trie_rows(spark, rows) == brute_trie(rows)
    assert trie_rows(spark, rows, heads=False) == brute_trie(rows, heads=False)


def test_turnless_conversations_are_at_the_root(spark):
    # a first turn that is replaced by an absent one leaves nothing
    short = [c for c in range(1000, 1300) if zlib.crc32(str(c).encode()) % 6 >= 1 and c % 100]
    rows = [(c, 0, "u", "gone") for c in short]
    got = trie_rows(spark, rows)
    assert got == brute_trie(rows) and len(got) == 1
    assert got[0][:7] == (min(short), 0, None, len(short), 0, 1, 0)


def test_trie_empty(spark):
    assert trie_rows(spark, [(None, 1, "u", "x")]) == []


@pytest.mark.parametrize("local", [2, 20, 4_096])
def test_trie_random_components(spark, local):
    rng = random.Random(local)
    rows = [(c, t, "u", rng.choice("ab")) for c in range(60) for t in range(rng.randint(1, 9))]
    assert trie_rows(spark, rows, local=local) == brute_trie(rows)


def test_one_deep_conversation_takes_few_rounds(spark):
    rows = [(7, t, "u", f"t{t}") for t in range(3_000)] + [(8, t, "u", f"t{t}" if t < 1_500 else "else") for t in range(1_700)]
    got = trie_rows(spark, rows, heads=False, local=400)
    assert got == brute_trie(rows, heads=False)
    assert prefix_trie.LAST_RUN["rounds"] <= 8


def test_hot_first_turn(spark):
    rows = [(c, t, "u", "same" if t == 0 else f"{c % 400}") for c in range(900) for t in range(2)]
    assert trie_rows(spark, rows, heads=False, local=50) == brute_trie(rows, heads=False)
    assert prefix_trie.LAST_RUN["rounds"] <= 3


def test_running_totals_of_groups_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k, i, (k * 7919 + i * 104729) % 2 ** 40) for k, n in ((1, 5), (2, 4_000), (3, 1), (4, 700)) for i in range(n)]
        random.Random(1).shuffle(rows)
        got = tables.running(spark.createDataFrame(rows, "k long, i long, v long"), "k", [F.col("i")], "run", ("v",))
        held = {(r["k"], r["i"]): (r["nth"], r["v"]) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    x = {}
    for k, i, v in sorted(rows):
        x[k] = x.get(k, 0) ^ v
        assert held[k, i] == (i, x[k])


def test_ends_hash_in_chunks(spark):
    rows = spark.range(10_000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("id").alias("c"))
    got = prefix_trie.joined_sha256(rows, prefix_trie.NODE, "c", chunk=97).collect()
    assert [r["sha256"] for r in got] == [hashlib.sha256(",".join(map(str, range(10_000))).encode()).hexdigest()]


# licences

def brute_licenses(rows):
    templates = license_scan.TEMPLATES
    words = [license_scan.split_words(t or "") for t in rows]
    lexicon = {w for t in templates for w in t.words}
    df = Counter(w for ws in words for w in set(ws) & lexicon)
    out = []
    for ws in words:
        base = [(i, label) for phrase, label in license_scan.BASE for i in range(len(ws))
                if ws[i:i + len(phrase.split())] == phrase.split()]
        rare = sorted(set(ws) & lexicon, key=lambda w: (df[w], w))[:license_scan.RARE]
        own = {}
        for t in templates:
            tw = t.words
            starts = {i - q for i, w in enumerate(ws) if w in rare for q, v in enumerate(tw) if v == w}
            known = [w for w in rare if w in tw]
            for s in starts:
                at = lambda i: ws[i] if 0 <= i < len(ws) else None
                votes = sum(at(s + tw.index(w)) == w for w in known)
                near = all(any(i >= 0 and ws[i:i + len(k)] == k for i in range(s + p - license_scan.SLACK, s + p + license_scan.SLACK + 1))
                           for p, k in t.key_places)
                if near and (votes >= license_scan.VOTES or votes == len(known)):
                    share = sum(at(s + i) == w for i, w in enumerate(tw)) / len(tw)
                    own[t.label] = max(own.get(t.label, 0), share)
        labels = {label for _, label in base}
        out.append((len(ws), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None),
                    ",".join(sorted(labels)), ",".join(sorted(labels | set(own))), max(own.values(), default=0.0)))
    return out


def test_licenses_brute(spark):
    rng = random.Random(11)
    filler = "the software license is a public version of 2 0 mit apache gnu".split()
    rows = [None, "", "MIT license", "the mit  LICENSE, mit-license!", "License mit", "ümit license mit license", "apache license" * 3,
            "GNU General Public License, Version 3 This work is licensed under the GNU General Public License, version 3."]
    for t in license_scan.TEMPLATES:
        w = t.text.split()
        for change in range(3):
            own = list(w)
            for _ in range(change):
                own.insert(rng.randrange(len(own)), rng.choice(filler))
            noise = [rng.choice(filler) for _ in range(rng.randint(0, 60))]
            rows.append(" ".join(noise + own + noise))
    rows += [" ".join(rng.choice(filler) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    rows.append("x " * 100_000 + "Released under the MIT License " + "y " * 100_000 + "licensed under cc by-nc 4.0")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").withColumn("labels", F.lit("old"))
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()}
    want = brute_licenses(rows)
    for i, w in enumerate(want):
        assert got[i] == w, rows[i]
    found = {label for w in want for label in w[5].split(",")}
    assert {t.label for t in license_scan.TEMPLATES} <= found


def test_every_template_holds_its_key_phrases():
    for t in license_scan.TEMPLATES:
        assert len(t.key_places) == len(t.keys) and len(t.words) < license_scan._BEFORE


def test_licenses_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "gpl")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_base"], r["labels"]) for r in license_scan.scan(docs).collect()) == [
        (0, 0, ""), (1, 1, "mit"), (1, 1, "mit")]
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_scan_stays_in_the_jvm(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = license_scan.scan(docs, order=license_scan.index_words())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# the parts of earlier operators that this round changed

def test_re_pair_goes_down_to_where_a_rule_pays():
    import numpy as np

    from transient_lake.llm import grammar_store as G
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 40_000, 100).astype(np.uint32)
    for copies, most in ((20, 60), (7, 60)):
        ids = np.concatenate([np.append(passage, 45_000 + i) for i in range(copies)]).astype(np.uint32)
        body, rules = G.compress(ids, 49_408)
        assert len(body) <= most and (G.Grammar(rules, G.rule_lengths(rules, 49_408), 49_408).expand(body) == ids).all()
    few = np.concatenate([passage, passage]).astype(np.uint32)
    assert len(G.compress(few, 49_408)[1]) == 0  # two copies save fewer bytes than their rules cost
    for n in (0, 1, 2, 7, 300, 5_000):
        for vocabulary in (1, 2, 5, 300, 70_000):
            for least in (None, 2, 5):
                ids = (rng.zipf(1.3, n) % vocabulary).astype(np.uint32)
                body, rules = G.compress(ids, vocabulary, least)
                lengths = G.rule_lengths(rules, vocabulary)
                assert (G.Grammar(rules, lengths, vocabulary).expand(body) == ids).all()
                for start, length in ((0, n), (n // 3, n // 2), (n, 0), (0, 1)):
                    assert (G.slice_ids(body, rules, lengths, vocabulary, start, length) == ids[start:start + length]).all()


def test_slice_of_an_unknown_document_is_empty(spark):
    from transient_lake.llm import grammar_store as G
    from transient_lake.llm.queries import tokenizer_path
    from transient_lake.session import scratch_path
    path = scratch_path(spark, "slices")
    docs = spark.createDataFrame([(i, f"some text {i} " * 30) for i in range(40)] + [(None, "x")], "doc_id long, text string")
    G.write_ids(docs, path, tokenizer_path("word_bpe_49k.json"), 1)
    whole = G.read_slice(spark, path, 7)
    assert G.read_slice(spark, path, 7, 5, 9) == whole[5:14] and G.read_slice(spark, path, 7, 10_000) == []
    assert G.read_slice(spark, path, 99) == []


def test_pieces_are_exact_on_random_texts():
    import numpy as np
    from tokenizers import Tokenizer

    from transient_lake.llm import token_counts, tokenize
    from transient_lake.llm.queries import tokenizer_path
    rng = random.Random(9)
    letters = list("ab Z9éß,.;:!?'\"()<>|\n\t\r \x01\x85 …€’s-_") + ["<|endoftext|>", "<|STARTOFTEXT|>", "don't", "  ", "x,", "y. "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(6_000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder, library = tokenize.PieceEncoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
        counter = token_counts.CountEncoder(tokenizer_path(name), {})
        for t in texts:
            want = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == want, repr(t)
            assert counter.count(t) == len(want), repr(t)
