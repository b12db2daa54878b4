"""Defined results on nulls, empty and very long texts, ties, repeated rows,
empty tables and clashing column names; round trips and skewed groups."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from transient_lake.llm import (classifier, exact_dedup, grammar_store, mixing, packing, quality_rules, sharding, simhash,
                                token_counts, tokenize, warc)
from transient_lake.llm.queries import tokenizer_path
from transient_lake.session import scratch_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
ROWS = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, "Hello  world\n\n ok\t\tx ", None, "a", 5), (3, "Hello  world\n\n ok\t\tx ", None, "a", 5),
        (None, "no id here at all", "en", "b", 1), (5, "same text", "en", "b", 1), (6, "SAME text", "en", "b", 1),
        (7, "<|endoftext|> a  <|startoftext|>  b  c  <|endoftext|>", "en", "c", 1),
        (8, LONG, "en", "a", len(LONG)), (9, "ünï ΑΣ Ⅷ \U0001f600́ ﬁ", "de", "a", 9), (10, "   ", "en", "a", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df, *names):
    return df.withColumns({n: F.lit("old") for n in names})


TEXTS = ["a b", "\xa0", "\u2003", "\x0b", " a", "a ", "\n", "\na", "a\n", "a\n\nb", "a \nb", "a\n b", "  \t x  ", "a\r\nb", "a b", "a   b", "\x1c\x1d a\x1fb",
         "x y 　z", "it's we'll I'M", "  <|endoftext|>  ", "a<|endoftext|><|endoftext|>b", "\x0b\x0c", "1234 56 7", "a\x00b \x00",
         "é e ́", "ΑΣ ΣΑ Σ", "日本 語です", "᠎ a​ b", "a" * 300 + " " * 50 + "b", "...!!! ?", " \n\n\n"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(path):
    t, e = Tokenizer.from_file(path), tokenize.PieceEncoder(path)
    rng = random.Random(3)
    alphabet = " \n\t\r\x0b\x85\xa0 aBé's1,<|>"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    c = token_counts.CountEncoder(path, {})
    for text in [*TEXTS, *made, LONG[:5000]]:
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(text), dtype="<u4").tolist() == want, repr(text)
        assert c.count(text) == len(want), repr(text)


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokenize, "CACHE_ENTRIES", 50)
    e, t = tokenize.PieceEncoder(BYTE), Tokenizer.from_file(BYTE)
    for k in range(20):
        text = " ".join(f"w{k}x{i}" for i in range(30))
        assert np.frombuffer(e.encode(text), dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert len(e.cache) <= 100


def test_token_counts(docs, empty):
    t = Tokenizer.from_file(BYTE)
    got = token_counts.count_tokens(clash(docs, "n_tokens"), BYTE).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = r["text"] or ""
        assert (r["n_tokens"], r["n_bytes"]) == (len(t.encode(text, add_special_tokens=False).ids), len(text.encode()))
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def test_frequent_table_does_not_change_counts(spark):
    docs = spark.createDataFrame([(i, f"the cat number {i} sat on the mat") for i in range(300)], "doc_id long, text string")
    table = token_counts.frequent_lengths(docs, BYTE, rows=50, fraction=0.9)
    assert b"cat" in token_counts._unpack(table)
    t = Tokenizer.from_file(BYTE)
    for r in token_counts.count_tokens(docs, BYTE).collect():
        assert r["n_tokens"] == len(t.encode(r["text"]).ids)


def test_packing_edges(docs, empty):
    rows = packing.pack(clash(docs, "piece", "ids"), BYTE, 2, capacity=64).collect()
    t = Tokenizer.from_file(BYTE)
    for d, text in {r[0]: r[1] or "" for r in ROWS}.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        mine = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        if d == 3:
            assert len(mine) == 2  # the repeated row is packed as a row of its own
            mine = mine[:1]
        assert b"".join(r["ids"] for r in mine) == np.asarray(ids, dtype="<u4").tobytes()
    assert packing.pack(empty, BYTE, 2).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100, 1024])
    counts = {rng.randint(1, capacity): rng.randint(1, 3000) for _ in range(rng.randint(1, 60))}
    runs = packing.plan(counts, capacity)
    placed, filled = {n: [] for n in counts}, {}
    for length, first, n, sequence, offset in runs:
        placed[length] += range(first, first + n)
        for s in range(sequence, sequence + n):
            filled.setdefault(s, []).append((offset, length))
    assert all(sorted(placed[n]) == list(range(c)) for n, c in counts.items())
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in spans) <= 2


def sequential_best_fit(counts, capacity):
    """The method one piece at a time."""
    large = sorted((n for n, c in counts.items() for _ in range(c) if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        fits = next((i for i, b in enumerate(large) if a + b <= capacity), None)
        gaps.append(capacity - a - (large.pop(fits) if fits is not None else 0))
    for n in sorted((n for n, c in counts.items() for _ in range(c) if 3 * n <= capacity), reverse=True):
        best = min((g for g in gaps if g >= n), default=None)
        if best is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(best)
            gaps.append(best - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_the_method_piece_by_piece(seed):
    rng = random.Random(100 + seed)
    counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(25)}
    runs = packing.plan(counts, 100)
    assert len({s for _, _, n, q, _ in runs for s in range(q, q + n)}) == sequential_best_fit(counts, 100)


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, "http://x/a", "<html><head><title>T &amp; x</title></head><body><p>A&lt;b</p><!-- <p>no</p> -->"
                                    "<script>var t='</p>'</script><a href='/u?a=1&amp;b=2'>l</a><br>é z</body>"),
                                   (2, None, None), (None, "http://x/b", ""), (1, "http://x/a", "plain"), (4, "u", "x\r\n\r\ny WARC/1.1\r\n")],
                                  "page_id long, url string, html string")
    records = warc.responses(pages)
    made = warc.derivatives(records)
    rows = made.collect()
    assert len(rows) == 10
    first = {r["record_type"]: r for r in rows if r["target_uri"] == "http://x/a" and r["title"]}
    assert first["conversion"]["content"] == "A<b\nl\né z"
    assert first["metadata"]["title"] == "T & x" and first["metadata"]["n_links"] == 1
    assert "outlink: /u?a=1&b=2\r\n" in first["metadata"]["content"] and "http-status: HTTP/1.1 200 OK\r\n" in first["metadata"]["content"]
    source = {bytes(r["record"]): warc.parse_record(bytes(r["record"])) for r in records.collect()}
    by_id = {f["warc-record-id"]: f for f, _ in source.values()}
    for r in rows:
        fields, block = warc.parse_record(r["record"].encode())
        assert fields["warc-refers-to"] == r["refers_to"] and r["refers_to"] in by_id
        assert fields["warc-block-digest"] == warc.digest(block) and block.decode() == r["content"]
        assert fields["warc-source-payload-digest"] == by_id[r["refers_to"]]["warc-payload-digest"]
    assert warc.derive(warc.make_record({"WARC-Type": "request", "WARC-Record-ID": "<x>"}, b"")) == []
    with pytest.raises(ValueError):
        warc.derive(b"nonsense")
    path = scratch_path(spark, "warc")
    warc.write_warc(made, path)
    back = warc.read_warc(spark, path)
    assert sorted(bytes(r["record"]) for r in back.collect()) == sorted(r["record"].encode() for r in rows)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def brute_rules(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    cover = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_rules_edges(spark, docs, empty):
    extra = spark.createDataFrame([(20, "a a a a a\nb\nb\n \n\n#x", "en", "a", 1), (21, "x y z " * 40, "en", "a", 1),
                                   (22, "\U0001f600 é é *", "en", "a", 1)], SCHEMA)
    both = docs.unionByName(extra)
    got = quality_rules.cascade(clash(both, "kept", "n_words"), with_features=True).collect()
    assert len(got) == both.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(r["text"])
        assert r["kept"] == (r["failed_rule"] is None)
    short = {(r["doc_id"], r["text"]): r["kept"] for r in quality_rules.cascade(both).collect()}
    assert short == {(r["doc_id"], r["text"]): r["kept"] for r in got}
    assert quality_rules.cascade(empty).count() == 0


def test_cascade_order():
    cost = {"a": 1.0, "b": 0.1, "c": 5.0}
    rejected = {"a": {1, 2, 3, 4}, "b": {1}, "c": {5, 6, 7}}
    assert quality_rules.order_by_rejection(cost, rejected) == ["b", "a", "c"]
    assert quality_rules.order_by_rejection(cost, {"a": {1}, "b": set(), "c": {1}})[0] == "a"


def test_features_not_asked_for_are_computed_in_the_cascade_only(spark, monkeypatch):
    fails = F.raise_error(F.lit("computed")).cast("long")
    lines = quality_rules.FEATURES["n_lines"]
    monkeypatch.setitem(quality_rules.FEATURES, "n_lines", lambda t: F.when(F.length(t) < 100, fails).otherwise(lines(t)))
    docs = spark.createDataFrame([(1, "few words"), (2, " ".join(f"word{i}" for i in range(80)))], "doc_id long, text string")
    order = [r.name for r in quality_rules.RULES]
    for asked in (("n_words", "n_dup_lines"), ()):
        got = {r["doc_id"]: r for r in quality_rules.cascade(docs, with_features=asked, order=order).collect()}
        assert [(got[d]["failed_rule"], got[d]["kept"]) for d in (1, 2)] == [("few_words", False), (None, True)]
        assert set(got[1].asDict()) == {"doc_id", "text", "failed_rule", "kept", *asked}


def test_exact_dedup_edges(docs, empty):
    got = exact_dedup.exact_groups(clash(docs, "kept", "keep_id")).collect()
    assert len(got) == len(ROWS)
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert by[(1, None)]["keep_id"] == 1 and by[(2, "")]["keep_id"] == 1 and not by[(2, "")]["kept"]
    assert by[(6, "SAME text")]["keep_id"] == 5 and by[(3, ROWS[2][1])]["group_size"] == 2
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in stay.collect()) == [0, 1, 3, 5, 7, 8, 9, 10]
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_hash_collisions_are_told_apart_by_bytes(spark):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(400)], "doc_id long, text string")
    got = exact_dedup.exact_groups(docs, hash128=lambda t: F.substring(F.md5(t), 1, 1)).collect()  # 16 hashes
    assert all((r["keep_id"], r["group_size"]) == (r["doc_id"] % 40, 10) for r in got) and len(got) == 400


def brute_components(values, distance):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_anchor_links_find_every_component(spark, crowd):
    rng = random.Random(11)
    values = [0, 1 << 63]
    for _ in range(12):  # walks of small steps, and points at the very distance
        at = rng.getrandbits(64)
        for _ in range(8):
            values.append(at)
            for b in rng.sample(range(64), rng.choice([1, 3, 3, 4])):
                at ^= 1 << b
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    points = spark.createDataFrame([(v,) for v in signed], "fp long")
    for distance in (0, 1, 2, 3):
        comp = simhash.star_components(simhash.links(points, distance, crowd), "a", "b").collect()
        found = {r["node"]: r["label"] for r in comp}
        label = brute_components(values, distance)
        want = {}
        for v, x in zip(signed, label):
            want.setdefault(x, set()).add(v)
        got = {}
        for v in signed:
            got.setdefault(found.get(v, v), set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())), distance


def test_simhash_edges(docs, empty):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert got[(1, 0)] == got[(2, 0)] == got[(10, 0)] == 1
    assert simhash.fingerprint("A b") == simhash.fingerprint("a  B")
    stay = simhash.one_of_each(docs)
    assert stay.columns == docs.columns
    ids = [r["doc_id"] for r in stay.collect()]
    assert 1 in ids and 2 not in ids and 10 not in ids and ids.count(3) == 1 and ids.count(5) == 1 and 6 not in ids
    assert ids.count(None) == 1
    assert simhash.near_groups(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_anchor_rows_are_not_broadcast(spark):
    # a small table by Spark's estimate, each row of which goes to some 34 anchors
    points = spark.range(500).select(F.xxhash64("id").alias("fp"))
    links = simhash.links(points)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    links.collect()
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_near_copies_of_one_text(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 400)}" for _ in range(400)]
    rows = [(0, " ".join(words))]
    for i in range(1, 60):
        copy = list(words)
        copy[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {}
    for r in simhash.near_groups(docs).collect():
        sizes[r["component_id"]] = sizes.get(r["component_id"], 0) + 1
    assert sizes.get(0, 0) >= 55


def test_every_group_keeps_one_row_when_ids_repeat(spark):
    def words(seed):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(40))
    a, b, c, d = (words(i) for i in range(4))
    rows = [(7, a), (7, b), (3, c), (5, c), (5, d), (7, d), (7, d), (None, words(9)), (None, words(9).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    assert sorted(got[i] for i in range(len(got)) if got[i][0]) == sorted([(7, a), (7, b), (3, c), (5, d)])
    assert sum(r[0] is None for r in got) == 1


def poisson_inverse(rate, u):
    k, p = 0, np.exp(-rate)
    c = p
    while c < u and k < mixing.TERMS:
        k += 1
        p *= rate / k
        c += p
    return k + (1 if c < u else 0)


def test_mixing(spark, docs, empty):
    rows = [(i, "x" * (10 + i % 50), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r["_source"]: r["rate"] for r in mixing.source_rates(table).collect()}
    weights = {s: sum(len(t) + 1 for _, t, x in rows if x == s) for s in rates}
    total = sum(weights.values())
    for s, n in weights.items():
        assert rates[s] == pytest.approx(n ** 0.5 / sum(m ** 0.5 for m in weights.values()) * total / n)
    import hashlib

    got = {}
    for r in mixing.poisson_mix(table).collect():
        got.setdefault(r["doc_id"], []).append(r["replica"])
    for i, _, s in rows:
        key = hashlib.md5(f"v{i}|v{'x' * (10 + i % 50)}|v{s}".encode()).hexdigest()
        u = (int(hashlib.md5(f"17:{key}:0:0".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        assert sorted(got.get(i, [])) == list(range(poisson_inverse(rates[s], u)))
    mass = sum(len(got.get(i, [])) * (len(t) + 1) for i, t, _ in rows)
    assert mass == pytest.approx(total, rel=0.1)
    big = mixing.poisson_mix(table, weights={"s0": 1.0}, epochs=3.0)
    assert {r["source"] for r in big.select("source").distinct().collect()} == {"s0"}
    assert big.count() == pytest.approx(3 * len(rows), rel=0.1)
    mixed = mixing.poisson_mix(clash(docs, "rate", "replica"), epochs=4.0)
    assert mixed.where("source is null").count() >= 0 and set(docs.columns) <= set(mixed.columns)
    assert mixing.poisson_mix(empty).count() == 0


def test_mix_is_shuffled_globally_and_repeats_itself(spark):
    table = spark.createDataFrame([(i, "x", "a" if i < 1500 else "b") for i in range(3000)], "doc_id long, text string, source string")
    order = [r["doc_id"] for r in mixing.poisson_mix(table).collect()]
    assert sorted(order) == sorted(r["doc_id"] for r in mixing.poisson_mix(table.repartition(7)).collect())
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.1


@pytest.mark.parametrize("doc_id", ["null", "1", "if(id % 3 = 0, 7, id)", "if(id % 2 = 0, null, id)"])
def test_mix_of_null_and_repeated_ids_keeps_its_law(spark, doc_id):
    n = 6_000
    table = spark.range(n).selectExpr(f"cast({doc_id} as long) as doc_id", "concat('text ', id) as text", "'s' as source")
    got = mixing.poisson_mix(table).groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("place").alias("p")).collect()
    assert sum(r["n"] for r in got) == pytest.approx(n, rel=0.05)
    assert len(got) == pytest.approx(n * (1 - np.exp(-1)), rel=0.05)  # a Poisson law of mean one, not blocks
    assert all(r["n"] == r["p"] for r in got)


def test_mix_of_equal_rows(spark):
    same = spark.range(5_000).selectExpr("1L as doc_id", "'same' as text", "'s' as source")
    rows = mixing.numbered_rows(same, part=64).collect()
    assert sorted(r["_nth"] for r in rows) == list(range(5_000))
    mixed = mixing.poisson_mix(same.unionByName(spark.range(5_000).selectExpr("id as doc_id", "concat('t', id) as text", "'s' as source")))
    n = {r["same"]: r["n"] for r in mixed.groupBy((F.col("text") == "same").alias("same")).agg(F.count("*").alias("n")).collect()}
    assert n[True] == pytest.approx(5_000, rel=0.06)
    sizes = [r["n"] for r in mixed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 1.5 * sum(sizes) / len(sizes)


def test_token_counts_of_white_space_runs_use_the_table(spark):
    texts = [" ".join(f"word{i % 40}" for i in range(k)) + "\n\n" + "\r\n".join(f"more{i % 30}  x" for i in range(k)) + "\t\t"
             for k in range(1, 60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    packed = token_counts.frequent_lengths(docs, BYTE, fraction=1.0)
    c = token_counts.CountEncoder(BYTE, token_counts._unpack(packed))
    made = []
    make, c._make = c._make, lambda p: made.append(p) or make(p)
    whole = Tokenizer.from_file(BYTE)
    assert [c.count(t) for t in texts] == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert b"word3" in c.frequent and len(made) <= 5  # all but led-by-run pieces come from the table


def test_sharding_edges(spark, docs, empty):
    got = sharding.to_shards(clash(docs, "shard", "size"), 40).collect()
    assert len(got) == len(ROWS)
    slots = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.to_shards(empty, 40).count() == 0
    n = spark.range(20_000).select(*[sharding.jump_shard(F.col("id"), k).alias(f"k{k}") for k in (1, 10, 31, 32, 33, 34, 200)]).toPandas()
    assert (n["k1"] == 0).all()
    for a, b in ((31, 32), (32, 33), (33, 34)):
        moved = n[f"k{a}"] != n[f"k{b}"]
        assert (n.loc[moved, f"k{b}"] == a).all() and 0.5 / b < moved.mean() < 1.5 / b
    assert n["k200"].value_counts().min() > 50 and n["k200"].max() == 199


def test_rows_of_one_key_are_numbered_in_many_groups(spark, monkeypatch):
    texts = [f"text {i}" for i in range(600)]
    docs = spark.createDataFrame([(7 if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sharding.to_shards(docs, 4).collect()
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    # in one group the slots of a key would follow the text checksums
    mine = sorted((r for r in rows if r["doc_id"] == 7), key=lambda r: r["slot"])
    sums = [zlib.crc32(r["text"].encode()) for r in mine]
    assert 20 < sum(a > b for a, b in zip(sums, sums[1:])) < 100
    monkeypatch.setattr(sharding, "GROUP_ROWS", 1)
    wide = sorted((r for r in sharding.to_shards(docs, 4).collect() if r["doc_id"] == 7), key=lambda r: r["slot"])
    sums = [zlib.crc32(r["text"].encode()) for r in wide]
    assert sum(a > b for a, b in zip(sums, sums[1:])) > 80  # more rows, more groups


def test_grammar_round_trip_and_slices(spark, docs, empty):
    rng = np.random.default_rng(5)
    for seq in (np.zeros(0, int), np.array([7]), np.full(5001, 3), np.tile([1, 2, 3, 1, 2, 4], 700), rng.integers(0, 9, 20_000),
                np.repeat(rng.integers(0, 50, 900), rng.integers(1, 9, 900))):
        body, rules = grammar_store.compress(seq, 100, min_count=4)
        lengths = grammar_store.rule_lengths(rules, 100)
        g = grammar_store.Grammar(rules, lengths, 100)
        assert g.expand(body).tolist() == seq.tolist()
        assert len(body) + 2 * len(rules) <= max(len(seq), 1) and g.size[body].sum() == len(seq)
        for _ in range(20):
            a = int(rng.integers(0, len(seq) + 1))
            n = int(rng.integers(0, len(seq) + 1 - a))
            assert grammar_store.slice_ids(body, rules, lengths, 100, a, n).tolist() == seq[a:a + n].tolist()
    t = Tokenizer.from_file(WORD)
    path = scratch_path(spark, "ids")
    grammar_store.write_ids(docs, path, WORD, 1, block_tokens=50)
    rows = grammar_store.read_documents(spark, path).collect()
    assert len(rows) == len(ROWS)
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        text = dict((x[0], x[1]) for x in ROWS)[r["doc_id"]] or ""
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids), np.asarray(ids, dtype="<u4").tobytes())
        at += len(ids)
    want = [*t.encode(LONG, add_special_tokens=False).ids, 1]
    assert grammar_store.read_slice(spark, path, 8, 1000, 50) == want[1000:1050]
    path = scratch_path(spark, "ids")
    grammar_store.write_ids(empty, path, WORD, 1)
    assert grammar_store.read_documents(spark, path).count() == 0


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(size=3000)] + [0.5] * 40 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 700, 1500, len(values)):
        assert classifier.kth_largest(df, "v", k) == order[k - 1]
    assert classifier.kth_largest(df, "v", 10 ** 6) == order[-1]


def test_classifier_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, None), (5, None, None), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = classifier.resample(clash(docs, "kept"), labels)
    assert got.count() == len(ROWS)
    assert classifier.resample(docs, labels.limit(0)).where("kept").count() == len(ROWS)
    top = classifier.resample(docs, labels, k=3).where("kept")
    assert top.count() in (3, 4)  # repeated rows tie
    assert classifier.resample(docs, labels, k=0).where("kept").count() == 0
    assert classifier.resample(empty, labels).count() == 0


def test_heavy_copies_count_once(spark):
    rows = [(i, f"alpha beta gamma {i % 97} delta {i % 89}") for i in range(1000)]
    rows += [(1000 + i, "zeta eta theta iota kappa") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = classifier.log_ratios(docs, spark.createDataFrame([(i,) for i in range(0, 1000, 2)], "_id long"), "doc_id", "text")
    copy = r[classifier.ngram_buckets("zeta eta theta iota kappa")]
    assert copy.mean() > -1.5  # about one document's worth of raw counts


@pytest.mark.parametrize("copies, rows", [(2, 2500), (3, 2500), (20, 2500), (2, 600), (833, 2500)])
@pytest.mark.parametrize("kind", ["equal", "case", "near"])
def test_copies_count_as_one_document(spark, kind, copies, rows):
    """Groups on both sides of one row in a thousand, up to a third of the rows."""
    made = {"equal": lambda i: "Zeta eta Theta", "case": lambda i: "zeta ETA theta" if i % 2 else "Zeta eta Theta",
            "near": lambda i: f"Zeta eta Theta {i}"}[kind]
    texts = [f"alpha {i} beta {i % 97}" for i in range(rows - copies)] + [made(i) for i in range(copies)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    good = list(range(0, 200, 2))
    r = classifier.log_ratios(docs, spark.createDataFrame([(i,) for i in good], "_id long"), "doc_id", "text", 1 << 12)
    same = {}
    for t in texts:
        same[t.lower()] = same.get(t.lower(), 0) + 1
    raw, target = np.ones(1 << 12), np.ones(1 << 12)
    for i, t in enumerate(texts):
        np.add.at(raw, classifier.ngram_buckets(t, 1 << 12), 1 / same[t.lower()])
        if i in set(good):
            np.add.at(target, classifier.ngram_buckets(t, 1 << 12), 1.0)
    assert np.allclose(r, np.log(target / target.sum()) - np.log(raw / raw.sum()), atol=1e-5)


def test_pipeline_stages_on_edges(spark, docs, empty):
    sf = "/root/testdata/sf0.001"
    for table in (docs, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf)
            assert out.columns == docs.columns, name
            assert out.dtypes == docs.dtypes, name
            assert name == "mix" or out.count() <= table.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, table, sf)
        assert packed.agg(F.sum("length")).first()[0] is not None or table is empty


def test_pipeline_against_brute_force(spark):
    """Each stage's decisions on its own input, the whole run at the end."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        steps[name] = (before.toPandas(), docs.toPandas())
    before, after = steps["exact"]
    lower = before["text"].fillna("").map(lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    assert sorted(after["doc_id"]) == sorted(before.groupby(lower)["doc_id"].min())
    before, after = steps["near"]
    fp = [simhash.fingerprint(t) for t in before["text"]]
    ids = before["doc_id"].tolist()
    label = brute_components(fp, 3)
    least = {}
    for x, d in zip(label, ids):
        least[x] = min(least.get(x, d), d)
    assert sorted(after["doc_id"]) == sorted(least.values())
    before, after = steps["mix"]
    assert set(after["doc_id"]) <= set(before["doc_id"])
    before, after = steps["pack"]
    t = Tokenizer.from_file(BYTE)
    assert after["length"].sum() == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in before["text"])
    run = corpus_pipeline.run(spark, sf).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run[key].values)) == sorted(map(tuple, after[key].values))
    assert zlib.crc32(b"") == 0


def test_ngrams_do_not_depend_on_the_cache(monkeypatch):
    texts = [" ".join(f"w{(i * j) % 311}" for j in range(60)) for i in range(60)]
    want = [classifier.ngram_buckets(t).tolist() for t in texts]
    monkeypatch.setattr(classifier, "WORDS", 20)
    tokenize.hold("another", object)  # drops the words held so far
    assert list(tokenize._HELD) == ["another"]
    assert [classifier.ngram_buckets(t).tolist() for t in texts] == want
    assert len(classifier.ngram_buckets(None)) == 0 and len(want[0]) == 119
