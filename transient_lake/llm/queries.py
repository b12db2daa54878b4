"""Registered queries of the training-data operators and their DuckDB SQL.

``op1`` to ``op13`` apply one operator to its whole table with production
parameters; the digest columns are derived from the operators' outputs.  Where
SQL cannot express an operator (library tokenisers, SimHash, CRC-32, models),
its tests hold it against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (classifier, collocations, exact_dedup, grammar_store, license_scan, mixing, packing, prefix_trie,
               quality_rules, sharding, simhash, token_counts, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return add


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), limit=512).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.digest(packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024))


@query("op3_warc_derivatives")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.withColumn("content_crc32", F.crc32(F.col("content").cast("binary"))).withColumn(
        "content_bytes", F.octet_length("content").cast("long")).drop("record")


OP4_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from t),
wins as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3),
seen as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from wins),
rep as (select doc_id, count(distinct p) as n from
        (select doc_id, unnest([i, i + 1, i + 2]) as p from seen where n >= 2) group by doc_id),
f as (select w.doc_id, cast(len(w) as bigint) as n_words,
  cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
  cast(length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as bigint) as n_capitals,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
  coalesce(rep.n, 0) as n_repeat_words from w left join rep using (doc_id)),
g as (select *, cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * n_symbols > 10 * word_chars
       or 100 * n_capitals > 40 * word_chars or 100 * n_dup_lines > 40 * n_lines or word_chars > 20 * n_words) as kept
from g
"""


@query("op4_quality_rules", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_rules.cascade(table(spark, sf_dir, "documents"), with_features=shown)
    base = [r.condition({f: F.col(f) for f in r.features}) for r in quality_rules.RULES if r.name in quality_rules.BASE]
    return judged.select("doc_id", *shown, (base[0] | base[1]).alias("base_failed"), "kept")


@query("op5_exact_dedup", """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as n
           from documents),
g as (select n, max(doc_id) as keep_id, count(*) as group_size from t group by n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n) as text_sha256 from t join g using (n)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "log_weight", "gumbel_key", "kept")


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), k=3, distance=3)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


OP8_SQL = """
with g as (select doc_id, text, lang, source, n_chars, count(*) as n from documents group by all),
d as (select doc_id, source, coalesce(strlen(text), 0) as n_bytes, md5(concat_ws('|', coalesce('v' || doc_id, 'n'),
    coalesce('v' || text, 'n'), coalesce('v' || lang, 'n'), coalesce('v' || source, 'n'), coalesce('v' || n_chars, 'n'))) as key,
    unnest(range(0, n)) as nth from g),
s as (select source, cast(sum(n_bytes + 1) as bigint) as size from d group by source),
r as (select source, sqrt(size) / (sum(sqrt(size)) over ()) * (sum(size) over ()) / size as rate from s),
r2 as (select source, rate, cast(greatest(1, ceil(rate / 16.0)) as int) as draws from r),
c as (select source, sum(p) over (partition by source order by k) as c from (
  select source, unnest(range(0, 81)) as k, exp(-rate / draws) * pow(rate / draws, k) / gamma(k + 1) as p from r2)),
u as (select key, nth, source,
    (cast('0x' || substr(md5('17:' || key || ':' || nth || ':' || j), 1, 13) as bigint) + 0.5) / pow(2, 52) as u
      from (select key, nth, d.source, unnest(range(0, draws)) as j from d join r2 on d.source is not distinct from r2.source)),
n as (select key, nth, count(*) as repeats from u join c on u.source is not distinct from c.source and c.c < u.u group by key, nth),
x as (select doc_id, d.source, n_bytes, round(rate, 6) as rate, repeats, key, nth, unnest(range(0, repeats)) as replica
  from d join n using (key, nth) join r2 on d.source is not distinct from r2.source)
select doc_id, source, n_bytes, rate, repeats, replica,
  cast('0x' || substr(md5('17:place:' || key || ':' || nth || ':' || replica), 1, 13) as bigint) as place from x
"""


@query("op8_poisson_mixing", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents"), power=0.5, epochs=1.0)
    return mixed.select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                        F.round("rate", 6).alias("rate"), F.col("repeats").cast("long").alias("repeats"),
                        F.col("replica").cast("long").alias("replica"), "place")


@query("op9_jump_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.to_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", sharding.text_crc32(F.col("text")).alias("text_crc32"), "law", "shard", "slot",
                         "grown_shard")


@query("op10_grammar_store")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    grammar_store.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return grammar_store.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


OP11_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
one as (select lang, x, count(*) as f from (select lang, unnest(w) as x from w) group by all),
total as (select lang, cast(sum(f) as bigint) as n from one group by lang),
two as (select lang, w[i] as x, w[i + 1] as y, count(*) as a from (select lang, w, unnest(range(1, len(w))) as i from w)
  group by all),
three as (select lang, w[i] as x, w[i + 1] as y, w[i + 2] as z, count(*) as a
  from (select lang, w, unnest(range(1, len(w) - 1)) as i from w) group by all having count(*) >= 10),
cuts as (
  select t.lang, x || ' ' || y as phrase, a, 1 as k, p.f as l, q.f as r from two t
  join one p using (lang, x) join one q on q.lang = t.lang and q.x = t.y
  where a >= 10 and not exists (select 1 from three c where c.lang = t.lang and 100 * c.a >= 50 * t.a
    and (c.x = t.x and c.y = t.y or c.y = t.x and c.z = t.y))
  union all
  select t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, 1, p.f, q.a from three t
  join one p on p.lang = t.lang and p.x = t.x join two q on q.lang = t.lang and q.x = t.y and q.y = t.z
  union all
  select t.lang, t.x || ' ' || t.y || ' ' || t.z, t.a, 2, p.a, q.f from three t
  join two p on p.lang = t.lang and p.x = t.x and p.y = t.y join one q on q.lang = t.lang and q.x = t.z),
scored as (select *, cast(1000000 * cast(a as hugeint) * a // (cast(l as hugeint) * r) as bigint) as score from cuts),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from lowest join total using (lang) qualify rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), min_count=10, subsume=50, top=2000, max_words=3)


OP12_SQL = """
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''),
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as i,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as k, length(coalesce(text, '')) as size
  from conversations where conv_id is not null),
n as (select c, count(*) as n, c - c % 100 as b, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
    range(1, length(cast(c as varchar)) + 1), lambda j: [ascii(substr(cast(c as varchar), j, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) % 6 as h
  from t group by c),
v as (select n.*, least(n.h, coalesce(m.n, 0)) as e from n left join n m on m.c = n.b),
r as (select v.c, e + i - h + 1 as d, k, size from t join v using (c) where i >= h
  union all select v.c, i + 1, k, size from v join t on t.c = v.b where i < e),
p as (select c, d, size, list(k) over (partition by c order by d) as p from r
  union all select c, 0, 0, cast([] as varchar[]) from n),
ends as (select c, max(d) as last from p group by c),
node as (select p.d, p, min(c) as conv_id, count(*) as n_convs, max(size) as size,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where last = p.d), '')) as ends_sha256
  from p join ends using (c) group by p.d, p),
kids as (select list_slice(p, 1, d - 1) as p, count(*) as n_children from node where d > 0 group by all),
whole as (select node.*, coalesce(n_children, 0) as n_children from node left join kids using (p)),
sums as (select q as p, count(*) filter (where n_children = 0) as n_leaves,
    cast(sum((n_convs - 1) * size) as bigint) as saved_tokens
  from (select n_children, n_convs, size, list_slice(p, 1, unnest(range(0, d + 1))) as q from whole) group by q)
select w.conv_id, w.d as depth, u.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
from whole w join sums using (p) left join node u on w.d > 0 and u.p = list_slice(w.p, 1, w.d - 1)
"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    return prefix_trie.report(table(spark, sf_dir, "conversations"), prefix_trie.head_turns(c), prefix_trie.block_start(c))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


OP13_SQL = r"""
with template(t, label, words, keys) as (values %s),
doc as (select row_number() over () as id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
lex as (select distinct unnest(words) as w from template),
word as (select id, unnest(ws) as w, unnest(range(0, len(ws))) as i from doc),
held as (select distinct id, w from word join lex using (w)),
idf as (select w, row_number() over (order by coalesce(n, 0), w) as rank from lex left join
  (select w, count(*) as n from held group by w) using (w)),
rare as (select id, w from held join idf using (w) qualify row_number() over (partition by id order by rank) <= 12),
posting as (select t, unnest(words) as w, unnest(range(0, len(words))) as q from template),
place as (select t, w, min(q) as q from posting group by t, w),
beginning as (select distinct id, t, i - q as s from rare join word using (id, w) join posting using (w)),
known as (select id, t, w, q from rare join place using (w)),
voted as (select b.id, b.t, b.s, count(*) as n, count(*) filter (where s + q >= 0 and ws[s + q + 1] = w) as v
  from beginning b join known using (id, t) join doc using (id) group by all),
verified as (select id, label, len(list_filter(range(0, len(words)), lambda j: s + j >= 0 and coalesce(ws[s + j + 1] = words[j + 1], false)))
    / cast(len(words) as double) as share
  from voted join template using (t) join doc using (id) where (v >= 3 or v = n) and len(list_filter(keys, lambda k:
    len(list_filter(range(s + k.at - 6, s + k.at + 7), lambda i: i >= 0 and list_slice(ws, i + 1, i + len(k.words)) = k.words)) = 0)) = 0),
best as (select id, list(label) as own, max(share) as score from verified group by id),
base as (select id, list(i) as places, list(l) as l from (
  select id, i - 1 as i, 'mit' as l from word a where w = 'license' and exists (select 1 from doc d where d.id = a.id and a.i >= 1 and d.ws[a.i] = 'mit')
  union all
  select id, i - 1, 'apache' from word a where w = 'license' and exists (select 1 from doc d where d.id = a.id and a.i >= 1 and d.ws[a.i] = 'apache')
  union all
  select id, i - 2, 'gpl' from word a where w = 'license' and exists (select 1 from doc d where d.id = a.id and a.i >= 2 and d.ws[a.i] = 'public'
    and d.ws[a.i - 1] = 'general')) group by id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(places), 0) as bigint) as n_base, list_min(places) as first_word,
  list_max(places) as last_word, array_to_string(list_sort(list_distinct(coalesce(l, []))), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(l, []), coalesce(own, [])))), ',') as labels, coalesce(score, 0.0) as score
from doc left join best using (id) left join base using (id)
""" % ", ".join(f"({i}, '{t.label}', {_sql_list(t.words)}, [" + ", ".join(
    f"{{'at': {at}, 'words': {_sql_list(k)}}}" for at, k in t.key_places) + "])" for i, t in enumerate(license_scan.TEMPLATES))


@query("op13_license_scan", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
