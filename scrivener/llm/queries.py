"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .common import read
from .langid import fit, identify, training
from .mixing import mix
from .neardup import near_duplicates
from .packing import pack_documents
from .pii import find_pii
from .quality import ITERATIONS, PSEUDO, RULES, START, quality
from .resample import WORDS, resample
from .sharding import shard
from .tokens import count_tokens, default_path, new_cache
from .topk import top_inner_products
from .trie import prefix_trie
from .urls import Judge, judge_urls, word_shares

#: Bytes of text that a shard may hold.
SHARD_BYTES = 1 << 20


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.filter(training())))
    return found.select("doc_id", (~training()).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts tokens with a cache that is empty at first, so that every distinct text is encoded."""
    return count_tokens(read(spark, sf_dir, "documents"), default_path(), new_cache(spark))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are counted on the texts of all pages."""
    pages = read(spark, sf_dir, "pages")
    return judge_urls(pages, judge=Judge(word_shares(pages)))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), default_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality(read(spark, sf_dir, "documents")).select(*cols, F.round("p_good", 4).alias("p_good"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), SHARD_BYTES)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"), group=100, heads=6)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10, least_words=20, longest=1)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_language_id, op2_token_counts, op3_mixing, op4_near_duplicates, op5_pii, op6_url_filters, op7_top_k, op8_packing, op9_quality_rules, op10_sharding, op11_prefix_trie, op12_importance_resampling, op13_bpe,
        )
    }


#: Mixing as one query: every source in the order of the same keys, taken while half of a document still fits the budget.
_MIXING = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    greatest(0.05::double, 1::double - 10.0::double * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::double
      / greatest(length(coalesce(text, '')), 1)) as weight,
    (('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint + 1)::double / 4503599627370496 as u
  from documents),
k as (select *, -ln(u) / weight as key from d),
s as (select source, sum(size)::bigint as source_size from k group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as w,
        row_number() over (order by source nulls last) as nth, 2.0::double * source_size as cap from s),
r as (select *, cap / w as ratio, sum(w) over () as all_w, sum(source_size) over ()::double as all_size,
        coalesce(sum(w) over b, 0) as w_before, coalesce(sum(cap) over b, 0) as cap_before
      from w window b as (order by cap / w, nth rows between unbounded preceding and 1 preceding)),
l as (select *, (all_size * 1.5 - cap_before) / (all_w - w_before) as level from r),
f as (select arg_min(level, ratio) as free from l where level <= ratio),
t as (select source, source_size, case when free is null then cap else least(cap, free * w) end as target from l left join f on true),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
p as (select k.doc_id, k.size, k.source, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
        sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows unbounded preceding) - k.size as before
      from k join e on k.source is not distinct from e.source)
select doc_id, size, source, source_size, target, (size * (epochs + case when 2 * before + size <= 2 * rest then 1 else 0 end))::bigint as taken,
  (epochs + case when 2 * before + size <= 2 * rest then 1 else 0 end)::bigint as times from p
"""

_TOP_K = """
with v as (
  select vec_id, [floor(64 * x::double) for x in embedding] as x from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


#: Depth by depth, the bytes of every prefix; a document's shard is its shortest prefix that fits. No bit past 32 is needed while ids are unique.
_SHARDING = f"""
with d as (select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes, ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint as h from documents),
l as (select doc_id, n_bytes, h, unnest(range(0, 33)) as depth from d),
s as (select depth, h >> (32 - depth) as prefix, sum(n_bytes)::bigint as shard_bytes, count(*)::bigint as shard_docs from l group by 1, 2),
f as (select l.doc_id, l.n_bytes, s.*, row_number() over (partition by l.doc_id order by s.depth) as nth
      from l join s on s.depth = l.depth and s.prefix = l.h >> (32 - l.depth) where s.shard_bytes <= {SHARD_BYTES} or s.shard_docs = 1)
select doc_id, n_bytes, case when depth = 0 then '' else lpad(bin(prefix), depth::integer, '0') end as shard_id, depth::integer as depth,
  shard_bytes, shard_docs, shard_bytes > {SHARD_BYTES} as oversize from f where nth = 1
"""

#: Vote patterns, then one common table expression for each step of expectation-maximisation over them.
_COUNTS = r"""
d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
p as (select doc_id, unnest(range(1, len(w) + 1)) as i, w from w),
g as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from p where i <= len(w) - 2),
r as (select doc_id, count(distinct i + k) as n_repeat_words from g, range(0, 3) as ks(k) where n > 1 group by doc_id),
c as (select w.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint as n_capitals,
        len(list_distinct(w))::bigint as n_distinct, (length(t) - length(regexp_replace(t, '[!-/:-@\[-`{-~]', '', 'g')))::bigint as n_punctuation,
        (length(t) - length(regexp_replace(t, '[.!?]', '', 'g')))::bigint as n_stops
      from w left join r using (doc_id))"""


def _quality_sql() -> str:
    k = len(RULES)
    cast = ", ".join(f"case when {r.bad} then -1 when {r.good} then 1 else 0 end" for r in RULES)
    parts = [
        _COUNTS.strip(),
        f"v as materialized (select *, [{cast}] as v from c)",
        "pats as materialized (select v, count(*)::double as n from v group by v)",
        f"long as materialized (select v as pat, n, j, v[j] as vote from pats, range(1, {k + 1}) as js(j))",
        f"w0 as materialized (select pat, max(n) as n, 1 / (1 + exp(-sum(case vote when -1 then {START[0]}::double when 0 then {START[1]}::double else {START[2]}::double end))) as w from long group by pat)",
    ]
    for i in range(1, ITERATIONS + 1):
        parts += [
            f"t{i} as materialized (select sum(n * w) as good, sum(n * (1 - w)) as bad from w{i - 1})",
            f"o{i} as materialized (select j, vote, ln(((sum(l.n * w) + {PSEUDO}) / (max(good) + {3 * PSEUDO})) / ((sum(l.n * (1 - w)) + {PSEUDO}) / (max(bad) + {3 * PSEUDO}))) as worth "
            f"from long l join w{i - 1} using (pat), t{i} group by j, vote)",
            f"w{i} as materialized (select l.pat, max(l.n) as n, 1 / (1 + exp(-(max(ln((good + {PSEUDO}) / (bad + {PSEUDO}))) + sum(worth)))) as w from long l join o{i} using (j, vote), t{i} group by l.pat)",
        ]
    return (
        "with " + ",\n".join(parts) + f"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed as base_failed, not failed and w >= 0.5 as kept, round(w, 4) as p_good
from (select v.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as failed from v) x join w{ITERATIONS} on x.v = pat
"""
    )


#: Of each string s of a table: crc, the unsigned CRC-32 of its UTF-8 bytes, by the table of its polynomial.
_CRC = """
tab as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
crcs as materialized (select s, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(s), (2 * i + 1)::bigint, 2))::bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint) as crc from strings, tab)"""

#: Every prefix of every rebuilt conversation; a node's savings and leaves go to all its prefixes.
_TRIE = f"""
with t as (select conv_id, turn, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) as k, length(coalesce(text, '')) as n from conversations where conv_id is not null),
o as (select conv_id, list({{'k': k, 'n': n}} order by turn nulls first, k) as own from t group by conv_id),
strings as (select distinct conv_id::varchar as s from o),{_CRC},
r as (select o.conv_id, coalesce(b.own[1:crc % 6], []) || o.own[crc % 6 + 1:] as seq
      from o join crcs on s = o.conv_id::varchar left join o as b on b.conv_id = o.conv_id - o.conv_id % 100),
p as (select conv_id, seq, unnest(range(0, len(seq) + 1)) as depth from r),
n as materialized (select seq[1:depth] as pre, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(seq) = depth), '') as ends from p group by 1, 2),
c as materialized (select pre[1:depth - 1] as pre, count(*) as n_children from n where depth > 0 group by 1),
s as (select pre[1:d] as pre, sum(case when depth > 0 then (n_convs - 1) * pre[depth].n else 0 end) as saved_tokens, sum(case when n_children is null then 1 else 0 end) as n_leaves
      from (select n.*, n_children, unnest(range(0, depth + 1)) as d from n left join c using (pre)) group by 1)
select n.conv_id, n.depth::bigint as depth, up.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves,
  saved_tokens::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from n join s using (pre) left join c using (pre) left join n as up on n.depth > 0 and up.pre = n.pre[1:n.depth - 1]
"""

_RESAMPLE = f"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as w from documents),
x as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as w from benchmark),
dw as materialized (select r, w, count(*) as k from (select r, unnest(w) as w from d) group by all),
xw as materialized (select w, count(*) as k from (select unnest(w) as w from x) group by all),
strings as (select w as s from dw union select w from xw),{_CRC},
sb as (select crc % 10000 as bucket, sum(k) as s from dw join crcs on s = w group by 1),
tb as (select crc % 10000 as bucket, sum(k) as t from xw join crcs on s = w group by 1),
g as (select range as bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from sb) + 10000)::double
        / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from tb) + 10000)::double)))::bigint as gain
      from range(10000) left join sb on sb.bucket = range left join tb on tb.bucket = range),
m as (select r, sum(k)::bigint as n, sum(k * gain)::bigint as total from dw join crcs on s = w join g on bucket = crc % 10000 group by r),
e as (select doc_id, coalesce(n, 0)::bigint as n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint::double as h from d left join m using (r)),
z as (select doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))))::bigint as score from e),
a as (select *, row_number() over (order by score desc, doc_id nulls last, n_features, weight) as place, count(*) over () as able from z where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= 10 * able // 100 then place end::bigint as rank from a
union all select doc_id, n_features, weight, score, null from z where n_features < 20
"""


def oracle_sql() -> dict[str, str]:
    """The others need trained models, tokenizers or a 64-bit hash that SQL lacks; tests hold them against brute force."""
    return {"op3_mixing": _MIXING, "op7_top_k": _TOP_K, "op9_quality_rules": _quality_sql(), "op10_sharding": _SHARDING, "op11_prefix_trie": _TRIE, "op12_importance_resampling": _RESAMPLE}
