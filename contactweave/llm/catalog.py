"""One query for each text operator over the given tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from contactweave.llm import chat, fill_middle, fingerprint, gam, lm_score, near_dedup, packing, pii, piece_codec, prefix_trie, quality_rules, secret_scan, simhash
from contactweave.llm.common import documents, labels
from contactweave.plans.storage import materialize


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return fingerprint.fingerprints(docs, fingerprint.band_mask(docs))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality_rules.learn(docs, labels(spark, sf_dir))
    return quality_rules.judge(docs, rules)


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.digest(pii.spans(docs, pii.disclosing_terms(docs)))


def op4_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return gam.score(docs, gam.learn(docs, labels(spark, sf_dir)))


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op6_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(documents(spark, sf_dir))


def op7_confirmed_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir)))


def op8_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_piece_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trips(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, chat.USER).otherwise(chat.ASSISTANT).alias("role"),
        F.lit(said).alias("text"),
    )
    trees = chat.from_turns(given.unionByName(extra))
    return chat.read_back(chat.conversations_of(chat.best_paths(trees)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_byte_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op13_frame_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(fill_middle.store(documents(spark, sf_dir)), "frames")
    return fill_middle.digest(fill_middle.transform(stored))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_imatch_fingerprints,
        op2_decision_list,
        op3_disclosure,
        op4_gam_quality,
        op5_minmax_dedup,
        op6_trie_scores,
        op7_confirmed_secrets,
        op8_bin_completion,
        op9_piece_round_trips,
        op10_reply_trees,
        op11_prefix_trie,
        op12_byte_positions,
        op13_frame_middles,
    )
}

_OP5 = r"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as s
  from texts
), sizes as (
  select d.doc_id, count(s.s) as n from documents d left join shingles s using (doc_id) group by d.doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n_shared
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * n_shared >= 85 * (x.n + y.n - n_shared)
), edges as (select a as u, b as v from links union all select b, a from links
), reach(node, root) as (
  select doc_id, doc_id from documents
  union
  select e.v, r.root from reach r join edges e on e.u = r.node where r.root < e.v
)
select s.doc_id, s.n as n_shingles, min(r.root) as component_id, min(r.root) = s.doc_id as kept
from sizes s join reach r on r.node = s.doc_id group by s.doc_id, s.n
"""

_OP10 = r"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8
    + case role when 'assistant' then 7 when 'user' then 13 when 'system' then 15 else 20 + length(role) end as formatted
  from given
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(formatted) as bigint) as formatted_chars
from sized group by conv_id
"""

_OP11 = r"""
with recursive steps(i, v, k) as (
  select i, cast(i as bigint), 0 from range(256) t(i)
  union all
  select i, case when v & 1 = 1 then xor(3988292384, v >> 1) else v >> 1 end, k + 1 from steps where k < 8
), crc_table as (select list(v order by i) as t from steps where k = 8
), given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), turns as (
  select conv_id, length(text) as chars, md5(length(role) || ':' || role || text) as name,
    row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text)) as r
  from given
), sizes as (select conv_id, count(*) as n from turns group by conv_id
), crc(conv_id, s, p, c) as (
  select conv_id, cast(conv_id as varchar), 1, 4294967295 from sizes
  union all
  select conv_id, s, p + 1, xor((select t from crc_table)[cast(xor(c, ascii(s[p])) & 255 as int) + 1], c >> 8) from crc where p <= length(s)
), plan as (
  select z.conv_id, z.conv_id - z.conv_id % 100 as head, xor(c, 4294967295) % 6 as h, least(xor(c, 4294967295) % 6, coalesce(b.n, 0)) as shared
  from crc join sizes z using (conv_id) left join sizes b on b.conv_id = z.conv_id - z.conv_id % 100 where p = length(s) + 1
), rebuilt as (
  select conv_id, 0 as depth, '' as name, 0 as chars from plan
  union all
  select p.conv_id, r, name, chars from plan p join turns t on t.conv_id = p.head where r <= shared
  union all
  select p.conv_id, r - h + shared, name, chars from plan p join turns t on t.conv_id = p.conv_id where r > h
), prefixes as (
  select *, list(name) over (partition by conv_id order by depth) as k, depth = max(depth) over (partition by conv_id) as ended from rebuilt
), nodes as (
  select k, depth, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ended), '')) as ends_sha256
  from prefixes group by k, depth
), children as (select k[:len(k) - 1] as k, count(*) as n from nodes where depth > 0 group by 1
), counted as (
  select n.*, coalesce(c.n, 0) as n_children from nodes n left join children c on c.k = n.k
), subtrees as (
  select k[:d + 1] as k, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * chars) as saved
  from (select *, unnest(range(0, depth + 1)) as d from counted) group by 1
)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
  cast(s.saved as bigint) as saved_tokens, n.ends_sha256
from counted n join subtrees s on s.k = n.k left join nodes p on n.depth > 0 and p.k = n.k[:len(n.k) - 1]
"""

_OP13 = r"""
with given as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), drawn as (
  select doc_id, t, n, cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as c1, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as c2,
    cast('0x' || substr(h, 17, 8) as bigint) % 100 as d3, cast('0x' || substr(h, 25, 8) as bigint) % 100 as d4
  from given
), formed as (
  select doc_id, t, n, least(c1, c2) as a, greatest(c1, c2) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or d3 >= 90 then 'plain' when d4 < 20 then 'spm' else 'psm' end as form
  from drawn
), parts as (
  select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from formed
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""

ORACLE = {"op5_minmax_dedup": _OP5, "op10_reply_trees": _OP10, "op11_prefix_trie": _OP11, "op13_frame_middles": _OP13}
