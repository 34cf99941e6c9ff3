"""The thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import chat, decontam, extract, hilbert, langid, pieces, quality, secrets, simhash, toxicity
from lodestar.llm.common import read_table

OP1_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents")).select(*OP1_COLUMNS)


OP1_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents
), w as (
  select rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from d
), tok as (
  select rid, unnest(words) as word, unnest(range(len(words))) as pos, len(words) as n from w
), tri as (
  select rid, pos, word || ' ' || lead(word) over (partition by rid order by pos) || ' ' || lead(word, 2) over (partition by rid order by pos) as g, n from tok
), rep as (
  select rid, pos, count(*) over (partition by rid, g) as c from tri where pos + 2 < n
), hit as (
  select rid, count(distinct p) as n_repeat_words from (select rid, unnest([pos, pos + 1, pos + 2]) as p from rep where c > 1) group by rid
), ln as (
  select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select rid, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid
), f as (
  select d.rid, doc_id, lang, source, len(words)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines
  from d join w using (rid) left join hit using (rid) left join ln using (rid)
), r as (
  select *, n_symbols * 10000 // greatest(n_words, 1) as sym_bp, n_dup_lines * 10000 // greatest(n_lines, 1) as dup_bp,
    n_repeat_words * 10000 // greatest(n_words, 1) as rep_bp, word_chars * 100 // greatest(n_words, 1) as len_pc,
    (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed
  from f
), v as (
  select lang, source, unnest(['sym_bp', 'dup_bp', 'rep_bp', 'len_pc']) as metric, unnest([sym_bp, dup_bp, rep_bp, len_pc]) as v from r where not base_failed
), b as (
  select lang, source, metric, (v >> greatest(length(bin(v)) - 7, 0)::bigint) << greatest(length(bin(v)) - 7, 0)::bigint as bin from v
), s as (
  select 0 as level, lang, source, metric, bin, count(*) as n from b group by all
  union all select 1, lang, null, metric, bin, count(*) from b group by lang, metric, bin
  union all select 2, null, null, metric, bin, count(*) from b group by metric, bin
), c as (
  select *, sum(n) over (partition by level, lang, source, metric) as total, sum(n) over (partition by level, lang, source, metric order by bin) as cum from s
), q as (
  select level, lang, source, metric, max(total) as total, min(bin) filter (20 * cum >= 2 * total) as p10, min(bin) filter (20 * cum >= 5 * total) as p25,
    min(bin) filter (20 * cum >= 10 * total) as p50, min(top) filter (20 * cum >= 15 * total) as p75, min(top) filter (20 * cum >= 18 * total) as p90
  from (select *, bin + (1::bigint << greatest(length(bin(bin)) - 7, 0)::bigint) - 1 as top from c) group by all
), z as (
  select g.lang, g.source, g.metric, g.total >= 50 as own, l.total >= 50 as mid,
    case when own then g.p25 when mid then l.p25 else a.p25 end as p25, case when own then g.p75 when mid then l.p75 else a.p75 end as p75,
    case when mid then l.p90 - l.p50 else a.p90 - a.p50 end as above, case when mid then l.p50 - l.p10 else a.p50 - a.p10 end as below,
    case when mid then l.p10 else a.p10 end as p10, case when mid then l.p90 else a.p90 end as p90
  from q g join q l on l.level = 1 and l.lang is not distinct from g.lang and l.metric = g.metric join q a on a.level = 2 and a.metric = g.metric where g.level = 0
), e as (
  select lang, source, metric, greatest(p75 + 3 * greatest(p75 - p25, above), case when metric = 'len_pc' then p90 end, 0) as hi, greatest(least(p25 - 3 * greatest(p75 - p25, below), p10), 0) as lo from z
), x as (
  select r.*, metric, case metric when 'sym_bp' then n_symbols when 'dup_bp' then n_dup_lines when 'rep_bp' then n_repeat_words else word_chars end::double / case metric when 'rep_bp' then 6.0::double else 1.0::double end as seen,
    (case metric when 'dup_bp' then n_lines else n_words end * hi)::double / case metric when 'rep_bp' then 60000.0::double when 'len_pc' then 100.0::double else 10000.0::double end as most,
    (n_words * lo)::double / 100.0::double as least
  from r left join e on e.lang is not distinct from r.lang and e.source is not distinct from r.source
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and bool_and(coalesce(seen <= most + 3.0::double * sqrt(most + 1.0::double) and (metric <> 'len_pc' or seen >= least - 3.0::double * sqrt(least + 1.0::double)), true)) as kept
from x group by rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
"""


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_rows(read_table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
with t as (
  select conv_id, case when conv_id is null then row_number() over () end as apart, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations
), c as (
  select conv_id, apart, list({'role': role, 'text': text} order by turn nulls first, role, text) as ts from t group by conv_id, apart
), a as (
  select *, case when conv_id is not null then lag(conv_id) over (partition by apart, ts[1] order by conv_id) end as prior,
    list_filter(range(1, len(ts) + 1), lambda i: ts[i].role = 'assistant') as answers from c
), e as (
  select *, answers[(len(answers) + 1) // 2] as mid from a
), p as (
  select e.conv_id, e.ts as c, case when o.ts is not null then o.ts when e.mid is null then e.ts
    else e.ts[1 : e.mid - 1] || [{'role': 'assistant', 'text': case when e.mid > 1 then e.ts[e.mid - 1].text else '' end}] end as r
  from e left join c o on o.conv_id = e.prior
), k as (
  select *, coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])[1] - 1, least(len(c), len(r))) as k from p
), m as (
  select conv_id, k, list_transform(c[1 : k], lambda x: '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10) || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)) as p,
    list_transform(c[k + 1 :], lambda x: {'role': x.role, 'head': '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10), 'body': replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)}) as c,
    list_transform(r[k + 1 :], lambda x: {'role': x.role, 'head': '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10), 'body': replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)}) as r
  from k
), s as (
  select *, list_transform(c, lambda x: length(x.head) + length(x.body)) as cn, list_transform(r, lambda x: length(x.head) + length(x.body)) as rn from m
)
select conv_id, k::integer as n_prompt_turns, coalesce(array_to_string(p, ''), '') as prompt,
  coalesce(array_to_string(list_transform(c, lambda x: x.head || x.body), ''), '') as chosen,
  coalesce(array_to_string(list_transform(r, lambda x: x.head || x.body), ''), '') as rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: (list_sum(cn[1 : i])::bigint - length(c[i].body))::varchar || ':' || (list_sum(cn[1 : i])::bigint)::varchar), ','), '') as chosen_loss,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: (list_sum(rn[1 : i])::bigint - length(r[i].body))::varchar || ':' || (list_sum(rn[1 : i])::bigint)::varchar), ','), '') as rejected_loss
from s
"""

OP4_COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select(*OP4_COLUMNS)


OP4_SQL = r"""
with dw as (
  select row_number() over () as rid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from documents
), iw as (
  select row_number() over () as item, item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from benchmark
), win as (
  select distinct item_id, least(len(ws), 10) as k, array_to_string(ws[s + 1 : s + least(len(ws), 10)], ' ') as g
  from (select item_id, ws, unnest(range(len(ws) - least(len(ws), 10) + 1)) as s from iw where len(ws) > 0)
), pos as (
  select rid, ws, unnest(range(len(ws))) as p from dw
), grams as (
  select rid, p, k, array_to_string(ws[p + 1 : p + k], ' ') as g from pos, (select distinct k from win) where p + k <= len(ws)
), met as (
  select rid, p, k, item_id from grams join win using (k, g)
), hit as (
  select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + k)) as q from met) group by rid
), its as (
  select rid, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from met group by rid
), tok as (
  select rid, p, ws[p + 1] as w from pos
), cnt as (
  select w, count(*) as n from tok group by w
), it as (
  select item, item_id, ws[off + 1] as w, off, len(ws) as l from (select item, item_id, ws, unnest(range(len(ws))) as off from iw)
), bl as (
  select item, item_id, w, off, n, unnest(list_distinct(list_concat(range(0, greatest(l - 9, 1), 10), [greatest(l - 10, 0)]))) as s from it join cnt using (w)
), rk as (
  select *, row_number() over (partition by item, s order by n, off) as r from bl where off >= s and off < s + 10
), rare as (
  select *, count(*) over (partition by item, s) as of_ from rk where r <= 4
), al as (
  select distinct rid, item, item_id, s, r, of_, p - off as beg from rare join tok using (w)
), full_ as (
  select l.rid, l.item_id from al l join al o on o.rid = l.rid and o.item = l.item and o.s = l.s and abs(o.beg - l.beg) <= 5
  where l.r <= 2 and (o.r <> l.r or o.beg = l.beg) group by l.rid, l.item, l.item_id, l.s, l.r, l.of_, l.beg having count(distinct o.r) >= case when l.of_ = 4 then 3 else l.of_ end
), nr as (
  select rid, count(distinct item_id) as n_near from full_ group by rid
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
from dw left join hit using (rid) left join its using (rid) left join nr using (rid)
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(found["fp"]).alias("fingerprint"), "component_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read_table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(read_table(spark, sf_dir, "documents"))


def op10_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hilbert.plan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_langid": op2_langid,
        "op3_chat": op3_chat,
        "op4_decontam": op4_decontam,
        "op5_simhash": op5_simhash,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_toxicity": op7_toxicity,
        "op8_extract": op8_extract,
        "op9_secrets": op9_secrets,
        "op10_hilbert": op10_hilbert,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": OP1_SQL, "op3_chat": OP3_SQL, "op4_decontam": OP4_SQL}
