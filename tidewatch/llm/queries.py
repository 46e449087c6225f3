"""One query for each training-data operator, and the SQL of those that SQL can state."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import audit, crosstoken, decontaminate, neardup, packing, pii, sharding, squares, suffixdedup, toxicity, urlfilter, vectorjoin, warc
from tidewatch.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@query("op7_pii")
def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(table(spark, sf, "documents"))


OP4_SQL = r"""
with w as (
  select 'd' kind, doc_id id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents
  union all
  select 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), wi as (
  select distinct item_id, len(win) k, array_to_string(win, ' ') win from (
    select id item_id, ws[i:i + 12] win from (select id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) i from w where kind = 'i' and len(ws) > 0))
), ks as (select distinct k from wi), first_words as (select distinct split_part(win, ' ', 1) f, k from wi),
starts as (
  select id doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') win from (select id, ws, unnest(range(1, len(ws) + 1)) i from w where kind = 'd') p join first_words f on f.f = p.ws[p.i]
  where i + k - 1 <= len(ws)
), hits as (select doc_id, i, s.k, item_id from starts s join wi using (win)),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, i, k from hits)) group by 1),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item_id::varchar item from hits) group by 1)
select d.id doc_id, len(ws) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from w d left join words on d.id = words.doc_id left join its on d.id = its.doc_id where kind = 'd'
"""


@query("op4_decontaminate", OP4_SQL)
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op2_neardup")
def op2_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.digest(table(spark, sf, "documents"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.sharded(table(spark, sf, "documents"))


#: The contract's rules.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op8_url_templates")
def op8_url_templates(spark: SparkSession, sf: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf, "pages"), URL_RULES)


OP5_SQL = """
with p as (select page_id, coalesce(html, '') h from pages), d as (select page_id, strlen(h) payload_bytes, sha1(h) payload_digest from p),
g as (select *, max(page_id) over (partition by payload_digest) top from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 1000 and page_id < top then top end refers_to,
  case when payload_bytes >= 1000 and page_id < top then 1 else greatest(1, cast(ceil(payload_bytes / 65536.0) as bigint)) end n_chunks from g
"""


@query("op5_warc", OP5_SQL)
def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.digest(table(spark, sf, "pages"))


@query("op1_vectorjoin")
def op1_vectorjoin(spark: SparkSession, sf: str) -> DataFrame:
    return vectorjoin.digest(table(spark, sf, "embeddings"))


@query("op3_suffixdedup")
def op3_suffixdedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffixdedup.digest(table(spark, sf, "documents"))


@query("op12_bestfit")
def op12_bestfit(spark: SparkSession, sf: str) -> DataFrame:
    return squares.digest(table(spark, sf, "documents"))


#: In the SQL a document's failures are a string of its letters; p runs over the orders, k over their steps.
OP11_SQL = r"""
with t as (select doc_id, coalesce(source, '') part, coalesce(text, '') text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') ws, min(doc_id) over (partition by text) low from t),
f as (select doc_id, part, case when len(ws) < 50 then 'A' else '' end || case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 'B' else '' end
  || case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) then 'C' else '' end
  || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when low < doc_id then 'E' else '' end fails from w),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by 1),
c as (select part, fails, count(*) n, count(*) filter (good) g, count(*) filter (toxic) t from f left join l using (doc_id) group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) x), p as (select a.x || b.x || c.x || d.x || e.x filter_order from x a, x b, x c, x d, x e
  where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
s as (select filter_order, k::int step, filter_order[k] letter, filter_order[:k - 1] before from p, range(1, 6) r(k)),
h as (select c.*, s.*, contains(fails, letter) fail, k.gone from c, s, lateral (select before <> '' and regexp_matches(fails, '[' || before || 'Z]') gone) k)
select part, filter_order, step, coalesce(sum(n) filter (not gone and not fail), 0)::bigint kept, coalesce(sum(n) filter (not gone and fail), 0)::bigint removed,
  coalesce(sum(n) filter (gone and fail), 0)::bigint redundant, coalesce(sum(n) filter (fails = letter), 0)::bigint unique_fails,
  coalesce(sum(g) filter (not gone and fail), 0)::bigint good_lost, coalesce(sum(t) filter (not gone and fail), 0)::bigint toxic_lost,
  coalesce(sum(n * 120 // greatest(len(fails), 1)) filter (fail), 0)::bigint shapley from h group by all
"""


@query("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op13_crosstoken")
def op13_crosstoken(spark: SparkSession, sf: str) -> DataFrame:
    return crosstoken.digest(table(spark, sf, "documents"))
