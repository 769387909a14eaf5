"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from harborlight.llm import (
    conversations, decontaminate, jaccard, languages, periodic, personal, sentencepieces, substrings, token_counts, token_files,
    toxicity, urls, vectors,
)
from harborlight.llm.common import table
from harborlight.session import shared_folder

#: Vocabulary files, and the id that ends a document in token files.
PIECES, BYTE_PAIRS, END_ID = "piece_bpe_32k.model", "byte_bpe_50k.json", 2
#: Documents of more tokens are over the limit.
TOKEN_LIMIT = 1024


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeated(table(spark, sf_dir, "documents")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(sentencepieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.digest(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_files.write_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_PAIRS), END_ID)
    return token_files.digest(token_files.read_documents(blocks))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(
        decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    )


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(personal.find_personal(table(spark, sf_dir, "documents")))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(urls.judge_urls(table(spark, sf_dir, "pages")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begins with an empty cache, so that it always encodes each different text once."""
    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts.digest(token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_PAIRS), cache), TOKEN_LIMIT)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.digest(given, conversations.repair(conversations.damage(given)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(table(spark, sf_dir, "documents"), periodic.stuttered))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_ngram_jaccard_join, op3_sentencepiece, op4_language_id, op5_token_files, op6_decontamination,
        op7_embedding_near_dedup, op8_personal_data, op9_url_filters, op10_toxicity,
        op11_token_counts, op12_conversation_repair, op13_periodic_runs,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op9_url_filters": r"""
with u as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u
), p as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h
), l as (
  select *, case when ('.' || host) like '%.example.org' and starts_with(path, '/en/1') then 'example.org/en/1'
    when ('.' || host) like '%.example.org' and starts_with(path, '/es/') then 'example.org/es/'
    when ('.' || host) like '%.com' and starts_with(path, '/fr/') then 'com/fr/'
    when ('.' || host) like '%.com' and starts_with(path, '/de/') then 'com/de/'
    when ('.' || host) like '%.org' and starts_with(path, '/') then 'org/' end as rule,
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '{n}', 'g')) as tokens
  from p
), c as (
  select host, tokens, count(*) filter (where rule in ('example.org/en/1', 'example.org/es/', 'com/de/')) as blocked, count(rule) as labelled
  from l group by host, tokens
), n as (
  select host, tokens, i, tokens[i] as child, tokens[1:i - 1] as parent from (select host, tokens, unnest(generate_series(1, len(tokens))) as i from c)
), v as (
  select host, parent from n group by host, parent having count(distinct child) >= 12 and count(distinct child) >= 2e-1 * count(*)
), t as (
  select n.host, n.tokens, list(case when v.host is null then n.child else '*' end order by i) as template
  from n left join v on n.host = v.host and n.parent = v.parent group by n.host, n.tokens
), f as (
  select c.*, coalesce(template, []::varchar[]) as template, coalesce(template[1:greatest(len(template) - 1, 0)], []::varchar[]) as parent
  from c left join t on c.host = t.host and c.tokens = t.tokens
), bt as (
  select host, parent, template, sum(blocked)::double as b, sum(labelled)::double as k from f group by host, parent, template
), bh as (
  select host, (sum(b) + 5e0 * 5e-1) / (sum(k) + 5e0) as share from bt group by host
), bp as (
  select bt.host, parent, (sum(b) + 5e0 * any_value(bh.share)) / (sum(k) + 5e0) as share from bt join bh using (host) group by bt.host, parent
), j as (
  select bt.host, bt.template,
    case when k > 0 and abs(b / k - bp.share) > 1.5e0 * sqrt(bp.share * (1 - bp.share) / greatest(k, 1)) then (b + 5e0 * bp.share) / (k + 5e0)
      else bp.share end as share
  from bt join bp on bt.host = bp.host and bt.parent = bp.parent
)
select page_id, l.host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when share >= 7e-1 then 'block' else 'allow' end as verdict,
  '/' || array_to_string(f.template, '/') as template
from l join f on l.host = f.host and l.tokens = f.tokens join j on f.host = j.host and f.template = j.template""",
    "op1_substring_dedup": r"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select rid, unnest(generate_series(1, len(w) - 34)) as i, w from d where len(w) >= 35
), h as (
  select rid, i, sha256(array_to_string(w[i:i + 34], ' ')) as h from s
), r as (
  select rid, i from h where h in (select h from h group by h having count(*) > 1)
), p as (
  select rid, unnest(generate_series(1, len(w))) as i, unnest(w) as word from d where len(w) > 0
), g as (
  select p.rid, p.i, p.word,
    max(r.i) over (partition by p.rid order by p.i rows between 34 preceding and current row) is not null as gone
  from p left join r on p.rid = r.rid and p.i = r.i
), k as (
  select rid, count(*) as n_words, count(*) filter (where gone) as n_removed,
    string_agg(word, ' ' order by i) filter (where not gone) as kept
  from g group by rid
)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k on d.rid = k.rid
""",
    "op2_ngram_jaccard_join": rf"""
with recursive d as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from d where len(w) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), o as (
  select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), l as (
  select a, b from o join n x on o.a = x.doc_id join n y on o.b = y.doc_id where 100 * o >= 80 * (x.n + y.n - o)
), e as (
  select a, b from l union all select b, a from l
), c as (
  select doc_id as node, doc_id as root from d union select e.b, c.root from c join e on c.node = e.a
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id
from d left join n using (doc_id) join (select node, min(root) as component_id from c group by node) m on m.node = d.doc_id
""",
    "op6_decontamination": rf"""
with b as (
  select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), p as (
  select distinct item, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)
), d as (
  select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), o as (
  select rid, i, size, item from (
    select rid, size, w, unnest(generate_series(1, len(w) - size + 1)) as i
    from d, (select distinct size from p) where len(w) >= size
  ) join p using (size) where array_to_string(w[i:i + size - 1], ' ') = g
), h as (
  select rid, count(distinct i + k) as n_hit from (select rid, i, unnest(generate_series(0, size - 1)) as k from o) group by rid
), t as (
  select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from o group by rid
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (rid) left join t using (rid)
""",
    "op7_embedding_near_dedup": """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
  where list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9
), c as (
  select vec_id as node, vec_id as root from v union select l.b, c.root from c join l on c.node = l.a
)
select vec_id, (select count(*) from l where l.a = vec_id) as n_links, min(root) as component_id, vec_id = min(root) as kept
from v join c on node = vec_id group by vec_id
""",
}
