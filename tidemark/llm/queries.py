"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (centroids, chat_format, decontaminate, divergence, exact_dedup, mixing, near_dedup, quality, repeats, tokens,
                          toxicity, url_filter)
from tidemark.llm.common import read_table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), extra={"text_sha256": digest})


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.page_outcomes(pages, read_table(spark, sf_dir, "labels")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate_perspectives(read_table(spark, sf_dir, "conversations"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read_table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_decontaminate, op3_bpe_codec, op4_toxicity, op5_token_counts, op6_url_filter,
                            op7_near_dedup, op8_quality, op9_suffix_dedup, op10_chat_format, op11_source_audit, op12_source_mixing,
                            op13_centroid_clustering, pipeline)}



def _clustering_sql(rounds: int = centroids.ROUNDS, k: int = centroids.CENTROIDS, dims: int = centroids.DIMS) -> str:
    """Lloyd's rounds written out: a table of (number, component, value) of the centroids for each round."""
    def assign(i: int) -> str:
        return f"""
        d{i} as materialized (
          select row, j, sum((x - c) * (x - c))::bigint as s from cells join c{i} using (d) group by row, j),
        a{i} as materialized (select row, arg_min(j, (s, j)) as j, min(s) as s from d{i} group by row)"""
    steps = ["""
        kept as materialized (
          select row_number() over () as row, vec_id, list_transform(embedding, lambda v: floor(256 * v::double)::bigint) as x from embeddings
          where len(embedding) = %d and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = %d),
        cells as materialized (select row, unnest(x) as x, unnest(range(%d)) as d from kept),
        c0 as materialized (
          select row_number() over (order by h, v) - 1 as j, unnest(v) as c, unnest(range(%d)) as d
          from (select sha256('2:' || coalesce(vec_id::varchar, '')) as h, x as v from kept order by h, v limit %d))"""
             % (dims, dims, dims, dims, k)]
    for i in range(rounds):
        steps += [assign(i), f"""
        m{i} as materialized (
          select j, d, floor_div(sum(x)::hugeint, count(*)) as c from a{i} join cells using (row) group by j, d),
        c{i + 1} as materialized (
          select j, d, coalesce(m{i}.c, c{i}.c)::bigint as c from c{i} left join m{i} using (j, d))"""]
    steps += [assign(rounds), f"""
        named as materialized (select j, sha256(string_agg(c::varchar, ',' order by d)) as centroid_sha256 from c{rounds} group by j)"""]
    return "with " + ",".join(steps).replace("floor_div(sum(x)::hugeint, count(*))", _FLOOR) + f"""
        select vec_id, j::int as cluster, s as distance, (sum(s) over (partition by j))::bigint as cluster_inertia,
               (sum(s) over ())::bigint as inertia, centroid_sha256
        from a{rounds} join kept using (row) join named using (j)"""


#: Integer division of DuckDB cuts towards zero.
_FLOOR = "(sum(x)::hugeint // count(*) - (sum(x)::hugeint % count(*) < 0)::int)"

ORACLE: dict[str, str] = {
    "op11_source_audit": f"""
        with terms as (
          select coalesce(lang, '') as lang, coalesce(source, '') as source,
                 regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'),
                                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
        kept as (
          select lang, term from (select lang, unnest(list_distinct(t)) as term from terms) group by all having count(*) >= 30),
        occ as (
          select lang, source, term, count(*) as c
          from (select lang, source, unnest(t) as term from terms) semi join kept using (lang, term) group by all),
        groups as (select distinct lang, source from terms),
        sizes as (
          select lang, source, coalesce(sum(c), 0)::hugeint as n, (select count(*) from kept k where k.lang = g.lang)::hugeint as v
          from groups g left join occ using (lang, source) group by all),
        shares as (
          select lang, source, term, coalesce(c, 0) as c, 1 + 1000000000::hugeint * (coalesce(c, 0) + 5) // (n + 5 * v) as p
          from sizes join kept using (lang) left join occ using (lang, source, term)),
        whole as (
          select lang, term, 1 + 1000000000::hugeint * (sum(c) + 5)::hugeint // ((sum(sum(c)) over (partition by lang)
                 + 5 * count(*) over (partition by lang))::hugeint) as p from occ group by lang, term),
        pairs as (
          select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value
          from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
                     from shares x join shares y on x.lang = y.lang and x.term = y.term group by all) s
            on s.lang = a.lang and s.source = a.source and s.item = b.source),
        marks as (
          select s.lang, s.source, s.term as item, (s.p - w.p)::bigint as value
          from shares s join whole w using (lang, term) where s.c > 0 and s.p > w.p)
        select lang, source, 'pair' as part, item, value,
               row_number() over (partition by lang, source order by value desc, encode(item))::int as rank from pairs
        union all
        select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, encode(item))::int as rank
        from marks qualify rank <= 50""",
    "op13_centroid_clustering": _clustering_sql(),
    "op1_exact_dedup": """
        select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
               count(*) over (partition by coalesce(text, '')) as group_size,
               doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents""",
    "op6_url_filter": f"""
        with split as (
          select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
          from pages),
        parts as (
          select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from split),
        ruled as (
          select *, case
            when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
            when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
            when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
            when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule,
            try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:/|\\.html)?$', 1), '') as bigint) as doc
          from parts),
        marks as (select doc_id, min(quality) as q from labels where doc_id is not null and quality is not null group by 1),
        hosts as (
          select host, string_split(host, '.') as s, count(*)::double as n, sum((q = 0)::int)::double as k
          from ruled join marks on doc = doc_id group by 1),
        named as (
          select host, n, k, array_to_string(s[-2:], '.') as domain, s[-1] as suffix from hosts),
        overall as (select (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) as m from named),
        l1 as (select suffix, sum(n) as n, sum(k) as k, (select m from overall) as m from named group by 1),
        t1 as (select sum((k - n*m) * (k - n*m) - n*m*(1-m)) as a, sum(n*(n-1)*m*(1-m)) as b from l1),
        s1 as (select case when coalesce(b, 0) = 0 or a <= 0 then 1000.0 else least(1000.0, greatest(1.0, b/a - 1)) end as t from t1),
        p1 as (select suffix, (k + t*m) / (n + t) as m from l1, s1),
        l2 as (select d.*, p1.m from (select domain, suffix, sum(n) as n, sum(k) as k from named group by 1, 2) d join p1 using (suffix)),
        t2 as (select sum((k - n*m) * (k - n*m) - n*m*(1-m)) as a, sum(n*(n-1)*m*(1-m)) as b from l2),
        s2 as (select case when coalesce(b, 0) = 0 or a <= 0 then 1000.0 else least(1000.0, greatest(1.0, b/a - 1)) end as t from t2),
        p2 as (select domain, (k + t*m) / (n + t) as m from l2, s2),
        l3 as (select named.host, n, k, p2.m from named join p2 using (domain)),
        t3 as (select sum((k - n*m) * (k - n*m) - n*m*(1-m)) as a, sum(n*(n-1)*m*(1-m)) as b from l3),
        s3 as (select case when coalesce(b, 0) = 0 or a <= 0 then 1000.0 else least(1000.0, greatest(1.0, b/a - 1)) end as t from t3),
        p3 as (select host, (k + t*m) / (n + t) as r, n + t + 1 as w from l3, s3),
        bad as (select host from p3 where r - {url_filter.QUANTILE} * sqrt(r * (1 - r) / w) > {url_filter.MAX_BAD})
        select page_id, host, path, rule,
               case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
                    when host in (select host from bad) then 'block' else 'allow' end as verdict
        from ruled""",
    "op10_chat_format": """
        with turns as (
          select conv_id, turn, coalesce(role, 'unknown') as who,
                 replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') as body
          from conversations),
        people as (select distinct conv_id, who as perspective from turns where who <> 'system'),
        seen as (
          select t.conv_id, p.perspective, t.turn, t.who as speaker, t.body, t.who = p.perspective as loss_mask,
                 case when t.who = p.perspective then 'assistant' when t.who = 'system' then 'system' else 'user' end as role,
                 case when t.who <> p.perspective and t.who <> 'system' then
                   regexp_replace(replace(replace(t.who, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>'),
                                  '[\\x00-\\x1F\\x7F\\x{85}\\x{2028}\\x{2029}=]', '_', 'g') end as name
          from turns t join people p on t.conv_id is not distinct from p.conv_id),
        opened as (
          select *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) as opening from seen)
        select conv_id, perspective, turn, speaker, role, name, opening || body || '<|im_end|>' || chr(10) as segment,
               loss_mask, case when loss_mask then length(opening) end as mask_start,
               case when loss_mask then length(opening) + length(body) + 10 end as mask_end
        from opened""",
}
