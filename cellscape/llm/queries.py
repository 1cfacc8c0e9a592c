"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellscape.llm import bagminhash, bpe, decontamination, embeddings, filter_audit, licenses, mixing, quality, resampling, sharding, token_counts, toxicity, urls
from cellscape.llm.common import shared_folder, table


def op1_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(table(spark, sf_dir, "embeddings"))


def op3_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.fit_toxicity(docs, labels, where=~toxicity.held_out(F.col("doc_id")))
    return toxicity.score_toxicity(docs, field)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.unwanted_urls(pages), urls.RULES)


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op7_bpe_speculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_count_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), shared_folder(spark, "token_counts"))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bagminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).documents
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_decision_list": op1_decision_list,
    "op2_itq_dedup": op2_itq_dedup,
    "op3_crf_toxicity": op3_crf_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op6_hash_tree_shards": op6_hash_tree_shards,
    "op7_bpe_speculate": op7_bpe_speculate,
    "op8_token_count_cache": op8_token_count_cache,
    "op9_bagminhash": op9_bagminhash,
    "op10_entropy_mix": op10_entropy_mix,
    "op11_filter_audit": op11_filter_audit,
    "op12_prefix_contamination": op12_prefix_contamination,
    "op13_importance_resampling": op13_importance_resampling,
}

LISTED_SQL = ", ".join(f"'{x}'" for x in urls.UNWANTED_LABELS)
RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)

ORACLE: dict[str, str] = {
    "op5_url_filter": rf"""
with cut as (
    select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
parts as (
    select page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path,
        regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) query
    from cut),
named as (
    select page_id, host, path,
        regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(path, '(/|\.html)$', '') stem,
        array_to_string(list_sort(list_filter(string_split(query, '&'),
            lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))), '&') asked
    from parts),
pages2 as (select page_id, host, path, stem || case when asked <> '' then '?' || asked else '' end canonical from named),
unwanted as (
    select distinct canonical from pages2
    where len(list_filter(string_split(host, '.'), lambda x: x in ({LISTED_SQL}))) > 0),
rules(verdict, h, p) as (values {RULES_SQL}),
fits as (
    select distinct host, path, h || p as rule, verdict
    from (select distinct host, path from pages2) d join rules
        on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
best as (select host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) verdict from fits group by all)
select page_id, host, path, rule,
    coalesce(verdict, case when u.canonical is not null then 'block' else 'allow' end) verdict,
    u.canonical is not null listed
from pages2 left join best using (host, path) left join unwanted u using (canonical)
""",
    "op11_filter_audit": r"""
with counted as (
    select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
firsts as (select coalesce(text, '') t, min(doc_id) first from documents group by 1),
known as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by 1),
failed as (
    select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
        (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
        + (case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) then 4 else 0 end)
        + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when doc_id > first then 16 else 0 end) pattern
    from counted join firsts using (t) left join known using (doc_id)),
patterns as (select part, pattern, count(*) n, sum(good) good, sum(toxic) toxic from failed group by all),
letters(f, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
    select a.f || b.f || c.f || d.f || e.f filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] bits
    from letters a, letters b, letters c, letters d, letters e
    where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (
    select filter_order, step::int step, bits[step] own, list_sum(list_concat([0], bits[1:step - 1]))::int before
    from orders, range(1, 6) r(step)),
effects as (
    select part, filter_order, step, own,
        sum(case when pattern & (own | before) = 0 then n else 0 end)::bigint kept,
        sum(case when pattern & before = 0 and pattern & own <> 0 then n else 0 end)::bigint removed,
        sum(case when pattern & before <> 0 and pattern & own <> 0 then n else 0 end)::bigint redundant,
        sum(case when pattern = own then n else 0 end)::bigint unique_fails,
        sum(case when pattern & before = 0 and pattern & own <> 0 then good else 0 end)::bigint good_lost,
        sum(case when pattern & before = 0 and pattern & own <> 0 then toxic else 0 end)::bigint toxic_lost
    from patterns, steps group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, own))::bigint shapley
from effects
""",
    "op12_prefix_contamination": r"""
with item_words as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
windows as (
    select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') win
    from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from item_words where len(w) > 0)),
doc_words as (
    select row_number() over () k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
numbered as (select *, len(w) n_words from doc_words),
starts as (select k, w, n_words, unnest(range(1, n_words + 1)) i from numbered),
grams as (
    select k, i, n, array_to_string(w[i:i + n - 1], ' ') win
    from starts, (select distinct n from windows) where i + n - 1 <= n_words),
found as (select k, i, g.n, item_id from grams g join windows using (n, win)),
places as (select distinct k, unnest(range(i, i + n)) p from found),
hits as (select k, count(*) n_hit from places group by k),
listed as (
    select k, count(distinct item_id) n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') items from found group by k)
select doc_id, n_words::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
    sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from numbered left join hits using (k) left join listed using (k)
""",
}
