"""One query per operator, over whole tables, and its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinprep.llm import (decontaminate, fingerprints, jaccard, language, lines, mixing, negatives, packing, secrets, substrings, tokens, toxicity,
                          whitening)
from clinprep.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op8_mix_sources", mixing.oracle())
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(load(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.drop("copies")


@query("op2_decontaminate", r"""
with words as (
  select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select item, list_aggregate(w[i:i + 9], 'string_agg', ' ') as win
  from (select item, w, unnest(range(1, greatest(2, len(w) - 8))) as i from words where len(w) > 0)),
docs as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), cast([] as varchar[])) as w from documents),
sizes as (select distinct len(string_split(win, ' ')) as k from windows),
grams as (
  select doc_id, i, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') as win
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from docs, sizes where len(w) >= k)),
hits as (select doc_id, i, k, item from grams join windows using (win)),
per_word as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by 1),
per_item as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from hits group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join per_word using (doc_id) left join per_item using (doc_id)""")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs), keep=["doc_id"])
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


#: Base spans only; the layers that the operator adds are beyond SQL.
@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(load(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["depth"] == 0)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(joined(plain), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), "n_layers")


@query("op7_pack_tokens")
def op7_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_trial(load(spark, sf_dir, "documents"))


@query("op5_substring_dedup", r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), cast([] as varchar[])) as w from documents),
win as (
  select doc_id, i, list_aggregate(w[i:i + 34], 'string_agg', ' ') as k
  from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
often as (select k from win group by k having count(*) > 1),
gone as (select doc_id, list(distinct p) as p from (
  select doc_id, unnest(range(i, i + 35)) as p from win where k in (select k from often)) group by 1),
j as (select doc_id, w, coalesce(p, cast([] as bigint[])) as p from d left join gone using (doc_id))
select doc_id, len(w)::bigint as n_words, len(p)::bigint as n_removed,
  sha256(coalesce((select string_agg(w[x], ' ' order by x) from (select unnest(range(1, len(w) + 1)) as x) where not list_contains(p, x)), '')) as kept_sha256
from j""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"))


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(load(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


@query("op12_hard_negatives", """
with fit as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label as kind, b.vec_id as other, b.label,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from fit a join fit b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positive as (
  select anchor_id, kind, other as positive_id, score as positive_score from scored where label = kind
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, p.positive_id,
       (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other))::int as rank,
       s.other as negative_id, p.positive_score, s.score as negative_score
from positive p join scored s on s.anchor_id = p.anchor_id
where s.label <> p.kind and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify rank <= 5""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, load(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "score", "predicted", "n_matches")
