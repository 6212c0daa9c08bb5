"""The queries opN_<name>: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, embeddings, langid, packing, pii, quality, simhash, tokens, toxicity, warc
from helixframe.llm.common import held_out, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)
    return captures.select(
        F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1).try_cast("bigint").alias("page_id"),
        F.col("main.payload_bytes").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        F.when(F.col("main.type") == "revisit", F.regexp_extract("main.refers_to", r"^urn:capture:response:(-?\d+):", 1).cast("bigint")).alias("refers_to"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), window=2048, end_id=1)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans", (F.size("found") - sum(F.col(f"n_{k}") for k in pii.KINDS)).alias("n_added"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.samples(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.predict(rows, learned).drop("text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, tokenizer("byte_bpe_50k.json"), limit=1024)


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings: 0 low quality, 1 good but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality.training_rows(docs, grades(table(spark, sf_dir, "labels")))
    model = quality.fit([t for t, _ in rows], [g for _, g in rows])
    return quality.classify(docs, model)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.training_rows(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, toxicity.fit([t for t, _ in rows], [y for _, y in rows]))


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_packing, op3_pii, op4_language, op5_decontamination, op6_token_counts, op7_quality, op8_embeddings, op9_simhash, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op8_embeddings": OP8}


#: All pairs, then the smallest number reachable.
OP8 = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
near as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  and list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95),
reach(node, seen) as (select vec_id, vec_id from embeddings union select r.node, n.b from reach r join near n on r.seen = n.a),
low as (select node, min(seen) as component_id from reach group by node),
n as (select a, count(*) as k from near group by a)
select vec_id, coalesce(k, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join low on vec_id = node left join n on vec_id = a
"""

#: Base32 by twenty bits at a time: four letters for each five hex digits of the digest.
OP1 = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, strlen(html) as n, h, list_aggregate(list_transform(generate_series(0, 31), lambda i:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || h[1 + 5 * (i // 4) : 5 + 5 * (i // 4)])::bigint >> (15 - 5 * (i % 4))) & 31)::int]), 'string_agg', '') as b32 from p),
m as (select h as mh, max(page_id) as top from d group by h)
select page_id, n::bigint as payload_bytes, b32 as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to from d join m on h = mh
"""
