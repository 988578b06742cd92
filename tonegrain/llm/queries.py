"""Registered queries of the corpus operators: thin wrappers that give the agreed columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrain.llm import (
    clusters,
    embed_dup,
    licenses,
    lm_score,
    mixing,
    near_dup,
    packing,
    phrases,
    pii,
    quality,
    toxicity,
    url_rules,
    warc,
)
from tonegrain.llm.common import fold, table

TOKENIZER = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold("_id", 5) != 0)
    scored = docs.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        toxicity.score(F.col("text"), model, docs).alias("score"),
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def _spans_of(kind: int) -> Column:
    # A second parameter of the lambda would be the place in the array.
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[_spans_of(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(pii.listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.concat("spans", "more")).alias("spans"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 10) == 0
    return lm_score.score(table(spark, sf_dir, "documents"), ~held_out, held_out)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.find(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op8_embed_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dup.find(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("first"))
    return found.select("vec_id", "n_links", "component_id", kept.alias("kept"), "audit_recall", "audit_links")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.apply(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; it imports this package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_lm_score": op3_lm_score,
    "op4_licenses": op4_licenses,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_near_dup": op7_near_dup,
    "op8_embed_dup": op8_embed_dup,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_centroids": op11_centroids,
    "op12_phrases": op12_phrases,
    "op13_url_rules": op13_url_rules,
    "pipeline": pipeline,
}

ORACLE = {
    "op5_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY x, payload_bytes) AS response FROM d)
        SELECT page_id, payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('{warc.BASE32}', 1 + CAST(
            (CAST(concat('0x', substr(x, 1 + 10 * CAST(i // 8 AS INT), 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), '')
            AS payload_digest,
          CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> response THEN response END AS refers_to, true AS verified
        FROM r""",
    "op8_embed_dup": f"""
        WITH RECURSIVE v AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
            sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
          FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b, a.e <> b.e AS apart FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {embed_dup.LINK}),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
          UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
        SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept,
          CAST(1.0 AS DOUBLE) AS audit_recall, (SELECT count(*) FROM link WHERE a % 20 = 0 AND apart) AS audit_links
        FROM c LEFT JOIN n ON c.vec_id = n.vec_id""",
    "op11_centroids": clusters.SQL,
    "op12_phrases": phrases.SQL,
    "op13_url_rules": url_rules.SQL,
}
