"""Registered queries of the training-data operators: ``(spark, sf_dir) -> DataFrame``, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meterframe.llm import (
    conversation_repair,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    merkle,
    mixing,
    quality,
    substring_dedup,
    token_counts,
    token_records,
    toxicity,
    url_filter,
)
from meterframe.llm.common import documents, stored
from meterframe.session import scratch_path


def op1_exact_dedup(spark, sf_dir):
    """Every document against a fresh index: which copy stays, and the group's size."""
    index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    d = index.ingest(documents(spark, sf_dir))
    index.drop()
    return d.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def op2_quality(spark, sf_dir):
    """Every document scored by the additive model fitted on the labels that are not held out."""
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_mix_sources(spark, sf_dir):
    """All documents mixed to 150 % of their words, weights 3, 1, 2, at most twice each source, in the order
    in which they are first trained on."""
    return mixing.ordered(mixing.plan(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM s
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM w
), o AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS k FROM r
), l AS (
  SELECT a.*, (a.budget - coalesce((SELECT sum(b.cap) FROM o b WHERE b.k < a.k), 0))
              / (SELECT sum(b.weight) FROM o b WHERE b.k >= a.k) AS level
  FROM o a
), f AS (SELECT arg_min(level, k) AS level FROM l WHERE ratio > level),
t AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.level IS NULL OR l.ratio <= f.level THEN l.cap ELSE l.weight * f.level END AS target
  FROM l LEFT JOIN f ON true
), c AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - begin))
          + greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - begin)) AS BIGINT) AS taken
FROM c
"""


def op4_decontaminate(spark, sf_dir):
    """Every document that copies a benchmark item, with the item and the alignment."""
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_token_counts(spark, sf_dir):
    """Totals for every context limit from the histogram of encoded lengths."""
    return token_counts.limits(token_counts.length_histogram(documents(spark, sf_dir)))


def op6_substring_dedup(spark, sf_dir):
    """Every document without the words that repeated 35-word windows cover."""
    d = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark, sf_dir):
    """The language whose dictionary compresses each text best."""
    d = language_id.identify(documents(spark, sf_dir))
    return d.select("doc_id", F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op8_url_filter(spark, sf_dir):
    """Every page's URL judged by rule, else by the model."""
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_toxicity(spark, sf_dir):
    """Every document scored by the convolutional network fitted on the labels that are not held out."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_jaccard_join(spark, sf_dir):
    """Component of every document under links of Jaccard similarity 0.75 or more."""
    return jaccard_join.link(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_token_records(spark, sf_dir):
    """Every document's token ids, written as record files and read back."""
    index = token_records.write(documents(spark, sf_dir), scratch_path(spark, "token-records"))
    return token_records.read(index, digest_only=True)


def op12_conversation_repair(spark, sf_dir):
    """Every conversation, damaged by the checksums of its turns, and its cheapest repair."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    damaged = conversation_repair.damage(conv)
    decided = stored(conversation_repair.audits(damaged), "audits")
    hashed = conversation_repair.digests(conversation_repair.repair(damaged, decided))
    every = conv.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(decided, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(hashed, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in (*conversation_repair.COUNTS, "cost")]
    sha = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), sha)


def op13_merkle(spark, sf_dir):
    """Every document's leaf, proof and fold to the root, a third of them with a tampered text."""
    proofs = merkle.manifest(documents(spark, sf_dir), merkle.lowered_leaf())
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_mix_sources": op3_mix_sources,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_token_records": op11_token_records,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle": op13_merkle,
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op3_mix_sources": OP3_SQL}
