"""A training corpus from raw documents: language ID, exact dedup, near-duplicate removal, benchmark
decontamination, and a mix of the sources to target weights.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.  All but the last return the columns of the documents, whatever they are.

Defined results: empty tables give empty results; rows with null texts go at the language stage (they
have no letter); rows without an id, or that share one, pass the filters by their text alone; extra columns
of any name come through unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.llm import decontaminate, exact_dedup, jaccard_join, language_id, mixing
from meterframe.llm.common import documents, free_names, stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressors tell; those without one, or with a narrow margin, go."""
    prefix = "_lid_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    known = language_id.identify(docs, prefix=prefix)
    return known.filter(f"{prefix}accepted").select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    index = exact_dedup.DigestIndex(spark, f"corpus_digests_{uuid.uuid4().hex}")
    decided = index.ingest(docs)
    index.drop()
    return exact_dedup.keep_first(docs, decided)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return jaccard_join.keep_one(docs, jaccard_join.link(docs))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no benchmark item."""
    (leaks,) = free_names(docs, 1)
    found = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=leaks)
    return found.filter(F.size(leaks) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix, range-sorted by first position: one row per document with the words taken and the
    position of each copy (none where the source's target is met without it)."""
    return mixing.ordered(mixing.plan(docs)).select("doc_id", "source", "size", "source_size", "target", "taken", "position", "positions")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix_sources", mix_stage),
]

#: Compression and alignment cannot be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
