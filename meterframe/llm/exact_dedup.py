"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

The index is a warehouse table with one row per distinct text ever kept: its SHA-256 digest and
the id that stays.  New rows are reduced to (id, digest) once, grouped by digest with map-side
combine, anti-joined to the index by sort-merge, and the digests not yet known are appended.

Defined results: null text counts as the empty text.  Of equal new texts the largest id stays
(null ids sort lowest).  Of rows repeated whole, one is kept.  An empty batch gives an empty result.
Ingesting the same batch again gives the same decisions, so a job that lost its driver can be rerun.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.llm.common import ascii_lower, attach, free_names, stored


def text_digest(c="text"):
    """Lowercase hex SHA-256 of the text with A-Z lower-cased, null as empty."""
    return F.sha2(ascii_lower(F.coalesce(F.col(c), F.lit(""))), 256)


class DigestIndex:
    """A bucketed table of digests: ``digest`` binary, ``keep_id`` long."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def drop(self) -> None:
        """Remove the table; decisions already made do not read it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def append(self, rows: DataFrame) -> None:
        # One exchange on the bucket columns, so each append writes one sorted file a bucket.
        (
            rows.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.table)
        )

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Decide every row of ``docs`` (doc_id, text) and append the new digests.

        Returns doc_id, digest, keep_id, group_size (rows of the batch with that text), kept.
        """
        rows = stored(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.unhex(text_digest()).alias("digest"),
                F.monotonically_increasing_id().alias("_rid"),
            ),
            "digests",
        )
        total = rows.count()
        best = F.max(F.struct("doc_id", "_rid"))
        groups = rows.groupBy("digest").agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
        if self.exists():
            known = self.spark.table(self.table)
        else:
            known = self.spark.createDataFrame([], "digest binary, keep_id long")
        # Fixed before the append below changes what the index holds.
        groups = stored(
            groups.join(known.withColumn("_seen", F.lit(True)).hint("merge"), "digest", "left").select(
                "digest",
                "group_size",
                F.col("_best._rid").alias("_win"),
                F.col("_best.doc_id").alias("_new"),
                F.coalesce("_seen", F.lit(False)).alias("_seen"),
                F.when(F.col("_seen"), F.col("keep_id")).otherwise(F.col("_best.doc_id")).alias("keep_id"),
            ),
            "digest-groups",
        )
        fresh = groups.filter(~F.col("_seen")).select("digest", "keep_id")
        if self.exists():
            fresh = fresh.join(self.spark.table(self.table).hint("merge"), "digest", "left_anti")
        self.append(fresh)
        out = attach(rows, groups, "digest", "group_size", total)
        kept = (F.col("_rid") == F.col("_win")) & (~F.col("_seen") | F.col("keep_id").eqNullSafe(F.col("_new")))
        return out.select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def keep_first(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``decisions`` keeps, one of each repeated row, all columns unchanged."""
    i, d, own = free_names(docs, 3)
    kept = decisions.filter("kept").select(F.col("doc_id").alias(i), F.col("digest").alias(d))
    marked = docs.withColumn(own, F.unhex(text_digest()))
    out = marked.join(kept, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(d)), "left_semi")
    return out.dropDuplicates(["doc_id", own]).drop(own)
