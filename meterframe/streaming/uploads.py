"""Upload folder ingest as a Structured Streaming job (A11 on a cluster).

The source's upload is "read the CSV, preprocess, replace the table".  On a
cluster, uploads land in a shared folder; a file stream picks up each new
file exactly once (the checkpoint remembers processed files), and
``foreachBatch`` runs the same staged replace as the batch sink.  With
``maxFilesPerTrigger=1`` every upload is its own micro-batch, so the table
ends up holding the latest upload -- the source's replace semantics.

A retried micro-batch writes a fresh staging folder and swaps again, so a
failure between write and swap never leaves a half-written table.

``delete_source=True`` removes ingested uploads (the source deletes each
upload after ingest).  Spark removes a batch's files when the following
batch commits, so after an ``available_now`` run the latest upload stays
until the next run; a continuously running stream removes it on its next
batch.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from meterframe.schema import DEFAULT_ROLES, Roles
from meterframe.session import scratch_path
from meterframe.sources.readers import CSV_GLOB_FILTER, type_ids
from meterframe.sources.sinks import replace_table

# Column layout of the source's billing exports (read as text, typed by role).
UPLOAD_COLUMNS = ("chargedate", "meterid", "loc", "res", "kwh", "ghc", "paymoney")


def upload_stream(spark: SparkSession, upload_dir: str, columns: Sequence[str] = UPLOAD_COLUMNS, delete_source: bool = False):
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    r = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("pathGlobFilter", CSV_GLOB_FILTER)
        .option("maxFilesPerTrigger", 1)
        .option("latestFirst", False)
    )
    if delete_source:
        r = r.option("cleanSource", "delete")
    return r.csv(upload_dir)


def start_upload_ingest(
    spark: SparkSession,
    upload_dir: str,
    table: str = "prod.sales",
    columns: Sequence[str] = UPLOAD_COLUMNS,
    checkpoint: Optional[str] = None,
    delete_source: bool = False,
    available_now: bool = True,
    roles: Roles = DEFAULT_ROLES,
) -> StreamingQuery:
    """Start the ingest; ``available_now`` processes what is there and stops."""

    def replace(batch, epoch_id):
        if batch.isEmpty():
            return
        replace_table(batch.sparkSession, type_ids(batch, roles), table, roles, clean=True)

    w = (
        upload_stream(spark, upload_dir, columns, delete_source)
        .writeStream.foreachBatch(replace)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "upload_ingest_checkpoint"))
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
