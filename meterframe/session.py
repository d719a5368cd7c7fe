"""Session helpers: settings the operators assume, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every operator relies on (dates are DATE in UTC, ANSI stays on).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "meterframe", conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings of BASE_CONF.

    On a cluster pass no master; the launcher decides.  Local tests pass
    ``local[N]`` and a small ``spark.sql.shuffle.partitions``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**BASE_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for staged writes and lineage cuts.

    The cluster's ``spark.checkpoint.dir``.  Only in local mode, where driver and executors are one
    process, may it be unset: a private temporary folder is then created and registered.  Elsewhere a
    machine-local folder would be invisible to the executors, so an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="meterframe-")
        spark.sparkContext.setCheckpointDir(d)
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - some deployments forbid setting it at runtime
            pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-path of the scratch folder."""
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df, name: str):
    """Write to the shared folder and read back: a lineage cut that is kept as columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
