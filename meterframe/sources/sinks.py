"""Sinks (A6, A7, A9, A11-A14, A17).

Table replacement is *write, then point*: the cleaned rows are written to a new managed table in the
warehouse, a version, and only when that is complete does the name, a view, get pointed at it in one catalog
statement.  Readers always find the old rows or the new ones; a write or a catalog call that fails
leaves the old ones in place and drops the new version.

The catalog is the manifest: versions are named by number, and the view's properties say which is current.
``versions`` lists them, ``rollback`` points back, ``retain`` drops the oldest.  Where the name is a real
table at first, it becomes version 0 by a rename just before the view is made; if that fails, it is renamed back.
"""

from __future__ import annotations

import datetime as _dt
import os
import re
import uuid
from typing import Iterable, Optional, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.operators.clean import coerce_metrics, date_first, parse_dates, preprocess
from meterframe.schema import DEFAULT_ROLES, RAW_DATE_FORMATS, Roles
from meterframe.sources.readers import allowed_file, ensure_database, is_missing, read_csv, read_parquet, type_ids


def validate_columns(df: DataFrame, required: Iterable[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def replace_table(
    spark: SparkSession,
    df: DataFrame,
    name: str = "prod.sales",
    roles: Roles = DEFAULT_ROLES,
    clean: bool = True,
    partition_by: Sequence[str] = (),
    analyze: bool = True,
    keep: Optional[int] = 2,
) -> str:
    """(preprocess ->) date first -> validate -> write a new version -> analyze -> point ``name`` at it.

    Returns the table that holds the new version.  ``partition_by`` (e.g. a year column) enables
    partition pruning for date-bounded queries at scale.  The last ``keep`` versions stay (None: all):
    readers that started before the switch may still be scanning the one before.
    """
    out = preprocess(df, roles) if clean else df
    validate_columns(out, [roles.date])
    out = date_first(out, roles)
    if "." in name:
        ensure_database(spark, name.split(".", 1)[0])
    kind = _kind(spark, name)
    number = max([0, *[_number(v) for v in versions(spark, name)]]) + 1
    version = f"{name}__v{number:08d}_{uuid.uuid4().hex[:8]}"
    w = out.write.mode("errorifexists").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    adopted = None
    try:
        w.saveAsTable(version)
        if analyze:
            analyze_table(spark, version)
        if kind == "TABLE":
            adopted = f"{name}__v{0:08d}_{uuid.uuid4().hex[:8]}"
            spark.sql(f"ALTER TABLE {name} RENAME TO {adopted}")
        point(spark, name, version, out.columns)
    except BaseException:
        if adopted and spark.catalog.tableExists(adopted):
            spark.sql(f"ALTER TABLE {adopted} RENAME TO {name}")
        spark.sql(f"DROP TABLE IF EXISTS {version}")
        raise
    if keep is not None:
        retain(spark, name, keep)
    return version


#: Property of the view that names the version it reads.
CURRENT = "meterframe.version"
_VERSION = re.compile(r"__v(\d{8})_[0-9a-f]{8}$")


def _number(version: str) -> int:
    return int(_VERSION.search(version)[1])


def _kind(spark: SparkSession, name: str) -> Optional[str]:
    """VIEW (one that ``point`` made), TABLE, or None; any other view is not this module's to replace."""
    if not spark.catalog.tableExists(name):
        return None
    kind = spark.catalog.getTable(name).tableType
    if kind in ("MANAGED", "EXTERNAL"):
        return "TABLE"
    if kind != "VIEW" or current_version(spark, name) is None:
        raise ValueError(f"{name} is a view that was not made by replace_table")
    return "VIEW"


def point(spark: SparkSession, name: str, version: str, columns: Sequence[str]) -> None:
    """Make ``name`` read ``version``, in one catalog statement."""
    names = ", ".join(f"`{c}`" for c in columns)
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{CURRENT}' = '{version}') AS SELECT {names} FROM {version}")


def current_version(spark: SparkSession, name: str) -> Optional[str]:
    """The version that ``name`` reads."""
    found = spark.sql(f"SHOW TBLPROPERTIES {name}").filter(F.col("key") == CURRENT).head()
    return found["value"] if found else None


def versions(spark: SparkSession, name: str) -> list[str]:
    """The versions of ``name``, oldest first."""
    database, _, table = name.rpartition(".")
    pre = f"{database}." if database else ""
    found = [t.name for t in spark.catalog.listTables(database or None) if t.name.startswith(f"{table.lower()}__v") or t.name.startswith(f"{table}__v")]
    return [pre + t for t in sorted((t for t in found if _VERSION.search(t)), key=_number)]


def rollback(spark: SparkSession, name: str, version: Optional[str] = None) -> str:
    """Point ``name`` at ``version``, or at the one before the current; returns it."""
    known, now = versions(spark, name), current_version(spark, name)
    if version is None:
        older = [v for v in known if _number(v) < _number(now)]
        if not older:
            raise ValueError(f"{name} has no version before {now}")
        version = older[-1]
    elif version not in known:
        raise ValueError(f"{version} is no version of {name}")
    point(spark, name, version, spark.table(version).columns)
    return version


def retain(spark: SparkSession, name: str, keep: int) -> None:
    """Drop all but the ``keep`` newest versions of ``name`` and the current one."""
    now = current_version(spark, name)
    for v in versions(spark, name)[: -keep if keep else None]:
        if v != now:
            spark.sql(f"DROP TABLE IF EXISTS {v}")


def drop_old_versions(spark: SparkSession, name: str, keep: str) -> None:
    """Drop the versions of ``name`` other than ``keep``, once nothing reads them any more."""
    for v in versions(spark, name):
        if v != keep:
            spark.sql(f"DROP TABLE IF EXISTS {v}")


def analyze_table(spark: SparkSession, name: str) -> None:
    """Table and column statistics for the cost-based optimizer."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def rebuild_from_csv(spark: SparkSession, paths, name: str = "prod.sales", roles: Roles = DEFAULT_ROLES,
                     formats=RAW_DATE_FORMATS) -> str:
    """CSV files -> typed (date parsed, ids and metrics numeric, as a typed
    CSV scan would give) -> replace.  No dedupe and no null drop, as in the
    source.  An empty input is an error and leaves the existing table untouched.
    """
    try:
        raw = read_csv(spark, paths)
        empty = not raw.columns or raw.limit(1).count() == 0
    except AnalysisException as e:  # no file matched: nothing to infer a header from
        if not is_missing(e):
            raise
        empty = True
    if empty:
        raise FileNotFoundError(f"no CSV rows found under {paths!r}; table {name} left unchanged")
    typed = coerce_metrics(type_ids(parse_dates(raw, roles, formats), roles), roles)
    return replace_table(spark, typed, name, roles, clean=False)


def refresh_from_uri(spark: SparkSession, uri: str, name: str = "prod.sales", roles: Roles = DEFAULT_ROLES) -> bool:
    """Re-read a Parquet export and replace the table; False when there is no such export.

    Any other failure (a store that cannot be reached, a broken file) is raised.
    """
    try:
        df = read_parquet(spark, uri)
        df.schema
    except Exception as e:
        if not is_missing(e):
            raise
        return False
    replace_table(spark, df, name, roles)
    return True


def ingest_upload(spark: SparkSession, path: str, name: str = "prod.sales", roles: Roles = DEFAULT_ROLES) -> str:
    """Gate on the extension, read the CSV, preprocess and replace the table.

    The uploaded file is left in place (a batch job does not own it).
    """
    if not allowed_file(os.path.basename(path)):
        raise ValueError(f"not a CSV upload: {path}")
    raw = type_ids(read_csv(spark, path, glob_filter=None), roles)
    return replace_table(spark, raw, name, roles, clean=True)


def export_name(prefix: str = "meter_export", now: Optional[_dt.datetime] = None) -> str:
    """UTC-stamped export file name."""
    now = now or _dt.datetime.now(_dt.timezone.utc)
    return f"{prefix}_{now.strftime('%Y%m%dT%H%M%SZ')}.csv"


def export_csv(df: DataFrame, path: str, single_file: bool = False, quote_all: bool = False) -> None:
    """CSV with a header, no index; ``quote_all`` quotes every cell and
    doubles inner quotes.  ``single_file`` funnels the rows through one task --
    only for small exports."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode("errorifexists").option("header", True)
    if quote_all:
        w = w.option("quoteAll", True).option("escape", '"')
    w.csv(path)


def export_filtered(df: DataFrame, params, folder: str, roles: Roles = DEFAULT_ROLES, prefix: str = "meter_export",
                    single_file: bool = False) -> str:
    """A12 end to end: the rows under a filter, written as CSV under a UTC-stamped
    name inside ``folder``; returns the written path."""
    path = os.path.join(folder, export_name(prefix))
    export_csv(params.apply(df, roles), path, single_file=single_file)
    return path


def to_source_csv_layout(df: DataFrame, roles: Roles = DEFAULT_ROLES, date_format: str = "dd-MMM-yy") -> DataFrame:
    """Render rows the way the source's CSV exports look: text dates, text numbers."""
    cols = []
    for c in df.columns:
        if c == roles.date:
            cols.append(F.date_format(F.col(c), date_format).alias(c))
        else:
            cols.append(F.col(c).cast("string").alias(c))
    return df.select(*cols)
