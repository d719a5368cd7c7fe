"""Readers (A1-A5, A8, A10, A16, A18, A19).

CSV files are read as text (every column a string, header names kept), then
typed by role: the date is parsed (B5), metrics coerced (B6) and the meter /
key ids cast to bigint -- all with ``try_`` functions, so a bad cell becomes
null instead of failing the job under ANSI mode.  ``infer_schema=True`` is an
opt-in (it costs an extra pass over the files).
"""

from __future__ import annotations

import itertools
import logging
import re
from typing import Callable, Iterable, List, Optional, Sequence

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.schema import DEFAULT_ROLES, Roles
from meterframe.sources import headers

CSV_GLOB_FILTER = "*.[cC][sS][vV]"  # upload gate: extension csv in any case
ALLOWED_EXTENSIONS = {"csv"}
#: Spark's error conditions for a table, path or data that is not there.
MISSING = {"TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND", "SCHEMA_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}
log = logging.getLogger(__name__)


def allowed_file(name: str) -> bool:
    """A10: a file name with the ``csv`` extension (any case)."""
    return "." in name and name.rsplit(".", 1)[1].lower() in ALLOWED_EXTENSIONS


def read_csv(
    spark: SparkSession, paths, infer_schema: bool = False, schema: Optional[T.StructType] = None,
    glob_filter: Optional[str] = CSV_GLOB_FILTER,
) -> DataFrame:
    """A1 / A2: CSV files (a folder, a glob or a list of paths) with a header row.

    Columns are matched by header, not by place: files whose headers differ (in order, or by a column)
    are read group by group and joined by name, absent columns as null.  Where there is more than one
    file, telling the groups apart reads the start of each; only stores that ``headers`` cannot open are
    passed over line by line.
    """
    paths = paths if isinstance(paths, (str, list)) else list(paths)

    def read(where):
        r = spark.read.option("header", True).option("mode", "PERMISSIVE")
        if glob_filter:
            r = r.option("pathGlobFilter", glob_filter)
        if schema is not None:
            r = r.schema(schema).option("enforceSchema", False)
        elif infer_schema:
            r = r.option("inferSchema", True)
        return r.csv(where)

    groups = [] if schema is not None else _files_by_header(spark, paths, glob_filter)
    if len(groups) < 2:
        return read(paths)
    out = read(groups[0])
    for files in groups[1:]:
        out = out.unionByName(read(files), allowMissingColumns=True)
    return out


def _files_by_header(spark: SparkSession, paths, glob_filter: Optional[str]) -> List[List[str]]:
    """Files grouped by their header line; empty where at most one file is read."""
    r = spark.read
    if glob_filter:
        r = r.option("pathGlobFilter", glob_filter)
    lines = r.text(paths)
    files = lines.inputFiles()
    if len(files) < 2:
        return []
    if all(map(headers.can_open, files)):
        first = headers.header_lines(spark, files)
    else:
        first = (
            lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
            .filter(F.trim("value") != "")
            .withColumn("line", F.struct("start", F.monotonically_increasing_id()))
            .groupBy("file").agg(F.min_by("value", "line").alias("header"))
        )
    # One row per file, as in the file listing that any scan keeps on the driver.
    by_header: dict = {}
    for row in first.filter("header != ''").orderBy("file").collect():
        by_header.setdefault(row["header"], []).append(unquote(row["file"]))
    return list(by_header.values())


def type_ids(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Meter id and row key as bigint (bad text -> null)."""
    for c in (roles.meter, roles.key):
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, F.col(c).try_cast("long"))
    return df


def read_parquet(spark: SparkSession, uri: str) -> DataFrame:
    """A3: Parquet from any URI Spark can read (object store, HDFS, file)."""
    return spark.read.parquet(uri)


def read_table(spark: SparkSession, name: str = "prod.sales") -> DataFrame:
    """A4."""
    return spark.table(name)


def preview_table(spark: SparkSession, name: str = "prod.sales", n: int = 5, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """A5: first n rows in a defined order (Spark has no storage order)."""
    df = spark.table(name)
    order = [c for c in (roles.date, roles.meter, roles.key) if c in df.columns]
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def is_missing(error: Exception) -> bool:
    """Whether an error says that a source is not there (and not that it failed)."""
    if isinstance(error, FileNotFoundError):
        return True
    return isinstance(error, AnalysisException) and error.getCondition() in MISSING


def load_first(spark: SparkSession, readers: Sequence[Callable[[], DataFrame]], empty_schema: T.StructType) -> DataFrame:
    """The first reader that resolves (its plan analyses), else an empty frame.

    Only a source that is not there is passed over; any other failure is raised, so a broken store
    never looks like an empty table.
    """
    for read in readers:
        try:
            df = read()
            df.schema  # forces analysis: missing table / path fails here
            return df
        except Exception as e:
            if not is_missing(e):
                raise
            log.warning("source not found, trying the next: %s", str(e).splitlines()[0])
    return spark.createDataFrame([], empty_schema)


def table_exists(spark: SparkSession, name: str = "prod.sales") -> bool:
    """A16."""
    return spark.catalog.tableExists(name)


def list_tables(spark: SparkSession, database: Optional[str] = None) -> List[str]:
    """Table names of a database (the current one by default)."""
    return [t.name for t in spark.catalog.listTables(database)]


def ensure_database(spark: SparkSession, name: str = "prod") -> None:
    """A19."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_ident(name)}")


def run_query(spark: SparkSession, sql: str, params: Optional[Iterable] = None) -> DataFrame:
    """Parameterised SQL with positional ``?`` markers (values bound, never spliced).

    The markers are bound by name: Spark 4.1 mixes up five or more positional arguments.
    """
    values = list(params or ())
    if not values:
        return spark.sql(sql)
    count = itertools.count()
    # Quoted text and names are left as they are.
    named = re.sub(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|\?""", lambda m: f":p{next(count)}" if m[0] == "?" else m[0], sql)
    if next(count) != len(values):
        raise ValueError("the markers and the values differ in number")
    return spark.sql(named, args={f"p{i}": v for i, v in enumerate(values)})


def _ident(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?", name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name
