"""Header lines of many text files as a Spark data source: one row per file.

Each task opens its files and reads no further than the first line that is not blank, so telling the
headers of a folder apart costs the same however long the files are.  Files are opened with Arrow's file
systems, with the credentials these find; ``can_open`` says which addresses they know.
"""

from __future__ import annotations

import json
import re
import sys
from urllib.parse import urlsplit

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The classes travel with the tasks, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "header_lines"
CHUNK_BYTES = 1 << 14
TASK_FILES = 256
MIN_TASKS = 64
#: Address schemes of Spark and the ones Arrow knows them by.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def can_open(file: str) -> bool:
    return urlsplit(file).scheme in SCHEMES


def first_line(stream) -> str:
    """The first line of a byte stream that is not blank, without its end; empty where there is none."""
    seen = b""
    while chunk := stream.read(CHUNK_BYTES):
        seen = (seen + chunk).lstrip(b"\r\n\t ")
        end = re.search(rb"[\r\n]", seen)
        if end:
            return seen[: end.start()].decode("utf-8", "replace")
    return seen.decode("utf-8", "replace")


class HeaderLines(DataSource):
    """``spark.read.format("header_lines").option("files", <JSON list>)``: file, header."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, header string"

    def reader(self, schema) -> "HeaderReader":
        return HeaderReader(json.loads(self.options["files"]))


class HeaderReader(DataSourceReader):
    def __init__(self, files):
        self.files = files

    def partitions(self):
        step = max(1, min(TASK_FILES, -(-len(self.files) // MIN_TASKS)))
        return [InputPartition(self.files[i : i + step]) for i in range(0, len(self.files), step)]

    def read(self, partition):
        from pyarrow import fs

        for file in partition.value:
            scheme, rest = file.split(":", 1)
            system, path = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")
            with system.open_input_stream(path) as stream:
                yield file, first_line(stream)


def header_lines(spark, files):
    """file, header of each of ``files`` (addresses as ``DataFrame.inputFiles`` gives them)."""
    spark.dataSource.register(HeaderLines)
    return spark.read.format(FORMAT).option("files", json.dumps(list(files))).load()
