"""Registered queries: one per operator of the inventory, each with its oracle SQL.

A ``Query`` pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with the
DuckDB text computing the same result on the raw warehouse views.  Queries
read whole tables; parameters are the dashboard's own (a location, a date
range, a bucket frequency), never a sample of the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Dict, Optional, Sequence

from pyspark.sql import DataFrame, SparkSession

from meterframe.plans.checks import for_check, is_exact, wrap_sql


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: Optional[str] = None
    doubles: Sequence[str] = ()
    dates: Sequence[str] = ()
    timestamps: Sequence[str] = ()
    bench: bool = True
    doc: str = ""

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return for_check(self.fn(spark, sf_dir), self.exact)

    @property
    def exact(self) -> list:
        return [c for c in self.doubles if is_exact(self.name, c)]

    def oracle(self) -> Optional[str]:
        if self.sql is None:
            return None
        return wrap_sql(self.sql, self.doubles, self.dates, self.timestamps, self.exact)


REGISTRY: Dict[str, Query] = {}


def register(name: str, sql: Optional[str] = None, doubles=(), dates=(), timestamps=(), bench: bool = True):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, tuple(doubles), tuple(dates), tuple(timestamps), bench, fn.__doc__ or "")
        return fn

    return deco


def all_queries() -> Dict[str, Query]:
    # Imported for the registration; a module that is missing is an error.
    from meterframe.plans import queries_dashboard, queries_explore, queries_features, queries_io, queries_summaries  # noqa: F401

    return REGISTRY
