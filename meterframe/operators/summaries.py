"""Stored summaries of the billing table that answer dashboard requests without reading its rows.

* ``Rollup`` (E1, E3, E5, E38): per day, location and residence, the number of rows and for each metric its
  sum, count and NaN count.  Sums and counts merge, so a new day's rows are rolled up alone and appended.
* ``MeterBitmaps`` (E8, E13): per month, location and residence, the set of meters as bitmaps of 64 ids a
  bucket.  Bitmaps merge by OR, so distinct counts over any months and places are exact without a distinct
  over rows.  A bucket is one long, so merging is a hash aggregate of small rows however sparse the ids are.
* ``MeterIndex`` (H2, H3): the meters with their locations, and a posting table from three-letter pieces to
  meters, stored by piece, that narrows LIKE and regex searches before the exact test.

Each function takes the rows too, and goes to them where a filter asks for what the summary does not hold.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from typing import List, Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.functions.dates import bucket, bucket_label, iso_text
from meterframe.functions.scalars import nan_to_null
from meterframe.operators import aggregates, facets, profile
from meterframe.operators.filters import FilterParams, date_between, like_search, optional_equals, regex_search, validate_metrics
from meterframe.schema import DEFAULT_ROLES, Roles


def _dims(rows: DataFrame, roles: Roles) -> List[str]:
    return [c for c in (roles.location, roles.residence_mapped) if c in rows.columns]


def _covered(params: Optional[FilterParams], rows: DataFrame, held: Sequence[str], skip: Sequence[str] = ()) -> bool:
    """Whether every selection that the rows would apply is on a column the summary holds."""
    chosen = params.normalized() if params else {}
    return all(c in held for c in chosen if c in rows.columns and c not in skip)


# --------------------------------------------------------------------- daily rollup
@dataclass
class Rollup:
    table: DataFrame
    dims: Sequence[str]
    metrics: Sequence[str]
    roles: Roles = DEFAULT_ROLES

    def covers(self, params: FilterParams, rows: DataFrame, metrics: Sequence[str] = ()) -> bool:
        return _covered(params, rows, [*self.dims, self.roles.date]) and all(m in self.metrics for m in metrics)


def roll_up(rows: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """The rollup's rows for ``rows``; a null date or category is a group of its own."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for m in roles.present_metrics(rows.columns):
        v = F.col(m).cast("double")
        aggs += [F.sum(nan_to_null(v)).alias(f"{m}_sum"), F.count(nan_to_null(v)).alias(f"{m}_n"), F.count_if(F.isnan(v)).alias(f"{m}_nan")]
    return rows.groupBy(roles.date, *_dims(rows, roles)).agg(*aggs)


def rollup(table: DataFrame, rows: DataFrame, roles: Roles = DEFAULT_ROLES) -> Rollup:
    """``table`` holds what ``roll_up`` gave for all of ``rows``, in any number of appended parts."""
    return Rollup(table, _dims(rows, roles), roles.present_metrics(rows.columns), roles)


def _means(r: DataFrame, metrics: Sequence[str]):
    return [F.coalesce(F.try_divide(F.sum(f"{m}_sum"), F.sum(f"{m}_n")), F.lit(0.0)).alias(m) for m in metrics]


def bucketed_mean(r: Rollup, rows: DataFrame, params: FilterParams) -> DataFrame:
    """E3 from the rollup where it covers the filter, else from the rows."""
    valid = validate_metrics(rows, params.metric, r.roles, multi=True)
    if not valid or not r.covers(params, rows, valid):
        return aggregates.bucketed_mean(rows, params, r.roles)
    b = bucket(F.col(r.roles.date), params.freq)
    base = params.apply(r.table, r.roles).filter(F.col(r.roles.date).isNotNull())
    out = base.groupBy(b.alias("bucket")).agg(*_means(base, valid))
    return out.select("bucket", bucket_label(F.col("bucket"), params.freq).alias("label"), *valid).orderBy("bucket")


def split_series(r: Rollup, rows: DataFrame, params: FilterParams, split_by: str) -> DataFrame:
    """E38 from the rollup where it covers the filter and the split, else from the rows."""
    valid = validate_metrics(rows, params.metric, r.roles, multi=True)
    if split_by not in r.dims or not valid or not r.covers(params, rows, valid):
        return aggregates.split_series(rows, params, split_by, r.roles)
    b = bucket(F.col(r.roles.date), params.freq)
    base = params.apply(r.table, r.roles).filter(F.col(r.roles.date).isNotNull() & F.col(split_by).isNotNull())
    out = base.groupBy(b.alias("bucket"), F.col(split_by).cast("string").alias("series")).agg(*_means(base, valid))
    return out.select("bucket", bucket_label(F.col("bucket"), params.freq).alias("label"), "series", *valid)


def daily_series(r: Rollup, rows: DataFrame, date_from, date_to, metric: str = "kwh", loc=None, res_mapped=None) -> DataFrame:
    """E1 from the rollup; a NaN in a day makes its sum NaN, as it does over rows."""
    if metric not in r.metrics:
        return aggregates.daily_series(rows, date_from, date_to, metric, loc, res_mapped, r.roles)
    pred = date_between(r.roles.date, date_from, date_to) & optional_equals(r.roles.location, loc)
    pred = pred & optional_equals(r.roles.residence_mapped, res_mapped)
    total = F.when(F.sum(f"{metric}_nan") > 0, F.lit(float("nan"))).otherwise(F.sum(f"{metric}_sum"))
    return r.table.filter(pred).groupBy(F.col(r.roles.date).alias("day")).agg(total.alias(f"total_{metric}")).orderBy("day")


def totals_by_location(r: Rollup, rows: DataFrame, params: FilterParams) -> DataFrame:
    """E5 from the rollup where it covers the filter, else from the rows."""
    valid = validate_metrics(rows, params.metric, r.roles, multi=False)
    if not valid or r.roles.location not in r.dims or not r.covers(params, rows, valid[:1]):
        return aggregates.totals_by_location(rows, params, r.roles)
    base = params.apply(r.table, r.roles).filter(F.col(r.roles.location).isNotNull() & (F.col(f"{valid[0]}_n") > 0))
    out = base.groupBy(F.col(r.roles.location).cast("string").alias("label")).agg(F.sum(f"{valid[0]}_sum").alias("value"))
    return out.orderBy(F.col("value").desc(), F.col("label").asc())


# --------------------------------------------------------------------- meters as bitmaps
def meter_bitmaps(rows: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """month, location, residence, bucket, bits: the meters with rows there.  Rows without a meter keep their
    month in an empty bitmap.  Parts for new rows can be appended."""
    m = F.col(roles.meter).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), m.bitwiseAND(F.lit(63)).cast("int"))
    return rows.groupBy(F.trunc(roles.date, "month").alias("month"), *_dims(rows, roles), F.shiftright(m, 6).alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def _count_meters(bitmaps: DataFrame, *by: str) -> DataFrame:
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bit_or("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0).cast("long")).alias("unique_meters"))


def monthly_distinct_meters(bitmaps: DataFrame) -> DataFrame:
    """E13 from the bitmaps."""
    per = _count_meters(bitmaps.filter(F.col("month").isNotNull()), "month")
    filled = profile._with_gap_months(per, "unique_meters", F.lit(0).cast("long"))
    return filled.select(F.last_day("month").alias("month_end"), "unique_meters")


def _whole_months(params: Optional[FilterParams]) -> bool:
    start, end = (params.start, params.end) if params else (None, None)
    last = end is None or end.day == calendar.monthrange(end.year, end.month)[1]
    return last and (start is None or start.day == 1)


def dataset_summary(r: Rollup, bitmaps: DataFrame, rows: DataFrame, params: Optional[FilterParams] = None) -> DataFrame:
    """E8 from the rollup and the bitmaps where the filter is on their columns and whole months, else from rows."""
    roles, params = r.roles, params or FilterParams()
    if not r.covers(params, rows) or roles.date in params.normalized() or not _whole_months(params):
        return aggregates.dataset_summary(params.apply(rows, roles), roles)
    base = params.apply(r.table, roles)
    facts = base.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.countDistinct(roles.location).alias("locations"),
        F.min(roles.date).alias("_a"), F.max(roles.date).alias("_b"),
    )
    months = params.apply(bitmaps.withColumnRenamed("month", roles.date), roles)
    both = profile._join_one_row(facts, _count_meters(months))
    return both.select(
        "rows", F.lit(len(rows.columns)).cast("long").alias("cols"), F.coalesce("unique_meters", F.lit(0)).alias("meters"), "locations",
        iso_text(F.col("_a")).alias("date_min"), iso_text(F.col("_b")).alias("date_max"),
    )


# --------------------------------------------------------------------- meter search
GRAM = 3


@dataclass
class MeterIndex:
    meters: DataFrame
    postings: DataFrame
    roles: Roles = DEFAULT_ROLES


def meters_of(rows: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """id, value (the id as text), location: every meter with every location it has rows for."""
    loc = F.col(roles.location) if roles.location in rows.columns else F.lit(None).cast("string")
    m = F.col(roles.meter)
    return rows.filter(m.isNotNull()).select(m.alias("id"), m.cast("string").alias("value"), loc.cast("string").alias("location")).distinct()


def postings_of(meters: DataFrame) -> DataFrame:
    """gram, value: the three-letter pieces of every meter's text in lower case."""
    text = F.lower("value")
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))
    return meters.select("value").distinct().select(F.explode(grams).alias("gram"), "value")


def write_meter_index(rows: DataFrame, path: str, roles: Roles = DEFAULT_ROLES) -> MeterIndex:
    """Build the index under ``path``: the postings range-partitioned and sorted by gram, so that a search
    reads the few row groups with its grams."""
    spark = rows.sparkSession
    meters_of(rows, roles).write.parquet(f"{path}/meters")
    made = postings_of(spark.read.parquet(f"{path}/meters"))
    made.repartitionByRange("gram", "value").sortWithinPartitions("gram", "value").write.parquet(f"{path}/postings")
    return MeterIndex(spark.read.parquet(f"{path}/meters"), spark.read.parquet(f"{path}/postings"), roles)


def like_pieces(q: str) -> List[str]:
    """Text that every match of LIKE '%q%' contains."""
    return [] if "\\" in q else re.split("[%_]", q)


def regex_pieces(q: str) -> List[str]:
    """Text that every match of a pattern contains; none where it has groups, classes or escapes."""
    if re.search(r"[\\()\[\]{}|]", q):
        return []
    pieces, run, i = [], "", 0
    while i < len(q):
        c, after = q[i], q[i + 1 : i + 2]
        if c in ".^$*+?":  # an anchor, or any character and its count
            pieces, run = [*pieces, run], ""
        elif after and after in "*?":
            pieces, run = [*pieces, run], ""
        elif after == "+":
            pieces, run = [*pieces, run + c], ""
        else:
            run += c
        i += 1
    return [*pieces, run]


def _grams(pieces: Sequence[str]) -> List[str]:
    low = [p.lower() for p in pieces if p.isascii()]
    return sorted({p[i : i + GRAM] for p in low for i in range(len(p) - GRAM + 1)})


def candidates(index: MeterIndex, pieces: Sequence[str]) -> DataFrame:
    """The meters that hold all grams of ``pieces``; all meters where there are none."""
    grams = _grams(pieces)
    if not grams:
        return index.meters
    hits = index.postings.filter(F.col("gram").isin(grams)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return index.meters.join(hits.filter(F.col("n") == len(grams)).select("value"), "value", "left_semi")


def meter_options(index: MeterIndex, rows: DataFrame, params: Optional[FilterParams] = None, q: str = "", limit: Optional[int] = None, regex: bool = True) -> DataFrame:
    """H2 (+C9) from the index where no filter but that on the location is set, else from the rows."""
    roles, params = index.roles, params or FilterParams()
    if (params.start, params.end) != (None, None) or not _covered(params, rows, [roles.location], [roles.meter]):
        return facets.meter_options(rows, params, q, limit, regex, roles)
    q = (q or "").strip()
    found = candidates(index, (regex_pieces(q) if regex else [q]) if q else [])
    chosen = params.normalized().get(roles.location)
    if chosen and roles.location in rows.columns:
        found = found.filter(F.col("location").isin(chosen))
    if q:
        found = found.filter(regex_search(F.col("value"), q, literal=not regex))
    out = found.select("value").distinct().orderBy("value")
    return out if limit is None else out.limit(max(int(limit), 1))


def meter_options_by_location(index: MeterIndex, loc: Optional[str] = None, q: str = "", limit: Optional[int] = None) -> DataFrame:
    """H3 (+C10) from the index."""
    q = (q or "").strip()
    found = candidates(index, like_pieces(q) if q else [])
    if loc:
        found = found.filter(F.col("location") == F.lit(loc))
    if q:
        found = found.filter(like_search(F.col("value"), q))
    out = found.select("id").distinct().orderBy("id")
    return (out if limit is None else out.limit(max(int(limit), 1))).select(F.col("id").cast("string").alias("value"))
