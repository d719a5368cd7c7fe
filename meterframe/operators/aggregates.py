"""Dashboard aggregates (E1-E11, E38, D3, E4/G4 top-k with remainder, G1, G2).

Every aggregate is a partial + final hash aggregate: map-side combine first,
so only one row per (partition, group) is shuffled.  Results are small
(buckets, categories); ordering uses explicit tie-breaks (label / key).
"""

from __future__ import annotations

from typing import List, Optional, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterframe.functions.dates import bucket, bucket_label, iso_text
from meterframe.functions.quantiles import exact_percentiles
from meterframe.functions.scalars import nan_to_null
from meterframe.operators.filters import FilterParams, date_between, optional_equals, validate_metrics
from meterframe.schema import DEFAULT_ROLES, OTHER_LABEL, TOP_N_SLICES, Roles


def daily_series(
    df: DataFrame,
    date_from,
    date_to,
    metric: str = "kwh",
    loc: Optional[str] = None,
    res_mapped: Optional[str] = None,
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """SUM(metric) per day within [from, to], optional equality filters."""
    d = F.col(roles.date)
    pred = date_between(roles.date, date_from, date_to) & optional_equals(roles.location, loc)
    pred = pred & optional_equals(roles.residence_mapped, res_mapped)
    return (
        df.filter(pred)
        .groupBy(d.alias("day"))
        .agg(F.sum(metric).alias(f"total_{metric}"))
        .orderBy("day")
    )


def top_categories(
    df: DataFrame, date_from, date_to, metric: str = "kwh", category: Optional[str] = None, n: int = 10,
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """SUM(metric) by category within the range, descending, first n (top-k).

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition keeps
    only its n best groups.
    """
    cat = category or roles.location
    return (
        df.filter(date_between(roles.date, date_from, date_to))
        .groupBy(cat)
        .agg(F.sum(metric).alias(f"total_{metric}"))
        .orderBy(F.col(f"total_{metric}").desc_nulls_last(), F.col(cat).asc_nulls_last())
        .limit(n)
    )


def bucketed_mean(
    df: DataFrame, params: FilterParams, roles: Roles = DEFAULT_ROLES, metrics: Optional[Sequence[str]] = None
) -> DataFrame:
    """AVG of each valid metric per day / week / month under the filter.

    Null averages become 0.0, empty buckets are absent, rows without a date
    are dropped before bucketing.  Output: bucket DATE, label, one column per
    metric.  No valid metric -> an empty frame with the bucket columns only.
    """
    valid = list(metrics) if metrics is not None else validate_metrics(df, params.metric, roles, multi=True)
    filtered = params.apply(df, roles).filter(F.col(roles.date).isNotNull())
    b = bucket(F.col(roles.date), params.freq)
    if not valid:
        return filtered.select(b.alias("bucket"), bucket_label(b, params.freq).alias("label")).limit(0)
    agg = filtered.groupBy(b.alias("bucket")).agg(*[F.avg(nan_to_null(F.col(m))).alias(m) for m in valid])
    return agg.select(
        "bucket",
        bucket_label(F.col("bucket"), params.freq).alias("label"),
        *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in valid],
    ).orderBy("bucket")


def split_series(
    df: DataFrame, params: FilterParams, split_by: str, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """The bucketed mean split by a dimension, long form (bucket, split, metrics)."""
    valid = validate_metrics(df, params.metric, roles, multi=True)
    filtered = params.apply(df, roles).filter(F.col(roles.date).isNotNull() & F.col(split_by).isNotNull())
    b = bucket(F.col(roles.date), params.freq)
    agg = filtered.groupBy(b.alias("bucket"), F.col(split_by).cast("string").alias("series")).agg(
        *[F.avg(nan_to_null(F.col(m))).alias(m) for m in valid]
    )
    return agg.select(
        "bucket",
        bucket_label(F.col("bucket"), params.freq).alias("label"),
        "series",
        *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in valid],
    )


def _segment_sums(df: DataFrame, segment: str, metric: str) -> DataFrame:
    """Null segment and null / NaN metric rows are dropped before grouping."""
    v = nan_to_null(F.col(metric))
    return (
        df.filter(F.col(segment).isNotNull() & v.isNotNull())
        .groupBy(F.col(segment).cast("string").alias("label"))
        .agg(F.sum(v).alias("value"))
    )


def composition(
    df: DataFrame,
    params: FilterParams,
    roles: Roles = DEFAULT_ROLES,
    segment: Optional[str] = None,
    top_n: int = TOP_N_SLICES,
) -> DataFrame:
    """Sum of one metric per segment, top ``top_n`` + 'Other' remainder.

    The segment is ``res_mapped`` if present, else ``loc``.  The top slices
    come from ``orderBy().limit()`` (each partition keeps only top_n groups),
    the remainder from an anti join against those <= top_n labels (broadcast,
    bounded by top_n), so no single task ever sees all groups.  'Other' only
    appears when there are more than top_n groups.  Output: position, label, value.
    """
    metric = (validate_metrics(df, params.metric, roles, multi=False) or [None])[0]
    seg = segment or (
        roles.residence_mapped if roles.residence_mapped in df.columns
        else (roles.location if roles.location in df.columns else None)
    )
    if metric is None or seg is None:
        return df.sparkSession.createDataFrame([], "position int, label string, value double")
    sums = _segment_sums(params.apply(df, roles), seg, metric)
    order = [F.col("value").desc(), F.col("label").asc()]
    top = sums.orderBy(*order).limit(top_n)
    top_ranked = top.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)
    rest = (
        sums.join(F.broadcast(top.select("label")), "label", "left_anti")
        .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 0)
        .select(F.lit(top_n).alias("position"), F.lit(OTHER_LABEL).alias("label"), "value")
    )
    return top_ranked.select(F.col("position").cast("int").alias("position"), "label", "value").unionByName(
        rest.select(F.col("position").cast("int"), "label", "value")
    )


def share_of_total(slices: DataFrame, value: str = "value", decimals: int = 1) -> DataFrame:
    """Percentage of the total per slice, rounded; 0 when the total is 0.

    The input is a composition result (<= top_n + 1 rows), so the window over
    all rows is bounded.
    """
    total = F.sum(F.col(value)).over(Window.partitionBy(F.lit(1)))
    pct = F.round(F.lit(100.0) * F.try_divide(F.col(value), F.when(total != 0, total)), decimals)
    return slices.withColumn("share_pct", F.coalesce(pct, F.lit(0.0)))


def totals_by_location(df: DataFrame, params: FilterParams, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """E5: sum of one metric per location, descending, no cap (label, value)."""
    metric = (validate_metrics(df, params.metric, roles, multi=False) or [None])[0]
    if metric is None or roles.location not in df.columns:
        return df.sparkSession.createDataFrame([], "label string, value double")
    return _segment_sums(params.apply(df, roles), roles.location, metric).orderBy(
        F.col("value").desc(), F.col("label").asc()
    )


def aligned_sums(df: DataFrame, params: FilterParams, label: Optional[str] = None, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """D3: per-label sums of every metric in one aggregate, missing -> 0.

    Equals a full outer join of the per-metric bar series on the label: a
    label appears when at least one metric has a value for it.
    """
    label = label or roles.location
    ms = roles.present_metrics(df.columns)
    vals = {m: nan_to_null(F.col(m)) for m in ms}
    any_value = None
    for v in vals.values():
        any_value = v.isNotNull() if any_value is None else (any_value | v.isNotNull())
    base = params.apply(df, roles).filter(F.col(label).isNotNull() & any_value)
    agg = base.groupBy(F.col(label).cast("string").alias("label")).agg(
        *[F.sum(v).alias(m) for m, v in vals.items()]
    )
    return agg.select("label", *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in ms])


def metric_stats(df: DataFrame, roles: Roles = DEFAULT_ROLES, exact_median: bool = True, broadcast_ranks: bool = True) -> DataFrame:
    """Sum, mean, exact median, min, max per metric; metrics without values omitted.

    One wide aggregate for sum/mean/min/max/count, and the distributed exact
    median (``exact_percentiles``) on the long form, joined on the metric name
    (<= number of metrics rows).  ``exact_median=False`` uses percentile_approx.
    """
    ms = roles.present_metrics(df.columns)
    spark = df.sparkSession
    if not ms:
        return spark.createDataFrame([], "metric string, label string, n bigint, sum double, mean double, median double, min double, max double")
    wide = df.agg(
        *[
            f(nan_to_null(F.col(m))).alias(f"{m}__{name}")
            for m in ms
            for name, f in (("n", F.count), ("sum", F.sum), ("mean", F.avg), ("min", F.min), ("max", F.max))
        ]
    )
    stack_args = ", ".join(
        f"'{m}', `{m}__n`, `{m}__sum`, `{m}__mean`, `{m}__min`, `{m}__max`" for m in ms
    )
    long = wide.selectExpr(f"stack({len(ms)}, {stack_args}) as (metric, n, sum, mean, min, max)")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), nan_to_null(F.col(m)).alias("v")) for m in ms])).alias("s")).select("s.*")
    if exact_median:
        med = exact_percentiles(values, "v", [0.5], by=["metric"], few_groups=broadcast_ranks).select("metric", F.col("v").alias("median"))
    else:
        med = values.groupBy("metric").agg(F.percentile_approx("v", 0.5, 10000).alias("median"))
    labels = spark.createDataFrame([(m, roles.metrics[m]) for m in ms], "metric string, label string")
    return (
        long.filter(F.col("n") > 0)
        .join(F.broadcast(labels), "metric")
        .join(med, "metric", "left")
        .select("metric", "label", "n", "sum", "mean", "median", "min", "max")
    )


def stats_display(stats: DataFrame) -> DataFrame:
    """The stats panel's text: thousands separators, two decimals (count: none)."""
    from meterframe.functions.scalars import thousands

    return stats.select(
        "metric", "label", thousands(F.col("n"), 0).alias("n"),
        *[thousands(F.col(c), 2).alias(c) for c in ("sum", "mean", "median", "min", "max")],
    )


def dataset_summary(df: DataFrame, roles: Roles = DEFAULT_ROLES, approximate: bool = False) -> DataFrame:
    """Rows, cols, distinct meters, distinct locations, date min / max (ISO text)."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs.append((distinct(roles.meter) if roles.meter in df.columns else F.lit(None).cast("long")).alias("meters"))
    aggs.append((distinct(roles.location) if roles.location in df.columns else F.lit(None).cast("long")).alias("locations"))
    if roles.date in df.columns:
        aggs += [F.min(roles.date).alias("_dmin"), F.max(roles.date).alias("_dmax")]
    else:
        aggs += [F.lit(None).cast("date").alias("_dmin"), F.lit(None).cast("date").alias("_dmax")]
    return df.agg(*aggs).select(
        "rows",
        F.lit(len(df.columns)).cast("long").alias("cols"),
        F.col("meters").cast("long").alias("meters"),
        F.col("locations").cast("long").alias("locations"),
        iso_text(F.col("_dmin")).alias("date_min"),
        iso_text(F.col("_dmax")).alias("date_max"),
    )


def date_bounds(df: DataFrame, params: Optional[FilterParams] = None, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Min / max date under the filter (ISO text, '' when empty)."""
    base = params.apply(df, roles) if params else df
    return base.agg(F.min(roles.date).alias("_a"), F.max(roles.date).alias("_b")).select(
        iso_text(F.col("_a")).alias("date_min"), iso_text(F.col("_b")).alias("date_max")
    )


def row_count(df: DataFrame, params: Optional[FilterParams] = None, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Number of rows under the filter."""
    base = params.apply(df, roles) if params else df
    return base.agg(F.count(F.lit(1)).alias("rows"))


def health(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("long").alias("cols")
    )


def page(
    df: DataFrame, date_from, date_to, equals: Optional[dict] = None, limit: int = 100, offset: int = 0,
    columns: Optional[List[str]] = None, roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """G1: rows in range with optional equalities, newest first, LIMIT / OFFSET.

    The key column makes the order total, so pages never overlap.
    """
    pred = date_between(roles.date, date_from, date_to)
    for c, v in (equals or {}).items():
        pred = pred & optional_equals(c, v)
    out = df.filter(pred).orderBy(F.col(roles.date).desc(), F.col(roles.key).asc()).offset(offset).limit(limit)
    return out.select(*columns) if columns else out


def page_after(
    df: DataFrame, date_from, date_to, after: Optional[tuple] = None, equals: Optional[dict] = None, limit: int = 100,
    columns: Optional[List[str]] = None, roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """G1 by key: the page that follows the row with (date, key) ``after`` (the first page without it).

    However deep the page, each task keeps ``limit`` rows and the date bound prunes the scan, where an
    offset carries every earlier row to one place.
    """
    d, k = F.col(roles.date), F.col(roles.key)
    rest = df
    if after is not None:
        rest = df.filter((d < F.lit(after[0])) | ((d == F.lit(after[0])) & (k > F.lit(after[1]))))
    return page(rest, date_from, date_to, equals, limit, 0, columns, roles)


def preview(df: DataFrame, params: Optional[FilterParams] = None, n: int = 10, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """First n rows in a defined order (date, meter, key)."""
    base = params.apply(df, roles) if params else df
    order = [c for c in (roles.date, roles.meter, roles.key) if c in base.columns]
    return base.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)
