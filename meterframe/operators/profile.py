"""Exploratory profiles.

Shapes used throughout:
* calendar gap filling: the calendar is generated from the aggregate's own
  min/max (``sequence`` + ``explode``), so it is as long as the time span,
  not the data, and is joined to the already-aggregated series;
* fixed small dimensions (7 weekdays, 50 bins, 200 grid points) are generated
  with ``spark.range`` / ``sequence`` and broadcast by construction;
* global statistics that need an ordering (medians, quartiles) use the
  distributed exact quantile, never a single-task buffer;
* windows without a partition key only run over aggregated calendars or
  bounded lists (months, <= 50 bins), never over raw rows.
"""

from __future__ import annotations

import math
from typing import List, Optional, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.functions.dates import is_weekend, weekday_index
from meterframe.functions.quantiles import exact_percentiles
from meterframe.functions.scalars import nan_to_null
from meterframe.operators.clean import day_type, residence_display
from meterframe.operators.filters import min_support
from meterframe.schema import DEFAULT_ROLES, WEEKDAYS, Roles


# --------------------------------------------------------------------- calendars
def _with_gap_months(agg: DataFrame, value: str, empty) -> DataFrame:
    """Every month from the first to the last, ``empty`` where the aggregate has none.

    Each month is followed by the months up to the next one it has (``lead``), so the table is read once.
    The window holds one row per month.
    """
    ahead = agg.withColumn("_next", F.lead("month").over(Window.orderBy("month")))
    upto = F.coalesce(F.add_months("_next", -1), F.col("month"))
    run = ahead.withColumn("_m", F.explode(F.sequence("month", upto, F.expr("INTERVAL 1 MONTH"))))
    own = F.when(F.col("_m") == F.col("month"), F.col(value))
    return run.select(F.col("_m").alias("month"), F.coalesce(own, empty).alias(value))


def monthly_total(df: DataFrame, metric: str = "kwh", roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Monthly sum with gap months filled with 0, labelled by month end."""
    rows = df.filter(F.col(roles.date).isNotNull())
    agg = rows.groupBy(F.trunc(roles.date, "month").alias("month")).agg(F.sum(nan_to_null(F.col(metric))).alias(metric))
    return _with_gap_months(agg, metric, F.lit(0.0)).select(F.last_day("month").alias("month_end"), metric)


def monthly_distinct_meters(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Distinct meters reporting per month, gaps filled with 0."""
    rows = df.filter(F.col(roles.date).isNotNull())
    agg = rows.groupBy(F.trunc(roles.date, "month").alias("month")).agg(F.countDistinct(roles.meter).alias("unique_meters"))
    return _with_gap_months(agg, "unique_meters", F.lit(0).cast("long")).select(F.last_day("month").alias("month_end"), "unique_meters")


def period_change(series: DataFrame, value: str, order: str) -> DataFrame:
    """F8: value minus the previous period's value (series is already a calendar)."""
    w = Window.orderBy(order)
    return series.withColumn("diff", (F.col(value) - F.lag(value, 1).over(w)).cast("double"))


def largest_drop(series_with_diff: DataFrame) -> DataFrame:
    """the row with the smallest diff (first such period on ties); null diffs skipped."""
    cols = series_with_diff.columns
    best = F.min_by(F.struct(*cols), F.struct("diff", cols[0]))
    found = series_with_diff.filter(F.col("diff").isNotNull()).agg(best.alias("_r"))
    return found.filter(F.col("_r").isNotNull()).select("_r.*")


# --------------------------------------------------------------------- group means
def mean_by(df: DataFrame, key, metric: str = "kwh", name: Optional[str] = None) -> DataFrame:
    """Mean of a metric per key; null keys dropped first (pandas groupby drops them)."""
    k = F.col(key) if isinstance(key, str) else key
    name = name or (key if isinstance(key, str) else "key")
    return df.filter(k.isNotNull()).groupBy(k.alias(name)).agg(F.avg(nan_to_null(F.col(metric))).alias(metric))


def mean_by_location(df: DataFrame, metric: str = "kwh", roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """E14 (descending)."""
    return mean_by(df, roles.location, metric).orderBy(F.col(metric).desc_nulls_last(), roles.location)


def mean_by_residence(df: DataFrame, metric: str = "kwh", roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """E15."""
    return mean_by(df, roles.residence, metric)


def mean_by_month_number(df: DataFrame, metric: str = "kwh", roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """E16 (+I5): mean per calendar month across years, with the month's short name."""
    d = F.col(roles.date)
    out = mean_by(df.filter(d.isNotNull()), F.month(d), metric, "month_num")
    return out.select(
        "month_num",
        F.date_format(F.make_date(F.lit(2000), F.col("month_num"), F.lit(1)), "MMM").alias("month_name"),
        metric,
    ).orderBy("month_num")


def mean_by_year(df: DataFrame, metric: str = "kwh", roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """E17."""
    return mean_by(df, F.year(F.col(roles.date)), metric, "year").orderBy("year")


def mean_by_weekday(df: DataFrame, metric: str = "kwh", roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """E18 (+I5): fixed Monday..Sunday rows; a weekday without rows gets null."""
    spark = df.sparkSession
    days = spark.createDataFrame([(i, n) for i, n in enumerate(WEEKDAYS)], "weekday_num int, weekday string")
    agg = mean_by(df.filter(F.col(roles.date).isNotNull()), weekday_index(F.col(roles.date)), metric, "weekday_num")
    return F.broadcast(days).join(agg, "weekday_num", "left").select("weekday_num", "weekday", metric)


def mean_by_residence_weekend(df: DataFrame, metric: str = "kwh", roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """E19 (+B12, B13): mean per (residence, weekend flag) with display labels."""
    d = F.col(roles.date)
    base = df.filter(F.col(roles.residence).isNotNull() & d.isNotNull())
    agg = base.groupBy(F.col(roles.residence).alias("res"), is_weekend(d).alias("is_weekend")).agg(
        F.avg(nan_to_null(F.col(metric))).alias(metric)
    )
    return agg.select(
        "res", "is_weekend", metric,
        residence_display(F.col("res")).alias("res_label"),
        day_type(F.col("is_weekend")).alias("day_type"),
    )


# --------------------------------------------------------------------- meter activity
def records_per_meter(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Rows per meter, descending (ties by meter id)."""
    return (
        df.filter(F.col(roles.meter).isNotNull())
        .groupBy(roles.meter)
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy(F.col("records").desc(), F.col(roles.meter))
    )


def activity_summary(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Meters, mean and exact median records per meter, most active meter.

    The most active meter is the one with most records, the smallest id on ties.
    """
    per = df.filter(F.col(roles.meter).isNotNull()).groupBy(roles.meter).agg(F.count(F.lit(1)).alias("records"))
    summary = per.agg(
        F.count(F.lit(1)).alias("meters"),
        F.avg("records").alias("mean_records"),
        F.min(F.struct((-F.col("records")).alias("nr"), F.col(roles.meter).alias("m"))).alias("_top"),
    )
    med = exact_percentiles(per, "records", [0.5]).select(F.col("records").alias("median_records"))
    return _join_one_row(summary, med).select(
        "meters", "mean_records", "median_records",
        F.col("_top.m").alias("top_meterid"), (-F.col("_top.nr")).cast("long").alias("top_records"),
    )


def _join_one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put a (possibly empty) single-row result next to a single-row aggregate
    (left equi-join on a constant, so an empty ``b`` gives nulls, not no row)."""
    return a.withColumn("_one", F.lit(1)).join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")


def records_by_location(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Mean records per meter within each location (two-level aggregate)."""
    per = (
        df.filter(F.col(roles.location).isNotNull() & F.col(roles.meter).isNotNull())
        .groupBy(roles.location, roles.meter)
        .agg(F.count(F.lit(1)).alias("records"))
    )
    return per.groupBy(roles.location).agg(F.avg("records").alias("mean_records")).orderBy(
        F.col("mean_records").desc(), roles.location
    )


def meter_profile(df: DataFrame, metrics: Sequence[str] = ("kwh",), roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """E23 (+H11): per-meter mean, sample std and non-null count, flattened names."""
    aggs = []
    for m in metrics:
        v = nan_to_null(F.col(m))
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_samp(v).alias(f"{m}_std"), F.count(v).alias(f"{m}_count")]
    return df.filter(F.col(roles.meter).isNotNull()).groupBy(roles.meter).agg(*aggs)


def profile_summary(df: DataFrame, metric: str = "kwh", min_count: int = 5, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """E24 (+C14): mean of per-meter means and stds over meters with count > min_count."""
    prof = min_support(meter_profile(df, [metric], roles), f"{metric}_count", min_count)
    return prof.agg(
        F.count(F.lit(1)).alias("meters"),
        F.avg(f"{metric}_mean").alias("mean_of_means"),
        F.avg(f"{metric}_std").alias("mean_of_stds"),
    )


# --------------------------------------------------------------------- table profiles
def correlation_matrix(df: DataFrame, columns: Sequence[str] = ("kwh", "ghc", "paymoney")) -> DataFrame:
    """Pearson correlation of each pair (pairwise complete rows), long form."""
    cols = list(columns)
    aggs = [
        F.corr(nan_to_null(F.col(a)), nan_to_null(F.col(b))).alias(f"{a}__{b}")
        for i, a in enumerate(cols) for b in cols[i:]
    ]
    wide = df.agg(*aggs)
    pairs = []
    for i, a in enumerate(cols):
        for b in cols:
            x, y = (a, b) if cols.index(a) <= cols.index(b) else (b, a)
            pairs.append((a, b, f"{x}__{y}"))
    stack = ", ".join(f"'{a}', '{b}', `{c}`" for a, b, c in pairs)
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) as (var1, var2, corr)")


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column (NaN counts as missing for doubles)."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        miss = c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()
        aggs.append(F.count_if(miss).alias(f.name))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{f.name}', `{f.name}`" for f in df.schema.fields)
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, nulls)")


def schema_report(df: DataFrame) -> DataFrame:
    """Column, type, non-null count, position."""
    fields = df.schema.fields
    wide = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f.name) for f in fields])
    stack = ", ".join(f"{i}, '{f.name}', '{f.dataType.simpleString()}', `{f.name}`" for i, f in enumerate(fields))
    return wide.selectExpr(f"stack({len(fields)}, {stack}) as (position, column_name, data_type, non_null)")


def _quartiles(long: DataFrame, exact: bool) -> DataFrame:
    """(column_name, percentage, v) for the three quartiles, exact or sketched."""
    if exact:
        return exact_percentiles(long, "v", [0.25, 0.5, 0.75], by=["column_name"], few_groups=True)
    q = long.groupBy("column_name").agg(F.percentile_approx("v", [0.25, 0.5, 0.75], 10000).alias("_q"))
    return q.select("column_name", F.posexplode("_q").alias("_i", "v")).select(
        "column_name", F.element_at(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_i") + 1).alias("percentage"), "v")


def describe_all(df: DataFrame, columns: Optional[Sequence[str]] = None, exact: bool = True) -> DataFrame:
    """describe(include='all') for numeric and text columns, one row per column.

    Numeric: count, mean, std, min, quartiles (exact; ``exact=False`` uses
    the one-pass sketch like Spark's ``summary``), max.  Text: count,
    unique, top (most frequent; smallest value on ties) and its frequency.
    Like the pandas table, every statistic is a float (count included).
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    num = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    txt = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    spark = df.sparkSession
    out_schema = (
        "column_name string, count double, unique double, top string, freq double, mean double, std double, "
        "min double, q25 double, q50 double, q75 double, max double"
    )
    parts: List[DataFrame] = []
    if num:
        aggs = []
        for c in num:
            v = nan_to_null(F.col(c).cast("double"))
            aggs += [F.count(v).alias(f"{c}__n"), F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__std"),
                     F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
        wide = df.agg(*aggs)
        stack = ", ".join(f"'{c}', `{c}__n`, `{c}__mean`, `{c}__std`, `{c}__min`, `{c}__max`" for c in num)
        long = wide.selectExpr(f"stack({len(num)}, {stack}) as (column_name, count, mean, std, min, max)")
        values = df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in num])).alias("s")
        ).select("s.*")
        q = _quartiles(values, exact)
        qw = q.groupBy("column_name").agg(
            F.max(F.when(F.col("percentage") == 0.25, F.col("v"))).alias("q25"),
            F.max(F.when(F.col("percentage") == 0.5, F.col("v"))).alias("q50"),
            F.max(F.when(F.col("percentage") == 0.75, F.col("v"))).alias("q75"),
        )
        parts.append(
            long.join(qw, "column_name", "left").select(
                "column_name", F.col("count").cast("double").alias("count"), F.lit(None).cast("double").alias("unique"),
                F.lit(None).cast("string").alias("top"), F.lit(None).cast("double").alias("freq"),
                "mean", "std", "min", "q25", "q50", "q75", "max",
            )
        )
    if txt:
        vals = df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in txt])).alias("s")
        ).select("s.*").filter(F.col("value").isNotNull())
        counts = vals.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
        # min(struct(-count, value)): most frequent first, smallest value on ties; a
        # plain aggregate, so it combines map-side instead of ranking in one task.
        per = counts.groupBy("column_name").agg(
            F.sum("cnt").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("cnt")).alias("nc"), F.col("value").alias("v"))).alias("_m"),
        )
        nulls = [F.lit(None).cast("double").alias(n) for n in ("mean", "std", "min", "q25", "q50", "q75", "max")]
        parts.append(
            per.select("column_name", F.col("count").cast("double").alias("count"), F.col("unique").cast("double"),
                       F.col("_m.v").alias("top"), (-F.col("_m.nc")).cast("double").alias("freq"), *nulls)
        )
    if not parts:
        return spark.createDataFrame([], out_schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _epoch_seconds_text(x):
    """Epoch seconds (double) -> 'yyyy-MM-dd HH:mm:ss' by day / second arithmetic
    (fractions of a second truncated; independent of the session time zone)."""
    days = F.floor(x / F.lit(86400.0))
    secs = F.floor(x - days * F.lit(86400.0)).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string")
    return F.when(x.isNotNull(), F.concat(day, F.lit(" "), two(F.floor(secs / 3600)), F.lit(":"),
                                          two(F.floor((secs % 3600) / 60)), F.lit(":"), two(secs % 60)))


def describe_dates(df: DataFrame, columns: Optional[Sequence[str]] = None, exact: bool = True) -> DataFrame:
    """E27 for DATE columns: count, mean, min, exact quartiles, max as timestamps text
    (pandas interpolates datetimes linearly, so quartiles can fall between days)."""
    dcols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType) and (columns is None or f.name in columns)]
    if not dcols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, count double, mean string, min string, q25 string, q50 string, q75 string, max string")
    secs = lambda c: F.unix_date(F.col(c)).cast("double") * F.lit(86400.0)
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), secs(c).alias("v")) for c in dcols])).alias("s")
    ).select("s.*").filter(F.col("v").isNotNull())
    stats = long.groupBy("column_name").agg(
        F.count("v").cast("double").alias("count"), F.avg("v").alias("_mean"), F.min("v").alias("_min"), F.max("v").alias("_max"))
    q = _quartiles(long, exact).groupBy("column_name").agg(
        *[F.max(F.when(F.col("percentage") == p, F.col("v"))).alias(n) for p, n in ((0.25, "_q25"), (0.5, "_q50"), (0.75, "_q75"))])
    out = stats.join(q, "column_name", "left")
    return out.select("column_name", "count", *[_epoch_seconds_text(F.col(f"_{n}")).alias(n) for n in ("mean", "min", "q25", "q50", "q75", "max")])


# --------------------------------------------------------------------- distributions
def _np_bin(v, lo, hi, bins: int):
    """numpy.histogram's bin index for equal-width bins over [lo, hi] (last bin closed)."""
    norm = F.lit(float(bins)) / (hi - lo)
    idx0 = F.floor((v - lo) * norm).cast("int")
    idx1 = F.when(idx0 == bins, F.lit(bins - 1)).otherwise(idx0)
    step = (hi - lo) / F.lit(float(bins))
    edge = lambda k: k.cast("double") * step + lo  # noqa: E731 - numpy's linspace edges
    return (
        F.when(v < edge(idx1), idx1 - 1)
        .when((v >= edge(idx1 + 1)) & (idx1 != bins - 1), idx1 + 1)
        .otherwise(idx1)
    )


def histogram(df: DataFrame, columns: Sequence[str] = ("kwh", "ghc", "paymoney"), bins: int = 50,
              transform=None) -> DataFrame:
    """Equal-width histogram per column over [min, max]; empty bins give 0.

    Same edges as numpy: all-equal values widen the range to [v-0.5, v+0.5].
    ``transform`` maps the value first (E30 uses log10).  Output: column_name,
    bin, bin_lo, bin_hi, count.
    """
    long = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), nan_to_null(transform(F.col(c)) if transform else F.col(c).cast("double")).alias("v"))
            for c in columns
        ])).alias("s")
    ).select("s.*").filter(F.col("v").isNotNull())
    raw = long.groupBy("column_name").agg(F.min("v").alias("_min"), F.max("v").alias("_max"))
    edges = raw.select(
        "column_name",
        F.when(F.col("_min") == F.col("_max"), F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
        F.when(F.col("_min") == F.col("_max"), F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
    )
    # One row per histogram column: broadcast by construction (bounded by len(columns)).
    binned = long.join(F.broadcast(edges), "column_name").select(
        "column_name", _np_bin(F.col("v"), F.col("_lo"), F.col("_hi"), bins).alias("bin")
    )
    counts = binned.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = edges.select("column_name", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return grid.join(counts, ["column_name", "bin"], "left").select(
        "column_name", "bin",
        (F.col("bin").cast("double") * step + F.col("_lo")).alias("bin_lo"),
        ((F.col("bin") + 1).cast("double") * step + F.col("_lo")).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


def log_histogram_of_records(df: DataFrame, bins: int = 50, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Histogram of log10(records per meter)."""
    per = df.filter(F.col(roles.meter).isNotNull()).groupBy(roles.meter).agg(F.count(F.lit(1)).alias("records"))
    return histogram(per, ["records"], bins, transform=lambda c: F.log10(c.cast("double")))


#: Bandwidths beyond which exp(-z * z / 2) is zero in a double.
REACH = 39.0
#: Cells per bandwidth and moments per cell of the density.  For a value d bandwidths from its cell's middle and
#: a grid point z from it, the kernel is exp(-z²/2) * exp(-d²/2) * exp(z d); the last factor's series is cut after
#: MOMENTS terms.  |z d| <= REACH / (2 CELLS) = 1.22, so the cut is off by at most 1.22^16 / 16! * e^1.22, a share
#: of 4e-12 of that value's kernel.
CELLS, MOMENTS = 16, 16


def density(values: DataFrame, column: str, gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density of a column on a regular grid (Scott's rule).

    bandwidth = sample std * n^(-1/5); grid from min - cut*bw to max + cut*bw.
    All values go into cells of a sixteenth of a bandwidth, each kept as its weighted moments (one
    aggregate with map-side combine, a row per cell that has values); the cells are then convolved with the
    kernel, each with the grid points in reach.  No row per value and grid point; every density is within a
    share of 4e-12 of the exact sum.  Only the four summary numbers reach the driver.
    """
    v = nan_to_null(F.col(column).cast("double"))
    base = values.select(v.alias("v")).filter(F.col("v").isNotNull())
    st = base.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    spark = values.sparkSession
    if st is None or not st["n"] or st["sd"] is None or st["sd"] == 0:
        return spark.createDataFrame([], "point int, x double, density double")
    n, sd = st["n"], st["sd"]
    bw = sd * math.pow(n, -0.2)
    lo, hi = st["lo"] - cut * bw, st["hi"] + cut * bw
    step = (hi - lo) / (gridsize - 1)
    width = bw / CELLS

    def middle(cell):
        return (cell.cast("double") + F.lit(0.5)) * F.lit(width) + F.lit(lo)

    placed = base.withColumn("cell", F.floor((F.col("v") - F.lit(lo)) / F.lit(width)))
    placed = placed.withColumn("d", (F.col("v") - middle(F.col("cell"))) / F.lit(bw))
    placed = placed.withColumn("w0", F.exp(F.lit(-0.5) * F.col("d") * F.col("d")))
    powers = ["w0"]
    for k in range(1, MOMENTS):  # w_k = exp(-d²/2) d^k / k!
        placed = placed.withColumn(f"w{k}", F.col(powers[-1]) * F.col("d") / F.lit(float(k)))
        powers.append(f"w{k}")
    cells = placed.groupBy("cell").agg(*[F.sum(w).alias(w) for w in powers])
    # Only the grid points within REACH bandwidths: beyond, the kernel is zero in a double.
    at, near = middle(F.col("cell")), F.lit(REACH * bw)
    first = F.greatest(F.lit(0), F.ceil((at - near - F.lit(lo)) / F.lit(step))).cast("int")
    last = F.least(F.lit(gridsize - 1), F.floor((at + near - F.lit(lo)) / F.lit(step))).cast("int")
    pts = cells.withColumn("point", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    pts = pts.withColumn("z", (F.col("point").cast("double") * F.lit(step) + F.lit(lo) - middle(F.col("cell"))) / F.lit(bw))
    series = F.col(powers[-1])
    for w in reversed(powers[:-1]):
        series = series * F.col("z") + F.col(w)
    sums = pts.groupBy("point").agg(F.sum(F.exp(F.lit(-0.5) * F.col("z") * F.col("z")) * series).alias("_s"))
    norm = 1.0 / (n * bw * math.sqrt(2 * math.pi))
    grid = spark.range(gridsize).select(F.col("id").cast("int").alias("point"))
    return grid.join(F.broadcast(sums), "point", "left").select(
        "point",
        (F.col("point").cast("double") * F.lit(step) + F.lit(lo)).alias("x"),
        (F.coalesce(F.col("_s"), F.lit(0.0)) * F.lit(norm)).alias("density"),
    )


def percentile_under_filter(df: DataFrame, column: str, p: float, predicate=None, exact: bool = True,
                            accuracy: int = 10000) -> DataFrame:
    """Linear-interpolation percentile of a column under an equality filter.

    Exact by default (distributed, see ``exact_percentiles``); ``exact=False``
    uses Spark's ``percentile_approx`` (a value of the column, rank error at
    most n / accuracy) in one pass.
    """
    base = df.filter(predicate) if predicate is not None else df
    name = f"{column}_p{int(round(p * 100))}"
    if not exact:
        return base.agg(F.percentile_approx(nan_to_null(F.col(column).cast("double")), p, accuracy).alias(name))
    return exact_percentiles(base, column, [p]).select(F.col(column).alias(name))


def date_text_bounds(df: DataFrame, roles: Roles = DEFAULT_ROLES, fmt: str = "dd-MMM-yy") -> DataFrame:
    """Lexicographic min / max of the date *text* next to the true date bounds."""
    txt = F.date_format(F.col(roles.date), fmt)
    return df.agg(
        F.min(txt).alias("min_text"), F.max(txt).alias("max_text"),
        F.min(roles.date).cast("string").alias("min_date"), F.max(roles.date).cast("string").alias("max_date"),
    )


def fixed_sample(df: DataFrame, n: int = 5000, seed: int = 1, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Exactly n rows (or all), repeatable on any engine: the n smallest md5 of "key-seed".

    ``orderBy().limit()`` is a TakeOrderedAndProject: each partition keeps only
    n rows, so the sample size, not the data, bounds the final merge.
    """
    rank = F.md5(F.concat_ws("-", F.col(roles.key).cast("string"), F.lit(str(seed))))
    return df.orderBy(rank, F.col(roles.key)).limit(n)


def exploration_report(df: DataFrame, roles: Roles = DEFAULT_ROLES, metric: str = "kwh") -> dict:
    """The exploration sequence as named DataFrames.

    Building the report runs only the small driver-side summaries that the
    exact median and the density need (bounds, five statistics); every
    result itself is lazy.

    Schema and quality (E28, E26, E27), cleaning (B11/B3/B8), distributions and
    correlation (E29, E25), time trends and coverage (E12, E13, F8, F9),
    location / residence / seasonal / weekday profiles (E14-E19), meter activity
    (E20-E22), per-meter variability (E23, E24, E31) and the scatter sample (H10).
    """
    from meterframe.operators.clean import eda_clean

    clean = eda_clean(df, roles)
    metrics = roles.present_metrics(clean.columns)
    coverage = period_change(monthly_distinct_meters(clean, roles), "unique_meters", "month_end")
    usage = meter_profile(clean, [metric], roles).filter(F.col(f"{metric}_count") > 5)
    return {
        "schema": schema_report(df),
        "null_counts": null_counts(df),
        "describe": describe_all(df),
        "describe_dates": describe_dates(df),
        "clean": clean,
        "histograms": histogram(clean, metrics),
        "correlation": correlation_matrix(clean, metrics),
        "monthly_total": monthly_total(clean, metric, roles),
        "monthly_meters": coverage,
        "largest_drop": largest_drop(coverage),
        "by_location": mean_by_location(clean, metric, roles),
        "by_residence": mean_by_residence(clean, metric, roles),
        "by_month": mean_by_month_number(clean, metric, roles),
        "by_year": mean_by_year(clean, metric, roles),
        "by_weekday": mean_by_weekday(clean, metric, roles),
        "by_residence_weekend": mean_by_residence_weekend(clean, metric, roles),
        "records_per_meter": records_per_meter(clean, roles),
        "activity": activity_summary(clean, roles),
        "records_by_location": records_by_location(clean, roles),
        "meter_usage": usage,
        "usage_summary": profile_summary(clean, metric, 5, roles),
        "usage_density": density(usage, f"{metric}_mean"),
        "sample": fixed_sample(clean, 5000, 1, roles),
    }
