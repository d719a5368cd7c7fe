"""Dashboard queries: time series, composition, totals, stats, summary, paging."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meterframe.operators import aggregates as agg
from meterframe.operators.filters import FilterParams, filter_by_request
from meterframe.plans.registry import REGISTRY, register
from meterframe.plans.sql import with_events, with_sales
from meterframe.sources.adapters import event_sales, sales_table as sales

D = dt.date
METRICS3 = "kwh,ghc,paymoney"

# Parameter fixtures of the dashboard requests.
ONE_LOC = FilterParams(selections={"loc": ["NATION_3"]}, freq="M", metric=METRICS3)
AND_TWO = FilterParams(
    start=D(1996, 1, 1), end=D(1998, 12, 31),
    selections={"loc": ["NATION_3", "NATION_7"], "res_mapped": ["Commercial"]}, freq="W", metric=METRICS3,
)
RANGE_1996 = FilterParams(start=D(1996, 1, 1), end=D(1996, 12, 31), freq="M", metric="kwh,ghc")
OPEN_START = FilterParams(end=D(1997, 6, 30), freq="W", metric="kwh")
OPEN_END = FilterParams(start=D(2000, 3, 1), freq="W", metric="kwh")
CASE_AND_BLANK = {"LOC": ["NATION_3", "", None], "nosuch": ["x"], "freq": "x", "metric": "kwh"}
EMPTY = FilterParams(start=D(1900, 1, 1), end=D(1900, 1, 2), metric="kwh")

AND_TWO_SQL = (
    "chargedate BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' "
    "AND CAST(loc AS VARCHAR) IN ('NATION_3', 'NATION_7') AND CAST(res_mapped AS VARCHAR) IN ('Commercial')"
)


def _bucket_sql(freq_unit: str, metrics, where: str = "TRUE", table: str = "sales") -> str:
    b = f"CAST(date_trunc('{freq_unit}', chargedate) AS DATE)"
    label = f"strftime({b}, '%Y-%m')" if freq_unit == "month" else f"CAST({b} AS VARCHAR)"
    ms = ", ".join(f"COALESCE(AVG({m}), 0.0) AS {m}" for m in metrics)
    return (
        f"SELECT {b} AS bucket, {label} AS label, {ms} FROM {table} "
        f"WHERE ({where}) AND chargedate IS NOT NULL GROUP BY 1, 2"
    )


# ----------------------------------------------------------------- E3 / C13
@register(
    "e03_bucketed_mean",
    with_sales(_bucket_sql("month", ["kwh", "ghc", "paymoney"], "CAST(loc AS VARCHAR) IN ('NATION_3')")),
    doubles=["kwh", "ghc", "paymoney"], dates=["bucket"],
)
def q_e03(spark, sf):
    """Monthly mean of three metrics for one location (the flagship query)."""
    return agg.bucketed_mean(sales(spark, sf), ONE_LOC)


@register(
    "e03_bucketed_mean_weekly_filtered",
    with_sales(_bucket_sql("week", ["kwh", "ghc", "paymoney"], AND_TWO_SQL)),
    doubles=["kwh", "ghc", "paymoney"], dates=["bucket"],
)
def q_e03_w(spark, sf):
    """Weekly means under a date range AND two selections (and_two)."""
    return agg.bucketed_mean(sales(spark, sf), AND_TWO)


@register(
    "e03_bucketed_mean_open_start",
    with_sales(_bucket_sql("week", ["kwh"], "chargedate <= DATE '1997-06-30'")),
    doubles=["kwh"], dates=["bucket"],
)
def q_e03_os(spark, sf):
    """Weekly means with only an end bound."""
    return agg.bucketed_mean(sales(spark, sf), OPEN_START)


@register(
    "e03_bucketed_mean_open_end",
    with_sales(_bucket_sql("week", ["kwh"], "chargedate >= DATE '2000-03-01'")),
    doubles=["kwh"], dates=["bucket"],
)
def q_e03_oe(spark, sf):
    """Weekly means with only a start bound."""
    return agg.bucketed_mean(sales(spark, sf), OPEN_END)


@register(
    "e03_bucketed_mean_events_daily",
    with_events(_bucket_sql("day", ["kwh"], table="event_sales")),
    doubles=["kwh"], dates=["bucket"],
)
def q_e03_ev(spark, sf):
    """Daily means of the sub-daily event table (timestamps bucketed to DATE)."""
    return agg.bucketed_mean(event_sales(spark, sf), FilterParams(freq="D", metric="kwh"))


@register(
    "e03_bucketed_mean_events_weekly",
    with_events(_bucket_sql("week", ["kwh"], table="event_sales")),
    doubles=["kwh"], dates=["bucket"],
)
def q_e03_evw(spark, sf):
    """Weekly means of the event table (Monday buckets)."""
    return agg.bucketed_mean(event_sales(spark, sf), FilterParams(freq="W", metric="kwh"))


@register(
    "c13_metric_validation",
    with_sales(_bucket_sql("month", ["kwh", "ghc"], "chargedate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")),
    doubles=["kwh", "ghc"], dates=["bucket"],
)
def q_c13(spark, sf):
    """Metric list with an unknown name: only the valid metrics are computed."""
    p = FilterParams(start=D(1996, 1, 1), end=D(1996, 12, 31), freq="M", metric="kwh,nosuch,ghc")
    return agg.bucketed_mean(sales(spark, sf), p)


@register(
    "e38_split_series",
    with_sales(
        "SELECT CAST(date_trunc('month', chargedate) AS DATE) AS bucket, "
        "strftime(CAST(date_trunc('month', chargedate) AS DATE), '%Y-%m') AS label, "
        "CAST(res_mapped AS VARCHAR) AS series, COALESCE(AVG(kwh), 0.0) AS kwh, COALESCE(AVG(ghc), 0.0) AS ghc "
        "FROM sales WHERE chargedate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' "
        "AND chargedate IS NOT NULL AND res_mapped IS NOT NULL GROUP BY 1, 2, 3"
    ),
    doubles=["kwh", "ghc"], dates=["bucket"],
)
def q_e38(spark, sf):
    """Monthly means split by residence category (long form)."""
    return agg.split_series(sales(spark, sf), RANGE_1996, "res_mapped")


# ----------------------------------------------------------------- E1 / E2
@register(
    "e01_daily_series",
    with_sales(
        "SELECT chargedate AS day, SUM(kwh) AS total_kwh FROM sales "
        "WHERE chargedate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND loc = 'NATION_3' GROUP BY 1"
    ),
    doubles=["total_kwh"], dates=["day"],
)
def q_e01(spark, sf):
    """Daily totals in a range for one location."""
    return agg.daily_series(sales(spark, sf), D(1996, 1, 1), D(1996, 12, 31), "kwh", loc="NATION_3")


@register(
    "e02_top_locations",
    with_sales(
        "SELECT loc, SUM(ghc) AS total_ghc FROM sales "
        "WHERE chargedate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' "
        "GROUP BY loc ORDER BY total_ghc DESC NULLS LAST, loc ASC NULLS LAST LIMIT 10"
    ),
    doubles=["total_ghc"],
)
def q_e02(spark, sf):
    """Ten locations with the largest totals in a range."""
    return agg.top_categories(sales(spark, sf), D(1996, 1, 1), D(1996, 12, 31), "ghc", "loc", 10)


# ----------------------------------------------------------------- E4 / E6 / E5 / D3
def _composition_sql(segment: str, metric: str, where: str = "TRUE") -> str:
    return (
        f"SELECT CAST(position AS INTEGER) AS position, label, value FROM ranked WHERE position < 8 "
        f"UNION ALL SELECT 8 AS position, 'Other' AS label, SUM(value) AS value FROM ranked "
        f"WHERE position >= 8 HAVING COUNT(*) > 0",
        f"sums AS (SELECT CAST({segment} AS VARCHAR) AS label, SUM({metric}) AS value FROM sales "
        f"WHERE ({where}) AND {segment} IS NOT NULL AND {metric} IS NOT NULL GROUP BY 1), "
        f"ranked AS (SELECT label, value, ROW_NUMBER() OVER (ORDER BY value DESC, label ASC) - 1 AS position FROM sums)",
    )


_c_res = _composition_sql("res_mapped", "kwh")
_c_loc = _composition_sql("loc", "ghc")


@register("e04_composition", with_sales(_c_res[0], _c_res[1]), doubles=["value"])
def q_e04(spark, sf):
    """Composition by residence category (three slices, no remainder)."""
    return agg.composition(sales(spark, sf), FilterParams(metric="kwh"))


@register("e04_composition_top8_other", with_sales(_c_loc[0], _c_loc[1]), doubles=["value"])
def q_e04_loc(spark, sf):
    """Composition by location: eight slices plus the 'Other' remainder."""
    return agg.composition(sales(spark, sf), FilterParams(metric="ghc"), segment="loc")


@register(
    "e06_share_of_total",
    with_sales(
        "SELECT position, label, value, COALESCE(ROUND(100.0 * value / NULLIF(SUM(value) OVER (), 0), 1), 0.0) AS share_pct "
        "FROM (" + _c_loc[0] + ") AS c",
        _c_loc[1],
    ),
    doubles=["value", "share_pct"],
)
def q_e06(spark, sf):
    """Percentage share of each composition slice."""
    return agg.share_of_total(agg.composition(sales(spark, sf), FilterParams(metric="ghc"), segment="loc"))


@register(
    "e05_totals_by_location",
    with_sales(
        "SELECT CAST(loc AS VARCHAR) AS label, SUM(paymoney) AS value FROM sales "
        "WHERE chargedate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' "
        "AND loc IS NOT NULL AND paymoney IS NOT NULL GROUP BY 1"
    ),
    doubles=["value"],
)
def q_e05(spark, sf):
    """Totals per location, uncapped, under a date range."""
    p = FilterParams(start=D(1996, 1, 1), end=D(1996, 12, 31), metric="paymoney")
    return agg.totals_by_location(sales(spark, sf), p)


@register(
    "d03_aligned_sums",
    with_sales(
        "SELECT CAST(loc AS VARCHAR) AS label, COALESCE(SUM(kwh), 0.0) AS kwh, "
        "COALESCE(SUM(paymoney), 0.0) AS paymoney, COALESCE(SUM(ghc), 0.0) AS ghc FROM sales "
        "WHERE loc IS NOT NULL AND (kwh IS NOT NULL OR paymoney IS NOT NULL OR ghc IS NOT NULL) GROUP BY 1"
    ),
    doubles=["kwh", "paymoney", "ghc"],
)
def q_d03(spark, sf):
    """Per-location sums of all metrics aligned on one label set."""
    return agg.aligned_sums(sales(spark, sf), FilterParams())


# ----------------------------------------------------------------- E7-E11
@register(
    "e07_metric_stats",
    with_sales(
        "SELECT metric, label, COUNT(x) AS n, SUM(x) AS sum, AVG(x) AS mean, median(x) AS median, "
        "MIN(x) AS min, MAX(x) AS max FROM v GROUP BY metric, label HAVING COUNT(x) > 0",
        "v AS (SELECT 'kwh' AS metric, 'kWh' AS label, kwh AS x FROM sales "
        "UNION ALL SELECT 'paymoney', 'Pay', paymoney FROM sales "
        "UNION ALL SELECT 'ghc', 'GHC', ghc FROM sales)",
    ),
    doubles=["sum", "mean", "median", "min", "max"],
)
def q_e07(spark, sf):
    """Sum / mean / exact median / min / max per metric over the whole table."""
    return agg.metric_stats(sales(spark, sf))


@register("e07_metric_stats_narrowing_path", REGISTRY["e07_metric_stats"].sql,
          doubles=["sum", "mean", "median", "min", "max"])
def q_e07n(spark, sf):
    """The same stats with the wanted ranks joined by shuffle instead of broadcast (what a
    grouping without a bound on its groups does)."""
    return agg.metric_stats(sales(spark, sf), broadcast_ranks=False)


@register(
    "i11_stats_display",
    with_sales(
        "SELECT metric, label, format('{:,}', COUNT(x)) AS n, format('{:,.2f}', SUM(x)) AS sum, "
        "format('{:,.2f}', AVG(x)) AS mean, format('{:,.2f}', median(x)) AS median, "
        "format('{:,.2f}', MIN(x)) AS min, format('{:,.2f}', MAX(x)) AS max FROM v GROUP BY metric, label HAVING COUNT(x) > 0",
        "v AS (SELECT 'kwh' AS metric, 'kWh' AS label, kwh AS x FROM sales "
        "UNION ALL SELECT 'paymoney', 'Pay', paymoney FROM sales "
        "UNION ALL SELECT 'ghc', 'GHC', ghc FROM sales)",
    ),
)
def q_i11(spark, sf):
    """Metric stats rendered as panel text (1,234.57)."""
    return agg.stats_display(agg.metric_stats(sales(spark, sf)))


_SUMMARY_SQL = (
    "SELECT COUNT(*) AS \"rows\", CAST(9 AS BIGINT) AS cols, COUNT(DISTINCT meterid) AS meters, "
    "COUNT(DISTINCT loc) AS locations, COALESCE(CAST(MIN(chargedate) AS VARCHAR), '') AS date_min, "
    "COALESCE(CAST(MAX(chargedate) AS VARCHAR), '') AS date_max FROM sales WHERE {w}"
)


@register("e08_dataset_summary", with_sales(_SUMMARY_SQL.format(w="TRUE")))
def q_e08(spark, sf):
    """Rows, columns, distinct meters and locations, date span."""
    return agg.dataset_summary(sales(spark, sf))


@register("e08_dataset_summary_filtered", with_sales(_SUMMARY_SQL.format(w=AND_TWO_SQL)))
def q_e08f(spark, sf):
    """The summary under a filter."""
    return agg.dataset_summary(AND_TWO.apply(sales(spark, sf)))


@register(
    "e09_date_bounds",
    with_sales(
        "SELECT COALESCE(CAST(MIN(chargedate) AS VARCHAR), '') AS date_min, "
        f"COALESCE(CAST(MAX(chargedate) AS VARCHAR), '') AS date_max FROM sales WHERE {AND_TWO_SQL}"
    ),
)
def q_e09(spark, sf):
    """Date bounds under a filter."""
    return agg.date_bounds(sales(spark, sf), AND_TWO)


@register("e10_row_count", with_sales(f"SELECT COUNT(*) AS \"rows\" FROM sales WHERE {AND_TWO_SQL}"))
def q_e10(spark, sf):
    """Row count under a filter."""
    return agg.row_count(sales(spark, sf), AND_TWO)


@register(
    "e10_row_count_empty",
    with_sales("SELECT COUNT(*) AS \"rows\" FROM sales WHERE chargedate BETWEEN DATE '1900-01-01' AND DATE '1900-01-02'"),
)
def q_e10e(spark, sf):
    """Row count of a range that matches nothing."""
    return agg.row_count(sales(spark, sf), EMPTY)


@register("e11_health", with_sales("SELECT COUNT(*) AS \"rows\", CAST(9 AS BIGINT) AS cols FROM sales"))
def q_e11(spark, sf):
    """Health probe: rows and columns of the table."""
    return agg.health(sales(spark, sf))


# ----------------------------------------------------------------- G1 / G2 / C1 / C3
@register(
    "g01_page",
    with_sales(
        "SELECT key, chargedate, meterid, loc, kwh FROM sales "
        "WHERE chargedate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND loc = 'NATION_3' "
        "ORDER BY chargedate DESC, key ASC LIMIT 20 OFFSET 40"
    ),
    doubles=["kwh"], dates=["chargedate"],
)
def q_g01(spark, sf):
    """Third page of 20 rows, newest first, in a range for one location."""
    return agg.page(
        sales(spark, sf), D(1996, 1, 1), D(1996, 12, 31), {"loc": "NATION_3"}, limit=20, offset=40,
        columns=["key", "chargedate", "meterid", "loc", "kwh"],
    )


@register(
    "g02_preview",
    with_sales(
        "SELECT * FROM sales WHERE CAST(loc AS VARCHAR) IN ('NATION_3') "
        "ORDER BY chargedate ASC NULLS LAST, meterid ASC NULLS LAST, key ASC NULLS LAST LIMIT 10"
    ),
    doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"],
)
def q_g02(spark, sf):
    """First ten filtered rows in (date, meter, key) order."""
    return agg.preview(sales(spark, sf), ONE_LOC, 10)


@register(
    "c01_filter_rows",
    with_sales(f"SELECT * FROM sales WHERE {AND_TWO_SQL}"),
    doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"],
)
def q_c01(spark, sf):
    """Rows under a date range AND two IN-lists (pushed to the scan)."""
    return AND_TWO.apply(sales(spark, sf))


@register(
    "c03_request_filter",
    with_sales("SELECT * FROM sales WHERE CAST(loc AS VARCHAR) IN ('NATION_3')"),
    doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"],
)
def q_c03(spark, sf):
    """Request with upper-case key, blank and null values, an unknown column and a bad freq."""
    return filter_by_request(sales(spark, sf), CASE_AND_BLANK)


# ----------------------------------------------------------------- request forms, sub-daily data
JSON_REQUEST = {
    "selections": {"LOC": ["NATION_3", "NATION_7", ""], "res_mapped": "Commercial", "nosuch": ["x"]},
    "start_date": "1996-01-01", "end_date": "1996-06-30", "freq": "x",
}


@register(
    "c03_request_filter_json",
    with_sales(
        "SELECT * FROM sales WHERE chargedate BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' "
        "AND CAST(loc AS VARCHAR) IN ('NATION_3', 'NATION_7')"
    ),
    doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"],
)
def q_c03j(spark, sf):
    """JSON request form: case-insensitive keys, a non-list value skipped, blanks dropped."""
    return filter_by_request(sales(spark, sf), JSON_REQUEST, enforce_exclusions=False, check_freq=False)


_c_filt = _composition_sql("loc", "kwh", AND_TWO_SQL.replace("AND CAST(res_mapped AS VARCHAR) IN ('Commercial')", ""))


@register("e04_composition_filtered", with_sales(_c_filt[0], _c_filt[1]), doubles=["value"])
def q_e04f(spark, sf):
    """Composition by location under a date range and a location selection."""
    p = FilterParams(start=D(1996, 1, 1), end=D(1998, 12, 31), selections={"loc": ["NATION_3", "NATION_7"]}, metric="kwh")
    return agg.composition(sales(spark, sf), p, segment="loc")


@register(
    "c07_end_of_day_bound",
    with_events(
        "SELECT COUNT(*) AS \"rows\" FROM event_sales WHERE chargedate BETWEEN DATE '2024-01-02' AND DATE '2024-01-05'"
    ),
)
def q_c07(spark, sf):
    """Inclusive end day on sub-daily rows: events late on the end date count."""
    return agg.row_count(event_sales(spark, sf), FilterParams(start=D(2024, 1, 2), end=D(2024, 1, 5)))


@register(
    "e01_daily_series_events",
    with_events(
        "SELECT chargedate AS day, SUM(kwh) AS total_kwh FROM event_sales "
        "WHERE chargedate BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND loc = 'click' GROUP BY 1"
    ),
    doubles=["total_kwh"], dates=["day"],
)
def q_e01e(spark, sf):
    """Daily totals of one event type over the month of events."""
    return agg.daily_series(event_sales(spark, sf), D(2024, 1, 1), D(2024, 1, 31), "kwh", loc="click")
