"""The dashboard's requests answered from stored summaries: same SQL as the queries over rows."""

from __future__ import annotations

import datetime as dt

from meterframe.operators import summaries as sm
from meterframe.operators.filters import FilterParams
from meterframe.plans import queries_dashboard as dash, queries_explore as explore  # noqa: F401 - their SQL is registered first
from meterframe.plans.registry import REGISTRY, register
from meterframe.plans.sql import with_sales
from meterframe.session import scratch_path, stored
from meterframe.sources.adapters import SALES_INPUTS, files_version, sales_table as sales

_STORED: dict = {}


def summaries(spark, sf):
    """Rollup, bitmaps and meter index of the billing table, built once a session and version of the data."""
    key = (spark.sparkContext.applicationId, files_version(spark, [f"{sf}/{t}.parquet" for t in SALES_INPUTS]))
    if key not in _STORED:
        rows = sales(spark, sf)
        rolled = sm.rollup(stored(sm.roll_up(rows), "rollup"), rows)
        _STORED.clear()
        _STORED[key] = (rolled, stored(sm.meter_bitmaps(rows), "meter-bitmaps"), sm.write_meter_index(rows, scratch_path(spark, "meter-index")))
    return _STORED[key]


def _again(name: str, rows_query: str):
    """Register ``name`` with the SQL of an earlier query."""
    q = REGISTRY[rows_query]
    return register(name, q.sql, q.doubles, q.dates, q.timestamps)


@_again("e01_daily_series_rollup", "e01_daily_series")
def q_e01(spark, sf):
    """Daily totals from the rollup."""
    return sm.daily_series(summaries(spark, sf)[0], sales(spark, sf), dt.date(1996, 1, 1), dt.date(1996, 12, 31), "kwh", loc="NATION_3")


@_again("e03_bucketed_mean_rollup", "e03_bucketed_mean")
def q_e03(spark, sf):
    """Monthly means from the rollup."""
    return sm.bucketed_mean(summaries(spark, sf)[0], sales(spark, sf), dash.ONE_LOC)


@_again("e03_bucketed_mean_weekly_rollup", "e03_bucketed_mean_weekly_filtered")
def q_e03w(spark, sf):
    """Weekly means under two selections from the rollup."""
    return sm.bucketed_mean(summaries(spark, sf)[0], sales(spark, sf), dash.AND_TWO)


@register(
    "e03_bucketed_mean_one_meter",
    with_sales(dash._bucket_sql("month", ["kwh"], "CAST(meterid AS VARCHAR) IN ('7', '11')")),
    doubles=["kwh"], dates=["bucket"],
)
def q_e03m(spark, sf):
    """A selection that the rollup does not hold goes to the rows."""
    p = FilterParams(selections={"meterid": ["7", "11"]}, freq="M", metric="kwh")
    return sm.bucketed_mean(summaries(spark, sf)[0], sales(spark, sf), p)


@_again("e05_totals_by_location_rollup", "e05_totals_by_location")
def q_e05(spark, sf):
    """Totals per location from the rollup."""
    p = FilterParams(start=dt.date(1996, 1, 1), end=dt.date(1996, 12, 31), metric="paymoney")
    return sm.totals_by_location(summaries(spark, sf)[0], sales(spark, sf), p)


@_again("e38_split_series_rollup", "e38_split_series")
def q_e38(spark, sf):
    """Means split by residence from the rollup."""
    return sm.split_series(summaries(spark, sf)[0], sales(spark, sf), dash.RANGE_1996, "res_mapped")


@_again("e08_dataset_summary_bitmaps", "e08_dataset_summary")
def q_e08(spark, sf):
    """The summary from rollup and bitmaps."""
    rolled, bitmaps, _ = summaries(spark, sf)
    return sm.dataset_summary(rolled, bitmaps, sales(spark, sf))


@_again("e08_dataset_summary_filtered_bitmaps", "e08_dataset_summary_filtered")
def q_e08f(spark, sf):
    """The summary under a filter from rollup and bitmaps."""
    rolled, bitmaps, _ = summaries(spark, sf)
    return sm.dataset_summary(rolled, bitmaps, sales(spark, sf), dash.AND_TWO)


@_again("e13_monthly_distinct_meters_bitmaps", "e13_monthly_distinct_meters")
def q_e13(spark, sf):
    """Distinct meters per month from the bitmaps."""
    return sm.monthly_distinct_meters(summaries(spark, sf)[1])


@_again("h02_meter_search_regex_index", "h02_meter_search_regex")
def q_h02(spark, sf):
    """Meter ids matching a regex, from the index."""
    p = FilterParams(selections={"loc": ["NATION_3"], "meterid": ["1"]})
    return sm.meter_options(summaries(spark, sf)[2], sales(spark, sf), p, q="1.*2", limit=200)


@_again("h03_meter_search_like_index", "h03_meter_search_like")
def q_h03(spark, sf):
    """Meter ids by LIKE search, from the index."""
    return sm.meter_options_by_location(summaries(spark, sf)[2], loc="NATION_7", q="1_3", limit=50)


@register(
    "h03_meter_search_gram_index",
    with_sales("SELECT CAST(v AS VARCHAR) AS value FROM (SELECT DISTINCT meterid AS v FROM sales WHERE CAST(meterid AS VARCHAR) ILIKE '%123%') AS t"),
)
def q_h03g(spark, sf):
    """Meter ids that hold a number: the postings of its grams name the candidates."""
    return sm.meter_options_by_location(summaries(spark, sf)[2], q="123")
