"""Facet and exploration queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meterframe.operators import facets as fc
from meterframe.operators import profile as pr
from meterframe.operators.clean import eda_clean
from meterframe.operators.filters import FilterParams
from meterframe.plans.queries_dashboard import AND_TWO, AND_TWO_SQL
from meterframe.plans.registry import register
from meterframe.plans.sql import with_events, with_sales
from meterframe.schema import FACET_CAP, METER_OPTIONS_CAP
from meterframe.sources.adapters import event_sales, sales_table as sales

D = dt.date
RANGE_SQL = "chargedate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"
FACET_PARAMS = FilterParams(start=D(1996, 1, 1), end=D(1998, 12, 31), selections={"loc": ["NATION_3", "NATION_7"]})
FACET_SQL = "chargedate BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND CAST(loc AS VARCHAR) IN ('NATION_3', 'NATION_7')"


def _facets_sql(where: str, facets, caps) -> str:
    union = " UNION ALL ".join(
        f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS value FROM sales WHERE {where}" for f in facets
    )
    cap_pred = " OR ".join(
        f"(facet = '{f}' AND position < {caps[f]})" if caps.get(f) is not None else f"facet = '{f}'" for f in facets
    )
    return with_sales(
        f"SELECT facet, value, position, total FROM r WHERE {cap_pred}",
        f"f AS ({union}), d AS (SELECT DISTINCT facet, value FROM f WHERE value IS NOT NULL), "
        "r AS (SELECT facet, value, CAST(ROW_NUMBER() OVER (PARTITION BY facet ORDER BY value) - 1 AS INTEGER) AS position, "
        "COUNT(*) OVER (PARTITION BY facet) AS total FROM d)",
    )


# ----------------------------------------------------------------- facets
@register("h01_facets", _facets_sql(FACET_SQL, ["loc", "res_mapped", "meterid"], {"meterid": 500}))
def q_h01(spark, sf):
    """All facet lists of a request (the dashboard shows 500 meter ids)."""
    return fc.facet_values(sales(spark, sf), FACET_PARAMS, caps={"meterid": METER_OPTIONS_CAP})


@register("h01_facets_unfiltered", _facets_sql("TRUE", ["loc", "res_mapped", "meterid"], {"meterid": 500}))
def q_h01u(spark, sf):
    """Facet lists of the whole table."""
    return fc.facet_values(sales(spark, sf), caps={"meterid": METER_OPTIONS_CAP})


@register("h04_unique_values", _facets_sql(AND_TWO_SQL, ["meterid", "loc", "res_mapped"], {"meterid": 200, "loc": 200, "res_mapped": 200}))
def q_h04(spark, sf):
    """First 200 sorted values of every non-excluded column under a filter."""
    return fc.unique_values(AND_TWO.apply(sales(spark, sf)), FACET_CAP)


@register(
    "h02_meter_search_regex",
    with_sales(
        "SELECT DISTINCT CAST(meterid AS VARCHAR) AS value FROM sales "
        "WHERE CAST(loc AS VARCHAR) IN ('NATION_3') AND meterid IS NOT NULL "
        "AND regexp_matches(CAST(meterid AS VARCHAR), '1.*2', 'i') ORDER BY value LIMIT 200"
    ),
)
def q_h02(spark, sf):
    """Meter ids matching a regex under the other filters (own selection ignored)."""
    p = FilterParams(selections={"loc": ["NATION_3"], "meterid": ["1"]})
    return fc.meter_options(sales(spark, sf), p, q="1.*2", limit=200)


@register(
    "h03_meter_search_like",
    with_sales(
        "SELECT CAST(v AS VARCHAR) AS value FROM (SELECT DISTINCT meterid AS v FROM sales "
        "WHERE meterid IS NOT NULL AND CAST(loc AS VARCHAR) = 'NATION_7' "
        "AND CAST(meterid AS VARCHAR) ILIKE '%1_3%' ORDER BY v LIMIT 50) AS t"
    ),
)
def q_h03(spark, sf):
    """Meter ids of one location by LIKE search ('_' is a wildcard), numeric order."""
    return fc.meter_options_by_location(sales(spark, sf), loc="NATION_7", q="1_3", limit=50)


_LOC_1996 = "SELECT DISTINCT CAST(loc AS VARCHAR) AS value FROM sales WHERE " + RANGE_SQL + " AND loc IS NOT NULL"


@register(
    "h05_selected_first",
    with_sales(
        "SELECT value, CAST(ROW_NUMBER() OVER (ORDER BY p, o) - 1 AS INTEGER) AS position FROM k",
        f"opts AS ({_LOC_1996}), "
        "o AS (SELECT value, 1 AS p, ROW_NUMBER() OVER (ORDER BY value) - 1 AS o FROM opts), "
        "s AS (SELECT * FROM (VALUES ('NATION_9', 0, 0), ('NATION_Z', 0, 1)) AS t(value, p, o)), "
        "u AS (SELECT value, p, CAST(o AS BIGINT) AS o FROM s UNION ALL SELECT value, p, CAST(o AS BIGINT) FROM o), "
        "k AS (SELECT value, p, o FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY value ORDER BY p, o) = 1)",
    ),
)
def q_h05(spark, sf):
    """Selected values first, then the remaining options, without duplicates."""
    opts = fc.facet_values(sales(spark, sf), FilterParams(start=D(1996, 1, 1), end=D(1996, 12, 31)), facets=["loc"])
    return fc.selected_first(spark, ["NATION_9", "NATION_Z"], opts)


@register(
    "g06_relevance_order",
    with_sales(
        "SELECT value, CAST(score AS INTEGER) AS score, "
        "CAST(ROW_NUMBER() OVER (ORDER BY sel, score, t, value) - 1 AS INTEGER) AS position FROM r",
        "v AS (SELECT DISTINCT CAST(loc AS VARCHAR) AS value FROM sales WHERE loc IS NOT NULL), "
        "r AS (SELECT value, CASE WHEN value = 'NATION_5' THEN 0 ELSE 1 END AS sel, "
        "CASE WHEN value = 'NATION_5' THEN -1 WHEN starts_with(lower(trim(value)), 'nation_2') THEN 0 "
        "WHEN contains(lower(trim(value)), 'nation_2') THEN 1 ELSE 2 END AS score, lower(trim(value)) AS t FROM v)",
    ),
)
def q_g06(spark, sf):
    """Option list ordered: selected, prefix match, substring match, rest."""
    vals = fc.facet_values(sales(spark, sf), facets=["loc"]).select("value")
    return fc.relevance_order(vals, q="nation_2", selected=["NATION_5"])


# ----------------------------------------------------------------- calendars
_MONTH_AGG = (
    "agg AS (SELECT CAST(date_trunc('month', chargedate) AS DATE) AS month, {agg} AS v "
    "FROM {t} WHERE chargedate IS NOT NULL GROUP BY 1), "
    "cal AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM agg), (SELECT max(month) FROM agg), "
    "INTERVAL 1 MONTH)) AS DATE) AS month)"
)


@register(
    "e12_monthly_total",
    with_sales(
        "SELECT last_day(cal.month) AS month_end, COALESCE(agg.v, 0.0) AS kwh FROM cal LEFT JOIN agg ON cal.month = agg.month",
        _MONTH_AGG.format(agg="SUM(kwh)", t="sales"),
    ),
    doubles=["kwh"], dates=["month_end"],
)
def q_e12(spark, sf):
    """Monthly totals with gap months as 0, labelled by month end."""
    return pr.monthly_total(sales(spark, sf), "kwh")


@register(
    "e13_monthly_distinct_meters",
    with_sales(
        "SELECT last_day(cal.month) AS month_end, COALESCE(agg.v, 0) AS unique_meters FROM cal LEFT JOIN agg ON cal.month = agg.month",
        _MONTH_AGG.format(agg="COUNT(DISTINCT meterid)", t="sales"),
    ),
    dates=["month_end"],
)
def q_e13(spark, sf):
    """Distinct meters per month, gaps as 0."""
    return pr.monthly_distinct_meters(sales(spark, sf))


_CHANGE_CTE = _MONTH_AGG.format(agg="COUNT(DISTINCT meterid)", t="sales") + (
    ", s AS (SELECT last_day(cal.month) AS month_end, COALESCE(agg.v, 0) AS unique_meters "
    "FROM cal LEFT JOIN agg ON cal.month = agg.month), "
    "c AS (SELECT month_end, unique_meters, CAST(unique_meters - LAG(unique_meters) OVER (ORDER BY month_end) AS DOUBLE) AS diff FROM s)"
)


@register("f08_period_change", with_sales("SELECT * FROM c", _CHANGE_CTE), doubles=["diff"], dates=["month_end"])
def q_f08(spark, sf):
    """Month-over-month change of the distinct meter count."""
    return pr.period_change(pr.monthly_distinct_meters(sales(spark, sf)), "unique_meters", "month_end")


@register(
    "f09_largest_drop",
    with_sales("SELECT * FROM c WHERE diff IS NOT NULL ORDER BY diff ASC, month_end ASC LIMIT 1", _CHANGE_CTE),
    doubles=["diff"], dates=["month_end"],
)
def q_f09(spark, sf):
    """The month with the largest drop in reporting meters."""
    return pr.largest_drop(pr.period_change(pr.monthly_distinct_meters(sales(spark, sf)), "unique_meters", "month_end"))


# ----------------------------------------------------------------- group means
@register(
    "e14_mean_by_location",
    with_sales("SELECT loc, AVG(kwh) AS kwh FROM sales WHERE loc IS NOT NULL GROUP BY loc"),
    doubles=["kwh"],
)
def q_e14(spark, sf):
    """Mean consumption per location."""
    return pr.mean_by_location(sales(spark, sf))


@register(
    "e15_mean_by_residence",
    with_sales("SELECT res, AVG(kwh) AS kwh FROM sales WHERE res IS NOT NULL GROUP BY res"),
    doubles=["kwh"],
)
def q_e15(spark, sf):
    """Mean consumption per residence type."""
    return pr.mean_by_residence(sales(spark, sf))


@register(
    "e16_mean_by_month_number",
    with_sales(
        "SELECT CAST(month(chargedate) AS INTEGER) AS month_num, strftime(chargedate, '%b') AS month_name, "
        "AVG(kwh) AS kwh FROM sales WHERE chargedate IS NOT NULL GROUP BY 1, 2"
    ),
    doubles=["kwh"],
)
def q_e16(spark, sf):
    """Seasonal profile: mean per calendar month across years."""
    return pr.mean_by_month_number(sales(spark, sf))


@register(
    "e17_mean_by_year",
    with_sales("SELECT CAST(year(chargedate) AS INTEGER) AS year, AVG(kwh) AS kwh FROM sales WHERE chargedate IS NOT NULL GROUP BY 1"),
    doubles=["kwh"],
)
def q_e17(spark, sf):
    """Yearly trend of the mean."""
    return pr.mean_by_year(sales(spark, sf))


_WEEKDAYS_SQL = (
    "days AS (SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), "
    "(4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) AS t(weekday_num, weekday)), "
    "a AS (SELECT CAST(isodow(chargedate) - 1 AS INTEGER) AS weekday_num, AVG(kwh) AS kwh FROM {t} "
    "WHERE chargedate IS NOT NULL GROUP BY 1)"
)


@register(
    "e18_mean_by_weekday",
    with_sales(
        "SELECT CAST(days.weekday_num AS INTEGER) AS weekday_num, days.weekday, a.kwh FROM days LEFT JOIN a USING (weekday_num)",
        _WEEKDAYS_SQL.format(t="sales"),
    ),
    doubles=["kwh"],
)
def q_e18(spark, sf):
    """Weekday profile, Monday..Sunday."""
    return pr.mean_by_weekday(sales(spark, sf))


@register(
    "e18_mean_by_weekday_events",
    with_events(
        "SELECT CAST(days.weekday_num AS INTEGER) AS weekday_num, days.weekday, a.kwh FROM days LEFT JOIN a USING (weekday_num)",
        _WEEKDAYS_SQL.format(t="event_sales"),
    ),
    doubles=["kwh"],
)
def q_e18e(spark, sf):
    """Weekday profile of the event table."""
    return pr.mean_by_weekday(event_sales(spark, sf))


@register(
    "e19_mean_by_residence_weekend",
    with_sales(
        "SELECT res, is_weekend, AVG(kwh) AS kwh, "
        "CASE res WHEN 'N-Resid [0]' THEN 'Non-Residential' WHEN 'Resid [1]' THEN 'Residential' END AS res_label, "
        "CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS day_type "
        "FROM (SELECT res, kwh, isodow(chargedate) IN (6, 7) AS is_weekend FROM sales "
        "WHERE res IS NOT NULL AND chargedate IS NOT NULL) AS t GROUP BY res, is_weekend"
    ),
    doubles=["kwh"],
)
def q_e19(spark, sf):
    """Mean per residence type and weekday / weekend."""
    return pr.mean_by_residence_weekend(sales(spark, sf))


# ----------------------------------------------------------------- meter activity
_PER_METER = "per AS (SELECT meterid, COUNT(*) AS records FROM sales WHERE meterid IS NOT NULL GROUP BY meterid)"


@register("e20_records_per_meter", with_sales("SELECT * FROM per", _PER_METER))
def q_e20(spark, sf):
    """Rows per meter, descending."""
    return pr.records_per_meter(sales(spark, sf))


@register(
    "e21_activity_summary",
    with_sales(
        "SELECT COUNT(*) AS meters, AVG(records) AS mean_records, median(CAST(records AS DOUBLE)) AS median_records, "
        "(SELECT meterid FROM per ORDER BY records DESC, meterid ASC LIMIT 1) AS top_meterid, "
        "(SELECT records FROM per ORDER BY records DESC, meterid ASC LIMIT 1) AS top_records FROM per",
        _PER_METER,
    ),
    doubles=["mean_records", "median_records"],
)
def q_e21(spark, sf):
    """Meter count, mean and exact median records, most active meter."""
    return pr.activity_summary(sales(spark, sf))


@register(
    "e22_records_by_location",
    with_sales(
        "SELECT loc, AVG(records) AS mean_records FROM (SELECT loc, meterid, COUNT(*) AS records FROM sales "
        "WHERE loc IS NOT NULL AND meterid IS NOT NULL GROUP BY loc, meterid) AS t GROUP BY loc"
    ),
    doubles=["mean_records"],
)
def q_e22(spark, sf):
    """Mean records per meter within each location."""
    return pr.records_by_location(sales(spark, sf))


_PROFILE = (
    "prof AS (SELECT meterid, AVG(kwh) AS kwh_mean, stddev_samp(kwh) AS kwh_std, COUNT(kwh) AS kwh_count, "
    "AVG(ghc) AS ghc_mean, stddev_samp(ghc) AS ghc_std, COUNT(ghc) AS ghc_count, "
    "AVG(paymoney) AS paymoney_mean, stddev_samp(paymoney) AS paymoney_std, COUNT(paymoney) AS paymoney_count "
    "FROM sales WHERE meterid IS NOT NULL GROUP BY meterid)"
)


@register(
    "e23_meter_profile",
    with_sales("SELECT * FROM prof", _PROFILE),
    doubles=["kwh_mean", "kwh_std", "ghc_mean", "ghc_std", "paymoney_mean", "paymoney_std"],
)
def q_e23(spark, sf):
    """Per-meter mean, sample std and count of every metric."""
    return pr.meter_profile(sales(spark, sf), ["kwh", "ghc", "paymoney"])


@register(
    "e24_profile_summary",
    with_sales(
        "SELECT COUNT(*) AS meters, AVG(kwh_mean) AS mean_of_means, AVG(kwh_std) AS mean_of_stds FROM prof WHERE kwh_count > 5",
        _PROFILE,
    ),
    doubles=["mean_of_means", "mean_of_stds"],
)
def q_e24(spark, sf):
    """Mean of per-meter means and stds over meters with more than five readings."""
    return pr.profile_summary(sales(spark, sf))


# ----------------------------------------------------------------- table profiles
_M3 = ["kwh", "ghc", "paymoney"]


def _corr_sql() -> str:
    parts = []
    for a in _M3:
        for b in _M3:
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS corr FROM sales")
    return with_sales(" UNION ALL ".join(parts))


@register("e25_correlation", _corr_sql(), doubles=["corr"])
def q_e25(spark, sf):
    """Pearson correlation matrix of the three metrics (long form)."""
    return pr.correlation_matrix(sales(spark, sf), _M3)


_SALES_COLS = ["key", "meterid", "chargedate", "loc", "res", "kwh", "ghc", "paymoney", "res_mapped"]


@register(
    "e26_null_counts",
    with_sales(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls FROM sales" for c in _SALES_COLS
        )
    ),
)
def q_e26(spark, sf):
    """Null count per column."""
    return pr.null_counts(sales(spark, sf))


_TYPE_NAMES = "CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' END"


@register(
    "e28_schema_report",
    with_sales(
        " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, "
            f"(SELECT {_TYPE_NAMES.format(c=c)} FROM sales LIMIT 1) AS data_type, COUNT({c}) AS non_null FROM sales"
            for i, c in enumerate(_SALES_COLS)
        )
    ),
)
def q_e28(spark, sf):
    """Schema report: column, type, non-null count."""
    return pr.schema_report(sales(spark, sf))


def _describe_sql() -> str:
    num = ["key", "meterid", "kwh", "ghc", "paymoney"]
    txt = ["loc", "res", "res_mapped"]
    nparts = [
        f"SELECT '{c}' AS column_name, CAST(COUNT({c}) AS DOUBLE) AS count, CAST(NULL AS DOUBLE) AS unique, "
        f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS DOUBLE) AS freq, AVG(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std, "
        f"CAST(MIN({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, "
        f"CAST(MAX({c}) AS DOUBLE) AS max FROM sales"
        for c in num
    ]
    tparts = [
        f"SELECT '{c}' AS column_name, CAST((SELECT COUNT({c}) FROM sales) AS DOUBLE) AS count, "
        f"CAST((SELECT COUNT(DISTINCT {c}) FROM sales) AS DOUBLE) AS unique, top, CAST(freq AS DOUBLE) AS freq, "
        "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS q25, "
        "CAST(NULL AS DOUBLE) AS q50, CAST(NULL AS DOUBLE) AS q75, CAST(NULL AS DOUBLE) AS max FROM "
        f"(SELECT {c} AS top, COUNT(*) AS freq FROM sales WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY freq DESC, top ASC LIMIT 1) AS t"
        for c in txt
    ]
    return with_sales(" UNION ALL ".join(nparts + tparts))


@register("e27_describe", _describe_sql(), doubles=["count", "unique", "freq", "mean", "std", "min", "q25", "q50", "q75", "max"])
def q_e27(spark, sf):
    """describe(include='all'): numeric stats with exact quartiles, text mode and counts."""
    return pr.describe_all(sales(spark, sf).drop("chargedate"))


def _ts_text_sql(x: str) -> str:
    days = f"floor(({x}) / 86400.0)"
    secs = f"CAST(floor(({x}) - {days} * 86400.0) AS INTEGER)"
    two = lambda e: f"lpad(CAST(CAST({e} AS INTEGER) AS VARCHAR), 2, '0')"
    return (
        f"CASE WHEN ({x}) IS NULL THEN NULL ELSE CAST(DATE '1970-01-01' + CAST({days} AS INTEGER) AS VARCHAR) || ' ' || "
        f"{two(f'floor({secs} / 3600)')} || ':' || {two(f'floor(({secs} % 3600) / 60)')} || ':' || {two(f'{secs} % 60')} END"
    )


@register(
    "e27_describe_dates",
    with_sales(
        "SELECT 'chargedate' AS column_name, CAST(COUNT(v) AS DOUBLE) AS count, "
        + ", ".join(f"{_ts_text_sql(e)} AS {n}" for e, n in (
            ("AVG(v)", "mean"), ("MIN(v)", "min"), ("quantile_cont(v, 0.25)", "q25"),
            ("quantile_cont(v, 0.5)", "q50"), ("quantile_cont(v, 0.75)", "q75"), ("MAX(v)", "max")))
        + " FROM d",
        "d AS (SELECT CAST(epoch(chargedate) AS DOUBLE) AS v FROM sales WHERE chargedate IS NOT NULL)",
    ),
    doubles=["count"],
)
def q_e27d(spark, sf):
    """describe(include='all') for the date column: timestamps text of mean, bounds, quartiles."""
    return pr.describe_dates(sales(spark, sf))


def _hist_sql(long_cte: str, bins: int = 50) -> str:
    step = f"((e.hi - e.lo) / {float(bins)})"
    return (
        "SELECT g.column_name, CAST(g.bin AS INTEGER) AS bin, "
        f"CAST(g.bin AS DOUBLE) * ((g.hi - g.lo) / {float(bins)}) + g.lo AS bin_lo, "
        f"CAST(g.bin + 1 AS DOUBLE) * ((g.hi - g.lo) / {float(bins)}) + g.lo AS bin_hi, "
        "COALESCE(c.cnt, 0) AS count FROM g LEFT JOIN c ON g.column_name = c.column_name AND g.bin = c.bin",
        long_cte + ", l AS (SELECT * FROM long WHERE v IS NOT NULL AND NOT isnan(v)), "
        "raw AS (SELECT column_name, min(v) AS mn, max(v) AS mx FROM l GROUP BY 1), "
        "e AS (SELECT column_name, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, "
        "CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM raw), "
        f"b0 AS (SELECT l.column_name, l.v, e.lo, e.hi, CAST(floor((l.v - e.lo) * ({float(bins)} / (e.hi - e.lo))) AS INTEGER) AS i0 "
        "FROM l JOIN e ON l.column_name = e.column_name), "
        f"b1 AS (SELECT *, CASE WHEN i0 = {bins} THEN {bins - 1} ELSE i0 END AS i1 FROM b0), "
        f"b2 AS (SELECT column_name, CASE WHEN v < CAST(i1 AS DOUBLE) * ((hi - lo) / {float(bins)}) + lo THEN i1 - 1 "
        f"WHEN v >= CAST(i1 + 1 AS DOUBLE) * ((hi - lo) / {float(bins)}) + lo AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END AS bin FROM b1), "
        "c AS (SELECT column_name, bin, COUNT(*) AS cnt FROM b2 GROUP BY 1, 2), "
        f"g AS (SELECT column_name, lo, hi, unnest(range(0, {bins})) AS bin FROM e)",
    )


_h = _hist_sql(
    "long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS column_name, CAST({m} AS DOUBLE) AS v FROM sales" for m in _M3) + ")"
)


@register("e29_histogram", with_sales(*_h), doubles=["bin_lo", "bin_hi"])
def q_e29(spark, sf):
    """50-bin histograms of the three metrics (numpy edges, empty bins as 0)."""
    return pr.histogram(sales(spark, sf), _M3, 50)


_hl = _hist_sql(
    _PER_METER + ", long AS (SELECT 'records' AS column_name, log10(CAST(records AS DOUBLE)) AS v FROM per)"
)


@register("e30_log_histogram", with_sales(*_hl), doubles=["bin_lo", "bin_hi"])
def q_e30(spark, sf):
    """Histogram of log10(records per meter)."""
    return pr.log_histogram_of_records(sales(spark, sf))


@register(
    "e31_density",
    with_sales(
        "SELECT CAST(g.point AS INTEGER) AS point, CAST(g.point AS DOUBLE) * p.step + p.lo AS x, "
        "SUM(exp(-0.5 * ((CAST(g.point AS DOUBLE) * p.step + p.lo - m.v) / p.bw) * ((CAST(g.point AS DOUBLE) * p.step + p.lo - m.v) / p.bw))) "
        "* (1.0 / (p.n * p.bw * sqrt(2 * pi()))) AS density "
        "FROM mv AS m, p, (SELECT unnest(range(0, 200)) AS point) AS g GROUP BY g.point, p.step, p.lo, p.n, p.bw",
        _PROFILE + ", mv AS (SELECT kwh_mean AS v FROM prof WHERE kwh_count > 5 AND kwh_mean IS NOT NULL), "
        "st AS (SELECT COUNT(v) AS n, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx FROM mv), "
        "b AS (SELECT n, sd * pow(n, -0.2) AS bw, mn, mx FROM st), "
        "p AS (SELECT n, bw, mn - 3.0 * bw AS lo, ((mx + 3.0 * bw) - (mn - 3.0 * bw)) / 199 AS step FROM b)",
    ),
    doubles=["x", "density"],
)
def q_e31(spark, sf):
    """Gaussian density of per-meter mean consumption (meters with > 5 readings)."""
    prof = pr.meter_profile(sales(spark, sf), ["kwh"]).filter(F.col("kwh_count") > 5)
    return pr.density(prof, "kwh_mean", 200, 3.0)


@register(
    "e32_percentile_one_location",
    with_sales("SELECT quantile_cont(kwh, 0.64) AS kwh_p64 FROM sales WHERE loc = 'NATION_3'"),
    doubles=["kwh_p64"],
)
def q_e32(spark, sf):
    """Exact 64th percentile of consumption for one location."""
    return pr.percentile_under_filter(sales(spark, sf), "kwh", 0.64, F.col("loc") == F.lit("NATION_3"))


@register(
    "e33_date_text_bounds",
    with_sales(
        "SELECT min(strftime(chargedate, '%d-%b-%y')) AS min_text, max(strftime(chargedate, '%d-%b-%y')) AS max_text, "
        "CAST(min(chargedate) AS VARCHAR) AS min_date, CAST(max(chargedate) AS VARCHAR) AS max_date FROM sales"
    ),
)
def q_e33(spark, sf):
    """Lexicographic bounds of the date text next to the real date bounds."""
    return pr.date_text_bounds(sales(spark, sf))


@register(
    "b11_eda_clean",
    with_sales(
        "SELECT DISTINCT * FROM sales WHERE kwh > 0 AND ghc >= 0 AND paymoney >= 0 "
        "AND chargedate IS NOT NULL AND loc IS NOT NULL AND res IS NOT NULL"
    ),
    doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"],
)
def q_b11(spark, sf):
    """Exploration cleaning: dedupe, validity filter, drop rows without key fields."""
    return eda_clean(sales(spark, sf))


@register(
    "h10_fixed_sample",
    with_sales("SELECT key, kwh, ghc, paymoney FROM sales ORDER BY md5(CAST(key AS VARCHAR) || '-1'), key LIMIT 5000"),
    doubles=["kwh", "ghc", "paymoney"],
)
def q_h10(spark, sf):
    """Repeatable fixed-size sample (5000 rows) for scatter plots."""
    return pr.fixed_sample(sales(spark, sf), 5000, seed=1).select("key", "kwh", "ghc", "paymoney")


# ----------------------------------------------------------------- sub-daily event data
_he = _hist_sql("long AS (SELECT 'kwh' AS column_name, CAST(kwh AS DOUBLE) AS v FROM event_sales)")


@register("e29_histogram_events", with_events(*_he), doubles=["bin_lo", "bin_hi"])
def q_e29e(spark, sf):
    """50-bin histogram of the event values."""
    return pr.histogram(event_sales(spark, sf), ["kwh"], 50)


@register(
    "e32_percentile_events",
    with_events("SELECT quantile_cont(kwh, 0.64) AS kwh_p64 FROM event_sales WHERE loc = 'purchase'"),
    doubles=["kwh_p64"],
)
def q_e32e(spark, sf):
    """Exact 64th percentile of one event type's values."""
    return pr.percentile_under_filter(event_sales(spark, sf), "kwh", 0.64, F.col("loc") == F.lit("purchase"))


@register("h01_facets_requested", _facets_sql(FACET_SQL, ["res", "key"], {}))
def q_h01r(spark, sf):
    """Facets named in the request, whole: a category column and an id column."""
    return fc.facet_values(sales(spark, sf), FACET_PARAMS, facets=["RES", "key"])


_PER_USER = "per AS (SELECT meterid, COUNT(*) AS records FROM event_sales WHERE meterid IS NOT NULL GROUP BY meterid)"


@register("e20_records_per_meter_events", with_events("SELECT * FROM per", _PER_USER))
def q_e20e(spark, sf):
    """Events per user (the meter role), descending."""
    return pr.records_per_meter(event_sales(spark, sf))


@register(
    "e21_activity_summary_events",
    with_events(
        "SELECT COUNT(*) AS meters, AVG(records) AS mean_records, median(CAST(records AS DOUBLE)) AS median_records, "
        "(SELECT meterid FROM per ORDER BY records DESC, meterid ASC LIMIT 1) AS top_meterid, "
        "(SELECT records FROM per ORDER BY records DESC, meterid ASC LIMIT 1) AS top_records FROM per",
        _PER_USER,
    ),
    doubles=["mean_records", "median_records"],
)
def q_e21e(spark, sf):
    """Activity summary of the event table."""
    return pr.activity_summary(event_sales(spark, sf))


@register(
    "e23_meter_profile_events",
    with_events(
        "SELECT meterid, AVG(kwh) AS kwh_mean, stddev_samp(kwh) AS kwh_std, COUNT(kwh) AS kwh_count "
        "FROM event_sales WHERE meterid IS NOT NULL GROUP BY meterid"
    ),
    doubles=["kwh_mean", "kwh_std"],
)
def q_e23e(spark, sf):
    """Per-user mean, sample std and count of event values."""
    return pr.meter_profile(event_sales(spark, sf), ["kwh"])
