"""Source and sink queries: CSV round trip, table replace / scan, fallback chain, SQL parameters.

These write into the session's shared scratch folder (``spark.checkpoint.dir``),
each run into a fresh sub-folder, then read the written data back.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meterframe.operators.clean import add_weekend_flag, drop_columns, preprocess, project, rename
from meterframe.operators.filters import FilterParams
from meterframe.plans.registry import register
from meterframe.plans.sql import with_sales
from meterframe.session import scratch_path
from meterframe.sources import readers as rd
from meterframe.sources import sinks as sk
from meterframe.sources.adapters import build_sales_table, sales_raw, sales_table

_ALL_PRESENT = (
    "key IS NOT NULL AND meterid IS NOT NULL AND chargedate IS NOT NULL AND loc IS NOT NULL "
    "AND res IS NOT NULL AND kwh IS NOT NULL AND ghc IS NOT NULL AND paymoney IS NOT NULL"
)


@register("a00_sales_build", with_sales("SELECT * FROM sales"), doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"])
def q_a00(spark, sf):
    """Build the billing table from the warehouse tables (lineitem pre-aggregated per
    order, joined to orders, customers and nations), write it, scan it."""
    return spark.read.parquet(build_sales_table(spark, sf))


@register(
    "a01_csv_roundtrip",
    with_sales(f"SELECT DISTINCT key, meterid, chargedate, loc, res, kwh, ghc, paymoney, res_mapped FROM sales WHERE {_ALL_PRESENT}"),
    doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"],
)
def q_a01(spark, sf):
    """Export in the source CSV layout (dd-MMM-yy text dates), scan the folder back
    with the upload glob filter, and run the ingest preprocessing (B0)."""
    path = scratch_path(spark, "csv_export")
    sk.export_csv(sk.to_source_csv_layout(sales_raw(spark, sf)), path)
    return preprocess(rd.type_ids(rd.read_csv(spark, path)))


@register(
    "a06_table_replace_scan",
    with_sales(f"SELECT DISTINCT chargedate, key, meterid, loc, res, kwh, ghc, paymoney, res_mapped FROM sales WHERE {_ALL_PRESENT}"),
    doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"],
)
def q_a06(spark, sf):
    """Replace prod.sales (preprocess, date first, staged write, swap, analyze) and scan it."""
    sk.replace_table(spark, sales_raw(spark, sf), "prod.sales")
    return rd.read_table(spark, "prod.sales")


@register(
    "a06_table_replace_partitioned",
    with_sales(f"SELECT DISTINCT chargedate, key, meterid, loc, res, kwh, ghc, paymoney, res_mapped, CAST(year(chargedate) AS INTEGER) AS year FROM sales WHERE {_ALL_PRESENT}"),
    doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"],
)
def q_a06p(spark, sf):
    """Replace a table partitioned by year, twice, and scan it."""
    rows = preprocess(sales_raw(spark, sf)).withColumn("year", F.year("chargedate"))
    for _ in range(2):
        sk.replace_table(spark, rows, "prod.sales_by_year", clean=False, partition_by=["year"], analyze=False)
    return rd.read_table(spark, "prod.sales_by_year")


_TYPED = "chargedate, key, meterid, loc, res, kwh, ghc, paymoney"


@register("a07_rebuild_from_csv", with_sales(f"SELECT {_TYPED} FROM sales"), doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"])
def q_a07(spark, sf):
    """Rebuild a table from CSV files in the source's layout (no dedupe, no null drop), and scan it."""
    path = scratch_path(spark, "csv_rebuild")
    sk.export_csv(sk.to_source_csv_layout(sales_raw(spark, sf)), path)
    sk.rebuild_from_csv(spark, path, "prod.sales_rebuilt")
    return rd.read_table(spark, "prod.sales_rebuilt").select(*[c.strip() for c in _TYPED.split(",")])


@register(
    "a11_ingest_upload",
    with_sales(f"SELECT DISTINCT {_TYPED}, res_mapped FROM sales WHERE {_ALL_PRESENT}"),
    doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"],
)
def q_a11(spark, sf):
    """An uploaded CSV (a folder of part files here) replaces a table; scan it."""
    path = scratch_path(spark, "upload") + ".csv"
    sk.export_csv(sk.to_source_csv_layout(sales_raw(spark, sf)), path)
    sk.ingest_upload(spark, path, "prod.sales_uploaded")
    return rd.read_table(spark, "prod.sales_uploaded")


@register(
    "a09_refresh_from_parquet",
    with_sales(f"SELECT DISTINCT {_TYPED}, res_mapped FROM sales WHERE {_ALL_PRESENT}"),
    doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"],
)
def q_a09(spark, sf):
    """A Parquet export is read from its URI (A3) and replaces a table (A9); a missing one changes nothing."""
    path = scratch_path(spark, "export")
    sales_raw(spark, sf).write.parquet(path)
    sk.refresh_from_uri(spark, path, "prod.sales_refreshed")
    sk.refresh_from_uri(spark, path + "-missing", "prod.sales_refreshed")
    return rd.read_table(spark, "prod.sales_refreshed")


@register("a13_quoted_export", with_sales("SELECT CAST(key AS VARCHAR) AS key, CAST(meterid AS VARCHAR) AS meterid, loc || ', \"x\"' AS loc FROM sales"))
def q_a13(spark, sf):
    """A fully quoted CSV export, inner quotes doubled, read back."""
    path = scratch_path(spark, "quoted")
    cells = sales_table(spark, sf).select("key", "meterid", F.concat("loc", F.lit(', "x"')).alias("loc"))
    sk.export_csv(cells, path, quote_all=True)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@register(
    "b08_reshape",
    with_sales(
        "SELECT meterid AS meter, kwh AS energy, chargedate AS day, isodow(chargedate) >= 6 AS is_weekend FROM sales"
    ),
    doubles=["energy"], dates=["day"],
)
def q_b08(spark, sf):
    """Columns dropped (B8), kept in a named order (B9) and renamed (B10), with a weekend flag."""
    d = add_weekend_flag(drop_columns(sales_table(spark, sf), ["loc", "res", "nosuch"]))
    return rename(project(d, ["meterid", "kwh", "chargedate", "is_weekend", "loc"]), {"meterid": "meter", "kwh": "energy", "chargedate": "day"})


@register(
    "c02_filter_sql_text",
    with_sales(
        "SELECT key, meterid, kwh FROM sales WHERE chargedate BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' "
        "AND loc IN ('NATION_3', 'NATION_7') AND res_mapped IN ('Commercial')"
    ),
    doubles=["kwh"],
)
def q_c02(spark, sf):
    """The dashboard filter as SQL text with bound values."""
    s = sales_table(spark, sf)
    s.createOrReplaceTempView("mf_sales_c02")
    p = FilterParams(start=dt.date(1996, 1, 1), end=dt.date(1998, 12, 31), selections={"loc": ["NATION_3", "NATION_7"], "res_mapped": ["Commercial"]})
    clause, values = p.to_sql_where("chargedate", s.columns)
    return rd.run_query(spark, f"SELECT key, meterid, kwh FROM mf_sales_c02 WHERE {clause}", values)


@register(
    "a05_table_preview",
    with_sales(
        f"SELECT DISTINCT chargedate, key, meterid, loc, res, kwh, ghc, paymoney, res_mapped FROM sales WHERE {_ALL_PRESENT} "
        "ORDER BY chargedate, meterid, key LIMIT 5"
    ),
    doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"],
)
def q_a05(spark, sf):
    """First five rows of a replaced table in (date, meter, key) order (its own
    table name, so it never races the replace / scan query)."""
    sk.replace_table(spark, sales_raw(spark, sf), "prod.sales_preview", analyze=False)
    return rd.preview_table(spark, "prod.sales_preview", 5)


@register(
    "a08_source_fallback",
    with_sales("SELECT * FROM sales"),
    doubles=["kwh", "ghc", "paymoney"], dates=["chargedate"],
)
def q_a08(spark, sf):
    """Source chain: a missing table first, then the stored billing table."""
    from pyspark.sql import types as T

    empty = T.StructType([T.StructField("chargedate", T.DateType())])
    return rd.load_first(spark, [lambda: spark.table("prod.no_such_table"), lambda: sales_table(spark, sf)], empty)


@register(
    "a18_parameterized_sql",
    with_sales(
        "SELECT chargedate AS day, SUM(kwh) AS total_kwh FROM sales "
        "WHERE chargedate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND loc = 'NATION_3' GROUP BY chargedate"
    ),
    doubles=["total_kwh"], dates=["day"],
)
def q_a18(spark, sf):
    """Daily totals through SQL text with bound positional parameters."""
    sales_table(spark, sf).createOrReplaceTempView("mf_sales")
    return rd.run_query(
        spark,
        "SELECT chargedate AS day, SUM(kwh) AS total_kwh FROM mf_sales "
        "WHERE chargedate BETWEEN ? AND ? AND loc = ? GROUP BY chargedate",
        [dt.date(1996, 1, 1), dt.date(1996, 12, 31), "NATION_3"],
    )
