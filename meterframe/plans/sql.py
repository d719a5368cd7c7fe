"""Oracle SQL text (DuckDB dialect) for the adapter views.

Each oracle query repeats the adapter CTE, so it runs on the raw warehouse
views the check tool registers.
"""

from __future__ import annotations

SALES_CTES = """
li AS (
  SELECT l_orderkey,
         SUM(l_quantity) AS kwh,
         SUM(l_extendedprice) AS ghc,
         SUM(l_extendedprice * (1.0 - l_discount)) AS paymoney
  FROM lineitem GROUP BY l_orderkey
),
sales_raw AS (
  SELECT o.o_orderkey AS key,
         o.o_custkey AS meterid,
         CAST(o.o_orderdate AS DATE) AS chargedate,
         n.n_name AS loc,
         CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'N-Resid [0]'
              WHEN c.c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'Resid [1]'
              ELSE c.c_mktsegment END AS res,
         li.kwh, li.ghc, li.paymoney
  FROM orders o
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
sales AS (
  SELECT *,
         CASE res WHEN 'N-Resid [0]' THEN 'Commercial'
                  WHEN 'Resid [1]' THEN 'Residential'
                  ELSE 'Unknown' END AS res_mapped
  FROM sales_raw
)"""

EVENT_CTES = """
event_sales AS (
  SELECT event_id AS key, user_id AS meterid, ts, CAST(ts AS DATE) AS chargedate,
         event_type AS loc, value AS kwh
  FROM events
)"""


def with_sales(body: str, extra: str = "") -> str:
    ctes = SALES_CTES + ("," + extra if extra else "")
    return f"WITH {ctes}\n{body}"


def with_events(body: str, extra: str = "") -> str:
    ctes = EVENT_CTES + ("," + extra if extra else "")
    return f"WITH {ctes}\n{body}"
