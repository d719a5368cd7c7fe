"""Presentation of query results for the cross-engine check.

A DOUBLE column is compared as it is where its value does not depend on the order of addition: counts,
extremes, quantiles, lags, and everything built on ``kwh``, whose per-order sums are whole numbers.  Other
floating sums differ between engines, and between runs of one engine, in the last bits; both sides snap
them to float32 precision with the same operations (see ``snap``).  A finer grid does not help: values
fall on either side of a rounding boundary with a chance of noise / grid, which for 12 digits and the
hundreds of thousands of values compared here is several per check.  DATE and TIMESTAMP are rendered as
ISO text.  The operators themselves never round.
"""

from __future__ import annotations

import re
from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



# An arbitrary, non-decimal scale (ln(pi)): it moves the float32 rounding
# boundaries off the decimal grid the money values live on.
SNAP_SCALE = 1.1447298858494002


def snap(c: F.Column) -> F.Column:
    """Double -> (x * SNAP_SCALE) to the nearest float32, back to double / SNAP_SCALE.

    Floating sums differ between engines in the last bits.  Rounding both
    sides to float32 hides that, except when the exact value sits right on a
    rounding boundary -- and money sums (two decimals) do land on float32
    midpoints (e.g. an odd integer where the float32 spacing is 2), and plain
    decimal rounding has the same problem at x.xx5.  Scaling by a
    non-decimal constant first moves the boundaries off that grid.  Every
    step (multiply, narrowing cast, widening cast, divide) is a single
    correctly rounded IEEE operation, identical in both engines.
    """
    return (c * F.lit(SNAP_SCALE)).cast("float").cast("double") / F.lit(SNAP_SCALE)


#: Columns that are compared exactly (queries on the event table, whose values are not whole, have none).
EXACT = re.compile(r"(total_)?kwh(_lag\d|_next|_next_pred|_delta\d|_p64)?|median|min|max|(median|mean)_records|count|unique|freq|q25|q50|q75|diff|share_pct")


def is_exact(query: str, column: str) -> bool:
    return not query.endswith("_events") and not re.search("_events_", query) and EXACT.fullmatch(column) is not None


def for_check(df: DataFrame, exact: Iterable[str] = ()) -> DataFrame:
    cols, exact = [], set(exact)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(c.cast("double").alias(f.name) if f.name in exact else snap(c.cast("double")).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(c.cast("string").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def sql_snap(expr: str) -> str:
    return f"(CAST(CAST(({expr}) * {SNAP_SCALE!r} AS FLOAT) AS DOUBLE) / {SNAP_SCALE!r})"


def wrap_sql(inner: str, doubles: Sequence[str] = (), dates: Iterable[str] = (), timestamps: Iterable[str] = (), exact: Iterable[str] = ()) -> str:
    """Apply the same presentation to an oracle query's result columns."""
    def q(c):
        return '"' + c + '"'

    exact = set(exact)
    repl = [("CAST(" + q(c) + " AS DOUBLE)" if c in exact else sql_snap("CAST(" + q(c) + " AS DOUBLE)")) + " AS " + q(c) for c in doubles]
    repl += ["CAST(" + q(c) + " AS VARCHAR) AS " + q(c) for c in dates]
    repl += ["strftime(" + q(c) + ", '%Y-%m-%d %H:%M:%S') AS " + q(c) for c in timestamps]
    if not repl:
        return inner
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{inner}\n) AS q"
