"""Exact percentiles (linear interpolation) of any number of groups in one plan, from two reads of the input.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation buffer, and a
ranking window holds a whole group in one task.  This operator brackets, then counts:

1. One aggregate gives each group its size and a mergeable quantile sketch (``percentile_approx``), asked a
   little below and a little above each percentage.  A sketch of accuracy a is off by at most n / a ranks, so
   the wanted ranks lie between the two answers; groups of few rows are bracketed by infinity.
2. The rows meet the bracket of their group.  Rows below it are only counted, rows above it are dropped, and
   those inside are counted by value (map-side combine).  Running totals over the values then name the ranks.

What a window holds is the distinct values of one bracket, at most ``4 / a`` of a group's rows (1/7,500 of
them for few groups, 1/2,500 for many), or the group itself where it has at most ``2 a`` rows.  There is one
code path, and no job runs while the plan is built.  A bracket that misses its rank, which the sketch's bound
rules out, raises an error.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketches where groups are few, and where there may be many (each has a buffer).
FEW_ACCURACY, MANY_ACCURACY = 30_000, 10_000


def exact_percentiles(
    df: DataFrame, value: str, percentages: Sequence[float], by: Iterable[str] = (), few_groups: bool = False, accuracy: int | None = None
) -> DataFrame:
    """Returns ``by..., percentage, value`` with exact linear-interpolated percentiles.

    Null and NaN values are ignored; a group without values gives no row; a null group is a group.
    ``few_groups`` states that the caller's groups are few by construction (metrics, columns): their brackets,
    one row each, are then broadcast; without ``by`` the one row always is.  ``accuracy`` is the sketches'.
    """
    user_by = list(by)
    keys = [f"_g{i}" for i in range(len(user_by))] or ["_all"]
    few = few_groups or not user_by
    accuracy = accuracy or (FEW_ACCURACY if few else MANY_ACCURACY)
    named = [F.col(c).alias(k) for c, k in zip(user_by, keys)] or [F.lit(0).alias("_all")]
    # Adding zero makes one value of both zeros.
    base = df.select(*named, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))

    pcts = sorted({float(p) for p in percentages})
    slack, k = 2.0 / accuracy, len(pcts)
    asked = [max(p - slack, 0.0) for p in pcts] + [min(p + slack, 1.0) for p in pcts]
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", asked, accuracy).alias("_q"))
    whole = F.col("_n") <= 2 * accuracy
    brackets = sizes.select(
        *[F.col(c).alias(f"{c}_b") for c in keys],
        "_n",
        *[F.when(whole, float("-inf")).otherwise(F.col("_q")[i]).alias(f"_lo{i}") for i in range(k)],
        *[F.when(whole, float("inf")).otherwise(F.col("_q")[k + i]).alias(f"_hi{i}") for i in range(k)],
    )
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    rows = base.join(F.broadcast(brackets) if few else brackets, same)
    cells = [F.struct(F.lit(i).alias("pid"), (F.col("_v") <= F.col(f"_hi{i}")).alias("use"), F.when(F.col("_v") >= F.col(f"_lo{i}"), F.col("_v")).alias("cell")) for i in range(k)]
    cell = rows.select(*keys, "_n", F.explode(F.array(*cells)).alias("_c")).filter("_c.use")
    group = [*keys, "_n", "_pid"]
    counts = cell.select(*keys, "_n", F.col("_c.pid").alias("_pid"), F.col("_c.cell").alias("_cell")).groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    # The rows below the bracket, without a value, come first.
    upto = Window.partitionBy(*group).orderBy(F.col("_cell").asc_nulls_first())
    counts = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    share = F.element_at(F.array(*[F.lit(p) for p in pcts]), F.col("_pid") + 1)
    position = (F.col("_n") - 1) * share

    def at(rank):
        hit = (F.col("_start") <= rank) & (rank < F.col("_end"))
        return F.max(F.when(hit, F.col("_cell")))

    found = counts.groupBy(*group).agg(at(F.floor(position)).alias("_lo"), at(F.ceil(position)).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    between = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (position - F.floor(position)))
    missed = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")
    result = F.when(lo.isNull() | hi.isNull(), missed).otherwise(between)
    return found.select(*[F.col(c).alias(u) for u, c in zip(user_by, keys)], share.alias("percentage"), result.alias(value))
