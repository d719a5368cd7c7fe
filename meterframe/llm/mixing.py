"""Mix sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule over training time t in [0, 1]: its mean weight times
``1 + slope * (2t - 1)``.  The integral of the schedule over [0, 1] is the mean weight, so targets
follow from the weights alone: the budget is shared by weight, a source takes at most ``max_repeats``
times its size, and what is above is shared again by weight until nothing is (a water level, found by
one pass over the sources sorted by the level at which each is full).

Documents of a source stand in a fixed pseudo-random order.  The running total of their sizes, over
as many rounds as the target needs, is the demand met so far; inverting the integrated schedule
``D(t) = target * (t + slope * (t^2 - t))`` gives the training position of each copy.  The last copy
is cut where the target is reached, so a source's taken words equal its target rounded down.

A source may hold most rows: running totals come from per-bucket sums (combined map-side) plus a
window inside a bucket, so no task sees a whole source.

Defined results: null text has size 0; null source is a source of its own, last in order; documents
of size 0 take 0 words; no words at all gives targets of 0.  Rows that share an id stand by size and a hash
of their text; rows repeated whole count as documents of their own, in either order.  Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import WORD, stored

#: Hex digits of the order key that name a bucket; 4096 buckets a source.
BUCKET_DIGITS = 3


def word_count(c: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(c), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the order key of each document, written once (the text is read once).  Rows that
    share an id are ordered by size and a hash of their text, so reruns agree."""
    return stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            # Never null, so one exchange serves the bucket sums, the windows and the join.
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
            word_count().alias("size"),
            F.xxhash64("text").alias("tie"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("ord"),
        ),
        "mix-sizes",
    )


def cyclic_weights(sources: DataFrame, weights=(3, 1, 2), slopes=(0.5, -0.5, 0.0)) -> DataFrame:
    """Mean weight and slope per source: repeating in code point order, null last (one row a source)."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(w) - 1) % len(weights)
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (at + 1).cast("int"))
    return sources.select("*", pick(weights).alias("weight"), pick(slopes).alias("slope"))


def targets(sources: DataFrame, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """Add ``target`` to (source, source_size, weight, ...): the capped, reshared budget.

    With caps ``max_repeats * source_size`` and sources ordered by cap / weight, the first sources
    are full; the rest share what is left by weight.
    """
    cap = F.col("source_size") * F.lit(max_repeats)
    s = sources.withColumn("_cap", cap.cast("double")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("_budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_wleft", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_wleft"))
        # Sources whose ratio is at most the level that would hold from them on are full.
        .withColumn("_open", F.col("_ratio") > F.col("_level"))
    )
    s = s.withColumn("_first", F.min(F.when(F.col("_open"), F.struct("_ratio", F.col("source").isNull().alias("n"), "source", "_level"))).over(every))
    target = F.when(F.col("_ratio") <= F.coalesce(F.col("_first._level"), F.col("_ratio")), F.col("_cap")).otherwise(F.col("weight") * F.col("_first._level"))
    return s.select(*sources.columns, target.alias("target"))


def plan(docs: DataFrame, share: float = 1.5, max_repeats: int = 2, weights=(3, 1, 2), slopes=(0.5, -0.5, 0.0)) -> DataFrame:
    """One row per document: doc_id, source, size, ord, source_size, target, slope, begin (words of its
    source before it), taken."""
    d = sized(docs).withColumn("bucket", F.substring("ord", 1, BUCKET_DIGITS))
    sums = stored(d.groupBy("skey", "bucket").agg(F.min("source").alias("source"), F.sum("size").alias("n")), "mix-buckets")
    sources = sums.groupBy("skey").agg(F.min("source").alias("source"), F.sum("n").alias("source_size"))
    tgt = targets(cyclic_weights(sources, weights, slopes), share, max_repeats)
    upto = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n", "source")
    info = starts.join(tgt.drop("source"), "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("ord", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(info, ["skey", "bucket"])
    d = d.withColumn("begin", F.col("start") + F.col("_in"))
    whole = F.floor("target").cast("long")
    taken = F.lit(0).cast("long")
    for k in range(max_repeats):
        left = whole - F.col("source_size") * F.lit(k) - F.col("begin")
        taken = taken + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return d.withColumn("taken", taken).select("doc_id", "source", "size", "ord", "source_size", "target", "slope", "begin", "taken")


def position(demand: Column) -> Column:
    """Training time at which the source's integrated schedule reaches ``demand`` words."""
    u = F.when(F.col("target") > 0, demand / F.col("target")).otherwise(F.lit(0.0))
    a = F.col("slope")
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - a) * (1 - a) + 4 * a * u))
    return F.when(F.abs(a) < 1e-9, u).otherwise((root - (1 - a)) / (2 * a)) + F.lit(0.0)


def positions(max_repeats: int = 2) -> Column:
    """The training positions of a planned document's copies, in order (``plan``'s columns)."""
    whole = F.floor("target").cast("long")
    each = [(F.col("source_size") * F.lit(k) + F.col("begin")) for k in range(max_repeats)]
    at = F.array(*[F.when((F.col("size") > 0) & (d < whole), position(d)) for d in each])
    return F.filter(at, lambda x: x.isNotNull())


def ordered(plan_df: DataFrame, max_repeats: int = 2) -> DataFrame:
    """The plan with the positions of each document's copies, range-sorted by the first (``position``; without one last)."""
    p = plan_df.withColumn("positions", positions(max_repeats)).withColumn("position", F.get("positions", F.lit(0)))
    first = F.col("position").asc_nulls_last()
    return p.repartitionByRange(first, "doc_id").sortWithinPartitions(first, "doc_id")


def curriculum(plan_df: DataFrame, max_repeats: int = 2) -> DataFrame:
    """One row per copy that is trained on: doc_id, copy, words, position, range-sorted by position."""
    copies = plan_df.withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(max_repeats)])))
    demand = F.col("copy") * F.col("source_size") + F.col("begin")
    words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target").cast("long") - demand))
    copies = copies.withColumn("words", words).filter("words > 0").withColumn("position", position(demand))
    return copies.select("doc_id", "copy", "words", "position").repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")
