"""Facet lists and meter search.

The filtered rows are unpivoted into (facet, value) pairs and de-duplicated with a partial + final
aggregate.  A facet with a cap is ranked by ``row_number() <= cap``, which Spark plans as a
WindowGroupLimit: each task keeps at most ``cap`` values a facet.  A facet without one gets positions from
a range partitioning, so no task ranks a whole facet; that costs one job while the plan is built.  Nothing
is capped unless the caller says so, and every row carries the ``total`` number of values of its facet.
"""

from __future__ import annotations

from typing import Dict, Iterable, List, Optional, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.operators.filters import FilterParams, like_search, not_null, regex_search
from meterframe.schema import DEFAULT_ROLES, Roles
from meterframe.session import cut_lineage


def _stack(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    return df.select(F.explode(pairs).alias("p")).select("p.facet", "p.value")


def _positions(df: DataFrame, order: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Add ``position``: the 0-based place of each row of ``by`` in ``order``, without one task per group.

    The rows are range-partitioned on (by, order); each is ranked inside its (range partition, group) and
    offset by the counts of the group's earlier partitions (a prefix sum over at most groups x partitions
    rows, broadcast by construction).
    """
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range boundaries are sampled: checkpoint the stamped rows once so both
    # uses below (and any retry) see the same partition ids.
    ranged = cut_lineage(df.repartitionByRange(n_parts, *by, *order).withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn("_lr", F.row_number().over(Window.partitionBy("_pid", *by).orderBy(*order)))
    counts = ranged.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    placed = local.join(F.broadcast(offsets), [*by, "_pid"])
    return placed.withColumn("position", (F.col("_off") + F.col("_lr") - 1).cast("int")).drop("_pid", "_lr", "_off", "_c")


def _listed(pairs: DataFrame, caps: Dict[str, Optional[int]]) -> DataFrame:
    """facet, value, position, total of the distinct values, the first ``cap`` of a capped facet."""
    distinct = pairs.filter(F.col("value").isNotNull()).distinct()
    totals = distinct.groupBy("facet").agg(F.count(F.lit(1)).alias("total"))
    groups: Dict[Optional[int], List[str]] = {}
    for f, cap in caps.items():
        groups.setdefault(cap, []).append(f)
    w = Window.partitionBy("facet").orderBy("value")
    out = None
    for cap, fs in groups.items():
        part = distinct.filter(F.col("facet").isin(fs))
        if cap is None:
            part = _positions(part, ["value"], ["facet"])
        else:  # the shape the limit rule matches
            part = part.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.lit(cap))
            part = part.withColumn("position", (F.col("_rn") - 1).cast("int"))
        part = part.select("facet", "value", "position")
        out = part if out is None else out.unionByName(part)
    # One row per facet of the request.
    return out.join(F.broadcast(totals), "facet").select("facet", "value", "position", "total")


EMPTY_LIST = "facet string, value string, position int, total bigint"


def listable(df: DataFrame, column: str) -> bool:
    """Whether a request may list a column's values: the text of a floating-point number is engine-specific."""
    return not isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))


def facet_values(
    df: DataFrame,
    params: Optional[FilterParams] = None,
    facets: Optional[Iterable[str]] = None,
    caps: Optional[Dict[str, Optional[int]]] = None,
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """Distinct text values per facet under the *full* filter, sorted as text.

    Default facets: location, residence category, meter id.  ``caps`` names the facets to cut short (the
    dashboard shows 500 meter ids); the others are whole.  Requested facets that may not be listed are
    left out.  Output: facet, value, position, total.
    """
    cols_lc = {c.lower(): c for c in df.columns}
    if facets:
        fs = list(dict.fromkeys(cols_lc[f.lower()] for f in facets if f.lower() in cols_lc and listable(df, cols_lc[f.lower()])))
    else:
        fs = [c for c in (roles.location, roles.residence_mapped, roles.meter) if c in df.columns]
    base = params.apply(df, roles) if params else df
    if not fs:
        return df.sparkSession.createDataFrame([], EMPTY_LIST)
    return _listed(_stack(base, fs), {f: (caps or {}).get(f) for f in fs})


def unique_values(df: DataFrame, cap: Optional[int] = None, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """H4: sorted text values of every non-excluded column, the first ``cap`` if given, and their total."""
    cols = [c for c in df.columns if c not in roles.exclude]
    if not cols:
        return df.sparkSession.createDataFrame([], EMPTY_LIST)
    return _listed(_stack(df, cols), {c: cap for c in cols})


def meter_options(
    df: DataFrame,
    params: Optional[FilterParams] = None,
    q: str = "",
    limit: Optional[int] = None,
    regex: bool = True,
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """H2 (+C9): meter ids as text under every filter except the meter selection
    itself, matching ``q`` case-insensitively (a regex by default, a literal
    with ``regex=False``), sorted as text, the first ``limit`` (>= 1) if given."""
    base = (params or FilterParams()).apply(df, roles, skip=[roles.meter])
    v = F.col(roles.meter).cast("string")
    out = base.select(v.alias("value")).filter(F.col("value").isNotNull())
    q = (q or "").strip()
    if q:
        out = out.filter(regex_search(F.col("value"), q, literal=not regex))
    out = out.distinct().orderBy("value")
    return out if limit is None else out.limit(max(int(limit), 1))


def meter_options_by_location(
    df: DataFrame, loc: Optional[str] = None, q: str = "", limit: Optional[int] = None, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """H3 (+C10): distinct meter ids, optional location equality and LIKE search
    ('%' and '_' in q are wildcards), sorted by the id's own type, the first ``limit`` (>= 1) if given."""
    m = F.col(roles.meter)
    out = df.filter(not_null(roles.meter))
    if loc:
        out = out.filter(F.col(roles.location).cast("string") == F.lit(loc))
    q = (q or "").strip()
    if q:
        out = out.filter(like_search(m.cast("string"), q))
    out = out.select(m.alias("_id")).distinct().orderBy("_id")
    return (out if limit is None else out.limit(max(int(limit), 1))).select(F.col("_id").cast("string").alias("value"))


def selected_first(spark, selected: Sequence[str], options: DataFrame, value: str = "value", order: str = "position") -> DataFrame:
    """H5: selected values (in their order) then the options (in theirs), de-duplicated."""
    sel = spark.createDataFrame(
        [(str(v), 0, i) for i, v in enumerate(selected)],
        T.StructType([T.StructField("value", T.StringType()), T.StructField("_p", T.IntegerType()), T.StructField("_o", T.LongType())]),
    )
    opts = options.select(F.col(value).cast("string").alias("value"), F.lit(1).alias("_p"), F.col(order).cast("long").alias("_o"))
    merged = sel.unionByName(opts).groupBy("value").agg(F.min(F.struct("_p", "_o")).alias("_k"))
    flat = merged.select("value", F.col("_k._p").alias("_p"), F.col("_k._o").alias("_o"))
    return _positions(flat, ["_p", "_o"]).select("value", "position")


def relevance_order(values: DataFrame, q: str = "", selected: Sequence[str] = (), value: str = "value") -> DataFrame:
    """G6 (+I13): selected values first (in their order), then prefix matches,
    then substring matches, then the rest, each alphabetical by lower-case text."""
    ql = (q or "").strip().lower()
    text = F.lower(F.trim(F.col(value).cast("string")))
    sel_map = {str(v): i for i, v in enumerate(selected)}
    if sel_map:
        sel_idx = F.create_map(*[F.lit(x) for kv in sel_map.items() for x in kv])[F.col(value).cast("string")]
    else:
        sel_idx = F.lit(None).cast("int")
    if ql:
        score = F.when(text.startswith(F.lit(ql)), 0).when(text.contains(F.lit(ql)), 1).otherwise(2)
    else:
        score = F.lit(2)
    ranked = values.select(
        F.col(value).alias("value"),
        F.when(sel_idx.isNotNull(), F.lit(0)).otherwise(F.lit(1)).alias("_sel"),
        F.coalesce(sel_idx, F.lit(0)).alias("_si"),
        F.when(sel_idx.isNotNull(), F.lit(-1)).otherwise(score).alias("score"),
        text.alias("_t"),
    )
    return _positions(ranked, ["_sel", "_si", "score", "_t", "value"]).select("value", "score", "position")
