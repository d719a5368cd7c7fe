"""Per-meter time-series features.

One feature build serves training and scoring (no train/serve skew): every
feature is computed on the full as-of history, then rows without a third lag
are dropped once at the end.

Physical plan
-------------
* The per-meter profile (mean / std / non-null count per metric, plus the
  row count) is a partial + final aggregate, joined back on ``meterid``.  That
  join is the one shuffle of the ordinary path: its output is hash
  partitioned by ``meterid``, so all lags, leads and rolling frames run as
  window functions on that partitioning (a sort, no further exchange).
* Hot meters (more than ``hot_key_rows`` rows) are found first with a count
  per meter; their ids (at most total_rows / hot_key_rows of them) come back
  to the driver and are broadcast, so neither the profile join nor a window
  ever groups a hot meter.  Without hot meters the plan is the window plan.
  Hot rows get a position inside the meter from a range partitioning on
  (meter, date, key) (row ids inside each sorted partition plus prefix sums
  of the per-partition counts), then the positions are cut into blocks of
  2^20; each block also gets the
  last five rows of the block before it (and the first row after it) as halo
  rows, and the ordinary window expressions run per (meter, block).  Work for one
  hot meter is spread over all tasks; no window groups more than one chunk.
* Category codes are a table (labels in sorted order, null -> -1), joined by its
  size, or part of the expression where they are few; it can be persisted with the model.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterframe.functions.scalars import month_cos, month_sin, nan_to_null, safe_ratio
from meterframe.operators.filters import as_of as up_to
from meterframe.schema import DEFAULT_ROLES, Roles
from meterframe.session import cut_lineage, stored

# ---------------------------------------------------------------------------
# Feature and target lists in the model's named order
# ---------------------------------------------------------------------------
METRIC_COLS = ("kwh", "ghc", "paymoney")
TARGETS = ("kwh_next", "ghc_next", "paymoney_next")
FEATURES = (
    "month_num", "year", "month_sin", "month_cos", "loc_enc", "res_enc", "kwh", "ghc", "paymoney",
    "kwh_lag1", "kwh_lag2", "kwh_lag3", "ghc_lag1", "ghc_lag2", "ghc_lag3", "paymoney_lag1", "paymoney_lag2", "paymoney_lag3",
    "kwh_roll3_mean", "kwh_roll3_std", "kwh_roll6_mean", "kwh_roll6_std",
    "ghc_roll3_mean", "ghc_roll3_std", "ghc_roll6_mean", "ghc_roll6_std",
    "paymoney_roll3_mean", "paymoney_roll3_std", "paymoney_roll6_mean", "paymoney_roll6_std",
    "kwh_mean", "kwh_std", "kwh_count", "ghc_mean", "ghc_std", "ghc_count", "paymoney_mean", "paymoney_std", "paymoney_count",
    "kwh_delta1", "kwh_delta2", "ghc_delta1", "ghc_delta2", "paymoney_delta1", "paymoney_delta2",
    "ghc_per_kwh", "paymoney_ratio",
)
# Rolling frames: (rows, minimum non-null values).
ROLLS = {"roll3": (3, 2), "roll6": (6, 3)}
MAX_LAG = 5  # the widest frame (6 rows) reaches 5 rows back
HOT_KEY_ROWS = 2_000_000  # rows of one meter above which the positional path is used
RANGE_PARTITIONS = None  # range partitions of the hot rows (None: spark.sql.shuffle.partitions)
INLINE_LABELS = 64  # category labels up to which the codes are part of the expression
BLOCK_ROWS = 1 << 20  # consecutive positions of one hot meter handled by one window partition


# --------------------------------------------------------------------- category codes
@dataclass(frozen=True)
class CategoryCodes:
    """A table (column, label, code); codes 0..n-1 follow the labels' order in each column.

    ``few`` holds its rows where there are at most ``INLINE_LABELS``.
    """

    table: DataFrame
    few: Optional[Sequence[tuple]] = None

    def of(self, column: str) -> DataFrame:
        return self.table.filter(F.col("column") == column).select("label", "code")

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CategoryCodes":
        """The saved codes, copied to the scratch folder so that ``path`` can be written over."""
        table = stored(spark.read.parquet(path), "category-codes")
        few = table.select("column", "label", "code").limit(INLINE_LABELS + 1).collect()
        return cls(table, [tuple(r) for r in few] if len(few) <= INLINE_LABELS else None)


def fit_category_codes(df: DataFrame, columns: Sequence[str] = ("loc", "res")) -> CategoryCodes:
    """Codes of each category column, by a range sort of its labels and prefix sums of the pieces.

    No task holds more than its range of them, and none comes to the driver unless ``INLINE_LABELS`` or
    fewer are all there are: these are numbered there.  Nulls have no code.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label")) for c in columns])
    labels = df.select(F.explode(pairs).alias("p")).select("p.*").filter("label is not null").distinct()
    few = labels.limit(INLINE_LABELS + 1).collect()
    if len(few) <= INLINE_LABELS:
        coded = [(c, l, k) for c in columns for k, l in enumerate(sorted((r["label"] for r in few if r["column"] == c), key=str.encode))]
        return CategoryCodes(df.sparkSession.createDataFrame(coded, "column string, label string, code int"), coded)
    # The pieces' numbers are physical: written once, so that both uses below see the same ones.
    ranged = stored(
        labels.repartitionByRange("column", "label").sortWithinPartitions("column", "label")
        .withColumn("_pid", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()),
        "category-labels",
    )
    pieces = ranged.groupBy("column", "_pid").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("column").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per column and piece.
    starts = pieces.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    coded = ranged.join(F.broadcast(starts), ["column", "_pid"])
    return CategoryCodes(stored(coded.select("column", "label", (F.col("_at") + F.col("_id")).cast("int").alias("code")), "category-codes"))


def apply_category_codes(df: DataFrame, codes: CategoryCodes, columns: Sequence[str] = ("loc", "res")) -> DataFrame:
    """``<column>_enc``: the label's code; null or unseen -> -1 (``cat.codes``).

    Few codes are part of the expression.  More are joined, by broadcast or by shuffle as the stored table's
    size decides.
    """
    out = df
    for c in columns:
        if codes.few is not None:
            pairs = [F.lit(x) for column, *pair in codes.few if column == c for x in pair]
            code = F.try_element_at(F.create_map(*pairs), F.col(c).cast("string")) if pairs else F.lit(None).cast("int")
            out = out.withColumn(f"{c}_enc", F.coalesce(code, F.lit(-1)))
            continue
        part = codes.of(c).select(F.col("label").alias(f"{c}__label"), F.col("code").alias(f"{c}__code"))
        out = out.join(part, F.col(c).cast("string") == F.col(f"{c}__label"), "left")
        out = out.withColumn(f"{c}_enc", F.coalesce(f"{c}__code", F.lit(-1))).drop(f"{c}__label", f"{c}__code")
    return out


def category_code_pairs(features: DataFrame, column: str = "loc") -> DataFrame:
    """H8: distinct (category, code) pairs."""
    return features.select(column, f"{column}_enc").distinct()


# --------------------------------------------------------------------- helpers
def _derived(df: DataFrame) -> DataFrame:
    """F11 deltas and I8 ratios on top of lag columns."""
    out = df
    for m in METRIC_COLS:
        out = out.withColumn(f"{m}_delta1", F.col(m) - F.col(f"{m}_lag1")).withColumn(
            f"{m}_delta2", F.col(f"{m}_lag1") - F.col(f"{m}_lag2")
        )
    return out.withColumn("ghc_per_kwh", safe_ratio("ghc", "kwh")).withColumn("paymoney_ratio", safe_ratio("paymoney", "ghc"))


def _window_features(rows: DataFrame, roles: Roles, with_targets: bool, partition=None, order=None) -> DataFrame:
    """Lags, leads and rolling frames as window functions (per meter by default)."""
    w = Window.partitionBy(*(partition or [roles.meter])).orderBy(*(order or [roles.date, roles.key]))
    cols = []
    for lag in (1, 2, 3):
        for m in METRIC_COLS:
            cols.append(F.lag(m, lag).over(w).alias(f"{m}_lag{lag}"))
    for m in METRIC_COLS:
        for name, (size, min_n) in ROLLS.items():
            f = w.rowsBetween(-(size - 1), 0)
            ok = F.count(m).over(f) >= min_n
            cols.append(F.when(ok, F.avg(m).over(f)).alias(f"{m}_{name}_mean"))
            cols.append(F.when(ok, F.stddev_samp(m).over(f)).alias(f"{m}_{name}_std"))
    if with_targets:
        for m in METRIC_COLS:
            cols.append(F.lead(m, 1).over(w).alias(f"{m}_next"))
    return rows.select("*", *cols)


def _positional_features(rows: DataFrame, roles: Roles, with_targets: bool) -> DataFrame:
    """Hot meters: positions from a range partitioning, then windows per block of positions.

    Positions: the rows are range-partitioned on (meter, date, key) -- balanced,
    contiguous pieces of the global order, whatever the key values look like --
    and sorted inside each partition, so ``monotonically_increasing_id`` is
    consecutive there.  Each (meter, partition) pair contributes its count to a
    prefix sum over the meter's partitions; that table has at most
    partitions + hot meters rows, so it is broadcast by construction.  No
    window ever holds a hot meter's rows.
    """
    mt, d, k = roles.meter, roles.date, roles.key
    n_parts = RANGE_PARTITIONS or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range boundaries come from sampling, and partition ids and row ids are
    # physical: the stamped rows are checkpointed once (reliably, into the
    # shared folder), so both uses below -- and any retry after a lost
    # executor -- read the same values instead of re-sampling.
    ranged = cut_lineage(
        rows.repartitionByRange(n_parts, mt, d, k)
        .sortWithinPartitions(mt, d, k)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_id", F.monotonically_increasing_id())
    )
    pieces = ranged.groupBy(mt, "_pid").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(mt).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(mt, "_pid", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    positioned = (
        ranged.join(F.broadcast(offsets), [mt, "_pid"])
        .withColumn("_pos", F.col("_off") + F.col("_id") - F.col("_first"))
        .drop("_pid", "_id", "_first", "_off")
    )
    # Blocks of BLOCK_ROWS consecutive positions; each block also receives, as
    # halo rows, the rows of earlier blocks within MAX_LAG positions of it (and,
    # for targets, the first row of the block after it), so the ordinary window
    # expressions see every neighbour they need; halo rows are dropped afterwards.
    pos = F.col("_pos")
    main = positioned.withColumn("_blk", F.expr(f"_pos div {BLOCK_ROWS}")).withColumn("_halo", F.lit(False))
    # A row serves positions pos+1 .. pos+MAX_LAG as a lag: copy it into every
    # later block those positions fall into (one block when BLOCK_ROWS > MAX_LAG).
    last_served = F.expr(f"(_pos + {MAX_LAG}) div {BLOCK_ROWS}")
    parts = [
        main,
        main.filter(last_served > F.col("_blk"))
        .withColumn("_blk", F.explode(F.sequence(F.col("_blk") + 1, last_served)))
        .withColumn("_halo", F.lit(True)),
    ]
    if with_targets:
        parts.append(
            main.filter((pos % BLOCK_ROWS == 0) & (F.col("_blk") > 0))
            .withColumn("_blk", F.col("_blk") - 1).withColumn("_halo", F.lit(True))
        )
    blocks = parts[0]
    for extra in parts[1:]:
        blocks = blocks.unionByName(extra)
    feats = _window_features(blocks, roles, with_targets, partition=[mt, "_blk"], order=["_pos"])
    return feats.filter(~F.col("_halo")).drop("_blk", "_halo", "_pos")


def profile_counts(base: DataFrame, meter: str) -> DataFrame:
    """Rows of each meter, as ``_all``."""
    return base.groupBy(meter).agg(F.count(F.lit(1)).alias("_all"))


# --------------------------------------------------------------------- the feature build
def build_features(
    df: DataFrame,
    as_of=None,
    roles: Roles = DEFAULT_ROLES,
    codes: Optional[CategoryCodes] = None,
    with_targets: bool = False,
    drop_incomplete: bool = True,
    hot_key_rows: Optional[int] = HOT_KEY_ROWS,
    profile_before=None,
) -> DataFrame:
    """K1: the 47 model features per row (and optionally the next-period targets).

    Steps: as-of cut (C12) -> month / year / cyclic month (I2, I3) -> category
    codes (I10) -> lags 1..3 (F1) -> rolling 3/6-row mean and std with
    minimum counts (F3-F6) -> per-meter profile (D1, E23, H11) -> deltas and
    safe ratios (F11, I8) -> drop rows without lag 3 (B3).  With
    ``with_targets`` the next row's metrics (F2) are attached before the drop.
    Row lags are row lags: a skipped month still yields the previous row.
    The per-meter profile uses the meter's whole as-of history (parity with the
    source, which lets later rows into earlier rows' profile); ``profile_before``
    restricts it to rows dated before that day, for look-ahead-free validation.
    """
    mt, d = roles.meter, roles.date
    base = up_to(df, as_of, roles) if as_of is not None else df
    base = base.select(
        mt, d, roles.key, roles.location, roles.residence, *[nan_to_null(F.col(m)).alias(m) for m in METRIC_COLS]
    ).filter(F.col(mt).isNotNull())
    if codes is None:
        codes = fit_category_codes(base, (roles.location, roles.residence))
    base = apply_category_codes(base, codes, (roles.location, roles.residence))
    base = (
        base.withColumn("month_num", F.month(d))
        .withColumn("year", F.year(d))
        .withColumn("month_sin", month_sin(F.col("month_num")))
        .withColumn("month_cos", month_cos(F.col("month_num")))
    )
    prof_aggs = [F.count(F.lit(1)).alias("_rows")]
    for m in METRIC_COLS:
        prof_aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_count")]
    prof_rows = base.filter(F.col(d) < F.lit(profile_before)) if profile_before is not None else base
    profile = prof_rows.groupBy(mt).agg(*prof_aggs)
    if hot_key_rows is None:
        feats = _window_features(base.join(profile, mt, "left"), roles, with_targets)
    elif hot_key_rows <= 0:
        # Validation mode: every meter through the positional path.
        feats = _positional_features(base.join(profile, mt, "left"), roles, with_targets)
    else:
        # The hot meters and their profiles stay a table: written once, joined by its size.
        hot = stored(profile_counts(base, mt).filter(F.col("_all") > hot_key_rows).select(mt), "hot-meters")
        if hot.isEmpty():
            feats = _window_features(base.join(profile, mt, "left"), roles, with_targets)
        else:
            ordinary = _window_features(base.join(hot, mt, "left_anti").join(profile, mt, "left"), roles, with_targets)
            hot_profile = stored(profile.join(hot, mt, "left_semi"), "hot-profiles")
            hot_rows = _positional_features(base.join(hot, mt, "left_semi").join(hot_profile, mt, "left"), roles, with_targets)
            feats = ordinary.unionByName(hot_rows)
    feats = _derived(feats).drop("_rows")
    if drop_incomplete:
        feats = feats.dropna(subset=[f"{m}_lag3" for m in METRIC_COLS])
    lead = [mt, d, roles.key, roles.location, roles.residence]
    tail = list(TARGETS) if with_targets else []
    return feats.select(*lead, *FEATURES, *tail)


def training_frame(df: DataFrame, as_of, roles: Roles = DEFAULT_ROLES, codes: Optional[CategoryCodes] = None, **kw) -> DataFrame:
    """K2 re-aimed: the K1 features with next-period targets, rows without a target dropped."""
    feats = build_features(df, as_of, roles, codes, with_targets=True, **kw)
    return feats.dropna(subset=list(TARGETS))


def latest_per_meter(features: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """the latest row of each meter (first on date ties by key).

    ``row_number() == 1`` is planned as a WindowGroupLimit, which keeps one
    row per meter and partition before the shuffle.
    """
    w = Window.partitionBy(roles.meter).orderBy(F.col(roles.date).desc(), F.col(roles.key).asc())
    return features.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
