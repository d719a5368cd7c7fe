"""Helpers shared by the training-data operators: scratch tables, heavy-key joins, word hashing.

Word rule used by every operator that splits text: a word is a run of characters other than
space and U+0009 to U+000D; lower-casing, where an operator asks for it, touches A-Z only.
Both hold byte by byte in UTF-8, so the hashing below works on the raw Arrow buffers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Keys counted as heavy hold more than 1/HEAVY of all rows, so there are fewer than HEAVY of them.
HEAVY = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would also fold other scripts)."""
    return F.translate(c, UPPER, UPPER.lower())


#: Bytes of rows that Spark hands to a Python worker at once, where the session does not say.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand text to Python workers in batches of bounded bytes: ten thousand long texts are too many at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, n: int, *taken: str) -> list[str]:
    """``n`` column names that ``df`` does not have, whatever their case, nor ``taken``."""
    have = {c.lower() for c in (*df.columns, *taken)}
    out, k = [], 0
    while len(out) < n:
        name, k = f"_free{k}", k + 1
        if name not in have:
            out.append(name)
    return out


def attach(left: DataFrame, stats: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of ``stats`` (one row per key) to ``left`` where a key may hold a third of all rows.

    ``weight`` counts the rows of a key and sums to at most ``total``.  Keys above total/HEAVY,
    fewer than HEAVY by that arithmetic, come by broadcast; their rows are spread evenly in the
    shuffle that joins the rest.  Rows with a null key find no partner and are spread as well.
    """
    limit = max(total // HEAVY, 1000)
    cols = [c for c in stats.columns if c != key]
    heavy = stats.filter(F.col(weight) > limit).select(F.col(key).alias("_hk"), F.struct(*cols).alias("_hv"))
    light = stats.filter(F.col(weight) <= limit).select(F.col(key).alias("_lk"), F.lit(0).cast("long").alias("_ls"), F.struct(*cols).alias("_lv"))
    spread = F.when(F.col("_hv").isNotNull() | F.col(key).isNull(), F.xxhash64(*[F.col(c) for c in left.columns])).otherwise(F.lit(0).cast("long"))
    out = left.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left").withColumn("_sp", spread)
    out = out.withColumn("_jk", F.when(F.col("_sp") == 0, F.col(key)))
    out = out.join(light.hint("merge"), (F.col("_jk").eqNullSafe(F.col("_lk"))) & (F.col("_sp") == F.col("_ls")), "left")
    got = F.coalesce(F.col("_hv"), F.col("_lv"))
    return out.select(*[F.col(c) for c in left.columns], *[got[c].alias(c) for c in cols])


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, out: int, bound: int | None = None) -> DataFrame:
    """doc_id, label of the labelled documents that are not held out; with ``bound`` at most so many, lowest hash
    first.

    A row is held out where crc32(doc_id as text) mod ``modulus`` is ``out``.  Of contradicting labels of
    one id the larger counts; null ids and labels are passed over.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).filter(crc % modulus != out)
    rows = rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return rows if bound is None else rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def is_held_out(modulus: int, out: int) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` is ``out``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == out, F.lit(False))


def from_text(docs: DataFrame, compute, added: str) -> DataFrame:
    """All columns of ``docs`` and those of the DDL ``added``, which ``compute(text column)`` returns as a
    list of Arrow arrays.  Columns of ``docs`` with the added names are replaced."""
    bounded_batches(docs.sparkSession)
    fields = T.StructType.fromDDL(added).fields
    new = [f.name for f in fields]
    names = [c for c in docs.columns if c not in new]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType(list(kept.schema.fields) + fields)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + compute(b.column("text")), names=names + new)

    return kept.mapInArrow(run, schema)


# --- word hashing on Arrow string buffers -------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes of text hashed at once inside a task; one longer text is taken whole.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def letters_only() -> np.ndarray:
    """Separator table for words of letters: everything in ASCII but A-Z and a-z separates."""
    sep = np.ones(256, dtype=bool)
    sep[65:91] = sep[97:123] = sep[128:] = False
    return sep


def letters_and_digits() -> np.ndarray:
    """Separator table for words of letters and digits."""
    sep = letters_only()
    sep[48:58] = False
    return sep


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Runs of rows whose texts sum to about ``limit`` bytes (at least one row each)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1, i + 1)
        yield i, j
        i = j


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE):
    """(hash, start, end, first) of all words of the texts ``raw[offsets[i]:offsets[i+1]]``.

    ``first[i]:first[i+1]`` are the words of text i; starts and ends are byte positions in ``raw``.
    ``space`` marks the bytes that separate words.
    """
    base = offsets[0]
    data = raw[base : offsets[-1]]
    off = offsets - base
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(len(off), np.int64)
    solid = ~space[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    finish = solid.copy()
    finish[:-1] &= ~solid[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = solid[cuts]
    finish[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    first = np.searchsorted(starts, off)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts, ends, first
    lengths = ends - starts
    at = np.flatnonzero(solid)
    wordstart = np.cumsum(lengths) - lengths
    k = np.arange(len(at)) - np.repeat(wordstart, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    h = np.add.reduceat((_BYTE_LOWER if lower else _BYTE)[data[at]] * powers[k], wordstart)
    return mix(h + lengths.astype(np.uint64)), starts + base, ends + base, first


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5):
    """The sorted distinct hashes of each text's ``size``-word shingles (A-Z lower-cased).

    A text with fewer words has its whole word sequence as its one shingle; one without words has none.
    """
    h, _, _, first = words(raw, offsets, lower=True)
    odd = _rng_odd(size)
    pad = np.concatenate([h, np.zeros(size, np.uint64)])
    roll = np.zeros(len(h), np.uint64)
    for j in range(size):
        roll += pad[j : j + len(h)] * odd[j]
    roll = mix(roll)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(roll[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * odd[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _rng_odd(n: int) -> np.ndarray:
    return np.random.default_rng(977).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
