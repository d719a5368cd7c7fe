"""Exact token counts for every context limit, from one histogram of encoded lengths.

Each document is encoded whole by a public byte-level BPE vocabulary; documents are aggregated by length
inside the tasks, then across them, so what is shuffled is a histogram.  Suffix sums over it answer
totals, quantiles and truncated totals for every limit at once: documents longer than a limit L add L,
the others their length.

Lengths are dealt to ranges of equal width, and the sums of the ranges are carried on, so no task needs
the whole histogram however many lengths there are.

Defined results: null and empty texts have length 0.  An empty table gives an empty histogram.  Equal
rows count each.  Other columns are not read.  The vocabulary's path is a parameter; the driver reads
the file once and broadcasts it (the reader refuses one above ``VOCAB_BYTES``).
"""

from __future__ import annotations

import base64
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import bounded_batches, stored

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCAB_BYTES = 16 << 20
#: How a byte-level BPE of this family splits text before merging (a fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths per range of the suffix sums.
RANGE = 256

#: Runs of white space from this length are cut out and encoded by themselves: the pattern matches them by
#: backtracking, which overflows its stack on a million characters.
LONG_SPACE = 10_000

_ENCODERS: dict = {}


def read_vocab(path: str = VOCAB) -> bytes:
    if Path(path).stat().st_size > VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {VOCAB_BYTES} bytes")
    return Path(path).read_bytes()


def encoder(raw: bytes):
    """The tiktoken encoder of a vocabulary, one per process."""
    import tiktoken

    key = hash(raw)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("public-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def n_tokens(enc, text: str, long_space: int = LONG_SPACE) -> int:
    """Encoded length of a whole text.

    In a run of white space before a word, the pattern takes all but the last character as one piece, and at
    the end of a text all of it; what stands before and behind is split as it would be alone.
    """
    total, start = 0, 0
    if len(text) >= long_space:
        for run in regex.finditer(r"\p{White_Space}{%d,}" % long_space, text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            total += len(enc.encode_ordinary(text[start : run.start()])) + len(enc._encode_single_piece(text[run.start() : end]))
            start = end
    return total + len(enc.encode_ordinary(text[start:]))


def length_histogram(docs: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocab(vocab))

    def count(batches):
        enc = encoder(shared.value)
        seen: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0):
                t = text.as_py()
                n = n_tokens(enc, t) if t else 0
                seen[n] = seen.get(n, 0) + 1
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    parts = docs.select(F.col("text")).mapInArrow(count, "n_tokens long, n long")
    return parts.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def limits(hist: DataFrame, width: int = RANGE) -> DataFrame:
    """For each length that occurs, as a context limit: totals over all documents, and truncated to it.

    n_tokens, n_docs, docs_above (longer than the limit), docs_total, tokens_total,
    tokens_truncated (sum of min(length, limit)), quantile (share of documents at or below the limit).
    """
    hist = stored(hist.withColumn("_r", F.floor(F.col("n_tokens") / width)), "lengths")
    weight = F.col("n_docs") * F.col("n_tokens")
    ranges = hist.groupBy("_r").agg(F.sum("n_docs").alias("d"), F.sum(weight).alias("t"))
    above = Window.orderBy("_r").rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy()
    ranges = ranges.select(
        "_r",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("_d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("_t_above"),
        F.sum("d").over(every).alias("docs_total"),
        F.sum("t").over(every).alias("tokens_total"),
    )
    inside = Window.partitionBy("_r").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    out = (
        hist.withColumn("_d", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
        .withColumn("_t", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(ranges, "_r")
        .withColumn("docs_above", F.col("_d") + F.col("_d_above"))
        .withColumn("_tokens_above", F.col("_t") + F.col("_t_above"))
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_above",
        "docs_total",
        "tokens_total",
        (F.col("tokens_total") - F.col("_tokens_above") + F.col("docs_above") * F.col("n_tokens")).alias("tokens_truncated"),
        ((F.col("docs_total") - F.col("docs_above")) / F.col("docs_total")).alias("quantile"),
    )


def answers(hist: DataFrame, context_limits, quantiles=()) -> DataFrame:
    """Truncated totals at any limits and exact length quantiles, from the histogram alone.

    kind ('truncated' or 'quantile'), at (limit or share), value (tokens, or the smallest length that
    at least that share of the documents does not exceed).
    """
    cut = [F.sum(F.least("n_tokens", F.lit(int(x))) * F.col("n_docs")).alias(f"t{i}") for i, x in enumerate(context_limits)]
    table = limits(hist)
    low = [F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(quantiles)]
    cols = [F.struct(F.lit("truncated").alias("kind"), F.lit(float(x)).alias("at"), F.col(f"t{i}").alias("value")) for i, x in enumerate(context_limits)]
    qcols = [F.struct(F.lit("quantile").alias("kind"), F.lit(float(q)).alias("at"), F.col(f"q{i}").alias("value")) for i, q in enumerate(quantiles)]
    out = None
    for aggs, rows, src in ((cut, cols, hist), (low, qcols, table)):
        if aggs:
            part = src.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            out = part if out is None else out.unionByName(part)
    return out
