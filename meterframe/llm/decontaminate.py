"""Benchmark decontamination: rare word-pair seeds join documents to test items, Smith-Waterman scores them.

Words are runs of lower-cased letters and digits, so punctuation, case and layout edits do not matter; in
scripts that put no space between words every character is a word, and two count as one below.  An
alignment scores match 1, mismatch and gap -0.5; a copy is reported where the best local alignment reaches
``need``: ``SHARE`` of the item's words, or ``LONG`` words, and all its words where the item has fewer than
``MIN_WORDS``.  The result is that of aligning every document with every item:

An alignment that passes has matches that follow each other without an error (weight 1) or over one
error (weight 0.5), of total weight ``need - 1`` or more, since two errors cost what a match earns.  So
the pairs of words at distance 1 or 2 find it, each at its own place in the item.  The document frequency
of every such pair is counted over all documents, and each item's most frequent places, ``SKIP`` of
``need - 1`` at most, are no seeds: the others still carry the rest of the weight, however the frequencies
fall.  Stretches of text with less seed weight, less weight over all places or fewer of the item's words
than any passing alignment holds are skipped by these bounds; the others are aligned, with as many words
to spare on either side as an alignment that passes can have errors.

The items are a stated query set, taken in blocks of about ``BLOCK_WORDS`` words; each block is one
broadcast of that size.  Nothing about the documents is broadcast or collected, and no candidate is
capped.

Defined results: null and empty texts have no copies.  Items of fewer than ``SHORT_WORDS`` words, or null,
match nothing (chance would).  Repeated items each report.  Repeated documents each report.  A document
that copies an item twice reports it once, where it scores best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import free_names, from_text, letters_and_digits, mix, slices, text_buffers, words

SHARE = 0.5
LONG = 20.0
MIN_WORDS = 8
SHORT_WORDS = 4
MISMATCH = GAP = 0.5
BLOCK_WORDS = 1_000_000
#: Share of the weight of a passing alignment that may lie on places which are no seeds.
SKIP = 0.7
#: Characters of scripts without spaces between words, and the marks between their sentences.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
WIDE_MARKS = r"[\x{3000}-\x{3004}\x{3008}-\x{3020}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}]"
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_LEAK = "array<struct<item_id:bigint,score:double,begin:int,end:int>>"


def _word_hashes(col):
    """(hash of every word, first word of each text), slice by slice of the batch."""
    col = pc.utf8_lower(col)
    raw, off = text_buffers(col)
    if len(raw) and raw.max() >= 0xE0:  # every character of the two classes begins with such a byte
        marked = pc.replace_substring_regex(pc.fill_null(col, ""), WIDE_MARKS, " ")
        raw, off = text_buffers(pc.replace_substring_regex(marked, f"({UNSPACED})", r" \1 "))
    for i, j in slices(off):
        h, _, _, first = words(raw, off[i : j + 1], lower=True, space=letters_and_digits())
        yield i, j, h, first


def pairs(h: np.ndarray, apart: int = 1) -> np.ndarray:
    """Hash of each word with the one ``apart`` words after it."""
    return mix(h[:-apart] * _PAIR + h[apart:])


def needed(n: int, unspaced: bool = False) -> float:
    """Score from which an alignment with an item of ``n`` words is a copy; infinite for too short ones."""
    unit = 2 if unspaced else 1
    if n < MIN_WORDS * unit:
        return n if n >= SHORT_WORDS * unit else np.inf
    return min(SHARE * n, LONG * unit)


def errors(n: int, need: float) -> int:
    """Mismatches and gaps that an alignment of score ``need`` with ``n`` words can have at most."""
    return int((n - need) / min(MISMATCH, GAP))


class Items:
    """One block of test items with the seeds to look for."""

    def __init__(self, rows):
        # rows: (item_id, text), by id
        ids = [i for i, _ in rows]
        self.ids, self.words, self.need = [], [], []
        texts = pa.array([t for _, t in rows], pa.string())
        unspaced = pc.count_substring_regex(texts, UNSPACED).to_pylist()
        for i, j, h, first in _word_hashes(texts) if rows else ():
            for k in range(j - i):
                w = h[first[k] : first[k + 1]]
                need = needed(len(w), 2 * unspaced[i + k] > len(w))
                if need <= len(w):
                    self.ids.append(ids[i + k])
                    self.words.append(w)
                    self.need.append(need)
        # (near, far) pairs of each item by place; the last place has no far pair.
        self.pairs = [(pairs(w), pairs(w, 2)) for w in self.words]
        self.seeds = np.unique(np.concatenate([p for both in self.pairs for p in both])) if self.words else np.zeros(0, np.uint64)
        self.index([np.ones(len(w) - 1, bool) for w in self.words])

    @classmethod
    def of(cls, state: dict) -> "Items":
        """Rebuilt from its attributes, which is what is broadcast."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def index(self, keep) -> None:
        """Make seeds of each item's marked places, and lay out seed -> (item, place in it, whether far)."""
        seed, item, place, far = [], [], [], []
        for k, both in enumerate(self.pairs):
            for apart, p in enumerate(both):
                pos = np.flatnonzero(keep[k][: len(p)])
                seed.append(p[pos])
                item.append(np.full(len(pos), k))
                place.append(pos)
                far.append(np.full(len(pos), apart == 1))
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.seed = flat(seed, np.uint64)
        order = np.argsort(self.seed, kind="stable")
        self.seed = self.seed[order]
        self.item, self.place, self.far = flat(item, np.int64)[order], flat(place, np.int64)[order], flat(far, bool)[order]
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.seed >> np.uint64(44)).astype(np.int64)] = True
        # Words of text that an alignment spans at most, and the seed weight that it has at least.
        self.span = np.array([len(w) + errors(len(w), need) for w, need in zip(self.words, self.need)], np.int64)
        self.weight = np.array([need - 1 - (~k).sum() for need, k in zip(self.need, keep)], float)

    def rare(self, frequency: dict) -> "Items":
        """No seeds at each item's most frequent places, by document frequency over the whole corpus."""
        count = np.array([frequency.get(int(p), 0) for p in self.seeds.view(np.int64)], np.int64)
        keep = []
        for need, (adjacent, far) in zip(self.need, self.pairs):
            df = count[np.searchsorted(self.seeds, adjacent)]
            df[: len(far)] += count[np.searchsorted(self.seeds, far)]
            k = np.ones(len(df), bool)
            k[np.argsort(-df, kind="stable")[: int(SKIP * (need - 1))]] = False
            keep.append(k)
        self.index(keep)
        return self

    def hits(self, p: np.ndarray) -> np.ndarray:
        """Places in ``p`` whose pair is a seed."""
        at = np.flatnonzero(self.near[(p >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.seed):
            return at[:0]
        k = np.searchsorted(self.seed, p[at])
        return at[self.seed[np.minimum(k, len(self.seed) - 1)] == p[at]]


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """(score, begin, end) of the best local alignment of two word sequences, end exclusive in ``text``."""
    n = len(text)
    row, begin = np.zeros(n + 1), np.arange(n + 1)
    drop = np.arange(n + 1) * GAP
    best = (0.0, 0, 0)
    for w in item:
        diag = np.concatenate([[0.0], row[:-1] + np.where(text == w, 1.0, -MISMATCH)])
        up = row - GAP
        new = np.maximum(np.maximum(diag, up), 0.0)
        start = np.where(diag >= np.maximum(up, 0.0), np.concatenate([[0], begin[:-1]]), np.where(up > 0, begin, np.arange(n + 1)))
        # Gaps along the row: the best earlier cell less its distance.
        lifted = new + drop
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= run, np.arange(n + 1), 0))
        row, begin = run - drop, start[source]
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (float(row[k]), int(begin[k]), k)
    return best


def heavy(w: np.ndarray, start: np.ndarray, span: int) -> np.ndarray:
    """Sum of ``w`` over each window that begins in ``start`` and has ``span`` entries."""
    c = np.concatenate([[0.0], np.cumsum(w)])
    return c[np.minimum(start + span, len(w))] - c[start]


def candidates(items: Items, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, text position less item place) of the seeds of ``h`` that enough seed weight follows."""
    entry, at, weight = [], [], []
    for apart in (1, 2):
        if len(h) <= apart:
            continue
        found = items.hits(p := pairs(h, apart))
        lo, hi = np.searchsorted(items.seed, p[found], "left"), np.searchsorted(items.seed, p[found], "right")
        n = hi - lo
        e = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        entry.append(e)
        at.append(np.repeat(found, n))
        weight.append(np.where(items.far[e] | (apart == 2), 0.5, 1.0))
    if not entry or not sum(map(len, entry)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    entry, at, weight = np.concatenate(entry), np.concatenate(at), np.concatenate(weight)
    item = items.item[entry]
    # A text position counts once an item, with its best weight; items are too far apart to share a window.
    key = item * (len(h) + int(items.span.max()) + 1) + at
    order = np.lexsort((-weight, key))
    entry, at, weight, item, key = entry[order], at[order], weight[order], item[order], key[order]
    weight[1:][key[1:] == key[:-1]] = 0.0
    c = np.concatenate([[0.0], np.cumsum(weight)])
    passing = c[np.searchsorted(key, key + items.span[item], "right")] - c[np.searchsorted(key, key, "left")] >= items.weight[item]
    return item[passing], (at - items.place[entry])[passing]


def may_pass(items: Items, k: int, h: np.ndarray) -> bool:
    """Whether some window of ``h`` has the words and the weight over all places of an alignment with item ``k`` that passes."""
    w, need, span = items.words[k], items.need[k], int(items.span[k])
    at = np.arange(len(h))
    if heavy(np.isin(h, w), at, span).max() < need:
        return False
    adjacent, far = items.pairs[k]
    every = np.concatenate([adjacent, far])
    weight = np.zeros(len(h))
    weight[:-2][np.isin(pairs(h, 2), every)] = 0.5
    p = pairs(h)
    weight[:-1][np.isin(p, far)] = 0.5
    weight[:-1][np.isin(p, adjacent)] = 1.0
    return heavy(weight, at, span).max() >= need - 1


def copies(items: Items, h: np.ndarray) -> list[tuple]:
    """(item_id, score, begin, end) for each item that the word sequence ``h`` copies."""
    item, origin = candidates(items, h)
    out = []
    for k in np.unique(item):
        w = items.words[k]
        need, spare = items.need[k], errors(len(w), items.need[k])
        begins = np.unique(np.maximum(origin[item == k] - spare, 0))
        ends = np.minimum(begins + len(w) + 2 * spare, len(h))
        # Windows that overlap are one stretch.
        fresh = np.flatnonzero(np.concatenate([[True], begins[1:] > np.maximum.accumulate(ends)[:-1]]))
        best = (0.0, 0, 0)
        for a, b in zip(begins[fresh], np.maximum.reduceat(ends, fresh)):
            if b - a < need or not may_pass(items, k, h[a:b]):
                continue
            s, x, y = align(w, h[a:b])
            if s > best[0]:
                best = (s, int(a) + x, int(a) + y)
        if best[0] >= need:
            out.append((items.ids[k], best[0] / len(w), best[1], best[2]))
    return out


def _frequency(docs: DataFrame, items) -> dict:
    """Documents that hold each pair of the block's items, over all of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(items))

    def run(batches):
        block = Items.of(shared.value)
        total = np.zeros(len(block.seeds), np.int64)
        for b in batches:
            for i, j, h, first in _word_hashes(b.column(0)):
                both = []
                for apart in (1, 2):
                    if len(h) <= apart:
                        continue
                    p = pairs(h, apart)
                    at = block.hits(p)
                    doc = np.searchsorted(first, at, "right")
                    ok = at + apart < first[doc]  # both words in one document
                    both.append(doc[ok] * len(total) + np.searchsorted(block.seeds, p[at[ok]]))
                if both:
                    total += np.bincount(np.unique(np.concatenate(both)) % len(total), minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(block.seeds[k].view(np.int64)), pa.array(total[k])], names=["seed", "n"])

    counted = docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    # At most one row per pair of the block.
    return {r["seed"]: r["n"] for r in counted.collect()}


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """The items in blocks of about ``block_words`` words, each collected as sorted (item_id, text) rows."""
    rows = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (6 * block_words)))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def scan(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, into: str = "leaks") -> DataFrame:
    """All columns of ``docs`` and ``into``: the items each document copies, with score and word span."""
    out = docs.drop(into).withColumn(into, F.expr(f"cast(array() as {_LEAK})"))
    (found,) = free_names(out, 1)
    for rows in blocks(benchmark, block_words):
        items = Items(rows)
        if not items.words:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(vars(items.rare(_frequency(docs, items))))

        def compute(col, shared=shared):
            got, block = [], Items.of(shared.value)
            for i, j, h, first in _word_hashes(col):
                got += [[dict(zip(("item_id", "score", "begin", "end"), c)) for c in copies(block, h[first[k] : first[k + 1]])] for k in range(j - i)]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())]))
            return [pa.array(got, kind)]

        out = from_text(out, compute, f"{found} {_LEAK}").withColumn(into, F.concat(into, found)).drop(found)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and copied item: doc_id, item_id, score, begin, end."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
