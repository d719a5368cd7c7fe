"""Substring dedup: words covered by a window of ``WINDOW`` words that also starts elsewhere are removed.

Suffix automata of reference shards answer, for every word of a streamed text, how long a passage ending
there occurs at least twice.  Sending each shard to every document would cost shards times documents, so
text is routed instead: only passages that can match a shard meet it.

*Routing.*  In each window the ``ANCHOR``-word gram of smallest hash (leftmost of equals) is its anchor;
equal windows have equal anchors at equal places.  Consecutive windows with one anchor form a segment.
Windows of different anchors cannot be equal, and each window lies in one segment, so the segments that
share an anchor are all that must be compared.

*Deciding.*  Segments are counted by content (map-side combine).  One that occurs twice or more is
repeated as a whole.  A segment that occurs once is decided against the other segments of its anchor: the
distinct segments of the anchors in question, dealt to tasks by anchor, are built into suffix automata of
about ``SHARD_WORDS`` words that count occurrences, and streamed through them for matching statistics.
Anchors with more than ``WIDE`` distinct segments (a short passage in very many contexts) are not
gathered: their windows are counted by content in the shuffle, with the same result.

*Removing.*  Decisions go back to the places of each segment; places of one document are merged into word
ranges and taken out of the whole text.

Segments are compared by 128 bits of content hash, windows of wide anchors likewise; everything between is
compared word by word.

Defined results: null, empty and word-less texts have no words, and the digest of the empty string.
Texts of fewer than WINDOW words lose nothing.  A row repeated whole repeats its own windows, so its texts
of WINDOW words or more go, as for any exact copy.  An empty table gives an empty result.  Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import attach, mix, slices, stored, text_buffers, words

WINDOW = 35
ANCHOR = 6
SHARD_WORDS = 60_000
WIDE = 2_000

_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _content(h: np.ndarray):
    """A function giving the hash of any word ranges [b, e) of the word hashes ``h``."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _R) * _powers(_R, len(h)), dtype=np.uint64)])
    back = _powers(_RINV, len(h) + 1)
    return lambda b, e: mix((total[e] - total[b]) * back[b] + (e - b).astype(np.uint64) * _RINV)


def segments(h: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = ANCHOR):
    """(text, anchor hash, content hash, begin, end) of all segments; begin and end count words of the text."""
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    content = _content(h)
    at = np.arange(n - gram + 1)
    key = content(at, at + gram)
    low = (key >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    # Sliding minimum over the grams of a window, by doubling.
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: n - window + 1], low[width - have : width - have + n - window + 1])
    where = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(first, np.arange(n - window + 1), "right") - 1
    valid = np.arange(n - window + 1) + window <= first[text + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    new = np.concatenate([[True], (where[start[1:]] != where[start[:-1]]) | (text[start[1:]] != text[start[:-1]])])
    b = start[new]
    e = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)] + window
    t = text[b]
    return t, key[where[b]], content(b, e), b - first[t], e - first[t]


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with how often each state's words occur."""

    def __init__(self):
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]

    def add(self, text, times: int) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in text:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
            else:
                cur = len(nxt)
                clone_for = q
                if q is None:
                    nxt.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    count.append(0)
                    p = last
                    while p != -1 and c not in nxt[p]:
                        nxt[p][c] = cur
                        p = link[p]
                    if p == -1:
                        last = cur
                        count[cur] += times
                        continue
                    q = nxt[p][c]
                    if length[q] == length[p] + 1:
                        link[cur] = q
                        last = cur
                        count[cur] += times
                        continue
                else:
                    p = last
                new = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                count.append(0)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = new
                    p = link[p]
                link[q] = new
                if clone_for is None:
                    link[cur] = new
                    last = cur
                else:
                    last = new
            count[last] += times

    def close(self) -> None:
        """Sum occurrences up the links; find each state's nearest one that occurs twice."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:
            self.count[self.link[v]] += self.count[v]
        self.repeated = [0] * len(self.length)
        for v in reversed(order):
            self.repeated[v] = v if self.count[v] > 1 else self.repeated[self.link[v]]

    def matching(self, text) -> list[int]:
        """For each word, the length of the longest passage ending there that occurs at least twice."""
        out, v, l = [], 0, 0
        for c in text:
            while v and c not in self.next[v]:
                v = self.link[v]
                l = self.length[v]
            if c in self.next[v]:
                v, l = self.next[v][c], l + 1
            r = self.repeated[v]
            out.append(l if r == v else self.length[r])
        return out


def repeated_windows(texts, times, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each text, ranges [lo, hi) of window starts that occur at least twice in all texts together."""
    numbers: dict = {}
    coded = [[numbers.setdefault(w, len(numbers)) for w in t] for t in texts]
    sam = SuffixAutomaton()
    for t, n in zip(coded, times):
        sam.add(t, n)
    sam.close()
    out = []
    for t in coded:
        ranges: list = []
        for end, l in enumerate(sam.matching(t), 1):
            if l >= window:
                s = end - window
                if ranges and ranges[-1][1] == s:
                    ranges[-1] = (ranges[-1][0], s + 1)
                else:
                    ranges.append((s, s + 1))
        out.append(ranges)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of 96 bits that names the document, whatever its id."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.hash("text", "doc_id"))


def _places(docs: DataFrame) -> DataFrame:
    """k1, k2 and the segments of each document that has any: arrays anchor, seg, begin, end."""

    def run(batches):
        for b in batches:
            raw, off = text_buffers(b.column("text"))
            for i, j in slices(off):
                h, _, _, first = words(raw, off[i : j + 1])
                t, anchor, seg, begin, end = segments(h, first)
                docs_with, start = np.unique(t, return_index=True)
                cut = pa.array(np.append(start, len(t)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (anchor.view(np.int64), seg.view(np.int64), begin.astype(np.int32), end.astype(np.int32))]
                at = pa.array(docs_with + i)
                yield pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), *lists], names=["k1", "k2", "anchor", "seg", "begin", "end"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 int, anchor array<long>, seg array<long>, begin array<int>, end array<int>")


def _cut_words(docs: DataFrame) -> DataFrame:
    """anchor, seg, n, kinds (distinct segments of the anchor) and the words of the segments in ``want``."""

    def run(batches):
        for b in batches:
            rows = {"anchor": [], "seg": [], "n": [], "kinds": [], "words": []}
            for text, want in zip(b.column("text"), b.column("want")):
                w = text.as_py().encode().split()
                for x in want.as_py():
                    for c in ("anchor", "seg", "n", "kinds"):
                        rows[c].append(x[c])
                    rows["words"].append(b" ".join(w[x["begin"] : x["end"]]))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64()), ("words", pa.binary())]))

    return docs.select("text", "want").mapInArrow(run, "anchor long, seg long, n long, kinds long, words binary")


def _by_automaton(rows: DataFrame) -> DataFrame:
    """(anchor, seg, lo, hi): window ranges repeated in the once-only segments of complete anchor groups."""

    def decide(held):
        once = [k for k, r in enumerate(held) if r[2] == 1]
        got = repeated_windows([r[3].split(b" ") for r in held], [r[2] for r in held]) if once else []
        out = [(held[k][0], held[k][1], lo, hi) for k in once for lo, hi in got[k]]
        return pa.RecordBatch.from_pydict(
            {"anchor": [r[0] for r in out], "seg": [r[1] for r in out], "lo": [r[2] for r in out], "hi": [r[3] for r in out]},
            schema=pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]),
        )

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("anchor", "seg", "n", "words"))):
                if r[0] != last and size >= SHARD_WORDS:
                    yield decide(held)
                    held, size = [], 0
                held.append(r)
                size += r[3].count(b" ") + 1
                last = r[0]
        if held:
            yield decide(held)

    return rows.sortWithinPartitions("anchor").mapInArrow(run, "anchor long, seg long, lo int, hi int")


def _by_window(rows: DataFrame) -> DataFrame:
    """The same for wide anchors: every window counted by content, no group gathered."""

    def run(batches):
        for b in batches:
            for anchor, seg, n, text in zip(*(b.column(c).to_pylist() for c in ("anchor", "seg", "n", "words"))):
                raw, off = text_buffers(pa.array([text.decode()]))
                h, _, _, _ = words(raw, off)
                at = np.arange(len(h) - WINDOW + 1)
                code = _content(h)(at, at + WINDOW).view(np.int64)
                k = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, anchor)), pa.array(np.full(k, seg)), pa.array(np.full(k, n)), pa.array(at.astype(np.int32)), pa.array(code)],
                    names=["anchor", "seg", "n", "lo", "code"],
                )

    each = stored(rows.mapInArrow(run, "anchor long, seg long, n long, lo int, code long"), "wide-windows")
    twice = each.groupBy("anchor", "code").agg(F.sum("n").alias("t")).filter("t > 1").select("anchor", "code")
    hit = each.filter("n = 1").join(twice, ["anchor", "code"], "left_semi")
    return hit.select("anchor", "seg", "lo", (F.col("lo") + 1).cast("int").alias("hi"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """k1, k2 and ``cut``: word ranges (begin, end) that repeated windows cover, of each document with any."""
    places = stored(_places(docs), "segment-places")
    flat = places.select("k1", "k2", F.explode(F.arrays_zip("anchor", "seg", "begin", "end")).alias("s")).select("k1", "k2", "s.*")
    # One place of each distinct segment stands for it.
    kinds = flat.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "begin", "end")).alias("at"))
    kinds = stored(kinds, "segment-kinds")
    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    open_ = kinds.join(groups.filter("kinds > 1 and least = 1"), "anchor")
    want = open_.select("at.k1", "at.k2", F.struct("anchor", "seg", "n", "kinds", F.col("at.begin").alias("begin"), F.col("at.end").alias("end")).alias("w"))
    want = want.groupBy("k1", "k2").agg(F.collect_list("w").alias("want"))
    # The texts of repeated rows are equal, so one of them serves.
    text = docs.join(want, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    cut = stored(_cut_words(text), "segment-words")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _by_automaton(cut.filter(F.col("kinds") <= WIDE).repartition(parts, "anchor"))
    found = found.unionByName(_by_window(cut.filter(F.col("kinds") > WIDE)))
    some = found.groupBy("anchor", "seg").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    whole = kinds.filter("n > 1").select("anchor", "seg", "n", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("ranges"))
    decided = stored(whole.unionByName(some.select("anchor", "seg", F.lit(1).cast("long").alias("n"), "ranges")), "segment-decisions")
    total = kinds.agg(F.sum("n")).first()[0] or 0
    keyed = decided.select(F.struct("anchor", "seg").alias("key"), "n", "ranges")
    hits = attach(flat.select(F.struct("anchor", "seg").alias("key"), "k1", "k2", "begin", "end"), keyed, "key", "n", total).filter("n is not null")
    inner = F.transform("ranges", lambda r: F.struct((F.col("begin") + r["lo"]).alias("begin"), (F.col("begin") + r["hi"] + (WINDOW - 1)).alias("end")))
    hits = hits.select("k1", "k2", F.when(F.col("ranges").isNull(), F.array(F.struct("begin", "end"))).otherwise(inner).alias("r"))
    return hits.groupBy("k1", "k2").agg(F.flatten(F.collect_list("r")).alias("cut"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the words that stay, joined by one space), n_words, n_removed of every row."""
    keyed = _keyed(docs)
    marked = keyed.join(repeated_ranges(keyed), ["k1", "k2"], "left")

    def run(batches):
        for b in batches:
            kept, total, gone = [], [], []
            for text, cut in zip(b.column("text"), b.column("cut")):
                w = (text.as_py() or "").encode().split()
                total.append(len(w))
                ranges = cut.as_py() or []
                if ranges:
                    drop = np.zeros(len(w) + 1, np.int64)
                    np.add.at(drop, [r["begin"] for r in ranges], 1)
                    np.add.at(drop, [r["end"] for r in ranges], -1)
                    stay = np.cumsum(drop[:-1]) == 0
                    w = [x for x, s in zip(w, stay) if s]
                gone.append(total[-1] - len(w))
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "kept", "n_words", "n_removed"])

    return marked.select("doc_id", "text", "cut").mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long")
