"""Quality classifier: a generalised additive model with pairwise interactions.

Numbers that describe a whole text (lengths, character classes, repetition) are put into bins at the
quantiles of the training sample.  Training goes round the features: each step fits a shallow tree to the
residuals over one feature's bins and adds it, shrunk, to that feature's lookup table.  Then the pairs
whose residuals gain most from a cut on both axes get tables of their own, trained the same way.  A score
is the sum of table entries, looked up for all texts of a batch at once, through a sigmoid.

The fit uses at most ``TRAIN_ROWS`` labelled documents (lowest hash of the id); everything is scored.

Defined results: null and empty texts are scored as texts of no words.  Without labelled rows, or with
one class only, every score is that class's share ((n1 + 1) / (n + 2)).  Equal texts get equal scores.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import bounded_batches, is_held_out, labelled, slices, text_buffers, words

TRAIN_ROWS = 12_000
BINS = 24
PAIR_BINS = 6
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.15
#: Weight of the prior in a leaf, in rows: leaves of few rows stay small.
SHRINK = 20.0
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "stops", "marks", "other_ascii", "newlines", "high",
    "distinct", "top_share", "doubled", "longest", "spread",
)

_CLASSES = np.zeros((7, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, 48:58] = True
_CLASSES[2, [ord(c) for c in ".,;:?'\"-()"]] = True
_CLASSES[3, [ord(c) for c in "!#$%&*|~^_=+<>@{}[]\\/`"]] = True
_CLASSES[4, 0:32] = True
_CLASSES[4, [9, 10, 13]] = False
_CLASSES[5, 10] = True
_CLASSES[6, 128:] = True


def features(col) -> np.ndarray:
    """One row of FEATURES per text of an Arrow string column."""
    raw, off = text_buffers(col)
    out = np.zeros((len(off) - 1, len(FEATURES)), np.float32)
    for i, j in slices(off):
        data = raw[off[i] : off[j]]
        at = off[i : j + 1] - off[i]
        size = np.maximum(np.diff(at), 1)
        for k, mask in enumerate(_CLASSES):
            total = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int32)])
            out[i:j, 2 + k] = np.diff(total[at]) / size
        h, start, end, first = words(raw, off[i : j + 1], lower=True)
        length = end - start
        for d in range(j - i):
            a, b = first[d], first[d + 1]
            n = b - a
            if n:
                _, c = np.unique(h[a:b], return_counts=True)
                w = length[a:b]
                out[i + d, [0, 1]] = np.log1p(n), w.mean()
                out[i + d, 9:] = len(c) / n, c.max() / n, (h[a + 1 : b] == h[a : b - 1]).mean() if n > 1 else 0, w.max(), w.std()
    return out


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g, n):
    return g / (n + SHRINK)


def _shallow_tree(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Value per bin of the tree of at most three leaves that fits the binned residuals best."""
    out = np.full(len(g), _leaf(g.sum(), n.sum()))
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None)
        for lo, hi in parts:
            cg, cn = np.cumsum(g[lo:hi]), np.cumsum(n[lo:hi])
            if hi - lo < 2:
                continue
            lg, ln, rg, rn = cg[:-1], cn[:-1], cg[-1] - cg[:-1], cn[-1] - cn[:-1]
            gain = lg**2 / (ln + SHRINK) + rg**2 / (rn + SHRINK) - cg[-1] ** 2 / (cn[-1] + SHRINK)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (lo, lo + k + 1, hi))
        if best[1] is None:
            break
        lo, mid, hi = best[1]
        parts = [p for p in parts if p != (lo, hi)] + [(lo, mid), (mid, hi)]
        for a, b in ((lo, mid), (mid, hi)):
            out[a:b] = _leaf(g[a:b].sum(), n[a:b].sum())
    return out


def _corner_tree(g: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, value per cell) of the best cut of a two-way table on both axes."""
    cg, cn = g.cumsum(0).cumsum(1), n.cumsum(0).cumsum(1)
    best, cut = 0.0, None
    tg, tn = cg[-1, -1], cn[-1, -1]
    for i in range(len(g) - 1):
        for j in range(g.shape[1] - 1):
            q = [(cg[i, j], cn[i, j]), (cg[i, -1] - cg[i, j], cn[i, -1] - cn[i, j]), (cg[-1, j] - cg[i, j], cn[-1, j] - cn[i, j])]
            q.append((tg - sum(a for a, _ in q), tn - sum(b for _, b in q)))
            gain = sum(a * a / (b + SHRINK) for a, b in q) - tg * tg / (tn + SHRINK)
            if gain > best:
                best, cut = gain, (i + 1, j + 1, [_leaf(a, b) for a, b in q])
    out = np.zeros(g.shape)
    if cut:
        i, j, (a, b, c, d) = cut
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = a, b, c, d
    return best, out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Lookup tables of the model: bias, edges, mains, pair edges, pairs."""
    base = (y.sum() + 1) / (len(y) + 2)
    model = {"bias": float(np.log(base / (1 - base))), "edges": [], "mains": [], "pair_edges": [], "pairs": []}
    if not len(y) or y.min() == y.max():
        return model
    model["edges"] = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    model["pair_edges"] = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model["edges"])]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model["pair_edges"])]
    sizes = [len(e) + 1 for e in model["edges"]]
    model["mains"] = [np.zeros(s) for s in sizes]
    z = np.full(len(y), model["bias"])
    for _ in range(ROUNDS):
        for f, b in enumerate(binned):
            p = _sigmoid(z)
            step = 4 * RATE * _shallow_tree(np.bincount(b, y - p, sizes[f]), np.bincount(b, minlength=sizes[f]).astype(float))
            model["mains"][f] += step
            z += step[b]

    def table(f, g, residual):
        k = len(model["pair_edges"][g]) + 1
        shape = (len(model["pair_edges"][f]) + 1, k)
        cell = coarse[f] * k + coarse[g]
        total = shape[0] * k
        return cell, np.bincount(cell, residual, total).reshape(shape), np.bincount(cell, minlength=total).reshape(shape).astype(float)

    residual = y - _sigmoid(z)
    found = []
    for f in range(x.shape[1]):
        for g in range(f):
            _, gs, ns = table(f, g, residual)
            found.append((_corner_tree(gs, ns)[0], f, g))
    chosen = [(f, g) for _, f, g in sorted(found, reverse=True)[:PAIRS]]
    tables = {p: 0.0 for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for f, g in chosen:
            cell, gs, ns = table(f, g, y - _sigmoid(z))
            step = 4 * RATE * _corner_tree(gs, ns)[1]
            tables[f, g] = tables[f, g] + step
            z += step.ravel()[cell]
    model["pairs"] = [(f, g, tables[f, g]) for f, g in chosen]
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of feature rows: one table look-up and addition per feature and pair."""
    z = np.full(len(x), model["bias"])
    for f, t in enumerate(model["mains"]):
        z += t[np.searchsorted(model["edges"][f], x[:, f], "right")]
    for f, g, t in model["pairs"]:
        z += t[np.searchsorted(model["pair_edges"][f], x[:, f], "right"), np.searchsorted(model["pair_edges"][g], x[:, g], "right")]
    return _sigmoid(z)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 5, out: int = 0, bound: int = TRAIN_ROWS) -> dict:
    """Fit on the labelled documents that are not held out (see ``labelled``)."""
    bounded_batches(docs.sparkSession)
    ids = labelled(docs, labels, column, modulus, out, bound)

    def run(batches):
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array(list(x.astype(float)), pa.list_(pa.float64()))], names=["doc_id", "label", "x"]
            )

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    rows = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x array<double>")
    # One row an id, however often the id repeats.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("doc_id", "r.*")
    got = sorted((r["doc_id"], tuple(r["x"]), r["label"]) for r in rows.collect())
    if not got:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array([g[1] for g in got], np.float32), np.array([g[2] for g in got], float))


def score(docs: DataFrame, model: dict, modulus: int = 5, out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = predict(shared.value, features(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s)], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(modulus, out).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
