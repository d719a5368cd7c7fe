"""Toxicity classifier: a convolutional network over hashed word embeddings, trained in numpy.

Words are runs of lower-cased letters.  A word's embedding is the sum of hashed rows: one of the
word, one of each of its beginnings of ``PREFIXES`` bytes, so inflected forms share what they begin with.
Filters one, two and three words wide run over the whole text, each is max-pooled, and a logistic layer
reads the pools.  Training is Adam over the whole texts of all labelled documents that are not held out.
They are dealt by hash to up to ``WORKERS`` tasks, one for every ``WORKER_ROWS`` rows; in each epoch every task
runs over its rows from the same network, and what the tasks changed is averaged (a row of the table over the
tasks that used it).  Up to ``WORKER_ROWS`` rows of ``HELD_BYTES`` are fitted in one task as a whole.

Language buckets come from the text itself (the function words it uses most).  For each bucket the
threshold on the raw output is set on a fifth of the labelled rows (by hash) that the network does not learn
from, with every row counted at steps of 1/``STEPS`` of the output, and scores are shifted so that it
stands at ``THRESHOLD``; buckets with few toxic validation rows take the threshold of all rows.

Defined results: null texts, and texts without a letter, are texts of no words and get the score of an
empty pool.  Without labelled rows of both classes every score is that class's share, at most half the
threshold where no row is toxic.  Equal texts get equal scores.  Other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import bounded_batches, is_held_out, labelled, letters_only, mix, slices, text_buffers, words
from meterframe.session import scratch_path

#: Tasks that train side by side at most, and labelled rows for each before another one is worth its averaging.
WORKERS, WORKER_ROWS = 16, 8_000
#: Bytes of word rows that one task may hold at once; up to so many and WORKER_ROWS rows are fitted in one go.
HELD_BYTES = 128 << 20
#: Words of a mini-batch; one longer text is a batch of its own.
BATCH_WORDS = 1 << 17
#: Steps of the raw output to which validation rows are counted, and the outputs beyond which all count as one.
STEPS, FAR = 256, 40
BUCKETS = 1 << 16
PREFIXES = (5, 6, 7, 8)
WIDTH = 12
FILTERS = 8
SPANS = (1, 2, 3)
EPOCHS = 8
BATCH = 32
RATE = 0.01
TABLE_RATE = 0.1
DECAY = 3e-4
THRESHOLD = 0.7
MIN_TOXIC = 20

# Common function words by language, to tell language buckets apart.
FUNCTION_WORDS = {
    "en": "the of and to in is was that for it with as be by on at this are or an".split(),
    "fr": "le la les de des et un une est dans que qui pour par sur au avec pas du il".split(),
    "de": "der die das und den von zu mit ist des dem nicht ein eine auf für im sich als auch".split(),
    "es": "el la los de que y en un una es por con para las del se al no su lo".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def _function_table() -> np.ndarray:
    """Points each embedding row gives to each language: those of its function words."""
    table = np.zeros((BUCKETS + 1, len(FUNCTION_WORDS)), np.float32)
    for k, lang in enumerate(FUNCTION_WORDS):
        for w in FUNCTION_WORDS[lang]:
            shared = sum(w in x for x in FUNCTION_WORDS.values())
            table[word_ids(pa.array([w]))[0][0, 0], k] += 1 / shared
    return table


def word_ids(col) -> tuple[np.ndarray, np.ndarray]:
    """(embedding rows of every word, first word of each text) of an Arrow string column.

    Row numbers: the word's, then one per prefix length, ``BUCKETS`` (zeros) where the word is not longer.
    """
    raw, off = text_buffers(pc.utf8_lower(col))
    parts, firsts, n = [], [np.zeros(1, np.int64)], 0
    for i, j in slices(off, 1 << 19):
        h, start, end, first = words(raw, off[i : j + 1], lower=True, space=letters_only())
        ids = np.full((len(h), 1 + len(PREFIXES)), BUCKETS, np.int32)
        ids[:, 0] = (h >> np.uint64(40)) % np.uint64(BUCKETS)
        for k, size in enumerate(PREFIXES, 1):
            longer = np.flatnonzero(end - start > size)
            code = np.full(len(longer), size, np.uint64)
            for b in range(size):
                code = code * np.uint64(1099511628211) ^ raw[start[longer] + b].astype(np.uint64)
            ids[longer, k] = (mix(code) >> np.uint64(40)) % np.uint64(BUCKETS)
        parts.append(ids)
        firsts.append(first[1:] + n)
        n += len(h)
    return np.concatenate(parts) if parts else np.zeros((0, 1 + len(PREFIXES)), np.int32), np.concatenate(firsts)


def _ahead(rows: np.ndarray, first: np.ndarray, by: int) -> np.ndarray:
    """Row of the word ``by`` words further on in the same text, zeros beyond its end."""
    if by == 0:
        return rows
    out = np.zeros_like(rows)
    out[:-by] = rows[by:]
    for k in range(1, by + 1):
        at = first[1:] - k
        out[at[at >= first[:-1]]] = 0
    return out


def new_network(seed: int = 5) -> dict:
    r = np.random.default_rng(seed)
    p = {"e": (r.normal(size=(BUCKETS + 1, WIDTH)) * 0.05).astype(np.float32)}
    p["e"][BUCKETS] = 0
    for s in SPANS:
        p[f"w{s}"] = (r.normal(size=(s, WIDTH, FILTERS)) / np.sqrt(s * WIDTH)).astype(np.float32)
        p[f"b{s}"] = np.zeros(FILTERS, np.float32)
    p["v"] = (r.normal(size=len(SPANS) * FILTERS) * 0.3).astype(np.float32)
    p["c"] = np.zeros(1, np.float32)
    return p


def embedded(p: dict, ids: np.ndarray) -> np.ndarray:
    x = p["e"][ids[:, 0]]
    for k in range(1, ids.shape[1]):
        x += p["e"][ids[:, k]]
    return x


def convolved(p: dict, x: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    out = x @ p[f"w{span}"][0] + p[f"b{span}"]
    for j in range(1, span):
        out += _ahead(x @ p[f"w{span}"][j], first, j)
    return out


def raw_output(p: dict, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The logistic layer's input for each text."""
    full = np.flatnonzero(np.diff(first) > 0)
    z = np.full(len(first) - 1, p["c"][0], np.float64)
    if len(full):
        x = embedded(p, ids)
        for k, s in enumerate(SPANS):
            top = np.maximum.reduceat(convolved(p, x, first, s), first[full], axis=0)
            z[full] += np.maximum(top, 0) @ p["v"][k * FILTERS : (k + 1) * FILTERS]
    return z


def new_state(p: dict) -> dict:
    """What Adam carries from step to step, and which rows of the table have moved."""
    zeros = lambda: {k: np.zeros_like(v) for k, v in p.items() if k != "e"}
    return {"m": zeros(), "q": zeros(), "t": 0, "scale": 1e-4, "touched": np.zeros(BUCKETS + 1, bool)}


def class_weights(n: float, toxic: float) -> tuple[float, float]:
    """Weight of a clean and of a toxic row."""
    return (n / max(n - toxic, 1)) ** 0.5, (n / max(toxic, 1)) ** 0.5


def mini_batches(texts: list[np.ndarray], order):
    """Runs of ``order`` of up to BATCH texts and BATCH_WORDS words, texts without words passed over."""
    pick, n = [], 0
    for k, i in enumerate(order):
        if len(texts[i]):
            if pick and n + len(texts[i]) > BATCH_WORDS:
                yield np.array(pick, int)
                pick, n = [], 0
            pick.append(i)
            n += len(texts[i])
        if pick and (k + 1) % BATCH == 0:
            yield np.array(pick, int)
            pick, n = [], 0
    if pick:
        yield np.array(pick, int)


def learn(p: dict, state: dict, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, order) -> None:
    """Adam over the texts in ``order``, in mini-batches; only the window that wins a pool gets its gradient."""
    m, q = state["m"], state["q"]
    for pick in mini_batches(texts, order):
        ids = np.concatenate([texts[i] for i in pick])
        first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
        x = embedded(p, ids)
        top, at = [], []
        for s in SPANS:
            conv = convolved(p, x, first, s)
            won = np.stack([first[d] + conv[first[d] : first[d + 1]].argmax(0) for d in range(len(pick))])
            at.append(won)
            top.append(np.maximum(conv[won, np.arange(FILTERS)], 0))
        pooled = np.concatenate(top, 1)
        z = pooled @ p["v"] + p["c"][0]
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
        grad = {"v": pooled.T @ g + DECAY * p["v"], "c": np.array([g.sum()], np.float32)}
        back = g[:, None] * p["v"] * (pooled > 0)
        last = first[1:][:, None]
        rows, steps = [], []
        for k, s in enumerate(SPANS):
            b = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad[f"b{s}"] = b.sum(0)
            gw = DECAY * p[f"w{s}"]
            for j in range(s):
                word = at[k] + j
                live = b * (word < last)
                word = np.minimum(word, len(ids) - 1)
                gw[j] += np.einsum("nf,nfd->df", live, x[word])
                rows.append(word.ravel())
                steps.append((live[:, :, None] * p[f"w{s}"][j].T[None]).reshape(-1, WIDTH))
            grad[f"w{s}"] = gw
        # Rows of the table that the winning words use, each with the sum of its gradients.
        hit = ids[np.concatenate(rows)]
        used, inverse = np.unique(hit, return_inverse=True)
        ge = np.zeros((len(used), WIDTH), np.float32)
        np.add.at(ge, inverse.reshape(hit.shape), np.concatenate(steps)[:, None, :])
        ge += DECAY * p["e"][used]
        ge[used == BUCKETS] = 0
        state["t"] += 1
        lr = RATE * np.sqrt(1 - 0.999 ** state["t"]) / (1 - 0.9 ** state["t"])
        for k, v in grad.items():
            m[k] += 0.1 * (v - m[k])
            q[k] += 0.001 * (v * v - q[k])
            p[k] -= lr * m[k] / (np.sqrt(q[k]) + 1e-7)
        # One step length for the whole table: a row moves as often as its words win, so words seen
        # once cannot be learned by heart in a single normalised step.
        state["scale"] = 0.99 * state["scale"] + 0.01 * float((ge * ge).sum() / WIDTH)
        p["e"][used] -= TABLE_RATE * ge / (np.sqrt(state["scale"]) + 1e-9)
        state["touched"][used] = True


def fit_network(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> dict:
    """The network of texts that are all here."""
    p, r = new_network(), np.random.default_rng(11)
    state, weight = new_state(p), np.where(y == 1, *class_weights(len(y), y.sum())[::-1])
    for _ in range(epochs):
        learn(p, state, texts, y, weight, r.permutation(len(y)))
    return p


def averaged(p: dict, state: dict, parts: list[dict]) -> tuple[dict, dict]:
    """The network and Adam's state after an epoch of several tasks that all began with ``p`` and ``state``."""
    total = sum(x["rows"] for x in parts)
    mean = lambda of: sum(of(x) * (x["rows"] / total) for x in parts)
    out = {k: mean(lambda x: x["p"][k]).astype(np.float32) for k in p if k != "e"}
    moved, users = np.zeros_like(p["e"]), np.zeros(len(p["e"]), np.float32)
    for x in parts:
        moved[x["used"]] += x["e"] - p["e"][x["used"]]
        users[x["used"]] += 1
    out["e"] = p["e"] + moved / np.maximum(users, 1)[:, None]
    after = new_state(p)
    for name in ("m", "q"):
        after[name] = {k: mean(lambda x: x[name][k]).astype(np.float32) for k in state[name]}
    after["t"], after["scale"] = max(x["t"] for x in parts), float(mean(lambda x: x["scale"]))
    return out, after


def language_of(ids: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES of each text, by the function words in it."""
    total = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[ids[:, 0]], axis=0, dtype=float)])
    points = total[first[1:]] - total[first[:-1]]
    return np.where(points.max(1) > 0, points.argmax(1), len(FUNCTION_WORDS))


def _best_threshold(z: np.ndarray, toxic: np.ndarray, n=1) -> float:
    """Raw output that separates the classes with the highest F1: midway to the next output below.

    ``n`` rows have each output, ``toxic`` of them toxic.
    """
    order = np.argsort(-z, kind="stable")
    zs, hit = z[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.cumsum((n * np.ones(len(z)))[order]) + toxic.sum())
    k = int(f1.argmax())
    return float((zs[k] + zs[k + 1]) / 2) if k + 1 < len(zs) else float(zs[k] - 1)


def _thresholds(lang: np.ndarray, z: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The threshold of each language bucket."""
    overall = _best_threshold(z, toxic, n) if toxic.any() else 0.0
    own = [lang == k for k in range(len(LANGUAGES))]
    return np.array([_best_threshold(z[of], toxic[of], n[of]) if toxic[of].sum() >= MIN_TOXIC else overall for of in own])


def _constant(n: int, toxic: float) -> dict:
    share = (toxic + 1) / (n + 2) if n else 0.5
    return {"constant": float(share if toxic else min(share, THRESHOLD / 2))}


def fit(texts: list[np.ndarray], y: np.ndarray) -> dict:
    """The network with a threshold for each language bucket, of texts that are all here."""
    if not len(y) or y.min() == y.max():
        return _constant(len(y), y.sum())
    valid = np.arange(len(y)) % 5 == 0
    model = fit_network([t for t, v in zip(texts, valid) if not v], y[~valid])
    model["function"] = _function_table()
    held = [t for t, v in zip(texts, valid) if v]
    ids, first = np.concatenate(held), np.concatenate([[0], np.cumsum([len(t) for t in held])])
    z = raw_output(model, ids, first)
    model["threshold"] = _thresholds(language_of(ids, first, model["function"]), z, y[valid], np.ones(len(z)))
    return model


def predict(model: dict, col) -> np.ndarray:
    n = len(col)
    if "constant" in model:
        return np.full(n, model["constant"])
    _, off = text_buffers(col)
    out = np.zeros(n)
    shift = np.log(THRESHOLD / (1 - THRESHOLD))
    for i, j in slices(off, 1 << 19):
        ids, first = word_ids(col.slice(i, j - i))
        z = raw_output(model, ids, first) - model["threshold"][language_of(ids, first, model["function"])]
        out[i:j] = 1 / (1 + np.exp(-np.clip(z + shift, -30, 30)))
    return out


def _texts(b) -> tuple[list[np.ndarray], np.ndarray]:
    """Word rows and labels of a batch of stored rows."""
    each = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 1 + len(PREFIXES)) for x in b.column("w")]
    return each, b.column("label").to_numpy().astype(float)


def training_rows(docs: DataFrame, labels: DataFrame, column: str, modulus: int, out: int) -> DataFrame:
    """doc_id, worker, valid, label, w (the word rows) of every labelled document that is not held out, stored."""
    ids = labelled(docs, labels, column, modulus, out)
    workers = max(1, min(WORKERS, -(-ids.count() // WORKER_ROWS)))

    def run(batches):
        for b in batches:
            raw = [b.column(n) for n in ("doc_id", "worker", "valid", "label")]
            ids_, first = word_ids(b.column("text"))
            w = pa.array([ids_[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*raw, w], names=["doc_id", "worker", "valid", "label", "w"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    # One row an id, however often the id repeats.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("r")).select("doc_id", "r.*")
    h = F.xxhash64("doc_id")
    rows = rows.select(
        F.pmod(F.shiftright(h, 8), F.lit(workers)).cast("int").alias("worker"), (F.pmod(h, F.lit(5)) == 0).alias("valid"), "label", "text", h.alias("h"), "doc_id"
    )
    # By hash, so that a task meets its rows in no order of theirs, and the same one each time.
    rows = rows.repartitionById(workers, F.col("worker")).sortWithinPartitions("worker", "h", "doc_id")
    path = scratch_path(docs.sparkSession, "toxicity")
    rows.mapInArrow(run, "doc_id long, worker int, valid boolean, label int, w binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _fit_small(rows: DataFrame) -> dict:
    """The model of few rows, fitted by one task that holds them all, in the order of their ids."""

    def run(batches):
        ids, each, y = [], [], []
        for b in batches:
            texts, labels = _texts(b)
            ids += b.column("doc_id").to_pylist()
            each += texts
            y += labels.tolist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([each[i] for i in order], np.array([y[i] for i in order], float)))], pa.binary())], names=["model"])

    return pickle.loads(rows.coalesce(1).mapInArrow(run, "model binary").head()["model"])


def _epoch(rows: DataFrame, p: dict, state: dict, weights: tuple[float, float], epoch: int) -> tuple[dict, dict]:
    """One pass of every worker over its rows, averaged."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(pickle.dumps((p, state)))

    def packed(mine, was, n):
        used = np.flatnonzero(was["touched"])
        dense = {k: v for k, v in mine.items() if k != "e"}
        out = {"rows": n, "p": dense, "used": used, "e": mine["e"][used], "m": was["m"], "q": was["q"], "t": was["t"], "scale": was["scale"]}
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], names=["part"])

    def run(batches):
        worker, n = None, 0
        for b in batches:
            at = b.column("worker").to_numpy()
            for k in np.unique(at):
                if k != worker:
                    if n:
                        yield packed(mine, was, n)
                    worker, n, (mine, was) = k, 0, pickle.loads(shared.value)
                    r = np.random.default_rng((epoch, int(k)))
                texts, y = _texts(b.filter(pa.array(at == k)))
                learn(mine, was, texts, y, np.where(y == 1, weights[1], weights[0]), r.permutation(len(y)))
                n += len(y)
        if n:
            yield packed(mine, was, n)

    # One row a worker.
    parts = [pickle.loads(r["part"]) for r in rows.mapInArrow(run, "part binary").collect()]
    shared.unpersist()
    return averaged(p, state, parts) if parts else (p, state)


def _validate(rows: DataFrame, model: dict) -> np.ndarray:
    """The thresholds, of every validation row counted by language bucket and step of the raw output."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts, y = _texts(b)
            ids, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            z = np.floor(np.clip(raw_output(shared.value, ids, first), -FAR, FAR) * STEPS)
            lang = language_of(ids, first, shared.value["function"])
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(z.astype(np.int32)), pa.array(y.astype(np.int32))], names=["lang", "step", "label"])

    counted = rows.mapInArrow(run, "lang int, step int, label int").groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
    # At most a row a step and bucket.
    got = sorted(tuple(r) for r in counted.collect())
    lang, step, n, toxic = np.array(got, float).reshape(-1, 4).T
    return _thresholds(lang, (step + 0.5) / STEPS, toxic, n)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = 3, out: int = 1) -> dict:
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, column, modulus, out)
    learns = ~F.col("valid")
    counts = rows.agg(F.count(F.lit(1)), F.sum("label"), F.count_if(learns), F.sum(F.when(learns, F.col("label"))), F.sum(F.length("w")))
    n, toxic, fitted, fitted_toxic, size = (x or 0 for x in counts.head())
    if toxic in (0, n):
        return _constant(n, toxic)
    if n <= WORKER_ROWS and size <= HELD_BYTES:
        return _fit_small(rows)
    model = new_network()
    state, weights = new_state(model), class_weights(fitted, fitted_toxic)
    learned = rows.filter(learns)
    for epoch in range(EPOCHS):
        model, state = _epoch(learned, model, state, weights, epoch)
    model["function"] = _function_table()
    model["threshold"] = _validate(rows.filter("valid"), model)
    return model


def score(docs: DataFrame, model: dict, modulus: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = predict(shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s)], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(modulus, out).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
