"""N-gram Jaccard join by parity sketches: every pair of texts with Jaccard similarity 0.75 or more.

A text's set holds its distinct five-word shingles, hashed to 64 bits.  A *parity sketch* has one bit per
hash position; each element flips one bit.  Where two sets differ in d elements their sketches differ in
at most d bits, so the Hamming distance is a lower bound of the symmetric difference.

*Bands and parts.*  Sizes fall into bands.  For a pair of sizes b <= a with similarity t or more the
difference is at most (1 - t) / (1 + t) * (a + b) <= 2a (1 - t) / (1 + t) = d.  In a band the sketch is cut
into more than d parts of 2 ** ``PART_BITS`` bits; d differences touch at most d parts, so by the pigeonhole
principle any d + 1 parts of the larger set hold one on which both sketches agree.  The larger set
*probes* d + 1 parts of its choice; every set is *indexed* under all its parts, in its own band and in
the next where a partner may fall there.  Sets of at most ``SMALL`` elements have one part per element.

*Choice of parts.*  Any d + 1 parts are enough, so a probe takes first the parts that a sample of the
corpus does not show to be common, and among those the ones with most elements: shared lines and passages
then bring no candidates together.  The sample steers cost only, never the result.  A set with too few
parts that are not empty also probes empty ones, and empty parts are indexed for that reason.

*Verification without all pairs.*  Equal sets are one class from the start.  In a bucket (equal part of
equal band) each member is first verified against a few centres; verified links give components.  Only
pairs of a probe and a member that lie in different components afterwards are looked at in a second round.
Before any set is fetched, the Hamming distance of the whole sketches must leave room for the link.
A group of n near copies so costs about n verifications, and no link that joins components is missed.

Defined results: null, empty and word-less texts have an empty set and are linked with nothing; a text of
fewer than five words has its whole word sequence as its one shingle.  Rows repeated whole are copies.
Classes are numbered apart from ids, so rows that share an id, or have none, lose no link; a component's id
is the smallest id in it, null where no row of it has one.  An empty table gives an empty result.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import attach, free_names, mix, shingle_sets, slices, stored, text_buffers
from meterframe.llm.components import components

SHINGLE = 5
#: Similarity as a fraction of whole numbers: NUM / DEN.
NUM, DEN = 75, 100
#: Sizes of band k end at BAND_RATIO ** k.
BAND_RATIO = 16 / 9
SMALL = 128
SLACK = 1.15
#: log2 of the bits of a part: elements of different texts must not meet on one bit by chance.
PART_BITS = 32
#: Classes whose parts are sampled to find common ones, the share of them that makes a part common, and
#: the most such parts that are broadcast.
SAMPLE = 20_000
COMMON = 5
COMMON_PARTS = 100_000
#: Signatures that a reduce task is meant to hold.
TASK_SIGNATURES = 500_000
#: Members of a bucket that every other one is verified against in the first round; one up to FEW members.
CENTRES = 3
FEW = 8
#: Buckets above so many members are compared by sketches of FINE bits an element.
LARGE = 64
FINE = 4
#: Pairs of places, or words of sketches, that a task looks at together.
PAIRS_AT_ONCE = 1 << 21
#: Members of a bucket that one task holds in the second round.
CHUNK = 20_000
#: Bytes of a signature kept beside its shard; a clash costs a verification, never a link.
KEY_BYTES = 5

_K1, _K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_EMPTY = np.uint64(0xE7037ED1A0B428DB)


def band(n: int) -> int:
    """The band of a set of n elements: the smallest k with n <= BAND_RATIO ** k."""
    k = max(int(np.ceil(np.log(max(n, 1)) / np.log(BAND_RATIO) - 1e-9)), 0)
    return k


def band_top(k: int) -> int:
    return int(BAND_RATIO**k + 1e-9)


def most_different(a: int, b: int) -> int:
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


def parts_of(k: int) -> int:
    """Parts of the sketch in band k; 0 stands for one part per element."""
    top = band_top(k)
    return 0 if top <= SMALL else int(SLACK * (most_different(top, top) + 1)) + 1


def signatures(x: np.ndarray, k: int):
    """(key, elements) of every part of the sorted set ``x`` in band k, empty parts last with 0 elements."""
    salt = np.uint64((k + 1) * int(_K2) % 2**64)
    p = parts_of(k)
    if p == 0:
        return mix(x ^ salt), np.ones(len(x), np.int64)
    part = ((x >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    # A part is sparse, so it is kept as the sum (XOR) of a code for each of its bits that is set.
    sketch = np.bitwise_xor.reduceat(mix((x & np.uint64(2**PART_BITS - 1)) + _K2), start)
    used = part[start]
    free = np.ones(p, bool)
    free[used.astype(np.int64)] = False
    empty = np.flatnonzero(free).astype(np.uint64)
    key = np.concatenate([mix(sketch ^ (used * _K1 + salt)), mix(_EMPTY ^ (empty * _K1 + salt))])
    return key, np.concatenate([np.diff(np.append(start, len(x))), np.zeros(len(empty), np.int64)])


def indexed(x: np.ndarray, common: np.ndarray):
    """(key, probes) of a set: its parts in its own band, with those it probes marked, and in the next."""
    n = len(x)
    k = band(n)
    key, size = signatures(x, k)
    need = most_different(n, n) + 1
    known = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key if len(common) else np.zeros(len(key), bool)
    # Empty parts last, common parts before them, then by fewer elements; ties by key.
    order = np.lexsort((key, -size, known, size == 0))
    probe = np.zeros(len(key), bool)
    probe[order[:need]] = True
    # Partners may be as large as n * DEN / NUM.
    top = n * DEN // NUM
    keys, probes = [key], [probe]
    for j in range(k + 1, band(top) + 1):
        more, _ = signatures(x, j)
        keys.append(more)
        probes.append(np.zeros(len(more), bool))
    return np.concatenate(keys), np.concatenate(probes)


def sketch(x: np.ndarray, scale: int = 1) -> bytes:
    """The parity sketch of a whole set, of at least ``scale`` bits an element (a power of two)."""
    bits = max(64, 1 << int(scale * len(x) - 1).bit_length())
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(raw: np.ndarray, size: int) -> np.ndarray:
    """A sketch of ``size`` 64-bit words from a longer one: positions that fall together add their parities."""
    return np.bitwise_xor.reduce(raw.reshape(-1, size), axis=0)


def near_pairs(words: list, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the pairs (i[k], j[k]) of sketches ``words`` of sets of ``n`` elements, those whose Hamming
    distance leaves room for a link; each pair is compared at the shorter sketch's length."""
    length = np.array([len(w) for w in words], np.int64)
    short = np.minimum(length[i], length[j]) if len(i) else np.zeros(0, np.int64)
    ok = np.zeros(len(i), bool)
    for size in np.unique(short):
        at = np.flatnonzero(short == size)
        seen = np.zeros(len(words), bool)
        seen[i[at]] = seen[j[at]] = True
        place = np.cumsum(seen) - 1
        table = np.stack([folded(words[x], size) for x in np.flatnonzero(seen)])
        a, b = place[i[at]], place[j[at]]
        step = max(1, PAIRS_AT_ONCE // size)
        for lo in range(0, len(at), step):
            gap = np.bitwise_count(table[a[lo : lo + step]] ^ table[b[lo : lo + step]]).sum(1, dtype=np.int64)
            k = at[lo : lo + step]
            ok[k] = gap <= (DEN - NUM) * (n[i[k]] + n[j[k]]) // (DEN + NUM)
    return ok


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def class_id(d: bytes) -> int:
    """62 bits of a digest: names a class in the candidate search (a clash costs a verification)."""
    return int.from_bytes(d[:8], "little") >> 2


def _sets(col):
    raw, off = text_buffers(col)
    for i, j in slices(off):
        yield i, j, shingle_sets(raw, off[i : j + 1], SHINGLE)


def _digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, and digest, class id and two sketches of the set (null for empty sets) of every row."""

    def run(batches):
        for b in batches:
            d, n, s, fine = [], [], [], []
            for _, _, sets in _sets(b.column("text")):
                n += [len(x) for x in sets]
                d += [digest(x) if len(x) else None for x in sets]
                s += [sketch(x) if len(x) else None for x in sets]
                fine += [sketch(x, FINE) if len(x) else None for x in sets]
            short = pa.array([None if x is None else class_id(x) for x in d], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(d, pa.binary()), short, pa.array(s, pa.binary()), pa.array(fine, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "digest", "id", "sketch", "fine"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, id long, sketch binary, fine binary")


def _common_parts(docs: DataFrame, classes: int) -> np.ndarray:
    """Keys of parts that many classes of the sample share, at most COMMON_PARTS of them, most shared first."""
    share = min(1.0, SAMPLE / max(classes, 1))

    def run(batches):
        for b in batches:
            found, seen = [], set()
            for _, _, sets in _sets(b.column("text")):
                for x in sets:
                    if len(x) and (d := digest(x)) not in seen and int.from_bytes(d[8:], "little") < share * 2**64:
                        seen.add(d)
                        found.append(np.unique(signatures(x, band(len(x)))[0]))
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    counted = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(COMMON_PARTS).collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def _buckets(docs: DataFrame, shards: int, common: np.ndarray) -> DataFrame:
    """(bucket, id, probe) of every bucket with a probe and another class; ids are class ids."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def spread(batches):
        keys, ids, seen, held = [], [], set(), 0

        def flush():
            key, who = np.concatenate(keys), np.concatenate(ids)
            shard = ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            key, who = key[order], who[order]
            live = [s for s in range(shards) if cut[s + 1] > cut[s]]
            # Low key bits suffice beside the shard: a clash costs a verification.
            pack = lambda a, s, width: np.ascontiguousarray(a[cut[s] : cut[s + 1]].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array(live, pa.int32()), pa.array([pack(key, s, KEY_BYTES) for s in live], pa.binary()), pa.array([pack(who, s, 8) for s in live], pa.binary())],
                names=["shard", "keys", "ids"],
            )

        for b in batches:
            for _, _, sets in _sets(b.column("text")):
                for x in sets:
                    if not len(x) or (d := digest(x)) in seen:
                        continue
                    seen.add(d)
                    key, probe = indexed(x, shared.value)
                    keys.append(key)
                    ids.append(np.uint64(class_id(d) << 1) | probe.astype(np.uint64))
                    held += len(key)
                    if held > 1_000_000:
                        yield flush()
                        keys, ids, held = [], [], 0
        if held:
            yield flush()

    def meet(batches):
        keys, ids = [], []
        for b in batches:
            for shard, k, i in zip(*(b.column(c) for c in ("shard", "keys", "ids"))):
                raw = np.frombuffer(k.as_py(), np.uint8).reshape(-1, KEY_BYTES)
                full = np.zeros((len(raw), 8), np.uint8)
                full[:, :KEY_BYTES] = raw
                keys.append(full.view(np.uint64)[:, 0] ^ (np.uint64(shard.as_py()) << np.uint64(8 * KEY_BYTES)))
                ids.append(np.frombuffer(i.as_py(), np.uint64))
        if not keys:
            return
        key, who = np.concatenate(keys), np.concatenate(ids)
        keys = ids = None
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        # Near copies meet in many buckets with the same members: one of those is enough.
        at = start[size == 2]
        two = np.sort(np.stack([who[at], who[at + 1]], 1), axis=1)
        ok = ((two & np.uint64(1)).any(1)) & ((two[:, 0] >> np.uint64(1)) != (two[:, 1] >> np.uint64(1)))
        two, one = np.unique(two[ok], axis=0, return_index=True)
        if len(two):
            yield rows(np.repeat(key[at[ok][one]], 2), two.ravel())
        out, seen, held = [], set(), 0
        for s, n in zip(start[size > 2], size[size > 2]):
            members = np.unique(who[s : s + n])
            cls = members >> np.uint64(1)
            if not (members & np.uint64(1)).any() or cls[0] == cls[-1]:
                continue
            mark = hashlib.blake2b(members.tobytes(), digest_size=12).digest()
            if mark not in seen:
                seen.add(mark)
                out.append((np.full(len(members), key[s]), members))
                held += len(members)
            if held > 200_000:
                yield rows(*map(np.concatenate, zip(*out)))
                out, held = [], 0
        if out:
            yield rows(*map(np.concatenate, zip(*out)))

    def rows(bucket, who):
        return pa.RecordBatch.from_arrays(
            [pa.array((bucket & np.uint64(2**63 - 1)).astype(np.int64)), pa.array((who >> np.uint64(1)).astype(np.int64)), pa.array((who & np.uint64(1)).astype(bool))],
            names=["bucket", "id", "probe"],
        )

    packed = docs.select("text").mapInArrow(spread, "shard int, keys binary, ids binary")
    return packed.repartition(shards, "shard").mapInArrow(meet, "bucket long, id long, probe boolean")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes whose sets (rep, members) are similar enough."""
    a = sets.select(F.col("rep").alias("u"), F.col("members").alias("x"))
    b = sets.select(F.col("rep").alias("v"), F.col("members").alias("y"))

    def run(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column("x"), t.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(DEN * shared >= NUM * (len(both) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("u").filter(keep), t.column("v").filter(keep)], names=["u", "v"])

    return pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, and digest and sorted shingle hashes of the set, of each row that has one."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            for i, j, sets in _sets(b.column("text")):
                made = [digest(x) if len(x) else None for x in sets]
                arrays = [ids.slice(i, j - i), pa.array(made, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "digest", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, members binary")


def _alike(p: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity, the smaller id second, each once."""
    p = p.filter((F.col("nu") * DEN >= F.col("nv") * NUM) & (F.col("nv") * DEN >= F.col("nu") * NUM) & (F.col("u") != F.col("v")))
    return p.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _sketches_near(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (u, v) that the Hamming bound of their sketches leaves."""
    side = lambda c: named.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def run(batches):
        for t in batches:
            words = [np.frombuffer(x.as_py(), np.uint64) for c in ("su", "sv") for x in t.column(c)]
            n = np.concatenate([t.column("nu").to_numpy(), t.column("nv").to_numpy()])
            k = np.arange(t.num_rows)
            keep = pa.array(near_pairs(words, n, k, k + t.num_rows))
            yield pa.RecordBatch.from_arrays([t.column("u").filter(keep), t.column("v").filter(keep)], names=["u", "v"])

    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(run, "u long, v long")


def _across(label: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs (u, v) of a probe and a member of one bucket that lie in different components and that the
    Hamming bound leaves.  ``label`` has bucket, rep, n, probe, comp and k, the members of the bucket.

    Buckets of more than CHUNK members are dealt as a grid of cells, so no task holds one whole.
    """
    m = F.ceil(F.col("k") / CHUNK).cast("int")
    c = F.pmod(F.xxhash64("rep"), F.col("m")).cast("int")
    row = lambda i: F.struct((F.col("c") * F.col("m") + i).alias("cell"), F.col("probe").alias("probe"), (i == F.col("c")).alias("member"))
    column = lambda i: F.struct((i * F.col("m") + F.col("c")).alias("cell"), F.lit(False).alias("probe"), F.lit(True).alias("member"))
    every = F.sequence(F.lit(0), F.col("m") - 1)
    cells = F.concat(F.transform(every, row), F.filter(F.transform(every, column), lambda x: x["cell"] != F.col("c") * F.col("m") + F.col("c")))
    rows = label.withColumn("m", m).withColumn("c", c).withColumn("x", F.explode(cells)).filter("x.probe or x.member")
    # Large buckets get sketches of more bits, so that few pairs pass that are not links.
    wide = F.col("k") > LARGE
    small = rows.filter(~wide).join(named.select("rep", "sketch"), "rep")
    large = rows.filter(wide).join(named.select("rep", F.col("fine").alias("sketch")), "rep")
    rows = small.unionByName(large).select("bucket", "x.cell", "rep", "n", "comp", "x.probe", "x.member", "sketch")
    parts = int(label.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(t):
        """Pairs of the whole buckets in a table sorted by bucket and cell."""
        col = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "cell", "rep", "n", "comp", "probe", "member")}
        words = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("sketch")]
        start = np.flatnonzero(np.concatenate([[True], (col["bucket"][1:] != col["bucket"][:-1]) | (col["cell"][1:] != col["cell"][:-1])]))
        size = np.diff(np.append(start, t.num_rows))
        out = []

        def keep(u, v):
            """Note which of the pairs of rows of a bucket may be links."""
            n, m = col["n"][u], col["n"][v]
            ok = (col["probe"][u] & col["member"][v]) | (col["probe"][v] & col["member"][u])
            ok &= (col["comp"][u] != col["comp"][v]) & (np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM)
            u, v = u[ok], v[ok]
            u, v = u[near := near_pairs(words, col["n"], u, v)], v[near]
            out.append(np.stack([np.maximum(col["rep"][u], col["rep"][v]), np.minimum(col["rep"][u], col["rep"][v])], 1))

        # Small buckets of one size at a time: all their pairs of places at once.
        for k in np.unique(size[size <= LARGE]):
            at = start[size == k]
            x, y = np.triu_indices(k, 1)
            step = max(1, PAIRS_AT_ONCE // (k * k))
            for lo in range(0, len(at), step):
                rows = at[lo : lo + step, None] + np.arange(k)
                keep(rows[:, x].ravel(), rows[:, y].ravel())
        # Large ones: pairs with a row outside the largest component.
        for s, k in zip(start[size > LARGE], size[size > LARGE]):
            labels, code, count = np.unique(col["comp"][s : s + k], return_inverse=True, return_counts=True)
            apart = s + np.flatnonzero(code != count.argmax())
            step = max(1, PAIRS_AT_ONCE // k)
            for lo in range(0, len(apart), step):
                part = apart[lo : lo + step]
                keep(np.repeat(part, k), np.tile(np.arange(s, s + k), len(part)))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            # The last bucket may go on in the next batch.
            same = pa.compute.and_(pa.compute.equal(t.column("bucket"), t.column("bucket")[-1]), pa.compute.equal(t.column("cell"), t.column("cell")[-1]))
            whole = t.num_rows - pa.compute.sum(same).as_py()
            if whole:
                yield compare(t.slice(0, whole).combine_chunks())
            held = t.slice(whole)
        if held is not None and held.num_rows:
            yield compare(held.combine_chunks())

    dealt = rows.repartition(parts, "bucket", "cell").sortWithinPartitions("bucket", "cell")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs that are links, by the whole sets of their classes.

    A class's set comes from a row with its smallest id and its digest: other rows may share the id."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct()
    wanted = stored(wanted.join(classes.select("rep", F.col("first").alias("wid"), F.col("digest").alias("wd")), "rep"), f"{name}-wanted")
    picked = docs.join(wanted.select("wid").distinct(), F.col("doc_id").eqNullSafe(F.col("wid")), "left_semi")
    sets = _set_rows(picked).join(wanted, (F.col("digest") == F.col("wd")) & F.col("doc_id").eqNullSafe(F.col("wid")))
    sets = stored(sets.select("rep", "members").dropDuplicates(["rep"]), f"{name}-sets")
    return stored(_verify(pairs, sets), f"{name}-links")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set), component_id of every row, and what tells
    its row and component apart where ids are missing or repeat: text_hash, and component (null for empty sets)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    rows = stored(_digests(docs), "shingle-digests")
    classes = rows.filter("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"), F.max("id").alias("id"), F.max("sketch").alias("sketch"), F.max("fine").alias("fine")
    )
    # Classes are numbered once, in what is stored: ids of documents may be null, or shared by several classes.
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "shingle-classes")
    total = classes.agg(F.sum("copies").alias("t"), F.sum("n").alias("s"), F.count(F.lit(1)).alias("c")).first()
    shards = max(-(-(total["s"] or 0) // TASK_SIGNATURES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    common = _common_parts(docs, total["c"] or 0)
    met = stored(_buckets(docs, shards, common), "buckets")
    named = classes.select("id", "rep", "n", "sketch", "fine")
    members = stored(met.join(named.drop("sketch", "fine"), "id").select("bucket", "rep", "n", "probe"), "bucket-members")
    # Round 1: every member against the centres of its bucket.
    orders = [F.col("rep"), *[F.xxhash64("rep", F.lit(k)) for k in range(1, CENTRES)]]
    best = [F.min_by(F.struct("rep", "n"), o) for o in orders]
    # Small buckets need one centre: their other pairs are few.
    centres = F.when(F.count(F.lit(1)) > FEW, F.array_distinct(F.array(*best))).otherwise(F.array(best[0]))
    first = members.groupBy("bucket").agg(centres.alias("f"))
    star = members.join(first, "bucket").withColumn("c", F.explode("f"))
    star = star.select(F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("c.rep").alias("v"), F.col("c.n").alias("nv"))
    star = stored(_sketches_near(_alike(star), named), "star-pairs")
    links = _verified(docs, classes, star, "star")
    comp = components(links)
    # Round 2: a probe against the members that are still in other components.
    label = members.join(comp, members["rep"] == comp["node"], "left").select("bucket", "rep", "n", "probe", F.coalesce("component", "rep").alias("comp"))
    span = label.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k"))
    label = label.join(span.filter("lo < hi and k > 2").select("bucket", "k"), "bucket")
    rest = stored(_across(label, named).join(star, ["u", "v"], "left_anti"), "rest-pairs")
    comp = components(links.unionByName(_verified(docs, classes, rest, "rest")))
    known = classes.join(comp, classes["rep"] == comp["node"], "left").select("digest", "copies", "first", F.coalesce("component", "rep").alias("component"))
    known = stored(known, "class-components")
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    known = attach(known, smallest, "component", "classes", total["c"] or 0)
    final = known.select("digest", "copies", F.col("first").alias("class_id"), "component", "component_id")
    out = attach(rows, final, "digest", "copies", total["t"] or 0)
    alone = F.col("digest").isNull()
    return out.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component", "text_hash",
    )


def keep_one(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one text of each component, the one with the smallest id (rows
    without an id last, then by a hash of the text); all columns unchanged."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    stay = linked.filter("component is not null").groupBy("component").agg(F.min(order).alias("stay"), F.count(F.lit(1)).alias("members"))
    stay = stored(stay.filter("members > 1"), "near-groups")
    rows = attach(linked, stay, "component", "members", linked.count())
    gone = rows.filter(F.col("stay").isNotNull() & (order != F.col("stay"))).select("doc_id", "text_hash").distinct()
    mine, (i, h) = docs.columns, free_names(docs, 2)
    gone = gone.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    return docs.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in mine])
