"""Merkle manifest of a dataset: one hash for all of it, and for each document what proves it is part of it.

A leaf hashes a document's fields.  The leaves of a language stand by doc_id; every ``FAN`` consecutive nodes
become the hash of their hex digests, level by level, until one is left: the language's subroot.  The
subroots, by language, are hashed to the root in the same way.

A parent is built child by child, and keeps a copy of its SHA-256 state before each child's slot.  To fold a
changed leaf up to the root, the state before its slot is resumed with the new digest and the siblings to the
right only; what stands to the left is already in the state.

On Spark the leaves are numbered by a range partitioning and the counts of its partitions.  A task takes
``FAN ** LEVELS`` consecutive nodes of a language and builds up to ``LEVELS`` levels of the tree over them, so
each round leaves 1/4096 of the rows and no task sees a whole language.  On the way back each block gets its
path, the siblings above it, once for all its nodes; only the last round meets every document.

Defined results: a null field counts as ``-``, which no value does.  Null languages come first, apart from the
empty one; null ids come first.  Rows of one language and id are ordered by their leaf; equal ones are
interchangeable.  A table of one document has its leaf as the root, and no siblings: its proof is the hash of
nothing.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import ascii_lower, bounded_batches, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
#: Levels of the tree that one task builds over a block of consecutive nodes.
LEVELS = 4
SPAN = FAN**LEVELS


def _field(c: Column) -> Column:
    """A field as its UTF-8 length, a colon and its value; ``-`` for a null."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """Hex SHA-256 of a document's fields, with another ``text`` if given."""
    return F.sha2(F.concat(*[_field(text if text is not None and f == "text" else F.col(f)) for f in FIELDS]), 256)


# --- the tree over one block ----------------------------------------------------------------


def digest(parts: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Parent:
    """The hash of consecutive nodes, with its state before each of them."""

    def __init__(self, children: list[bytes]):
        self.children, self.before = children, []
        state = hashlib.sha256()
        for c in children:
            self.before.append(state.copy())
            state.update(c)
        self.digest = state.hexdigest().encode()

    def replaced(self, slot: int, node: bytes) -> bytes:
        """The parent's hash with ``node`` in a slot: its state there, the node, and what stands right of it."""
        state = self.before[slot].copy()
        state.update(node)
        for sibling in self.children[slot + 1 :]:
            state.update(sibling)
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> list[bytes]:
        return self.children[:slot] + self.children[slot + 1 :]


class Tree:
    """``levels`` levels over consecutive nodes, the first of which begins a run on every level."""

    def __init__(self, nodes: list[bytes], levels: int):
        self.levels = []
        for _ in range(levels):
            self.levels.append([Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
            nodes = [p.digest for p in self.levels[-1]]
        self.top = nodes[0]

    def path(self, i: int) -> list[tuple[int, list[bytes]]]:
        """Of each level above node i: its slot in the run, and the run."""
        out = []
        for parents in self.levels:
            i, slot = divmod(i, FAN)
            out.append((slot, parents[i].children))
        return out

    def siblings(self, i: int) -> bytes:
        out = []
        for parents in self.levels:
            i, slot = divmod(i, FAN)
            out += parents[i].siblings(slot)
        return b"".join(out)

    def fold(self, i: int, node: bytes) -> bytes:
        """The top with another node at i."""
        for parents in self.levels:
            i, slot = divmod(i, FAN)
            node = parents[i].replaced(slot, node)
        return node


class Path:
    """The runs above a block, each with its states, up to the root."""

    def __init__(self, text: str):
        runs = [r.split(":") for r in text.split(",")] if text else []
        self.runs = [(int(slot), Parent([run[k : k + 64].encode() for k in range(0, len(run), 64)])) for slot, run in runs]
        self.siblings = b"".join(b"".join(p.siblings(slot)) for slot, p in self.runs)

    def fold(self, node: bytes) -> bytes:
        for slot, parent in self.runs:
            node = parent.replaced(slot, node)
        return node


def _path_text(path: list[tuple[int, list[bytes]]], above: str) -> str:
    runs = [f"{slot}:{b''.join(run).decode()}" for slot, run in path]
    return ",".join([*runs, above] if above else runs)


def levels_of(n: int) -> int:
    """Levels above the leaves of a language with n of them."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


# --- numbering ------------------------------------------------------------------------------


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows``, stored, with ``g`` (the number of their group, by its value, null first) and ``pos`` (the row's
    place in its group, from 0); and the groups: g, the group's value, n.

    Rows are range-partitioned by group and order, so a large group spreads over many partitions; what is
    summed in order has one row per partition and group.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
    spread = stored(spread.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), name)
    parts = stored(spread.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first")), f"{name}-parts")
    groups = parts.groupBy(group).agg(F.sum("_n").alias("n"))
    groups = stored(groups.withColumn("g", F.row_number().over(Window.orderBy(F.col(group).asc_nulls_first())) - 1), f"{name}-groups")
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    parts = parts.join(groups.withColumnRenamed(group, "_v"), F.col(group).eqNullSafe(F.col("_v")))
    parts = parts.select(F.col("_p").alias("_pp"), "_v", "g", "n", "_base")
    same = (F.col("_p") == F.col("_pp")) & F.col(group).eqNullSafe(F.col("_v"))
    out = spread.join(parts, same).withColumn("pos", F.col("_i") + F.col("_base"))
    return out.drop("_p", "_pp", "_i", "_base", "_v"), groups


# --- rounds ---------------------------------------------------------------------------------


def _levels_left(n: int, done: int) -> int:
    return min(LEVELS, max(levels_of(n) - done, 0))


def _climb(nodes: DataFrame, done: int) -> DataFrame:
    """The nodes that stand ``LEVELS`` levels above ``nodes`` (g, n, pos, node); tops stay as they are."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("pos")
        n = t.column("n")[0].as_py()
        tree = Tree([x.encode() for x in t.column("node").to_pylist()], _levels_left(n, done))
        return pa.table({"g": t.column("g").slice(0, 1), "n": [n], "pos": [t.column("pos")[0].as_py() // SPAN], "node": [tree.top.decode()]})

    return nodes.groupBy("g", F.floor(F.col("pos") / SPAN)).applyInArrow(run, "g long, n long, pos long, node string")


def _descend(nodes: DataFrame, above: DataFrame, done: int) -> DataFrame:
    """g, pos, path of every node, from the paths of the blocks above them."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("pos")
        up, places = t.column("path")[0].as_py(), t.column("pos").to_pylist()[1:]
        tree = Tree([x.encode() for x in t.column("node").to_pylist()[1:]], _levels_left(t.column("n")[1].as_py(), done))
        g = t.column("g")[0].as_py()
        paths = [_path_text(tree.path(i), up) for i in range(len(places))]
        return pa.table({"g": [g] * len(places), "pos": places, "path": paths})

    rows = nodes.select("g", F.floor(F.col("pos") / SPAN).alias("block"), "pos", "n", "node", F.lit(None).cast("string").alias("path"))
    return _with_heads(rows, above).groupBy("g", "block").applyInArrow(run, "g long, pos long, path string")


def _with_heads(rows: DataFrame, above: DataFrame) -> DataFrame:
    """The rows of each block and, before them (pos -1), the path above it."""
    heads = above.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path")
    return rows.unionByName(heads, allowMissingColumns=True)


def _tops(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of nodes from ``nodes`` up, and the one node of each group (g, n, pos, node)."""
    most = nodes.agg(F.max("n")).head()[0] or 0
    rounds, done = [], 0
    while done < levels_of(most):
        rounds.append(nodes)
        nodes = stored(_climb(nodes, done), "merkle-nodes")
        done += LEVELS
    return rounds, nodes


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document of ``docs`` (FIELDS): doc_id, lang, position, leaf, subroot, root, proof_sha256 (the
    hash of its siblings, level by level up to the root), folded_root, verified.

    ``folded_root`` is folded from the document's leaf, or from ``tampered``, another leaf that some documents
    have (null for the others); ``verified`` tells whether it is the root.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf().alias("leaf"), (F.lit(None).cast("string") if tampered is None else tampered).alias("other"))
    # Stored first, as the range boundaries are drawn from it: every text is hashed once.
    leaves, groups = numbered(stored(rows, "merkle-hashes"), "lang", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "merkle-leaves")
    leaves = leaves.withColumn("g", F.col("g").cast("long"))
    # Up: the subroots of the languages, then the root over them.
    rounds, subroots = _tops(leaves.select("g", "n", "pos", F.col("leaf").alias("node")))
    n_groups = groups.count()
    over = subroots.select(F.lit(0).cast("long").alias("g"), F.lit(n_groups).cast("long").alias("n"), F.col("g").alias("pos"), "node")
    top_rounds, root = _tops(over)
    # Down: the path above every subroot, then above every block of leaves.
    paths = root.select("g", "pos", F.lit("").alias("path"))
    paths = _paths(top_rounds, paths, 0)
    paths = paths.select(F.col("pos").alias("g"), F.lit(0).cast("long").alias("pos"), "path")
    if rounds:
        paths = _paths(rounds, paths, 1)
    else:  # every language is a lone leaf
        rounds = [leaves]
    whole = root.head()
    heads = paths.join(subroots.select("g", F.col("node").alias("subroot")), "g").withColumn("root", F.lit(whole["node"] if whole else None).cast("string"))
    block = F.floor(F.col("pos") / SPAN).alias("block")
    body = leaves.select("g", block, "pos", "n", "doc_id", "lang", "leaf", "other")
    heads = heads.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "subroot", "root")
    schema = "doc_id long, lang string, position long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return body.unionByName(heads, allowMissingColumns=True).groupBy("g", "block").applyInArrow(_prove, schema)


def _paths(rounds: list[DataFrame], paths: DataFrame, lowest: int) -> DataFrame:
    """Paths above the nodes of round ``lowest``, from those above the tops."""
    for k in reversed(range(lowest, len(rounds))):
        paths = stored(_descend(rounds[k], paths, k * LEVELS), "merkle-paths")
    return paths


def _prove(table: pa.Table) -> pa.Table:
    """The proofs of a block of leaves, with the path above it as the first row."""
    t = table.sort_by("pos")
    up, subroot, root = Path(t.column("path")[0].as_py()), t.column("subroot")[0].as_py(), t.column("root")[0].as_py()
    t = t.slice(1)
    leaves, others = t.column("leaf").to_pylist(), t.column("other").to_pylist()
    tree = Tree([x.encode() for x in leaves], _levels_left(t.column("n")[0].as_py(), 0))
    proofs, folded = [], []
    for i, (own, other) in enumerate(zip(leaves, others)):
        proofs.append(digest((tree.siblings(i), up.siblings)).decode())
        folded.append(up.fold(tree.fold(i, (own if other is None else other).encode())).decode())
    n = t.num_rows
    return pa.table(
        {
            "doc_id": t.column("doc_id"), "lang": t.column("lang"), "position": t.column("pos"), "leaf": t.column("leaf"),
            "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        }
    )


def lowered_leaf() -> Column:
    """The leaf of a document whose text had A-Z lower-cased, for those whose id's checksum 3 divides."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.when(crc % 3 == 0, leaf(ascii_lower(F.col("text"))))
