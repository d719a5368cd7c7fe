"""The Merkle manifest against a recursion in plain Python."""

import hashlib
import random
import zlib

import pytest
from meterframe.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g long, pos long, path string, _p int, other string"


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return _h(["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def _lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _tree(nodes):
    """The top of ``nodes`` and, for each, its siblings' (left, right) by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, i in zip(paths, at):
            a = i // 8 * 8
            path.append((level[a:i], level[i + 1 : a + 8]))
        level = [_h(level[a : a + 8]) for a in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def _plain(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, subroots = {}, []
    for lang in langs:
        members = [r for r in rows if r["lang"] == lang]
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"])))
        top, paths = _tree([_leaf(r, r["text"]) for r in members])
        trees[lang] = (members, top, paths)
        subroots.append(top)
    root, above = _tree(subroots) if subroots else (None, [])
    out = []
    for lang, up in zip(langs, above):
        members, top, paths = trees[lang]
        for r, path in zip(members, paths):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = _lower(text)
            node = _leaf(r, text)
            for left, right in path + up:
                node = _h([*left, node, *right])
            proof = _h([s for left, right in path + up for s in left + right])
            out.append((r["doc_id"], _leaf(r, r["text"]), top, root, proof, node, node == root))
    return out


def _key(row):
    return (row[0] is not None, *[str(v) for v in row])


def _query(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op13_merkle(spark, str(path)).collect()), key=_key)


def test_query_on_the_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [r.asDict() for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op13_merkle(spark, path).collect()), key=_key)
    assert got == sorted(_plain(rows), key=_key)
    assert {r[-1] for r in got} == {True, False}


def _rows(n, langs, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text = r.choice([None, "", "Some Text", "lower", "Été Z", "x" * 500])
        out.append({"doc_id": r.choice([None, *range(-5, n)]), "text": text, "lang": r.choice(langs), "source": r.choice([None, "", "a", "1:b"]), "n_chars": r.choice([None, 0, 7])})
    return out


def _frame(spark, rows):
    extra = dict.fromkeys(("leaf", "g", "pos", "path", "_p", "other"))
    return spark.createDataFrame([{**r, **extra} for r in rows], SCHEMA)


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (2, ["en"]), (8, [None]), (9, ["en"]), (65, ["en", None, ""]), (300, [f"l{i}" for i in range(40)]), (700, ["en", "en", "en", "é", "z"])])
def test_shapes(spark, tmp_path, n, langs):
    rows = _rows(n, langs, n)
    rows += rows[: n // 3]
    assert _query(spark, _frame(spark, rows).repartition(3), tmp_path) == sorted(_plain(rows), key=_key)


def test_more_leaves_than_a_block(spark, tmp_path):
    rows = _rows(merkle.SPAN * 2 + 77, ["en"] * 9 + ["fr"], 4)
    assert _query(spark, _frame(spark, rows).repartition(6), tmp_path) == sorted(_plain(rows), key=_key)


def test_empty_table(spark, tmp_path):
    assert _query(spark, _frame(spark, []), tmp_path) == []


def test_midstates_resume():
    nodes = [_h([str(i)]).encode() for i in range(100)]
    tree = merkle.Tree(nodes, merkle.levels_of(100))
    for i in (0, 7, 8, 63, 64, 99):
        assert tree.fold(i, nodes[i]) == tree.top
        changed = nodes[:i] + [b"0" * 64] + nodes[i + 1 :]
        assert tree.fold(i, b"0" * 64) == merkle.Tree(changed, merkle.levels_of(100)).top != tree.top
