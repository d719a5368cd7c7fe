"""Every operator and pipeline stage on awkward tables: nulls, empty and long texts, ties, repeated rows,
no rows at all, and extra columns whose names clash with the operators' own."""

import random
import uuid

import pytest
from meterframe.llm import decontaminate, exact_dedup, jaccard_join, language_id, mixing, quality, substring_dedup, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, leaks string, key string, size string, rep long, k1 string"
EXTRA = (0.5, "d", "l", "k", "s", 1, "k1")


def _words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = _words(1, 20000)
ITEM = _words(2, 30)
ROWS = [
    (1, "Some short text.", "en", "a"),
    (2, "SOME SHORT TEXT.", "en", "b"),
    (3, None, None, None),
    (4, "", "en", ""),
    (5, " \t\n", None, "a"),
    (6, LONG, "en", "a"),
    (7, LONG + " tail", "en", "a"),
    (7, LONG + " tail", "en", "a"),
    (None, "no id here", "fr", "b"),
    (8, "x" * 50000, "fr", "b"),
    (9, "12345 !!! 67", "fr", None),
    (10, " ".join(LONG.split()[160:100:-1]) + " " + ITEM + " " + " ".join(LONG.split()[960:900:-1]), "en", "b"),
    (11, "Éa ñu\u00a0ça \u2003 ß", "fr", "b"),
    (12, "word", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, l, s, len(t or ""), *EXTRA) for i, t, l, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (1, ITEM), (5, _words(9, 40))], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (6, None, None), (12, 0, 1), (8, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")


def _index(spark):
    return exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)


def test_exact_dedup(spark, docs, empty):
    index = _index(spark)
    got = {}
    for r in index.ingest(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    assert [got[i][0]["keep_id"] for i in (1, 2)] == [2, 2] and not got[1][0]["kept"] and got[2][0]["kept"]
    assert got[3][0]["keep_id"] == 4 and got[4][0]["group_size"] == 2  # null text is empty text
    assert sorted(r["kept"] for r in got[7]) == [False, True]
    assert got[None][0]["kept"] and got[None][0]["keep_id"] is None
    # The same batch again decides the same; a later copy of a known text goes.
    again = {(r["doc_id"], r["kept"]) for r in index.ingest(docs).collect()}
    assert again == {(r["doc_id"], r["kept"]) for rs in got.values() for r in rs}
    later = index.ingest(spark.createDataFrame([(50, "some short TEXT."), (51, "new")], "doc_id long, text string"))
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in later.collect()} == {(50, 2, False), (51, 51, True)}
    assert spark.table(index.table).groupBy("digest").count().filter("count > 1").count() == 0
    kept = exact_dedup.keep_first(docs, _index(spark).ingest(docs))
    assert kept.columns == docs.columns and kept.count() == 11
    assert _index(spark).ingest(empty).count() == 0


def test_quality_and_toxicity(spark, docs, empty, labels):
    for op, column in ((quality, "quality"), (toxicity, "toxic")):
        model = op.train(docs, labels)
        got = op.score(docs, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got), column
        same = [r["score"] for r in got if r["doc_id"] == 7]
        assert same[0] == same[1]
        assert op.score(empty, model).count() == 0
        none = op.train(empty, labels)
        assert op.score(docs, none).count() == len(ROWS)


def test_mixing(spark, docs, empty):
    plan = mixing.plan(docs)
    got = plan.collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert set(by) == {"a", "b", "", None}
    total = sum(r["size"] for r in got)
    for rows in by.values():
        assert sum(r["taken"] for r in rows) == int(rows[0]["target"]) <= 2 * rows[0]["source_size"]
    assert abs(sum(rows[0]["target"] for rows in by.values()) - 1.5 * total) < 1e-6 * total
    trained = mixing.curriculum(plan).collect()
    assert [r["position"] for r in trained] == sorted(r["position"] for r in trained) and all(0 <= r["position"] < 1 for r in trained)
    assert sum(r["words"] for r in trained) == sum(r["taken"] for r in got)
    assert mixing.plan(empty).count() == 0
    assert [r["target"] for r in mixing.plan(docs.filter("doc_id in (3, 4)")).collect()] == [0.0, 0.0]


def test_decontaminate(spark, docs, empty, benchmark):
    got = decontaminate.leaks(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(10, 1)} and len(got) == 2  # the item is there twice
    assert got[0]["score"] == 1.0 and got[0]["end"] - got[0]["begin"] == 30
    marked = decontaminate.scan(docs, benchmark)
    assert marked.count() == len(ROWS) and marked.columns.count("leaks") == 1
    assert decontaminate.leaks(empty, benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_token_counts(spark, docs, empty):
    hist = token_counts.length_histogram(docs)
    out = {r["n_tokens"]: r for r in token_counts.limits(hist).collect()}
    assert sum(r["n_docs"] for r in out.values()) == len(ROWS) and out[0]["n_docs"] == 2
    assert token_counts.length_histogram(empty).count() == 0 and token_counts.limits(token_counts.length_histogram(empty)).count() == 0


def test_substring_dedup(spark, docs, empty):
    got = {}
    for r in substring_dedup.remove_repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[6][0]["n_removed"] == 20000 and [r["n_removed"] for r in got[7]] == [20001, 20001]
    assert got[3][0]["kept"] == got[4][0]["kept"] == got[5][0]["kept"] == ""
    assert got[8][0]["n_words"] == 1 and got[1][0]["kept"] == "Some short text."
    # A no-break space and an em space do not separate words.
    assert got[11][0]["n_words"] == 4
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_language(spark, docs, empty):
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert {got[i]["lang_pred"] for i in (3, 4, 5, 9)} == {"und"}
    assert all(got[i]["lang_pred"] in ("en", "fr") for i in (1, 6, 8, 10, None))
    assert got[1].asDict()["digest"] == "d" and len(got[1]) == len(SCHEMA.split(",")) + 2
    assert language_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, dictionaries=[]).collect()} == {"und"}


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/x"), (4, "http://"), (5, "http://A.Example.ORG?x"), (6, "https://example.org/es/1?x#y"), (7, "http://notexample.org/es/"), (8, "x://q.com/fr/"), (9, "x://com/de/#"), (9, "x://com/de/#"), (10, "http://example.org/en/12")]
    pages = spark.createDataFrame([(i, u, "h", "r", 1.0) for i, u in rows], "page_id long, url string, host string, rule string, features double")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[1][:3] == got[2][:3] == got[3][:3] == got[4][:3] == ("", "", None)
    assert got[5][:3] == ("a.example.org", "", None)
    assert got[6] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[7] == ("notexample.org", "/es/", "org/", "allow")
    assert got[8] == ("q.com", "/fr/", "com/fr/", "allow") and got[9] == ("com", "/de/", "com/de/", "block")
    assert got[10][2:] == ("example.org/en/1", "block")
    assert url_filter.judge(pages).count() == len(rows)
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.filter("page_id <= 4")).collect()} == {"allow"}


def test_jaccard_join(spark, docs, empty):
    got = {}
    for r in jaccard_join.link(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[3][0]["n_shingles"] == got[5][0]["n_shingles"] == 0 and got[5][0]["component_id"] == 5
    assert got[1][0]["component_id"] == got[2][0]["component_id"] == 1
    assert got[6][0]["component_id"] == 6 and [r["component_id"] for r in got[7]] == [6, 6]
    assert got[None][0]["component_id"] is None
    assert got[12][0]["n_shingles"] == 1 and got[6][0]["n_shingles"] == 19996
    assert jaccard_join.link(empty).count() == 0


def test_pipeline_stages(spark, docs, empty, benchmark, tmp_path):
    import corpus_pipeline as C

    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    judged = {r["doc_id"]: r["accepted"] for r in language_id.identify(docs).collect()}
    # One letter 50,000 times over is its own dictionary: nothing tells the languages apart.
    assert {i for i, ok in judged.items() if not ok} == {3, 4, 5, 8, 9}
    sizes = []
    for table in (docs, empty):
        d = table
        for name, stage in C.STAGES[:-1]:
            d = stage(spark, d, str(tmp_path))
            assert d.columns == docs.columns, name
            d = C.stored(d, "test")
            sizes.append(d.count())
        assert C.STAGES[-1][1](spark, d, str(tmp_path)).count() == d.count()
    # Rejected: 3, 4, 5, 8, 9; copies: 1 of 2, one of the rows 7; near copies: 7 of 6; the item: 10.
    assert sizes == [9, 7, 6, 5, 0, 0, 0, 0]
    assert {r["doc_id"] for r in d.collect()} == set()


CLASHES = "_id _dg _digest _gone _found _leaks _lid_accepted _lid_score _lid_lang_pred _free0 _FREE1 _free2 _free3 rep component text_hash first accepted".split()


def test_pipeline_stages_with_every_helper_name_as_a_column(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    r = random.Random(3)
    rows = [(d, _words(d, r.randint(30, 60)), "en", "a") for d in range(100, 130)] + [(200, ITEM, "en", "a"), (None, _words(7, 50), "en", None)]
    docs = spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES], name
        for row in docs.collect():
            assert all(row[c] == f"{c}-{row['doc_id'] if row['doc_id'] is not None else 'none'}" for c in CLASHES), (name, row)


def test_jaccard_links_through_shared_and_missing_ids(spark):
    base = _words(50, 60).split()
    near = lambda k: " ".join([*base[:k], f"x{k}", *base[k + 1 :]])
    a, other = " ".join(base), _words(51, 60)
    chain = [" ".join(_words(60, 80).split()[k : k + 70]) for k in (0, 5, 10)]
    for order in (1, -1):
        rows = [(1, other), (1, a), (2, near(30))][::order] + [(7, chain[0]), (None, chain[1]), (8, chain[2]), (9, _words(52, 50)), (None, _words(53, 40))]
        got = {(r["doc_id"], r["text_hash"]): r["component_id"] for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        by_id: dict = {}
        for (i, _), c in got.items():
            by_id.setdefault(i, []).append(c)
        assert by_id[1] == [1, 1] and by_id[2] == [1] and by_id[8] == [7] == by_id[7] and by_id[9] == [9]
        assert sorted(by_id[None], key=str) == [7, None]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        kept = sorted((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs, jaccard_join.link(docs)).collect() if r["doc_id"] is not None)
        # Of the row pair (1, a) and (2, near) one stays; (1, other) is no copy of anything.
        assert kept == sorted([(1, other), (1, a), (7, chain[0]), (9, _words(52, 50))])


def test_numbered_words_are_no_copies(spark):
    item = " ".join(f"w{k}" for k in range(1000, 1030))
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40))), (2, "so " + item), (3, " ".join(str(k) for k in range(50)))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, " ".join(str(7 * k) for k in range(20, 40)))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(2, 1)}


def test_classifiers_learn_one_row_of_an_id(spark):
    """An id that repeats in the documents sends one row to the fit, the same in any order."""
    from meterframe.llm import quality, toxicity

    rows = [(d, _words(d, 20 + d % 7)) for d in range(1, 41)]
    labels = spark.createDataFrame([(d, d % 2, d % 2) for d in range(1, 41)], "doc_id long, quality int, toxic int")
    copies = rows + [(3, _words(k, 9)) for k in range(200)]
    one = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    two = spark.createDataFrame(copies[::-1], "doc_id long, text string").coalesce(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (quality, toxicity):
        a, b = (sorted((r["doc_id"], r["score"]) for r in part.score(docs, part.train(x, labels)).collect()) for x in (one, two))
        assert a == b and len(a) == 40


def test_toxicity_learns_from_every_labelled_row_whole(spark, monkeypatch):
    """Every labelled row that is not held out is learned from or validated on, long texts to their ends, and
    so are those of several workers."""
    import zlib

    from meterframe.llm import toxicity

    # What tells the classes apart stands at the end of texts of more words than were once taken.
    long = "filler words " * 2100
    text = lambda d: (long if d % 50 == 0 else "") + _words(d, 12) + (" vile scum" if d % 2 else " kind folk")
    docs = spark.createDataFrame([(d, text(d)) for d in range(1, 601)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(d, d % 2) for d in range(1, 601)], "doc_id long, toxic int")
    mine = [d for d in range(1, 601) if zlib.crc32(str(d).encode()) % 3 != 1]
    monkeypatch.setattr(toxicity, "WORKER_ROWS", 120)
    rows = toxicity.training_rows(docs, labels, "toxic", 3, 1).collect()
    assert len(rows) == len(mine) and len({r["worker"] for r in rows}) == 4
    assert sum(len(r["w"]) > 4000 * 4 * (1 + len(toxicity.PREFIXES)) for r in rows) == sum(d % 50 == 0 for d in mine) > 0
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect() if r["held_out"]}
    assert sum(p == d % 2 for d, p in got.items()) > 0.9 * len(got)
