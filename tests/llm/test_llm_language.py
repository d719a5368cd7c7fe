"""Narrow margins: texts of no learned language go, held-out texts of the learned ones stay."""

import os
import random
import zlib

import numpy as np
import pytest

from meterframe.llm import language_id

SF = "/root/testdata/sf0.1"


def test_unlearned_language_and_gibberish_are_rejected(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) >= 250")
    judge = language_id.Compressors(language_id.train(docs.filter("lang <> 'de'"))).judge
    held_out = [r for r in docs.select("doc_id", "lang", "text").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    accepted = lambda texts: np.mean([judge(t)[2] for t in texts])
    assert accepted([r["text"] for r in held_out if r["lang"] != "de"][:400]) > 0.98
    assert accepted([r["text"] for r in held_out if r["lang"] == "de"][:200]) < 0.05
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    assert accepted([" ".join(word() for _ in range(r.randint(50, 400))) for _ in range(100)]) < 0.05


def test_dictionary_has_a_share_of_every_sampled_text_from_its_whole_length(spark):
    """Openings are the same in all texts; what tells them apart is at their middles and ends."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    texts = {d: "opening " * 100 + " ".join(word() for _ in range(400)) for d in range(700)}
    ((_, made),) = language_id.train(spark.createDataFrame([(d, t, "xx") for d, t in texts.items()], "doc_id long, text string, lang string"))
    assert 0.9 * language_id.DICT_BYTES < len(made) <= language_id.DICT_BYTES
    held = {x.decode() for x in made.split()}
    words = {d: t.split()[100:] for d, t in texts.items()}
    half = [[sum(any(w in held for w in part) for part in [words[d][a : a + 200]]) for d in words] for a in (0, 200)]
    # 400 texts are sampled at most, less those kept back.
    assert all(sum(x) > 250 for x in half)
    # Small and large ids alike.
    assert min(sum(half[1][:350]), sum(half[1][350:])) > 100


def _letters(n):
    return "".join("abcdefghij"[int(c)] for c in f"{n:06d}")


def test_every_labelled_text_is_learned_from_and_copies_change_nothing(spark):
    rows = [(d, f"common {_letters(d)} ending", "xx") for d in range(2000)] + [(d, f"gemein {_letters(d)} ende", "yy") for d in range(2000, 2300)]
    schema = "doc_id long, text string, lang string"
    made = language_id.train(spark.createDataFrame(rows, schema))
    assert [lang for lang, _ in made] == ["xx", "yy"]
    held = [set(content.decode().split()) for _, content in made]
    # Three quarters are not held out, and a fifth of those is kept back for the margins.
    assert 1050 < len(held[0]) < 1350 and 140 < len(held[1]) < 220
    # The words of most texts are the last.
    assert {made[0][1].split()[-1], made[0][1].split()[-2]} == {b"common", b"ending"}
    copies = [(10_000 + k, rows[0][1], "xx") for k in range(3000)] + rows[5:25] * 7
    again = language_id.train(spark.createDataFrame(rows + copies, schema))
    assert list(again) == list(made) and again.margins == made.margins


def test_words_are_those_of_most_texts_and_no_runs(spark):
    texts = [f"rare{_letters(d)} " * 50 + "often" * (d % 2) + " x" + "y" * 900 + " " + "ab" * 20 + " 日本語文章" for d in range(40)]
    df = spark.createDataFrame([("xx", t, 1) for t in texts], "lang string, text string, weight long")
    got = [r["word"] for r in language_id.common_words(df).orderBy("rank").collect()]
    assert "y" * 24 not in got and "ab" * 12 in got and {"日本語", "文章"} <= set(got)
    assert "often" in got[:10] and len([w for w in got if w.startswith("rare")]) == 40


def test_margins_are_of_every_text_kept_back(spark):
    r = random.Random(3)
    words = {lang: ["".join(r.choice(abc) for _ in range(r.randint(2, 8))) for _ in range(300)] for lang, abc in (("xx", "abcdefghi"), ("yy", "efghijklm"))}
    rows = [(d, " ".join(r.choice(words[lang]) for _ in range(r.choice((5, 20, 500)))), lang) for d, lang in enumerate(["xx", "yy"] * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = language_id.train(docs)
    back = [x for x in language_id.training_texts(docs)[0].collect() if x["back"]]
    assert all(sum(x["lang"] == lang for x in back) > 200 for lang in words)
    judge, gaps = language_id.Compressors(list(made)).measure, {}
    for x in back:
        text = x["text"]
        start = zlib.crc32(text.encode()) % max(len(text) - 2047, 1)
        for part in [text[start : start + n] for n in language_id.CUTS if n < len(text)] + [text]:
            best, gap, size = judge(part)
            if best == x["lang"]:
                gaps.setdefault((best, int(np.log2(size))), []).append(int(gap * language_id.STEPS))
    want = {k: sorted(v)[int(np.ceil(0.01 * len(v))) - 1] / language_id.STEPS / 2 for k, v in gaps.items() if len(v) >= language_id.OBSERVED}
    assert want == {(lang, p): least for lang, each in made.margins.items() for p, least in each.items()}
