"""Decontamination against aligning every document with every item."""

import random

import numpy as np
import pytest

from meterframe.llm import decontaminate


def exhaustive(docs, items):
    """{(doc_id, item_id): score} of the copies, by aligning all texts with all items."""
    code = {}
    seq = lambda t: np.array([code.setdefault(w, len(code)) for w in t.split()])
    out = {}
    for i, t in items:
        w = seq(t)
        for d, text in docs:
            s = decontaminate.align(w, seq(text))[0]
            if s >= min(0.5 * len(w), 20):
                out[d, i] = s / len(w)
    return out


def found(spark, docs, items):
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): r["score"] for r in got.collect()}


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_copy_of_a_part_of_an_item(spark):
    r = random.Random(1)
    item = words(r, 60)
    docs = [(0, " ".join(words(r, 40) + item[:25] + words(r, 40)))] + [(d, " ".join(words(r, 80))) for d in range(1, 9)]
    assert found(spark, docs, [(5, " ".join(item))]) == {(0, 5): 25 / 60}


def test_excerpt_that_many_documents_quote(spark):
    """The quoted words are the frequent ones of the item; nothing else of it occurs often."""
    r = random.Random(2)
    item = words(r, 60)
    docs = [(d, " ".join(words(r, 20) + item[10:34] + words(r, 20))) for d in range(200)]
    docs += [(200 + d, " ".join(words(r, 20) + item[k : k + 3] + words(r, 20))) for d, k in enumerate(range(0, 60, 3))]
    assert set(found(spark, docs, [(5, " ".join(item))])) == {(d, 5) for d in range(200)}


def test_copy_without_two_words_in_a_row(spark):
    r = random.Random(3)
    item = words(r, 30)
    spread = [x for w in item for x in (w, *words(r, 1))]
    docs = [(0, " ".join(words(r, 15) + spread + words(r, 15))), (1, " ".join(words(r, 60)))]
    assert set(found(spark, docs, [(5, " ".join(item))])) == {(0, 5)}


@pytest.mark.parametrize("vocabulary", [12, 60, 1000])
def test_against_exhaustive_alignment(spark, vocabulary):
    """Partial and edited copies, each in many documents, among texts that share words by chance."""
    r = random.Random(vocabulary)
    vocab = words(r, vocabulary)
    pick = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, pick(r.choice([8, 9, 15, 30, 41, 60, 90]))) for i in range(12)]
    docs = []
    for d in range(150):
        _, w = items[d % 12 if d % 3 else 0]
        n = r.randint(len(w) // 3, len(w))
        a = r.randint(0, len(w) - n)
        error, copy = r.choice([0, 0.1, 0.3, 0.5]), []
        for x in w[a : a + n]:
            y = r.random()
            copy += [] if y < error / 3 else pick(1) if y < 2 * error / 3 else [x, *pick(1)] if y < error else [x]
        docs.append((d, " ".join(pick(r.randint(0, 60)) + copy + pick(r.randint(0, 60)))))
    items = [(i, " ".join(w)) for i, w in items]
    want = exhaustive(docs, items)
    assert len(want) > 30 and found(spark, docs, items) == pytest.approx(want)


def test_short_items_match_whole(spark):
    """Items of four to seven words match word for word only; shorter ones match nothing."""
    items = [(1, "What is 17 + 25?"), (2, "name the capital of lower saxony"), (3, "yes or no")]
    docs = [
        (0, "so what is 17, 25 then"), (1, "what is 17 26"), (2, "Name the capital of Lower Saxony!"), (3, "name the capital of upper saxony"),
        (4, "yes or no"), (5, "what is 17"), (6, "25 what is 17"),
    ]
    assert found(spark, docs, items) == {(0, 1): 1.0, (2, 2): 1.0}


def test_scripts_without_spaces(spark):
    """Every character is a word; two count as one for the least and the sufficient length."""
    item = "请写出三角形面积的计算公式并说明每个符号的意思"
    docs = [
        (0, "题目：" + item + "。以下是答案"), (1, "今天天气很好，我们去公园散步。"), (2, "请写出三角形面积的计算公式，谢谢"),
        (3, "三角形"), (4, "Plain English words with “quotes” and numbers 12"),
    ]
    got = found(spark, docs, [(7, item), (8, "三角形面积的计"), (9, "สวัสดีครับผมชื่อ")])
    assert got == {(0, 7): 1.0, (2, 7): 13 / 23}


def test_a_batch_does_not_change_its_neighbours():
    """Texts hash alike with and without a text of another script beside them."""
    import pyarrow as pa

    texts = ["a “quoted” word — and a dash", "naïve café", None, ""]
    alone = [h.tolist() for _, _, h, _ in decontaminate._word_hashes(pa.array(texts))][0]
    beside = [h.tolist() for _, _, h, _ in decontaminate._word_hashes(pa.array([*texts, "三角形"]))][0]
    assert beside[: len(alone)] == alone and len(beside) == len(alone) + 3
