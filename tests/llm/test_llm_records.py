"""Record files of token ids against the plain encoding, a bitwise checksum, and damaged files."""

import os
import random
import uuid
import zlib

import numpy as np
import pytest
from meterframe.llm import queries, token_records
from meterframe.session import scratch_path

SCHEMA = "doc_id long, text string, ids string, start long, _row long, _by long, file string"
ODD = [
    "", " ", "\n\t\x0b\x0c\r", "a", "A,B", "it's I'LL don't 'tis o'clock '' 's", "x y  z", "été, ÉTÉ!!", "€!! 5€.",
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>, <|x", "12345 3.14 1,000", "İstanbul ß ﬁ Å", "中文 日本。", "\U0001f600\U0001f3fd !",
    "a" * 5000, "..." * 300, "́ x", "word́, word", "ǅ ΣΣ ẞ", "²½ IV Ⅳ",
]


def _plain_crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def _mask(c: int) -> int:
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_records.vocabulary())


def _expected(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def _write(spark, docs):
    return token_records.write(docs, scratch_path(spark, f"records-{uuid.uuid4().hex}"))


def test_checksums_are_those_of_the_polynomial():
    assert _plain_crc32c(b"123456789") == 0xE3069283
    r = random.Random(3)
    parts = [bytes(r.randrange(256) for _ in range(n)) for n in [4, 5, 8, 255, 256, 257, 258, 259, 260, 511, 512, 513, 1000, 3000, 12]]
    ends = np.cumsum([len(p) for p in parts])
    got = token_records.masked_crc32c(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends)
    assert got.tolist() == [_mask(_plain_crc32c(p)) for p in parts]


def test_frame_is_the_common_one():
    raw, lengths = token_records.frame([b"abcdefghijkl", b"0123456789ab0"])
    assert lengths.tolist() == [28, 29]
    assert raw[:8] == (12).to_bytes(8, "little") and raw[12:24] == b"abcdefghijkl"
    assert raw[8:12] == _mask(_plain_crc32c(raw[:8])).to_bytes(4, "little")
    assert raw[24:28] == _mask(_plain_crc32c(b"abcdefghijkl")).to_bytes(4, "little")


def test_words_encode_as_the_whole_text(tokenizer):
    enc = token_records.WordEncoder(open(token_records.vocabulary(), "rb").read())
    r = random.Random(11)
    signs = ["a", "B", "the", "é", "é", "'", "'s", "'LL", ".", ",", "<|", "|>", "<|endoftext|>", "7", "€", "ß", "İ", " ", " ", " ", "\n", "中", "。", "́", "#"]
    texts = ODD + ["".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    for got, text in zip(enc.encode([t.encode() for t in texts]), texts):
        assert np.frombuffer(got, enc.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_full_memo_changes_nothing(monkeypatch, tokenizer):
    monkeypatch.setattr(token_records.WordEncoder, "ENTRIES", 5)
    enc = token_records.WordEncoder(open(token_records.vocabulary(), "rb").read())
    for text in ["one two three four", "five six, one", "ONE two."] * 2:
        assert np.frombuffer(enc.encode([text.encode()])[0], enc.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_query_against_plain_encoding(spark, sf_small, tokenizer):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op11_token_records(spark, sf_small).orderBy("start").collect()
    assert [tuple(r) for r in got] == _expected(tokenizer, docs)


def test_odd_texts_null_and_repeated_ids(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, None), (3, "other"), (3, "a"), (3, "a"), (-5, "negative")]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, "f") for r in rows], SCHEMA).repartition(5)
    got = [tuple(r)[:4] for r in token_records.read(_write(spark, docs)).orderBy("start").collect()]
    # Ids ascend, null first; rows that share an id come in some order.
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    texts: dict = {}
    for (_, _, n, crc), (i, t) in zip(_expected(tokenizer, rows), rows):
        texts.setdefault(i, []).append((n, crc))
    found: dict = {}
    start = 0
    for i, s, n, crc in got:
        assert s == start
        start += n
        found.setdefault(i, []).append((n, crc))
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(v) for i, v in texts.items()}
    again = [tuple(r)[:4] for r in token_records.read(_write(spark, docs.repartition(2))).orderBy("start").collect()]
    assert again == got


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert token_records.read(_write(spark, docs)).collect() == []


def test_shuffled_read_gives_the_same_records(spark, sf_small):
    index = _write(spark, spark.read.parquet(f"{sf_small}/documents.parquet").repartition(4))
    assert index.select("file").distinct().count() >= 1
    plain = [tuple(r) for r in token_records.read(index).collect()]
    drawn = [tuple(r) for r in token_records.read(index, seed=7).collect()]
    assert [r[1] for r in plain] == sorted(r[1] for r in plain)
    assert sorted(drawn) == sorted(plain) and [r[1] for r in drawn] != [r[1] for r in plain]
    assert drawn == [tuple(r) for r in token_records.read(index, seed=7).collect()]
    assert [r[1] for r in drawn] != [r[1] for r in token_records.read(index, seed=8).collect()]


@pytest.mark.parametrize("at", [3, 9, 20, -2])
def test_damage_is_found(spark, at):
    index = _write(spark, spark.createDataFrame([(1, "some text", *[None] * 5), (2, "more text", *[None] * 5)], SCHEMA).coalesce(1))
    path = index.head()["file"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[at] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="damaged"):
        token_records.read(index).collect()
    os.truncate(path, len(raw) - 4)
    with pytest.raises(Exception, match="damaged|cut"):
        token_records.read(index).collect()


def test_vocabulary_with_other_rules():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, plain = token_records.WordEncoder(open(path, "rb").read()), Tokenizer.from_file(path)
    for text in ("Two words,  and\nmore.", ""):
        assert np.frombuffer(enc.encode([text.encode()])[0], enc.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids
