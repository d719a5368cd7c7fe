"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

Framing, the same as that of the common record files of training pipelines (all numbers little-endian):

    length of the payload   8 bytes
    masked CRC-32C of it    4 bytes
    payload                 length bytes
    masked CRC-32C of it    4 bytes

A payload is ``flags`` (4 bytes: 1 = the document has an id, 2 = ids take two bytes), ``doc_id`` (8 bytes)
and the token ids, the end id last.  Ids take two bytes where the vocabulary has at most 65,536 entries.

Documents are range-partitioned and sorted by id, so file 0 holds the smallest ids.  Each task writes one
file of its own name and returns its index rows; Spark commits the index as Parquet.  A file counts only if
the index names it, so a task that is run again, or twice, leaves at worst a file that nobody reads.

Texts are encoded word by word with a memo: the vocabulary's rules drop white space and never look across
it, so the ids of a text are those of its words in turn (tests compare with the plain encoding).  A vocabulary
with other rules gets whole texts.

Defined results: null and empty texts give a record with the end id alone.  Null ids come first.  Rows that
share an id are ordered by a hash of their text; whole repeats are interchangeable, each has its record.
An empty table gives no records.  Other columns are not read.  A damaged or cut file raises an error.
The vocabulary is read once by the driver and broadcast (one above ``VOCAB_BYTES`` is refused).  Files are
written with Arrow's file systems: a shared mount or one of their remote schemes.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from operator import add
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import bounded_batches, stored, text_buffers

END_ID = 1
VOCAB_BYTES = 16 << 20
#: Bytes of records that one reading task takes.
READ_BYTES = 64 << 20
#: Bytes read from a file at once (a longer record is read whole).
CHUNK_BYTES = 4 << 20
INDEX = "file_no int, file string, offset long, length long, first long, n_tokens long"

HAS_ID, SHORT_IDS = 1, 2
#: flags and doc_id
_HEAD, HEAD_BYTES = "<Iq", 12


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- checksums ------------------------------------------------------------------------------

CASTAGNOLI = np.uint32(0x82F63B78)
BLOCK = 128
_MASK_DELTA = np.uint32(0xA282EAD8)
#: Blocks looked up at once: their indices then stay in the processor's cache.
_LANES = 1024


def _crc_tables() -> np.ndarray:
    """``t[i, b]``: what byte b adds to the checksum as byte i of a block."""
    t = np.zeros((BLOCK, 256), np.uint32)
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ CASTAGNOLI, c >> np.uint32(1))
    t[-1] = c
    for i in reversed(range(BLOCK - 1)):
        t[i] = (t[i + 1] >> np.uint32(8)) ^ t[-1][t[i + 1] & np.uint32(255)]
    return t


_CRC = _crc_tables()


def masked_crc32c(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of each ``data[starts[i]:ends[i]]`` (at least four bytes each).

    Zeros before a message do not change a checksum that starts from zero, so messages are padded in front to
    whole blocks; the usual start from all ones is the same as flipping the first four bytes.  A block's
    checksum is the sum of its bytes' table entries; a message's blocks are then chained, all messages at once.
    """
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint32)
    lengths = ends - starts
    blocks = -(-lengths // BLOCK)
    last = np.cumsum(blocks)
    padded = np.zeros(int(last[-1]) * BLOCK, np.uint8)
    for a, b, end in zip(starts.tolist(), ends.tolist(), (last * BLOCK).tolist()):
        padded[end - b + a : end] = data[a:b]
    head = last * BLOCK - lengths
    padded[head[:, None] + np.arange(4)] ^= 255
    padded = padded.reshape(-1, BLOCK)
    raw = np.empty(len(padded), np.uint32)
    table, lane = _CRC.ravel(), np.arange(BLOCK) * 256
    for i in range(0, len(padded), _LANES):
        raw[i : i + _LANES] = np.bitwise_xor.reduce(table.take(padded[i : i + _LANES] + lane), axis=1)
    order = np.argsort(-blocks, kind="stable")
    first, count = (last - blocks)[order], blocks[order]
    state = np.zeros(n, np.uint32)
    for k in range(int(count[0])):
        active = int(np.searchsorted(-count, -k, "left"))
        s = state[:active]
        moved = _CRC[0][s & 255] ^ _CRC[1][s >> 8 & 255] ^ _CRC[2][s >> 16 & 255] ^ _CRC[3][s >> 24]
        state[:active] = moved ^ raw[first[:active] + k]
    c = np.empty(n, np.uint32)
    c[order] = ~state
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + _MASK_DELTA


# --- encoding -------------------------------------------------------------------------------

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Token ids of texts as little-endian bytes, from a memo of the ids of words.

    Splitting at ASCII white space, folding A-Z and cutting off trailing ASCII punctuation do not change the
    ids: the vocabulary normalises and splits in the same places.  Words that may hold a special token are
    left as they are.  A full memo keeps the words of the texts at hand; long words are not kept.
    """

    ENTRIES, LONGEST, GROUP = 1_000_000, 64, 256

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec.decode())
        rules = json.loads(spec)
        self.by_word = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.by_word &= (rules["model"].get("end_of_word_suffix") or "") == "</w>"
        # Lower-case ASCII letters pass the vocabulary's normalising and splitting as they are: merges alone.
        bare = rules | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(bare))
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.flags = SHORT_IDS if self.dtype.itemsize == 2 else 0
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {b"": b""}

    def _plain(self, word: bytes) -> bytes:
        return np.array(self.tok.encode(word.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        """Ids of words (ASCII ones in lower case)."""
        ascii_only, letters = [], []
        for w in words:
            if len(w) <= self.LONGEST and w.isalpha():
                ascii_only.append(w)
            elif len(w) <= self.LONGEST and w.decode().isalpha():
                letters.append(w)
            else:
                self.memo[w] = self._plain(w)
        self._learn_letters(self.merges, ascii_only)
        self._learn_letters(self.tok, letters)

    def _learn_letters(self, tok, letters: list[bytes]) -> None:
        """Runs of letters are encoded many at once, and cut where a token closes a word."""
        groups = [letters[i : i + self.GROUP] for i in range(0, len(letters), self.GROUP)]
        texts = [b" ".join(g).decode() for g in groups]
        k = self.dtype.itemsize
        for g, e in zip(groups, tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(self.closes[ids]) + 1
            if len(cuts) == len(g) and cuts[-1] == len(ids):
                raw, ends = ids.tobytes(), (cuts * k).tolist()
                self.memo.update(zip(g, [raw[a:b] for a, b in zip([0, *ends], ends)]))
            else:
                self.memo.update((w, self._plain(w)) for w in g)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, without the end id."""
        if not self.by_word:
            return [self._plain(t) for t in texts]
        split = [t.split() for t in texts]
        words, memo = set().union(*split), self.memo
        missing = words.difference(memo)
        if missing:
            plain = [w for w in missing if w.isalpha()]  # ASCII letters only
            other = [w for w in missing if not w.isalpha()]
            lower = [w.lower() for w in plain]
            cores = [self._core(w) for w in other]
            tails = [w[len(c) :] for w, c in zip(other, cores)]
            need = set(lower)
            need.update(cores, tails)
            need = need.difference(memo)
            self._learn(need)
            memo.update(zip(plain, map(memo.__getitem__, lower)))
            memo.update(zip(other, map(add, map(memo.__getitem__, cores), map(memo.__getitem__, tails))))
        out = [b"".join(map(memo.__getitem__, s)) for s in split]
        if missing:
            for some in (missing, need):
                if max(map(len, some), default=0) > self.LONGEST:
                    for w in some:
                        if len(w) > self.LONGEST:
                            memo.pop(w, None)
            if len(memo) > self.ENTRIES:
                self.memo = {b"": b""} | {w: memo[w] for w in words if w in memo}
        return out

    @staticmethod
    def _core(w: bytes) -> bytes:
        """What of a word is encoded apart from its trailing punctuation."""
        if b"<|" in w:
            return w
        core = w.lower().rstrip(_PUNCTUATION)
        # The rest is a piece of its own only behind what the vocabulary's rules end as a letter or number.
        if core[-1:].isalnum() or core and unicodedata.normalize("NFC", core.decode()[-1]).lower().isalnum():
            return core
        return w


def _encoder(spec: bytes) -> WordEncoder:
    """One encoder, with its memo, for all tasks of a worker process.  Globals of this module come anew with
    every task, so it is kept on a module that stays."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_word_encoders", {})
    key = hash(spec)
    if key not in kept:
        kept[key] = WordEncoder(spec)
    return kept[key]


# --- files ----------------------------------------------------------------------------------


def _open(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The framed records, one after another, and the length of each with its frame."""
    n = len(payloads)
    lengths = np.array([len(p) for p in payloads], np.int64)
    heads = lengths.astype("<u8").view(np.uint8)
    at = np.arange(n) * 8
    head_crc = masked_crc32c(heads, at, at + 8).astype("<u4").tobytes()
    ends = np.cumsum(lengths)
    body_crc = masked_crc32c(np.frombuffer(b"".join(payloads), np.uint8), ends - lengths, ends).astype("<u4").tobytes()
    raw = heads.tobytes()
    parts = []
    for i, p in enumerate(payloads):
        parts += (raw[8 * i : 8 * i + 8], head_crc[4 * i : 4 * i + 4], p, body_crc[4 * i : 4 * i + 4])
    return b"".join(parts), lengths + 16


def unframe(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payload bounds of the records at ``starts`` in ``data``, after checking lengths and checksums."""
    head = starts[:, None] + np.arange(8)
    stated = np.ascontiguousarray(data[head]).view("<u8").ravel().astype(np.int64)
    word = lambda at: np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").ravel()
    if not (stated + 16 == lengths).all() or not (word(starts + 8) == masked_crc32c(data, starts, starts + 8)).all():
        raise ValueError("a record's length is damaged")
    a, b = starts + 12, starts + lengths - 4
    if not (word(b) == masked_crc32c(data, a, b)).all():
        raise ValueError("a record's payload is damaged")
    return a, b


def write(docs: DataFrame, path: str, vocab: str | None = None) -> DataFrame:
    """Encode every text of ``docs`` (doc_id, text) into record files under ``path``; the stored index.

    Index columns: file_no, file, offset and length of the record, first (tokens before it in its file),
    n_tokens (with the end id).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vocab = vocab or vocabulary()
    if Path(vocab).stat().st_size > VOCAB_BYTES:
        raise ValueError(f"{vocab} is larger than {VOCAB_BYTES} bytes")
    shared = spark.sparkContext.broadcast(Path(vocab).read_bytes())

    def save(batches):
        from pyspark import TaskContext

        enc, no = _encoder(shared.value), TaskContext.get().partitionId()
        file = f"{path}/part-{no:06d}-{uuid.uuid4().hex}.records"
        store, inner = _open(file)
        sink, offset, first = None, 0, 0
        try:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                if sink is None:
                    store.create_dir(os.path.dirname(inner), recursive=True)
                    sink = store.open_output_stream(inner)
                ids = batch.column(0)
                data, at = text_buffers(batch.column(1))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                body = enc.encode(texts)
                payloads = [
                    struct.pack(_HEAD, enc.flags | (HAS_ID if i is not None else 0), i or 0) + b + enc.end for i, b in zip(ids.to_pylist(), body)
                ]
                out, lengths = frame(payloads)
                sink.write(out)
                tokens = (lengths - 16 - HEAD_BYTES) // enc.dtype.itemsize
                n = len(lengths)
                ends, total = offset + np.cumsum(lengths), first + np.cumsum(tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([no] * n, pa.int32()), pa.array([file] * n), pa.array(ends - lengths), pa.array(lengths), pa.array(total - tokens), pa.array(tokens)],
                    names=["file_no", "file", "offset", "length", "first", "n_tokens"],
                )
                offset, first = int(ends[-1]), int(total[-1])
        finally:
            if sink is not None:
                sink.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    # Rows of one id are spread by text, and whole repeats by row, so no id fills a task alone.
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_row")]
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(rows.select("doc_id", "text").mapInArrow(save, INDEX), "record-index")


def positions(index: DataFrame) -> tuple[DataFrame, int]:
    """The index with ``start`` (tokens of all records before it), and the bytes of all records.

    Only the totals of the files, one row each, are summed in order."""
    files = stored(index.groupBy("file_no").agg(F.sum("length").alias("bytes"), F.sum("n_tokens").alias("tokens")), "record-files")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file_no", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("_base"))
    total = files.agg(F.sum("bytes")).head()[0] or 0
    out = index.join(bases, "file_no").withColumn("start", F.col("first") + F.col("_base")).drop("_base")
    return out, total


def read(index: DataFrame, seed: int | None = None, digest_only: bool = False) -> DataFrame:
    """Every record of the index, read from its file and checked: doc_id, start, n_tokens, ids_crc32, ids.

    In file order, or, with ``seed``, in an order drawn from it, by random access.  ``ids_crc32`` is over the
    ids as little-endian unsigned 32-bit numbers.  ``digest_only`` leaves the ids out.
    """
    located, total = positions(index)
    by = F.col("start") if seed is None else F.xxhash64(F.lit(seed), F.col("start"))
    parts = max(1, -(-total // READ_BYTES))
    rows = located.withColumn("_by", by).repartitionByRange(parts, "_by").sortWithinPartitions("_by").select("file", "offset", "length", "start", "n_tokens")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")

    def load(batches):
        handles: dict = {}
        try:
            for batch in batches:
                lengths = batch.column(2).to_numpy()
                for a, b in _chunks(lengths):
                    yield _load(batch.slice(a, b - a), handles, digest_only)
        finally:
            for h in handles.values():
                h.close()

    return rows.mapInArrow(load, schema)


def _chunks(lengths: np.ndarray):
    ends, i = np.cumsum(lengths), 0
    while i < len(lengths):
        j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK_BYTES, "right")), i + 1)
        yield i, j
        i = j


def _load(batch: pa.RecordBatch, handles: dict, digest_only: bool) -> pa.RecordBatch:
    
    files, offsets, lengths = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
    n = len(files)
    # Records that follow one another in a file are read at once; results keep the order of the batch.
    order = sorted(range(n), key=lambda i: (files[i], offsets[i]))
    pieces, at, size, i = [], np.zeros(n, np.int64), 0, 0
    while i < n:
        j, begin, end = i, int(offsets[order[i]]), int(offsets[order[i]])
        while j < n and files[order[j]] == files[order[i]] and offsets[order[j]] == end:
            at[order[j]] = size + end - begin
            end += int(lengths[order[j]])
            j += 1
        name = files[order[i]]
        if name not in handles:
            if len(handles) >= 64:
                handles.pop(next(iter(handles))).close()
            store, inner = _open(name)
            handles[name] = store.open_input_file(inner)
        got = handles[name].read_at(end - begin, begin)
        if len(got) != end - begin:
            raise ValueError(f"{name} is cut")
        pieces.append(got)
        size += end - begin
        i = j
    raw = b"".join(pieces)
    starts, ends = unframe(np.frombuffer(raw, np.uint8), at, lengths)
    doc, count, crc, ids = [], [], [], []
    for a, b in zip(starts.tolist(), ends.tolist()):
        flags, doc_id = struct.unpack_from(_HEAD, raw, a)
        dtype = np.dtype("<u2" if flags & SHORT_IDS else "<u4")
        tokens = np.frombuffer(raw, dtype, (b - a - HEAD_BYTES) // dtype.itemsize, a + HEAD_BYTES).astype("<u4")
        doc.append(doc_id if flags & HAS_ID else None)
        count.append(len(tokens))
        crc.append(zlib.crc32(tokens.tobytes()))
        if not digest_only:
            ids.append(tokens.astype(np.int64))
    if count != batch.column(4).to_pylist():
        raise ValueError("the index does not belong to these files")
    arrays = [pa.array(doc, pa.int64()), batch.column(3), pa.array(count, pa.int64()), pa.array(crc, pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if not digest_only:
        arrays.append(pa.array(ids, pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names=names)
