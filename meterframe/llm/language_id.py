"""Language identification by compression: the language whose dictionary compresses a text best.

Per language, a raw-content zstandard dictionary of up to ``DICT_BYTES`` holds the words that are in most of its
labelled texts, the commonest last, where references to them are shortest.  Every labelled text that is not held
out is counted, whole.  A text counts once, however many copies it has (each counts an equal part), and a word
once in a text; of equally common words the lower hash goes first.  A word of a script without spaces is up to
``UNSPACED_LETTERS`` letters; other runs of letters are cut at ``LONGEST``.  A text is normalised (lower-cased,
runs of non-letters become one space), cut into pieces of ``PIECE`` bytes, and every piece is compressed with each
dictionary; the sizes are summed over the whole text, and the smallest sum wins.  Each piece starts afresh, so a
long text does not become its own dictionary.

The margin is the gap between the smallest and second smallest sum as a share of the second.  ``accepted``
is false where it is narrow for the language and the compressed size, and where there is no language.
What is narrow is learned: a fifth of the labelled texts (by hash) stay out of the dictionaries and are judged, every
one of them, whole and cut to ``CUTS`` characters.  The margins of each language and power of two of compressed
bytes are counted at steps of 1/``STEPS``; ``SLACK`` times their ``NARROW`` quantile is the least that is accepted;
other sizes use the next smaller learned one.  So texts of a language that is not learned, gibberish and mixtures,
whose margins are narrower, go.  Sizes are whole bytes, so short texts can tie; a tie is first put to the sizes of the
words compressed one by one, and where labelled texts tie as well, ties are accepted.  A language with
fewer than ``LEAST`` labelled texts, or a size with fewer than ``OBSERVED`` of them, has the margin
``MARGIN``, or none below ``SHORT`` compressed bytes.

Defined results: null texts and texts without a letter get ``und`` and score 0.  Ties go to the language
with more training texts, then by name.  With no labelled rows everything is ``und``.  Repeated rows
and other columns do not matter.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import bounded_batches, from_text, stored

DICT_BYTES = 96 << 10
#: Letters of a word at most, and of a word of a script that has no spaces.
LONGEST, UNSPACED_LETTERS = 24, 3
#: What a text counts; copies share it.
WHOLE = 1 << 20
PIECE = 512
LEVEL = 9
#: Languages the operator takes; so many dictionaries of DICT_BYTES are broadcast at most.
MAX_LANGUAGES = 200
#: Texts that compress below so many bytes are too short to show a margin in whole bytes; they are accepted.
SHORT = 48
#: Smallest share by which the second language must compress worse.
MARGIN = 0.0005
#: Labelled texts of a language from which some are kept back.
LEAST = 100
#: Lengths to which they are cut, labelled texts of a size from which its margin is learned, and steps of a margin.
CUTS, OBSERVED, STEPS = (32, 64, 128, 256, 512, 1024, 2048), 15, 1 << 16
#: Margins below this quantile of the labelled texts of a size, times the slack for what few texts tell, are narrow.
NARROW, SLACK = 0.01, 0.5
UNDETERMINED = "und"

_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_UNSPACED_LETTER = regex.compile(f"[{_UNSPACED}]")
_WORD = regex.compile(rf"[{_UNSPACED}]{{1,{UNSPACED_LETTERS}}}|[^{_UNSPACED}]{{1,{LONGEST}}}")


class _Letters(dict):
    """Letters as they are, every other character as a space."""

    def __missing__(self, c: int) -> int:
        self[c] = c if unicodedata.category(chr(c))[0] == "L" else 32
        return self[c]


_LETTERS = _Letters()


def normalise(text: str) -> str:
    return " ".join(text.lower().translate(_LETTERS).split())


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def words_of(text: str) -> set[str]:
    """The words of a text; a run of one letter is none."""
    runs = set(normalise(text).split())
    odd = [x for x in runs if len(x) > LONGEST or not x.isascii() and _UNSPACED_LETTER.search(x)]
    if odd:
        runs.difference_update(odd)
        runs.update(w for x in odd for w in _WORD.findall(x))
    return {w for w in runs if w[0] != w[-1] or len(w) < 3 or w.count(w[0]) < len(w)}


def training_texts(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """lang, text, weight, back (kept back for the margins) of every labelled row, and the texts of each language.

    The weights of a text's copies add up to ``WHOLE``, so nothing depends on how often a row is repeated.
    """
    rows = docs.filter("lang is not null and doc_id is not null and length(text) > 0").filter(~held_out())
    rows = rows.select("lang", "text", F.xxhash64("text").alias("_h"), F.xxhash64(F.lit("copy"), "text").alias("_g"))
    same = ["lang", "_h", "_g"]
    # Hashes alone are shuffled; the texts are where there are more copied ones than a broadcast takes.
    texts = stored(rows.groupBy(same).agg(F.count(F.lit(1)).alias("n")), "language-texts")
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    copied = texts.filter("n > 1").select(*same, F.greatest(F.lit(1), F.floor(F.lit(WHOLE) / F.col("n"))).alias("_w"))
    copied = stored(copied, "language-copies")
    back = F.col("lang").isin([x for x, n in sizes.items() if n >= LEAST]) & (F.pmod("_h", F.lit(5)) == 0)
    weight = F.coalesce("_w", F.lit(WHOLE)).cast("long")
    return rows.join(copied, same, "left").select("lang", "text", weight.alias("weight"), back.alias("back")), sizes


def common_words(texts: DataFrame) -> DataFrame:
    """lang, word, rank: the words in most texts of each language, as many as a dictionary holds."""

    def rows(counts, unit):
        for lang, each in counts.items():
            n = np.fromiter(each.values(), np.int64, len(each)) * unit
            columns = [pa.array([lang] * len(each), pa.string()), pa.array(list(each), pa.string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

    def run(batches):
        for b in batches:
            counts, shares = defaultdict(Counter), defaultdict(Counter)
            for lang, text, weight in zip(*(b.column(x).to_pylist() for x in ("lang", "text", "weight"))):
                if weight == WHOLE:
                    counts[lang].update(words_of(text))
                else:
                    shares[lang].update(dict.fromkeys(words_of(text), weight))
            yield from rows(counts, WHOLE)
            yield from rows(shares, 1)

    # Each batch is counted before anything is shuffled.
    counted = texts.select("lang", "text", "weight").mapInArrow(run, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.xxhash64("word"), "word")
    # No dictionary holds more words than half its bytes: the rank limit runs inside each task before the shuffle.
    ranked = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= DICT_BYTES // 2)
    held = F.sum(F.octet_length("word") + 1).over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_b", held).filter(F.col("_b") <= DICT_BYTES).select("lang", "word", "rank")


class Dictionaries(list):
    """(language, dictionary content) of each language; ``margins``: {language: {power of two: least margin}}."""

    margins: dict = {}


def train(docs: DataFrame) -> Dictionaries:
    """(language, dictionary content) of every labelled language, most texts first, with the margins."""
    bounded_batches(docs.sparkSession)
    langs = docs.filter("lang is not null").select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if langs > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    texts, size = training_texts(docs)
    by_lang: dict[str, list] = {}
    # At most DICT_BYTES a language.
    for r in common_words(texts.filter("not back")).collect():
        by_lang.setdefault(r["lang"], []).append((-r["rank"], r["word"]))
    out = Dictionaries()
    for lang in sorted(by_lang, key=lambda x: (-size[x], x)):
        out.append((lang, " ".join(word for _, word in sorted(by_lang[lang])).encode()))
    if out and max(size.values()) >= LEAST:
        out.margins = learned_margins(out, texts.filter("back"))
    return out


def learned_margins(dictionaries, texts: DataFrame) -> dict:
    """{language: {power of two: least margin}} from lang, text, weight rows that the dictionaries do not hold."""
    shared = texts.sparkSession.sparkContext.broadcast(list(dictionaries))

    def run(batches):
        judge = Compressors(shared.value).measure
        for b in batches:
            found = []
            for lang, text, weight in zip(*(b.column(x).to_pylist() for x in ("lang", "text", "weight"))):
                # The cuts come from any place of the text.
                start = zlib.crc32(text.encode()) % max(len(text) - CUTS[-1] + 1, 1)
                for part in [text[start : start + n] for n in CUTS if n < len(text)] + [text]:
                    best, gap, size = judge(part)
                    if best == lang:
                        found.append((lang, power(size), int(gap * STEPS), weight))
            columns = list(zip(*found)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "power", "step", "weight"])

    steps = texts.select("lang", "text", "weight").mapInArrow(run, "lang string, power int, step int, weight long")
    steps = steps.groupBy("lang", "power", "step").agg(F.sum("weight").alias("n"))
    # At most a row a step of each language and power.
    each = Window.partitionBy("lang", "power")
    upto = F.sum("n").over(each.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.select("lang", "power", "step", upto.alias("upto"), F.sum("n").over(each).alias("n"))
    # Copies' shares are rounded down.
    enough = F.col("n") >= int((OBSERVED - 0.5) * WHOLE)
    least = steps.filter(enough & (F.col("upto") >= F.col("n") * NARROW)).groupBy("lang", "power").agg(F.min("step").alias("step"))
    out: dict = {}
    # At most some dozens of rows a language.
    for r in least.collect():
        out.setdefault(r["lang"], {})[r["power"]] = SLACK * r["step"] / STEPS
    return out


def power(size: float) -> int:
    """The power of two at or below a size in bytes."""
    return int(size).bit_length() - 1


class Compressors:
    """One zstandard compressor per language, over prepared raw-content dictionaries."""

    def __init__(self, dictionaries, margins=None):
        self.margins = getattr(dictionaries, "margins", {}) if margins is None else margins
        self.langs, self.each = [x for x, _ in dictionaries], []
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Summed compressed bytes of the whole text under each dictionary."""
        raw = normalise(text).encode()
        if not raw:
            return np.zeros(0)
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.each], float)

    def measure(self, text) -> tuple[str, float, float]:
        """(language, margin, compressed bytes)."""
        s = self.sizes(text) if text and self.each else np.zeros(0)
        if not len(s):
            return UNDETERMINED, 0.0, 0.0
        size = float(s.min())
        if (s == s.min()).sum() > 1:
            # Sizes are whole bytes, so short texts tie: let the words, compressed alone, decide.
            s = s + np.array([sum(len(c.compress(w)) for w in normalise(text).encode().split()) for c in self.each], float)
        best = int(s.argmin())
        rest = np.delete(s, best)
        return self.langs[best], float(1 - s[best] / rest.min()) if len(rest) else 1.0, size

    def judge(self, text, margin: float = MARGIN) -> tuple[str, float, bool]:
        """(language, margin, accepted)."""
        lang, gap, size = self.measure(text)
        if not size:
            return lang, gap, False
        least = 0.0 if size < SHORT else margin
        learned = self.margins.get(lang, {})
        below = [p for p in learned if p <= power(size)]
        if below:
            least = max(least, learned[max(below)])
        return lang, gap, gap >= least


def identify(docs: DataFrame, dictionaries=None, margin: float = MARGIN, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (the margin, 0 to 1) and accepted, named with ``prefix``.

    Columns of those names that ``docs`` already has are replaced.
    """
    spark = docs.sparkSession
    dictionaries = train(docs) if dictionaries is None else dictionaries
    shared = spark.sparkContext.broadcast((list(dictionaries), getattr(dictionaries, "margins", {})))

    def compute(col):
        judge = Compressors(*shared.value).judge
        got = [judge(t.as_py(), margin) for t in col]
        lang = pa.array([g[0] for g in got], pa.string())
        score = pa.array([g[1] for g in got], pa.float64())
        ok = pa.array([g[2] for g in got], pa.bool_())
        return [lang, score, ok]

    return from_text(docs, compute, f"`{prefix}lang_pred` string, `{prefix}score` double, `{prefix}accepted` boolean")
