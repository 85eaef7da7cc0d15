"""Phrase collocation mining after Toivonen: a sample proposes phrases, and full passes count them and their negative border exactly until the set is closed."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.common import Sums, Words, batches, byte_values, forget, materialize, mix, rows, signed, text_bytes

#: Occurrences of a phrase, and words, at most; phrases of a language that are returned.
LEAST, LONGEST, FIRST = 100, 5, 2000
#: One of so many documents is in the sample.
PART = 8
#: Bytes of text that are counted together.
BATCH = 1 << 19
#: Bits of a filter for each phrase, how many of them a phrase sets, and the largest filter as a power of two (32 MB).
BITS, PROBES, LARGEST = 16, 4, 28
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: all but blanks, and the marks and line ends that part pieces.
_CUT = np.zeros(256, bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_INK = ~_CUT
_INK[[9, 32]] = False


class Filter:
    """A set of 64-bit keys as a bitmap of bounded size: it has every key that went in, and some others."""

    def __init__(self, keys: DataFrame):
        """Keys are the column ``key``. Their bits are combined by Spark; the driver gets a row for each word of the bitmap."""
        n = keys.count()
        self.mask = (1 << min(LARGEST, max(16, math.ceil(math.log2(max(1, n * BITS)))))) - 1
        key = F.col("key")
        step = F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1).cast("long"))
        bits = F.explode(F.array(*[(key + step * F.lit(k).cast("long")).bitwiseAND(F.lit(self.mask).cast("long")) for k in range(PROBES)]))
        found = keys.select(bits.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63L)))").alias("word")).toArrow()
        self.words = np.zeros((self.mask + 1) // 64, _U)
        self.words[found.column(0).to_numpy()] = found.column(1).to_numpy().view(_U)

    def has(self, keys: np.ndarray) -> np.ndarray:
        step = (keys >> _U(32)) | _U(1)
        out = np.ones(len(keys), bool)
        for k in range(PROBES):
            bit = (keys + step * _U(k)) & _U(self.mask)
            out &= (self.words[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) > 0
        return out


def _language_keys(column: pa.Array) -> np.ndarray:
    codes = column.dictionary_encode()
    keys = np.array([xxhash.xxh3_64_intdigest(x) for x in codes.dictionary.to_pylist()], _U)
    return keys[codes.indices.to_numpy()] if len(column) else np.zeros(0, _U)


class Phrases:
    """Words of a batch of texts, and the key of every phrase of 1 to LONGEST words that stands inside a piece."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, language: np.ndarray):
        self.data = _LOWER[data]
        self.words = Words(self.data, starts, ink=_INK)
        cuts = np.cumsum(_CUT[self.data])
        self.piece = cuts[self.words.begin] + self.words.text if len(self.words.begin) else np.zeros(0, np.int64)
        self.sums = Sums(mix(self.words.hash + language[self.words.text]))
        self.n = len(self.words.begin)

    def keys(self, k: int) -> np.ndarray:
        """The keys of all runs of k words; one over a piece's end is never asked for."""
        at = np.arange(max(0, self.n - k + 1))
        return self.sums.hashes(at, at + k)

    def inside(self, k: int) -> np.ndarray:
        return self.piece[: max(0, self.n - k + 1)] == self.piece[k - 1 :]

    def both(self, shorter: np.ndarray, k: int) -> np.ndarray:
        """Of runs of k words: whether both runs of one word less are marked."""
        return shorter[:-1][: max(0, self.n - k + 1)] & shorter[1:] if self.n >= k else np.zeros(0, bool)


def _counted(phrases: Phrases, filters: list[Filter], levels: range) -> Iterator[np.ndarray]:
    """The keys, by level, that the pass over the last filter counts.

    The first filter's set has been proposed by the sample. Its pass counts every word, and every longer phrase whose two parts of one word less
    are in the set: the set and its negative border. A pass over a further filter, which also has the border phrases that turned out frequent, counts the border of
    that larger set without what was counted before, and looks ahead: a phrase also counts if a part is counted for the first time itself.
    """
    before: list[np.ndarray] = []  # of each filter: marks of the shorter runs
    for k in levels:
        keys = phrases.keys(k)
        done = np.zeros(len(keys), bool)
        marks = []
        for j, one in enumerate(filters):
            if k == 1:
                new = np.full(len(keys), j == 0)
            else:
                new = phrases.both(before[j], k) & phrases.inside(k) & ~done
            done |= new
            if j + 1 == len(filters):
                yield keys[new]
            mark = np.zeros(len(keys), bool)
            some = done if j == 0 else phrases.inside(k)
            mark[some] = one.has(keys[some])
            marks.append(mark | new if j else mark)
        before = marks


_COUNTS = "key long, n long"


def _batches(part: pa.RecordBatch) -> Iterator[tuple[Phrases, int, int]]:
    data, starts = text_bytes(part.column(0))
    language = _language_keys(part.column(1))
    for lo, hi in batches(starts, BATCH):
        yield Phrases(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], language[lo:hi]), lo, hi


def _count(parts: Iterator[pa.RecordBatch], filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for phrases, _, _ in _batches(part):
            for keys in _counted(phrases, filters, range(1, LONGEST + 1)):
                some, n = np.unique(keys, return_counts=True)
                yield rows(_COUNTS, signed(some), n)


def _count_level(parts: Iterator[pa.RecordBatch], k: int, shorter: Filter | None) -> Iterator[pa.RecordBatch]:
    """Phrases of k words whose parts are in a filter; all words for k = 1."""
    for part in parts:
        for phrases, _, _ in _batches(part):
            keys = phrases.keys(k)
            if shorter is not None:
                keys = keys[phrases.both(shorter.has(phrases.keys(k - 1)), k) & phrases.inside(k)]
            some, n = np.unique(keys, return_counts=True)
            yield rows(_COUNTS, signed(some), n)


def _frequent(counts: DataFrame, least: int) -> DataFrame:
    return materialize(counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"))


def proposed(docs: DataFrame, least: int, part: int = PART) -> DataFrame:
    """Keys of the phrases that are frequent in a sample, level by level, by a threshold so far below its share that few frequent ones are missed."""
    sample = docs.where(F.rand(12) * part < 1)
    share = least / part
    low = max(2, math.floor(share - 2 * math.sqrt(share)))
    found, shorter = None, None
    for k in range(1, LONGEST + 1):
        level = _frequent(sample.mapInArrow(partial(_count_level, k=k, shorter=shorter), _COUNTS), low)
        shorter = Filter(level)
        found = level if found is None else found.unionByName(level)
    return found


def frequent_keys(docs: DataFrame, least: int = LEAST, part: int = PART) -> DataFrame:
    """Keys of all phrases that are frequent in all rows of ``text, lang``, and by chance of few others.

    The pass over the sample's set and its negative border is followed by one over the border of the set with the border phrases that
    proved frequent, as long as there are any that the last pass did not know.
    """
    known = proposed(docs, least, part)
    filters: list[Filter] = []
    found = None
    while True:
        filters.append(Filter(known))
        new = _frequent(docs.mapInArrow(partial(_count, filters=filters), _COUNTS), least)
        found = new if found is None else found.unionByName(new)
        failures = materialize(new.join(known, "key", "left_anti"))
        if len(filters) > 1 or failures.isEmpty():  # a further pass has looked ahead: all that its failures could extend is counted
            return found
        known = materialize(known.unionByName(failures))
        forget(failures)


_TEXTS = "lang string, words int, phrase string, n long"


def _spelled(parts: Iterator[pa.RecordBatch], wanted: Filter) -> Iterator[pa.RecordBatch]:
    """The texts of the phrases in a filter with their occurrences, and, as 0 words, all words of each language."""
    for part in parts:
        for phrases, lo, _ in _batches(part):
            lang = part.column(1).slice(lo)
            w, whole = phrases.words, phrases.data.tobytes()
            for k in range(1, LONGEST + 1):
                keys, inside = phrases.keys(k), phrases.inside(k)
                at = np.flatnonzero(inside)
                at = at[wanted.has(keys[at])]
                _, one, n = np.unique(keys[at], return_index=True, return_counts=True)
                first = at[one]
                begin, end = w.begin[first], w.end[first + k - 1]
                said = [b" ".join(whole[b:e].split()) if k > 1 else whole[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
                yield rows(_TEXTS, lang.take(pa.array(w.text[first])), np.full(len(first), k, np.int32), pa.array(said, pa.binary()).cast(pa.string()), n)
            total = np.bincount(w.text, minlength=1)
            yield rows(_TEXTS, lang.slice(0, len(total)), np.zeros(len(total), np.int32), pa.array([""] * len(total)), total)


def counted_texts(docs: DataFrame, least: int = LEAST, part: int = PART) -> DataFrame:
    """``lang, words, phrase, n`` of every phrase with at least ``least`` occurrences, counted by its text; with 0 words, the number of all words of a language."""
    wanted = Filter(frequent_keys(docs, least, part))
    counts = docs.mapInArrow(partial(_spelled, wanted=wanted), _TEXTS)
    return materialize(counts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("words") == 0) | (F.col("n") >= least)))


def _piece(words: Column, begin: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of the phrases of two words and more: the cut of lowest score, the first of equals."""
    of = counts.where("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    total = counts.where("words = 0").select("lang", F.col("n").alias("n"))
    w = F.split("phrase", " ")
    cuts = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = cuts.select("lang", "phrase", "words", "a", "k", _piece(w, F.lit(1), F.col("k")).alias("left"), _piece(w, F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    both = parts.join(of.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"]).join(of.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"]).join(F.broadcast(total), "lang")
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    score = F.expr("(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def mine(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, first: int = FIRST, part: int = PART) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``first`` phrases by score, occurrences and bytes, of those that occur at least ``least`` times.

    Texts are lower-cased (A-Z), parted into pieces at marks and line ends, and pieces into words at blanks; a phrase is 2 to LONGEST words of a piece. A null text has no
    words, a null language is ``und``. Every row counts, repeated ones and those without an id too; other columns are ignored; an empty table gives an empty table. A phrase
    goes if a longer one that holds it occurs as often.

    The sample and the passes work on 64-bit keys and only say which phrases may be frequent; occurrences are then counted by text. Candidates live in Spark tables; tasks hold filters of
    at most 32 MB, whose chance hits cost a count and change nothing. A last pass spells what is frequent.
    """
    docs = df.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    counts = counted_texts(docs, least, part)
    w = F.split("phrase", " ")
    shorter = counts.where("words > 2").select("lang", F.col("n").alias("a"), F.explode(F.array(_piece(w, F.lit(1), F.col("words") - 1), _piece(w, F.lit(2), F.col("words") - 1))).alias("phrase"))
    left = scored(counts).join(shorter.distinct(), ["lang", "phrase", "a"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
