"""Toxicity from class-conditional Kneser-Ney models over the bytes of words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import Sums, Words, batches, byte_values, forget, materialize, rows, signed, text_bytes

#: Bytes of an n-gram, and what is taken off each count.
ORDER, DISCOUNT = 6, 0.75
#: The most frequent words and n-grams whose ratios tasks hold; those of all others come by joins, with the same result.
AT_HAND = 500_000
#: Labelled documents that the score is calibrated on, at most; of five parts of the ids, part 0 is held out and part 1 calibrates.
CALIBRATION, FOLDS = 20_000, 5
#: Words with the largest ratio whose mean is a second measure of a text.
TELLING = 5
EDGE = 0  # the byte before and after a word


def _framed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as bytes with ORDER - 1 edges before and one after, and where each starts."""
    lead = ORDER - 1
    length = end - begin + lead + 1
    starts = np.concatenate(([0], np.cumsum(length)))
    out = np.full(starts[-1], EDGE, np.uint8)
    size = end - begin
    inner = np.repeat(starts[:-1] + lead - (np.cumsum(size) - size), size) + np.arange(size.sum())
    source = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out[inner] = data[source]
    return out, starts


def _word_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct lower-cased words of a batch with how often each class has them."""
    for part in parts:
        data, starts = text_bytes(part.column(0))
        toxic = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in batches(starts, 1 << 20):
            own = data[starts[lo] : starts[hi]]
            own = np.where((own >= 65) & (own <= 90), own + 32, own).astype(np.uint8)
            found = Words(own, starts[lo : hi + 1] - starts[lo])
            _, at, which = np.unique(found.hash, return_index=True, return_inverse=True)
            mark = toxic[lo:hi][found.text]
            whole = own.tobytes()
            words = [whole[b:e] for b, e in zip(found.begin[at].tolist(), found.end[at].tolist(), strict=True)]
            yield rows("word binary, toxic long, ordinary long", words, np.bincount(which, mark, len(at)).astype(np.int64), np.bincount(which, ~mark, len(at)).astype(np.int64))


def _gram_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of two bytes and more of distinct words with counts by class; combined in the batch."""
    schema = "order int, gram long, context long, short long, short_context long, toxic long, ordinary long"
    for part in parts:
        data, starts = text_bytes_of_binary(part.column(0))
        framed, at = _framed(data, starts[:-1], starts[1:])
        word = np.repeat(np.arange(len(at) - 1), np.diff(at))
        toxic, ordinary = (part.column(k).to_numpy() for k in (1, 2))
        real = np.arange(len(framed)) - at[word] >= ORDER - 1
        sums = Sums(byte_values(framed))
        end = np.flatnonzero(real) + 1
        for k in range(2, ORDER + 1):
            gram, context = sums.hashes(end - k, end), sums.hashes(end - k, end - 1)
            short, short_context = sums.hashes(end - k + 1, end), sums.hashes(end - k + 1, end - 1)
            _, one, which = np.unique(gram, return_index=True, return_inverse=True)
            t = np.bincount(which, toxic[word[end - 1]], len(one)).astype(np.int64)
            o = np.bincount(which, ordinary[word[end - 1]], len(one)).astype(np.int64)
            yield rows(schema, np.full(len(one), k, np.int32), *(signed(x[one]) for x in (gram, context, short, short_context)), t, o)


def _real(framed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of framed words end an n-gram, and whose each byte is."""
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.arange(len(framed)) - at[word] >= ORDER - 1, word


def _edges(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, starts = text_bytes_of_binary(column)
    return data, starts[:-1], starts[1:]


def text_bytes_of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    whole = column.cast(pa.large_binary())
    starts = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


class Model:
    """Kneser-Ney over bytes: a class discounts its own counts of the longest n-grams and backs off to counts that both share.

    The shared model has the longest n-grams of both classes together, and for shorter ones in how many
    longer ones they end (continuation counts). Where a class has few counts, both classes come near the shared
    probability, and the ratio near 1. All n-grams and contexts are rows of two Spark tables, ``grams`` and ``contexts``;
    lengths share them, as a hash tells lengths apart.
    """

    def __init__(self, found: DataFrame):
        none = [F.lit(0).cast("long").alias(c) for c in ("toxic", "ordinary")]
        shorter = found.groupBy(F.col("short").alias("gram")).agg(F.first("short_context").alias("context"), F.count("*").alias("n"))
        top = found.where(F.col("order") == ORDER).select("gram", "context", (F.col("toxic") + F.col("ordinary")).alias("n"), "toxic", "ordinary")
        grams = materialize(shorter.select("gram", "context", "n", *none).unionByName(top))
        sums = [x for c in ("n", "toxic", "ordinary") for x in (F.sum(c).alias(f"{c}_total"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))]
        self.grams, self.contexts = grams.drop("context"), materialize(grams.groupBy("context").agg(*sums))
        self.weight = (0.0, 0.0, 0.0)

    def ratios(self, words: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
        """``hash, n, ratio``: the log-likelihood ratio, toxic to ordinary, of each row of ``word, n`` with distinct words; and the written tables that this reads.

        Each n-gram of the words is smoothed once: it is joined with its counts and its context, then, length by length, with
        the next shorter n-gram. A word sums the ratios of its longest n-grams.
        """
        asked = words.mapInArrow(_asked, _ASKED).groupBy("gram").agg(F.first("order").alias("order"), F.first("context").alias("context"), F.first("short").alias("short"), F.sum("n").alias("n"))
        counted = asked.join(self.grams.withColumnRenamed("n", "both"), "gram", "left").join(self.contexts, "context", "left")
        parts = [x for c, t in (("both", "n"), ("toxic", "toxic"), ("ordinary", "ordinary")) for x in _parts(c, t)]
        counted = materialize(counted.select("order", "gram", "short", "n", *parts))
        p = counted.where("order = 1").select("gram", (F.col("both_own") + F.col("both_back") / 257).alias("p"))
        for k in range(2, ORDER + 1):
            here = counted.where(F.col("order") == k).join(p.withColumnRenamed("gram", "short").withColumnRenamed("p", "lower"), "short")
            p = here.withColumn("p", F.col("both_own") + F.col("both_back") * F.col("lower"))
            p = p.select("gram", "p") if k < ORDER else p
        ratio = F.log(F.col("toxic_own") + F.col("toxic_back") * F.col("p")) - F.log(F.col("ordinary_own") + F.col("ordinary_back") * F.col("p"))
        found = materialize(p.select("gram", "n", ratio.alias("ratio")))
        forget(counted)
        schema = "hash long, n long, part double, rest array<long>"
        begun = materialize(words.mapInArrow(partial(_begin, hand=_at_hand(found, "gram"), schema=schema), schema))
        whole = begun.where("size(rest) = 0").select("hash", "n", F.col("part").alias("ratio"))
        rest = begun.where("size(rest) > 0").select("hash", "n", "part", F.explode("rest").alias("gram")).join(found.select("gram", "ratio"), "gram")
        return whole.unionByName(rest.groupBy("hash").agg(F.first("n").alias("n"), (F.first("part") + F.sum("ratio")).alias("ratio"))), (begun, found)

    def measures(self, docs: DataFrame) -> DataFrame:
        """``doc_id, held_out, mean, telling`` of each row of ``doc_id, text, held_out``: the mean ratio of the words of a text and the mean
        of the TELLING largest; both 0 for a text without words."""
        each = docs.select("text", F.lit(True).alias("mark")).mapInArrow(_word_counts, "word binary, toxic long, ordinary long")
        words = materialize(each.groupBy("word").agg(F.sum("toxic").alias("n")))
        ratios, (begun, found) = self.ratios(words)
        ratios = materialize(ratios)
        forget(words, begun, found)
        schema = "row long, doc_id long, held_out boolean, words long, total double, top array<double>, rest array<long>, times array<long>"
        begun = docs.select("doc_id", "text", "held_out").mapInArrow(partial(_begin_text, hand=_at_hand(ratios, "hash"), schema=schema), schema)
        begun = materialize(begun)  # once, as the numbers of rows are given to tasks
        rest = begun.where("size(rest) > 0").select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("hash"), "x.times")
        rest = rest.join(ratios.select("hash", "ratio"), "hash").groupBy("row").agg(F.collect_list(F.struct("ratio", "times")).alias("more"))
        work = begun.where("size(rest) > 0").join(rest, "row").select("doc_id", "held_out", "words", "total", "top", "more")
        whole = begun.where("size(rest) = 0").select("doc_id", "held_out", "words", "total", "top", F.array().cast(work.schema["more"].dataType).alias("more"))
        schema = "doc_id long, held_out boolean, mean double, telling double"
        measured = materialize(whole.unionByName(work).mapInArrow(partial(_end_text, schema=schema), schema))
        forget(ratios, begun)
        return measured


def _parts(count: str, name: str) -> tuple[Column, Column]:
    """What an n-gram has of its own, and its share of the shorter one's probability: all of it where the context is not known."""
    n, total, kinds = F.coalesce(count, F.lit(0)), F.col(f"{name}_total"), F.col(f"{name}_kinds")
    own = F.when(total > 0, F.greatest(n - DISCOUNT, F.lit(0.0)) / total).otherwise(0.0)
    return own.alias(f"{count}_own"), F.when(total > 0, DISCOUNT * kinds / total).otherwise(1.0).alias(f"{count}_back")


def _at_hand(table: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and ratios of the rows of largest ``n``, whole steps of ``n`` and at most AT_HAND rows."""
    step = F.floor(8 * F.log2("n")).cast("int")
    left, least = AT_HAND, None
    for r in sorted(table.groupBy(step.alias("step")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r.step
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    some = table.where(step >= least).select(key, "ratio").toArrow()
    keys, ratio = some.column(0).to_numpy(), some.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], ratio[order]


def _look_up(hand: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The ratios of keys, NaN for those not at hand."""
    if not len(hand[0]):
        return np.full(len(keys), np.nan)
    at = np.minimum(np.searchsorted(hand[0], keys), len(hand[0]) - 1)
    return np.where(hand[0][at] == keys, hand[1][at], np.nan)


def _lists(of: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values as a list for each of ``n`` rows; ``of`` says whose they are and rises."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values))


_ASKED = "order int, gram long, context long, short long, n long"


def _asked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of distinct words, and in how many places of these; combined in the batch."""
    for part in parts:
        framed, at = _framed(*_edges(part.column(0)))
        end, sums = np.flatnonzero(_real(framed, at)[0]) + 1, Sums(byte_values(framed))
        for k in range(1, ORDER + 1):
            _, one, n = np.unique(sums.hashes(end - k, end), return_index=True, return_counts=True)
            last = end[one]
            yield rows(_ASKED, np.full(len(one), k, np.int32), *(signed(x) for x in (sums.hashes(last - k, last), sums.hashes(last - k, last - 1), sums.hashes(last - k + 1, last))), n)


def _begin(parts: Iterator[pa.RecordBatch], hand: tuple[np.ndarray, np.ndarray], schema: str) -> Iterator[pa.RecordBatch]:
    """The hash of each word, the sum of the ratios at hand, and its other longest n-grams, each as often as it stands there."""
    for part in parts:
        data, begin, end = _edges(part.column(0))
        hashes = signed(Sums(byte_values(data)).hashes(begin, end))
        framed, at = _framed(data, begin, end)
        real, word = _real(framed, at)
        last = np.flatnonzero(real) + 1
        gram, word = signed(Sums(byte_values(framed)).hashes(last - ORDER, last)), word[last - 1]
        ratio = _look_up(hand, gram)
        rest = np.isnan(ratio)
        yield rows(schema, hashes, part.column(1), np.bincount(word[~rest], ratio[~rest], len(begin)), _lists(word[rest], gram[rest], len(begin)))


def _begin_text(parts: Iterator[pa.RecordBatch], hand: tuple[np.ndarray, np.ndarray], schema: str) -> Iterator[pa.RecordBatch]:
    """Per text: its number of words, the sum and the largest of the ratios at hand, and its other words with how often they stand there."""
    row = TaskContext.get().partitionId() << 33
    for part in parts:
        data, starts = text_bytes(part.column(1))
        ids, held = part.column(0), part.column(2)
        for lo, hi in batches(starts, 1 << 20):
            own = data[starts[lo] : starts[hi]]
            own = np.where((own >= 65) & (own <= 90), own + 32, own).astype(np.uint8)
            found, n = Words(own, starts[lo : hi + 1] - starts[lo]), hi - lo
            hashes, text = signed(found.hash), found.text
            ratio = _look_up(hand, hashes)
            rest = np.isnan(ratio)
            total = np.bincount(text[~rest], ratio[~rest], n)
            here, whose = ratio[~rest], text[~rest]
            order = np.lexsort((-here, whose))
            here, whose = here[order], whose[order]
            top = np.arange(len(here)) - np.searchsorted(whose, whose) < TELLING
            other, of = hashes[rest], text[rest]
            order = np.lexsort((other, of))
            other, of = other[order], of[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), (other[1:] != other[:-1]) | (of[1:] != of[:-1]))))
            times = np.diff(np.append(first, len(of)))
            yield rows(schema, np.arange(row, row + n), ids.slice(lo, n), held.slice(lo, n), np.diff(found.first), total, _lists(whose[top], here[top], n), _lists(of[first], other[first], n), _lists(of[first], times, n))
            row += n


def _end_text(parts: Iterator[pa.RecordBatch], schema: str) -> Iterator[pa.RecordBatch]:
    for part in parts:
        words, total = (part.column(k).to_numpy() for k in (2, 3))
        telling, sums = np.zeros(len(words)), total.copy()
        for i, (top, more) in enumerate(zip(part.column(4), part.column(5), strict=True)):
            some = top.values.to_numpy()
            if len(more):
                ratio, times = more.values.field("ratio").to_numpy(), more.values.field("times").to_numpy()
                sums[i] += (ratio * times).sum()
                some = np.concatenate((some, np.repeat(ratio, np.minimum(times, TELLING))))
            telling[i] = np.sort(some)[-TELLING:].sum() / TELLING
        yield rows(schema, part.column(0), part.column(1), sums / np.maximum(words, 1), telling)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of the two measures and a constant, by Newton's method with a light penalty."""
    scale = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(2)
    z = np.concatenate([x / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(3)
        step = np.linalg.solve(h, z.T @ (y - p) - 0.01 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale[0]), float(w[1] / scale[1]), float(w[2])


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.withColumn("fold", (F.crc32(F.col("doc_id").cast("string")) % FOLDS).cast("int"))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from all labelled documents of parts 2 to 4; its score is calibrated on at most CALIBRATION of part 1.

    Words are counted by class, then n-grams of distinct words, all combined before the shuffles. Every n-gram stays, in tables of the
    shared folder; the driver receives the measures of the calibration rows and the ratios of at most AT_HAND words and n-grams.
    Rows with a null id or label count for nothing.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) != 0).alias("mark")).where("doc_id is not null and mark is not null").groupBy("doc_id").agg(F.max("mark").alias("mark"))
    known = _docs(df, id_col, text_col).join(marked, "doc_id")
    words = known.where("fold >= 2").select("text", "mark").mapInArrow(_word_counts, "word binary, toxic long, ordinary long")
    words = materialize(words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    schema = "order int, gram long, context long, short long, short_context long, toxic long, ordinary long"
    grams = words.mapInArrow(_gram_counts, schema).groupBy("order", "gram").agg(F.first("context").alias("context"), F.first("short").alias("short"), F.first("short_context").alias("short_context"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    grams = materialize(grams)
    model = Model(grams)
    forget(words, grams)
    some = marked.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION)
    docs = _docs(df, id_col, text_col).join(F.broadcast(some), "doc_id").select("doc_id", "text", F.lit(False).alias("held_out"))
    seen = model.measures(docs).join(F.broadcast(some), "doc_id").orderBy("doc_id").limit(2 * CALIBRATION).toPandas()
    model.weight = _logistic(seen[["mean", "telling"]].to_numpy(float).reshape(-1, 2), seen["mark"].to_numpy(float))
    return model


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row per input row; texts are not shuffled.

    A null, empty or blank text has the score of a text without evidence. A null id is never held out. Repeated rows stay; other
    columns are ignored; an empty table gives an empty table. Only the text decides the score.
    """
    docs = _docs(df, id_col, text_col).select("doc_id", "text", F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"))
    mean, telling, constant = (F.lit(float(w)) for w in model.weight)
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), mean * F.col("mean") + telling * F.col("telling") + constant))
    scored = model.measures(docs).withColumn("score", 1 / (1 + F.exp(-x)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
