"""Blocks of repeated text as tables: what substring dedup and suffix-array dedup share.

A block is a distinct anchor span (see ``anchors``): ``anchor, content`` identify it in
128 bits, its head is its first occurrence. Windows of two different blocks can only be
equal under one anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.anchors import spans
from changeloom.llm.common import Sums, Words, batches, byte_values, forget, materialize, rows, signed, text_bytes

#: A place and a number of windows in one long.
PACK = 1 << 12
_OCCURRENCE = "anchor long, content long, doc_id long, at long, count int, inner int"


def sequences(column: pa.Array, unit: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The elements of a batch's texts (bytes or words) as 64-bit values, in parts: first text, values, starts."""
    data, starts = text_bytes(column)
    for lo, hi in batches(starts):
        part, own = data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
        if unit == "words":
            found = Words(part, own)
            yield lo, found.hash, found.first
        else:
            yield lo, byte_values(part), own


def _scan(parts: Iterator[pa.RecordBatch], unit: str, window: int, run: int) -> Iterator[pa.RecordBatch]:
    for part in parts:
        ids = part.column(0).to_numpy()
        for lo, values, starts in sequences(part.column(1), unit):
            for x in spans(values, starts, window, run):
                yield rows(_OCCURRENCE, signed(x.anchor), signed(x.content), ids[lo + x.text], x.at, x.count.astype(np.int32), x.inner.astype(np.int32))


def occurrences(docs: DataFrame, unit: str, window: int, run: int) -> DataFrame:
    """Spans whose anchor occurs more than once: ``anchor, content, doc_id, at, count, inner``, written to the shared folder.

    The others cannot hold a repeated window. Counts are combined before their shuffle. They are a table of their own, so that
    adaptive execution can split an anchor that very many texts have; the join's right side has each anchor once.
    """
    found = docs.select("doc_id", "text").mapInArrow(partial(_scan, unit=unit, window=window, run=run), _OCCURRENCE)
    shared = materialize(found.groupBy("anchor").count().where("count > 1").select("anchor"))
    out = materialize(found.join(shared, "anchor", "left_semi"))
    forget(shared)
    return out


def blocks(found: DataFrame) -> DataFrame:
    """Distinct blocks: ``anchor, content, n, head (doc_id, at), count, inner``, written to the shared folder."""
    head = F.min(F.struct("doc_id", "at"))
    return materialize(found.groupBy("anchor", "content").agg(F.count("*").alias("n"), head.alias("head"), F.first("count").alias("count"), F.first("inner").alias("inner")))


def rivals(distinct: DataFrame) -> DataFrame:
    """Blocks that share their anchor with another block, with the number of these as ``rivals``."""
    several = distinct.groupBy("anchor").agg(F.count("*").alias("rivals")).where("rivals > 1")
    return distinct.join(several, "anchor")


def _windows(parts: Iterator[pa.RecordBatch], unit: str, window: int) -> Iterator[pa.RecordBatch]:
    schema = "anchor long, string long, doc_id long, at long"
    for part in parts:
        ids, lists = part.column(0).to_numpy(), part.column(2)
        offsets, packed = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        anchors, place = packed.field("anchor").to_numpy(), packed.field("place").to_numpy()
        for lo, values, starts in sequences(part.column(1), unit):
            hi = lo + len(starts) - 1
            some = slice(offsets[lo], offsets[hi])
            text = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
            at, count = place[some] // PACK, place[some] % PACK
            each = np.repeat(np.arange(len(at)), count)
            own = at[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            begin = starts[text[each]] + own
            yield rows(schema, anchors[some][each], signed(Sums(values).hashes(begin, begin + window)), ids[lo + text[each]], own)


def places(of: DataFrame) -> DataFrame:
    """The heads of some blocks by document: ``doc_id, spans``; as many as a text has spans at most."""
    place = F.struct("anchor", (F.col("head.at") * PACK + F.col("count")).alias("place"), "inner")
    return of.groupBy(F.col("head.doc_id").alias("doc_id")).agg(F.collect_list(place).alias("spans"))


def windows(docs: DataFrame, of: DataFrame, unit: str, window: int) -> DataFrame:
    """Every window of the heads of some blocks: ``anchor, string, doc_id, at``; anchor and string identify its content."""
    work = docs.join(places(of), "doc_id").select("doc_id", "text", "spans")
    return work.mapInArrow(partial(_windows, unit=unit, window=window), "anchor long, string long, doc_id long, at long")


def by_document(covered: DataFrame) -> DataFrame:
    """Covered places ``doc_id, at, count`` as one list a document."""
    return covered.groupBy("doc_id").agg(F.collect_list(F.col("at") * PACK + F.col("count")).alias("covered"))


def mask(n: int, packed: np.ndarray | None, window: int) -> np.ndarray:
    """Which of ``n`` elements the given windows cover."""
    if packed is None or not len(packed):
        return np.zeros(n, bool)
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, packed // PACK, 1)
    np.add.at(steps, packed // PACK + packed % PACK + window - 1, -1)
    return np.cumsum(steps[:n]) > 0
