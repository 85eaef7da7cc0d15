"""Ranked lexical search: hashed max-sketches of documents bound their scores, and documents are rescored exactly in the order of their bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.common import Words, batches, materialize, one_per_id, rows, signed, text_bytes

#: Cells of a sketch for each distinct term of its document, and in how many of them each term is folded.
CELLS, FOLDS = 12, 6
#: Items that are searched together, and bytes of their texts, at most.
BLOCK, BLOCK_TEXT = 1024, 1 << 23
#: Documents of an item that the first round rescores; each further round takes WIDER times as many, and all items together at most PAIRS.
FIRST, WIDER, PAIRS = 64, 8, 400_000
#: A cell holds a count up to this; one that is full stands for any count.
FULL = 255
#: Bytes of terms: ASCII letters and digits, and all that is not ASCII.
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_U = np.uint64
_SKETCH = "doc_id long, n long, sketch binary"


def term_counts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: the number of terms of each; and for each text and distinct term the text, the term's hash and its count."""
    found = Words(data, starts, lower=True, ink=_TERM)
    order = np.lexsort((found.hash, found.text))
    term, text = found.hash[order], found.text[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(term)), bool), (term[1:] != term[:-1]) | (text[1:] != text[:-1]))))
    return np.diff(found.first), text[head], term[head], np.diff(np.append(head, len(term)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What ``tf`` occurrences of a term of weight 1 add to a score; it rises with ``tf``."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_factor(n: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """``m`` of documents of ``n`` terms, from the number of documents with terms and the number of all their terms."""
    return 25 + 75 * n * size[0] // size[1]


def _cell(term: np.ndarray, k: int, width: np.ndarray | int) -> np.ndarray:
    """The k-th cell of terms in sketches of some width."""
    return ((term + _U(k) * ((term >> _U(32)) | _U(1))) % _U(width) if isinstance(width, int) else (term + _U(k) * ((term >> _U(32)) | _U(1))) % width).astype(np.int64)


def _sketches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        data, starts = text_bytes(part.column(1))
        for lo, hi in batches(starts):
            n, text, term, tf = term_counts(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
            width = CELLS * np.bincount(text, minlength=hi - lo)
            at = np.concatenate(([0], np.cumsum(width)))
            cells = np.zeros(at[-1], np.uint8)
            for k in range(FOLDS):
                np.maximum.at(cells, at[text] + _cell(term, k, width[text].astype(_U)), np.minimum(tf, FULL).astype(np.uint8))
            sketch = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(cells)])
            yield rows(_SKETCH, part.column(0).slice(lo, hi - lo), n, sketch)


def sketch_index(docs: DataFrame) -> DataFrame:
    """``doc_id, n, sketch`` of each row of ``doc_id, text`` with a term, written to the shared folder.

    A sketch has CELLS cells for each distinct term. A term's count is folded into FOLDS of them, and a cell keeps the largest,
    so the least of a term's cells is never below its count. Sketches depend on no query and on no other document.
    """
    return materialize(docs.mapInArrow(_sketches, _SKETCH).where("n > 0"))


@dataclass
class Asked:
    """A block of items: their distinct terms in order, and who asks for each how often."""

    ids: np.ndarray
    terms: np.ndarray
    start: np.ndarray  # of each term in who and times, with one more at the end
    who: np.ndarray
    times: np.ndarray
    weight: np.ndarray
    size: tuple[int, int]

    def scores(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """What terms, by place, with these values add up to for each item."""
        count = self.start[at + 1] - self.start[at]
        all_ = np.repeat(self.start[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.bincount(self.who[all_], np.repeat(value, count) * self.times[all_], len(self.ids)).astype(np.int64)


def ask(ids: list[int], texts: list[str | None]) -> Asked:
    data, starts = text_bytes(pa.array(texts, pa.large_string()))
    _, item, term, tf = term_counts(data, starts)
    order = np.lexsort((item, term))
    terms, start = np.unique(term[order], return_index=True)
    return Asked(np.array(ids, np.int64), terms, np.append(start, len(term)), item[order], tf[order], np.zeros(len(terms), np.int64), (0, 1))


def _places(asked: Asked, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which terms the items ask for, and their places."""
    if not len(asked.terms):
        return np.zeros(len(term), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(asked.terms, term), len(asked.terms) - 1)
    hit = asked.terms[at] == term
    return hit, at[hit]


def _frequencies(parts: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(asked.terms), np.int64)
    for part in parts:
        data, starts = text_bytes(part.column(0))
        for lo, hi in batches(starts):
            found = Words(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], lower=True, ink=_TERM)
            hit, at = _places(asked, found.hash)
            total += np.bincount(np.unique(found.text[hit] * len(asked.terms) + at) % max(1, len(asked.terms)), minlength=len(asked.terms))
    some = np.flatnonzero(total)
    yield rows("term int, n long", some.astype(np.int32), total[some])


def weighed(asked: Asked, docs: DataFrame, size: tuple[int, int]) -> Asked:
    """The block with the weight of each term, from the number of documents that hold it: one pass over the texts."""
    found = docs.select("text").mapInArrow(partial(_frequencies, asked=asked), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    weight = found.select("term", F.floor(1000 * F.log((2.0 * size[0] + 2) / (2.0 * F.col("n") + 1))).alias("weight")).toArrow()
    out = np.zeros(len(asked.terms), np.int64)
    out[weight.column(0).to_numpy()] = weight.column(1).to_numpy()
    return replace(asked, weight=out, size=size)


@dataclass
class Found:
    """What rounds know of each item of a block: where its bounds have been read to, and the score and document that a further one must beat."""

    bound: np.ndarray  # bound and document of the last pair that was rescored
    doc: np.ndarray
    least: np.ndarray
    least_doc: np.ndarray
    open: np.ndarray

    @classmethod
    def none(cls, n: int) -> Found:
        top = np.iinfo(np.int64).max
        return cls(np.full(n, top), np.full(n, -top), np.zeros(n, np.int64), np.full(n, -top), np.ones(n, bool))


def _best(item: np.ndarray, bound: np.ndarray, doc: np.ndarray, most: int) -> np.ndarray:
    """Places of each item's pairs of largest bound, at most ``most``, the smaller document first of equals."""
    order = np.lexsort((doc, -bound, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < most]


def _bounds(parts: Iterator[pa.RecordBatch], asked: Asked, found: Found, most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of item and document, largest bounds first, at most ``most`` an item and partition, of those not yet rescored that may still be among the best."""
    held = [np.zeros(0, np.int64) for _ in range(3)]
    floor = np.where(found.open, found.least, np.iinfo(np.int64).max)
    for part in parts:
        data, starts = text_bytes_of(part.column(2))
        ids, m = part.column(0).to_numpy(), length_factor(part.column(1).to_numpy(), asked.size)
        new: list[list[np.ndarray]] = [[], [], []]
        for i in range(len(ids)):
            sketch = data[starts[i] : starts[i + 1]]
            at, code = np.arange(len(asked.terms)), None
            for k in range(FOLDS):
                here = sketch[_cell(asked.terms[at], k, len(sketch))]
                code = here if code is None else np.minimum(code, here)
                alive = code > 0
                at, code = at[alive], code[alive]
            tf = code.astype(np.int64)
            value = np.where(tf < FULL, impact(tf, m[i]), 1_000_000)
            bound = asked.scores(at, asked.weight[at] * value)
            doc = ids[i]
            fits = (bound > floor) | (bound == floor) & (doc < found.least_doc) | (bound == floor) & (floor > found.least)
            fits &= (bound > 0) & ((bound < found.bound) | (bound == found.bound) & (doc > found.doc))
            some = np.flatnonzero(fits)
            for c, x in zip(new, (some, bound[some], np.full(len(some), doc)), strict=True):
                c.append(x)
        held = [np.concatenate((h, *n)) for h, n in zip(held, new, strict=True)]
        keep = _best(*held, most)
        held = [h[keep] for h in held]
        count = np.bincount(held[0], minlength=len(floor))
        last = np.cumsum(count)[count == most] - 1  # the least of a full item
        floor[held[0][last]] = np.maximum(floor[held[0][last]], held[1][last])
    yield rows("item int, bound long, doc_id long", held[0].astype(np.int32), held[1], held[2])


def text_bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and where each value starts, with one more start at the end."""
    whole = column.cast(pa.large_binary())
    starts = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, starts


def _rescored(parts: Iterator[pa.RecordBatch], asked: Asked, item: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Exact scores of pairs, which are sorted by document, from the texts of their documents."""
    for part in parts:
        ids = part.column(0).to_numpy()
        first, last = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
        wanted = np.flatnonzero(last > first)
        data, starts = text_bytes(part.column(1).take(pa.array(wanted)))
        for lo, hi in batches(starts):
            n, text, term, tf = term_counts(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
            hit, at = _places(asked, term)
            text, tf = text[hit], tf[hit]
            value = asked.weight[at] * impact(tf, length_factor(n, asked.size)[text])
            edge = np.searchsorted(text, np.arange(hi - lo + 1))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i in range(hi - lo):
                own = item[first[wanted[lo + i]] : last[wanted[lo + i]]]
                score = asked.scores(at[edge[i] : edge[i + 1]], value[edge[i] : edge[i + 1]])[own]
                out.append((own, np.full(len(own), ids[wanted[lo + i]]), score))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield rows("item int, doc_id long, score long", columns[0].astype(np.int32), *columns[1:])


def _search_block(asked: Asked, docs: DataFrame, sketches: DataFrame, top: int) -> list[tuple[int, int, int, int]]:
    """Rows of ``item_id, rank, doc_id, score``: rounds over bounds in descending order until no bound is left that beats an item's last place."""
    n = len(asked.ids)
    found, most = Found.none(n), FIRST
    best = [np.zeros(0, np.int64) for _ in range(3)]
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
    while found.open.any():
        most = max(1, min(most, PAIRS // int(found.open.sum())))
        pairs = sketches.mapInArrow(partial(_bounds, asked=asked, found=found, most=most), "item int, bound long, doc_id long")
        pairs = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n").toArrow()
        item, bound, doc = (pairs.column(k).to_numpy().astype(np.int64) for k in range(3))
        by = np.lexsort((item, doc))
        scored = docs.mapInArrow(partial(_rescored, asked=asked, item=item[by], doc=doc[by]), "item int, doc_id long, score long").toArrow() if len(by) else None
        if scored is not None:
            best = [np.concatenate((b, scored.column(k).to_numpy())) for b, k in zip(best, (0, 2, 1), strict=True)]
        real = best[1] > 0
        keep = _best(*(b[real] for b in best), top)
        best = [b[real][keep] for b in best]
        count = np.bincount(item, minlength=n)
        found.open &= count == most
        by = np.lexsort((-doc, bound, item))  # the last pair of each item first
        who, at = np.unique(item[by], return_index=True)
        found.bound[who], found.doc[who] = bound[by][at], doc[by][at]
        full = np.bincount(best[0], minlength=n) == top
        last = np.cumsum(np.bincount(best[0], minlength=n))[full] - 1
        found.least[full], found.least_doc[full] = best[1][last], best[2][last]
        most *= WIDER
    rank = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) + 1
    return list(zip(asked.ids[best[0]].tolist(), rank.tolist(), best[2].tolist(), best[1].tolist(), strict=True))


def search(df: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of highest score above 0 for each item, the smaller id first of equals.

    Terms are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII, told apart by 64-bit hashes. Null and empty texts have none,
    count for nothing and are never found; an item without terms has no rows. Rows without an id go, on both sides; of rows that repeat an id the text that sorts
    last counts. Other columns are ignored; empty tables give an empty table.

    One pass over the texts writes a sketch per document, one counts the documents of each term that a block of items asks for. Each round then
    reads the sketches for the largest bounds and the texts of the documents that these name. Bounds are never below scores, so the result is exact; looser ones only cost rounds.
    Items are searched in blocks of about BLOCK; the driver holds a block's items, its pairs of a round (PAIRS at most) and its results.
    """
    spark = df.sparkSession
    docs = one_per_id(df, id_col, text_col)
    asked = one_per_id(items, item_id, item_text)
    sketches = sketch_index(docs)
    size = sketches.agg(F.count("*"), F.sum("n")).first()
    schema = "item_id long, rank int, doc_id long, score long"
    held = asked.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = -(-held[0] // BLOCK) + (held[1] or 0) // BLOCK_TEXT
    out = spark.createDataFrame([], schema)
    if not size[0]:
        return out
    for k in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k).orderBy("doc_id").collect()
        block = weighed(ask([r.doc_id for r in some], [r.text for r in some]), docs, (size[0], size[1]))
        answer = spark.createDataFrame(_search_block(block, docs, sketches, top), schema)
        out = answer if blocks == 1 else out.unionByName(materialize(answer))
    return out
