"""Best-fit packing of token pieces with exact-complement hashing over the histogram of their lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import batches, materialize, rows, text_bytes, without_cycles
from changeloom.llm.wordbpe import vocabulary

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 4096, 1


def _cut(parts: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, schema: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path)
    for part in parts:
        starts = text_bytes(part.column(1))[1]
        for lo, hi in batches(starts, 1 << 22):
            with without_cycles():
                found, n = bpe.encode(part.column(1).slice(lo, hi - lo))
            last = np.cumsum(n + 1) - 1
            ids = np.full(len(found) + len(n), end, "<u4")
            inner = np.ones(len(ids), bool)
            inner[last] = False
            ids[inner] = found
            count = n // capacity + 1
            text = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, n[text] + 1 - start)
            begin = (last - n)[text] + start
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [part.column(0).take(pa.array(lo + text)), piece, start, length, crc]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids, pa.int64())))
            yield rows(schema, *columns)


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Token pieces of each text: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, the ``ids``; no shuffle.

    A text's ids are the tokenizer's without added special tokens, then ``end``; a string that spells a special token is that token, as in the
    library. A null or empty text is the one token ``end``. Only texts of more than ``capacity`` tokens are cut.
    A null id and repeated rows stay as they are; other columns are ignored.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    run = partial(_cut, path=tokenizer_path, capacity=capacity, end=end, schema=schema, with_ids=with_ids)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class _Stock:
    """How many pieces of each length are left, and the sums of one, two and three lengths that exist."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.n[length] = count
        self.capacity = capacity
        self.index()

    def index(self) -> None:
        """Index the sums of two lengths anew; those of three are a length and a sum of two."""
        self.there = self.n > 0
        size = 2 * (self.capacity + 1)
        wave = np.fft.rfft(self.there.astype(np.float64), size)
        self.two = np.fft.irfft(wave * wave, size)[: self.capacity + 1] > 0.5

    def enough(self, some: tuple[int, ...]) -> int:
        """How often these lengths are there together."""
        return min(int(self.n[x]) // some.count(x) for x in set(some))

    def exact(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap exactly, with what is held already; larger ones first."""
        left = self.n.copy()
        np.subtract.at(left, list(held), 1)
        if left[gap] > 0:
            return (gap,)
        if a := self.pair(gap, left):
            return a, gap - a
        for a in np.flatnonzero((left[1:gap] > 0) & self.two[gap - 1 : 0 : -1])[::-1].tolist():
            left[a + 1] -= 1
            if b := self.pair(gap - a - 1, left):
                return a + 1, b, gap - a - 1 - b
            left[a + 1] += 1
        return None

    @staticmethod
    def pair(gap: int, left: np.ndarray) -> int:
        """The larger of two lengths left that fill the gap, the largest there is; 0 if there are none."""
        there = left[:gap] > 0
        both = there[1:] & there[:0:-1]
        if gap % 2 == 0 and gap:
            both[gap // 2 - 1] &= left[gap // 2] > 1
        found = np.flatnonzero(both)
        return int(found[-1]) + 1 if len(found) else 0

    def largest(self, gap: int, held: tuple[int, ...]) -> int:
        """The longest piece that fits, 0 if none does."""
        for x in np.flatnonzero(self.there[: gap + 1])[::-1].tolist():
            if self.enough((*held, x)):
                return x
        return 0


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """How often to fill a sequence with which lengths, for ``counts`` pieces of each length up to ``capacity``.

    A sequence starts with the longest piece left. Its gap is looked up among the lengths, the sums of two and
    of three; a combination that fills it exactly is taken, else the best fit, the longest piece that fits, and the smaller gap is
    looked up again. The sequence is used as often as its lengths are there, so each step uses up a length or nearly: work and
    memory depend on ``capacity``, not on the number of pieces.
    """
    stock, out = _Stock(counts, capacity), []
    while stock.there.any():
        held: tuple[int, ...] = (int(np.flatnonzero(stock.there)[-1]),)
        gap = capacity - held[0]
        while gap:
            if (some := stock.exact(gap, held)) is None:
                if not (x := stock.largest(gap, held)):
                    break
                some = (x,)
            held += some
            gap -= sum(some)
        times = stock.enough(held)
        out.append((times, held))
        for x in held:
            stock.n[x] -= times
        stock.index()
    return out


def slots(planned: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: length, first rank, last rank, first sequence, pieces a sequence, first offset."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, some in planned:
        offset = 0
        for n in sorted(set(some), reverse=True):
            per, rank = some.count(n), used.get(n, 0)
            out.append((n, rank, rank + per * times - 1, sequence, per, offset))
            used[n] = rank + per * times
            offset += per * n
        sequence += times
    return out


def _placed(parts: Iterator[pa.RecordBatch], found: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = found[:, 0] << 40 | found[:, 1]
    for part in parts:
        length, rank = part.column("length").to_numpy(), part.column("rank").to_numpy()
        own = found[np.searchsorted(keys, length << 40 | rank, "right") - 1].reshape(-1, 6)
        nth = rank - own[:, 1]
        per = np.maximum(own[:, 4], 1)
        columns = [*part.columns[:-1], pa.array(own[:, 3] + nth // per), pa.array(own[:, 5] + nth % per * length)]
        yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "sequence_id", "offset"])


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a place in as few sequences of ``capacity`` tokens as the method finds.

    Adds ``sequence_id`` and ``offset``, gapless from 0 in every sequence, to a table with a ``length`` from 1 to
    ``capacity``. The driver sees the histogram of lengths only, at most ``capacity`` rows, and plans on it. Pieces of
    one length are interchangeable: each gets a rank among them, from counts per partition
    and length, so that no length is gathered in one task. The plan goes to the tasks: a row per length in a
    pattern of lengths, at most a few times ``capacity``, whatever the number of pieces. An empty table gives an empty table.
    """
    own = materialize(cut.withColumn("part", F.spark_partition_id()))
    counted = own.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    start = counted.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = own.join(start, ["length", "part"]).withColumn("rank", F.col("before") + rank - 1)
    columns = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    schema = T.StructType([*[cut.schema[c] for c in columns], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    found = np.array(slots(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    return ranked.select(*columns, F.col("rank").alias("rank")).mapInArrow(partial(_placed, found=found[np.lexsort((found[:, 1], found[:, 0]))]), schema)
