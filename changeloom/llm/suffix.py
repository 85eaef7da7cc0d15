"""Suffix-array dedup: maximal repeats of a corpus from the interval tree of common prefixes."""

from __future__ import annotations

import math
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.blocks import PACK, blocks, by_document, mask, occurrences, places, rivals, windows
from changeloom.llm.common import batches, materialize, one_per_id, rows, text_bytes

#: Bytes of a repeat at least, and of an anchor.
BYTES, ANCHOR = 400, 100
#: Blocks under one anchor that one suffix array holds at most; more are told apart by their strings.
GROUP = 4096
#: Blocks that a task sorts together.
TASK = 20_000


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """The interval tree of a sorted list by a stack scan: depth, first and last member; ``prefixes[i]`` is what i shares with i-1."""
    stack = [(0, 0)]
    for i in range(1, len(prefixes) + 1):
        depth, first = prefixes[i] if i < len(prefixes) else 0, i - 1
        while stack[-1][0] > depth:
            below, first = stack.pop()
            yield below, first, i - 1
        if stack[-1][0] < depth:
            stack.append((depth, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats through a common anchor: bytes before it, bytes from it on, and all members that hold it.

    ``rights`` are the suffixes at the anchor, ``lefts`` what stands before it, reversed.
    Suffixes are sorted, the common prefixes of neighbours give the interval tree, and
    inside an interval the members are sorted by what stands before: a set is a
    repeat only if its members differ in their next byte to the left, and to the right.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    shared = [0] + [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    for depth, first, last in intervals(shared):
        need = max(0, least - depth)
        child, which = 0, {order[first]: 0}
        for k in range(first + 1, last + 1):
            child += shared[k] == depth
            which[order[k]] = child
        by_left = sorted(which, key=lefts.__getitem__)
        before = [0] + [common_prefix(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:])]
        found = list(intervals(before))
        if need == 0 and (not found or found[-1][1:] != (0, len(by_left) - 1)):
            found.append((0, 0, len(by_left) - 1))
        for back, lo, hi in found:
            members = by_left[lo : hi + 1]
            if back >= need and len({which[m] for m in members}) > 1:
                yield back, depth, members


def _contexts(parts: Iterator[pa.RecordBatch], window: int, schema: str) -> Iterator[pa.RecordBatch]:
    for part in parts:
        data, starts = text_bytes(part.column(1))
        ids, lists = part.column(0).to_numpy(), part.column(2)
        n = np.diff(lists.offsets.to_numpy())
        packed = lists.flatten()
        text = np.repeat(np.arange(len(ids)), n)
        place = packed.field("place").to_numpy()
        at, count = place // PACK, place % PACK
        begin = starts[text] + at
        whole = data.tobytes()
        yield rows(schema, packed.field("anchor"), ids[text], at, packed.field("inner"), [whole[b : b + c + window - 1] for b, c in zip(begin.tolist(), count.tolist(), strict=True)])


def _united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same numbers in as few ranges as hold them."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(set(ranges)):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def repeated_ranges(lefts: list[bytes], rights: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """For each member, how many bytes before the anchor its repeated strings of ``least`` bytes begin, as ranges: the union of all maximal repeats that hold it.

    The same array and scan as in ``maximal_repeats``, with memory in proportion to the members: an open interval of the stack holds its members by what stands before them, and when
    a child closes, the smaller of its list and its parent's is inserted into the other. A member's neighbours there share most bytes before the anchor with it, of all members of
    the interval, so only they are compared; the interval's depth is what they share from the anchor on.
    """
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    place = {m: k for k, m in enumerate(by_left)}
    found: list[list[tuple[int, int]]] = [[] for _ in lefts]

    def add(a: int, b: int, depth: int) -> None:
        back = common_prefix(lefts[by_left[a]], lefts[by_left[b]])
        if back + depth >= least:
            for m in (by_left[a], by_left[b]):
                found[m].append((max(0, least - depth), back))
                if len(found[m]) > 16:
                    found[m] = _united(found[m])

    def join(one: list[int], two: list[int], depth: int) -> list[int]:
        if len(one) < len(two):
            one, two = two, one
        for x in two:
            k = bisect(one, x)
            if k:
                add(one[k - 1], x, depth)
            if k < len(one):
                add(x, one[k], depth)
            one.insert(k, x)
        return one

    order = sorted(range(len(rights)), key=rights.__getitem__)
    stack: list[tuple[int, list[int]]] = []
    for k, m in enumerate(order):
        shared = common_prefix(rights[order[k - 1]], rights[m]) if k else 0
        members: list[int] | None = None
        while stack and stack[-1][0] > shared:
            depth, own = stack.pop()
            members = join(own, members, depth) if members is not None else own
        if stack and stack[-1][0] == shared and members is not None:
            stack[-1] = (shared, join(stack[-1][1], members, shared))
        elif members is not None:
            stack.append((shared, members))
        stack.append((len(rights[m]) + 1, [place[m]]))
    members = None
    while stack:
        depth, own = stack.pop()
        members = join(own, members, depth) if members is not None else own
    return [_united(f) for f in found]


def _search(least: int) -> Callable[[pa.Table], pa.Table]:
    def search(part: pa.Table) -> pa.Table:
        part = part.sort_by("anchor")
        anchor, ids, at, inner = (part.column(c).to_numpy() for c in ("anchor", "doc_id", "at", "inner"))
        texts = part.column("text").to_pylist()
        doc, begin, count = [], [], []
        for group in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(anchor)) + 1):
            members = group.tolist()
            lefts, rights = [texts[m][: inner[m]][::-1] for m in members], [texts[m][inner[m] :] for m in members]
            for m, found in zip(members, repeated_ranges(lefts, rights, least), strict=True):
                for near, far in found:
                    doc.append(ids[m])
                    begin.append(at[m] + inner[m] - far)
                    count.append(far - near + 1)
        return pa.Table.from_batches([rows("doc_id long, at long, count int", doc, begin, count)])

    return search


def repeats(docs: DataFrame, window: int = BYTES, run: int = ANCHOR) -> DataFrame:
    """Stretches of repeated bytes: ``doc_id, at, count``, ``count`` windows of ``window`` bytes from byte ``at``; all occurrences.

    A block found more than once is a repeat as a whole. Blocks that only share their anchor
    are the suffixes of an enhanced suffix array per anchor. Above GROUP blocks under one anchor their
    strings of ``window`` bytes are counted by a shuffle instead, so no group grows without bound.
    """
    found = occurrences(docs, "bytes", window, run)
    distinct = blocks(found)
    whole = found.join(distinct.where("n > 1").select("anchor", "content"), ["anchor", "content"], "left_semi").select("doc_id", "at", "count")
    several = materialize(rivals(distinct))
    few, many = several.where(F.col("rivals") <= GROUP), several.where(F.col("rivals") > GROUP)
    n, hot = several.agg(F.count("*"), F.count(F.when(F.col("rivals") > GROUP, 1))).first()
    schema = "anchor long, doc_id long, at long, inner int, text binary"
    texts = docs.join(places(few), "doc_id").select("doc_id", "text", "spans").mapInArrow(partial(_contexts, window=window, schema=schema), schema)
    task = F.pmod(F.xxhash64("anchor"), F.lit(max(1, math.ceil(n / TASK))))
    out = whole.unionByName(texts.groupBy(task.alias("task")).applyInArrow(_search(window), "doc_id long, at long, count int"))
    if hot:
        some = materialize(windows(docs, many, "bytes", window))
        twice = some.groupBy("anchor", "string").count().where("count > 1").select("anchor", "string")
        out = out.unionByName(some.join(twice, ["anchor", "string"], "left_semi").select("doc_id", "at", F.lit(1).alias("count")))
    return out


_MEMBERS = "group_id string, anchor long, doc_id long, at long, begin int, length int"


def _groups(least: int) -> Callable[[pa.Table], pa.Table]:
    def search(part: pa.Table) -> pa.Table:
        part = part.sort_by("anchor")
        anchor, ids, at, inner = (part.column(c).to_numpy() for c in ("anchor", "doc_id", "at", "inner"))
        texts = part.column("text").to_pylist()
        out = []
        for group in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(anchor)) + 1):
            members = group.tolist()
            lefts, rights = [texts[m][: inner[m]][::-1] for m in members], [texts[m][inner[m] :] for m in members]
            for k, (back, on, some) in enumerate(maximal_repeats(lefts, rights, least)):
                out += [(f"{anchor[members[0]]}:{k}", anchor[m], ids[m], at[m], inner[m] - back, back + on) for m in (members[x] for x in some)]
        return pa.Table.from_batches([rows(_MEMBERS, *(zip(*out, strict=True) if out else [[]] * 6))])

    return search


def repeat_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = BYTES, run: int = ANCHOR) -> DataFrame:
    """Groups of repeated strings of ``window`` bytes or more with all their occurrences: ``group_id, length, n, doc_id, at``, a row per occurrence, ``at`` in bytes.

    A group is as long as its bytes go on in the same places: bytes to the left or right differ between its occurrences, or are in a string of
    ``window`` bytes that stands in further places too and so belongs to another, larger group. Under an anchor groups are the maximal repeats of the suffix array
    (above GROUP blocks, strings counted by a shuffle), and blocks found more than once; an occurrence of a block is an occurrence of
    what was found in its first one. Neighbouring groups with the same occurrences, compared by a hash of their places relative to the first, are joined. Ids, nulls and
    repeated rows are as in ``remove_repeated_bytes``. The result has a row per occurrence of every group, which for
    repeats nested in each other is many; it is not made where only bytes are removed.
    """
    docs = one_per_id(df, id_col, text_col)
    found = occurrences(docs, "bytes", window, run)
    distinct = blocks(found)
    several = materialize(rivals(distinct))
    few, many = several.where(F.col("rivals") <= GROUP), several.where(F.col("rivals") > GROUP)
    schema = "anchor long, doc_id long, at long, inner int, text binary"
    texts = docs.join(places(few), "doc_id").select("doc_id", "text", "spans").mapInArrow(partial(_contexts, window=window, schema=schema), schema)
    task = F.pmod(F.xxhash64("anchor"), F.lit(max(1, math.ceil(several.count() / TASK))))
    members = texts.groupBy(task.alias("task")).applyInArrow(_groups(window), _MEMBERS)
    of = distinct.select("anchor", F.col("head.doc_id").alias("doc_id"), F.col("head.at").alias("at"), "content")
    parts = members.join(of, ["anchor", "doc_id", "at"]).select("group_id", "anchor", "content", "begin", "length")
    inside = parts.join(found, ["anchor", "content"]).select("group_id", "doc_id", (F.col("at") + F.col("begin")).alias("at"), "length")
    whole = found.join(distinct.where("n > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    whole = whole.select(F.concat_ws("/", "anchor", "content").alias("group_id"), "doc_id", "at", (F.col("count") + window - 1).cast("int").alias("length"))
    strings = windows(docs, many, "bytes", window).select(F.concat_ws("=", "anchor", "string").alias("group_id"), "doc_id", "at", F.lit(window).cast("int").alias("length"))
    hot = found.join(many.select("anchor", "content", "head"), ["anchor", "content"]).where("doc_id <> head.doc_id or at <> head.at")
    counted = strings.unionByName(_copies(strings, hot, window))
    twice = counted.groupBy("group_id").count().where("count > 1").select("group_id")
    every = materialize(inside.unionByName(whole).unionByName(counted.join(twice, "group_id", "left_semi")))
    head = F.min(F.struct("doc_id", "at"))
    first = every.groupBy("group_id").agg(head.alias("head"), F.first("length").alias("length"), F.count("*").alias("n"))
    shape = F.sum(F.xxhash64("doc_id", F.col("at") - F.col("head.at")) % (1 << 40))
    pieces = every.drop("length").join(first, "group_id").groupBy("group_id", "head", "length", "n").agg(shape.alias("shape"))
    row = Window.partitionBy("head.doc_id", "n", "shape").orderBy("head.at", "length")
    ends = F.max(F.col("head.at") + F.col("length")).over(row.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("head.at") > ends - (window - 1), F.lit(True)).cast("int")
    joined = pieces.withColumn("opens", opens).withColumn("chain", F.sum("opens").over(row))
    chains = joined.groupBy(F.col("head.doc_id").alias("doc"), "n", "shape", "chain").agg(F.min_by("group_id", F.col("head.at")).alias("group_id"), (F.max(F.col("head.at") + F.col("length")) - F.min("head.at")).cast("int").alias("length"))
    return every.drop("length").join(chains.select("group_id", "length", "n"), "group_id").select("group_id", "length", "n", "doc_id", "at")


def _copies(strings: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """The strings of later occurrences of hot blocks: those of the first one, moved."""
    moved = hot.select("doc_id", F.col("at").alias("to"), "count", F.col("head.doc_id").alias("from_id"), F.col("head.at").alias("from_at"))
    s = strings.select("group_id", F.col("doc_id").alias("from_id"), F.col("at").alias("s_at"), "length")
    both = moved.join(s, "from_id").where((F.col("s_at") >= F.col("from_at")) & (F.col("s_at") < F.col("from_at") + F.col("count")))
    return both.select("group_id", "doc_id", (F.col("to") + F.col("s_at") - F.col("from_at")).alias("at"), "length")


def _keep(parts: Iterator[pa.RecordBatch], window: int, schema: str) -> Iterator[pa.RecordBatch]:
    for part in parts:
        data, starts = text_bytes(part.column(1))
        lists, n_bytes, n_removed, n_spans, kept = part.column(2), [], [], [], []
        for i in range(len(starts) - 1):
            text, packed = data[starts[i] : starts[i + 1]], lists[i].values
            gone = mask(len(text), None if packed is None else packed.to_numpy(), window)
            n_bytes.append(len(text))
            n_removed.append(int(gone.sum()))
            n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            kept.append(text[~gone].tobytes())
        yield rows(schema, part.column(0), n_bytes, n_removed, n_spans, kept)


def remove_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = BYTES, run: int = ANCHOR) -> DataFrame:
    """Documents without the bytes that any string of ``window`` bytes with a second occurrence covers.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept``, a row per id. A text is its UTF-8 bytes,
    null is empty; what is left may cut a character. All occurrences go, the first too, in the same document or
    another, overlapping or not; strings are judged on the input and never cross documents. Texts shorter than a
    string lose nothing. Rows without an id go; of rows that repeat an id the text that sorts last counts. Other
    columns are ignored; an empty table gives an empty table.
    """
    docs = one_per_id(df, id_col, text_col)
    covered = by_document(repeats(docs, window, run))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    work = docs.join(covered, "doc_id", "left").select("doc_id", "text", "covered")
    return work.mapInArrow(partial(_keep, window=window, schema=schema), schema)
