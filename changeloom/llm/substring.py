"""Substring dedup by greedy relative Lempel-Ziv parsing against reference blocks under content-defined anchors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.blocks import PACK, blocks, occurrences, rivals, windows
from changeloom.llm.common import Words, batches, forget, materialize, one_per_id, rows, text_bytes

#: Words of a factor at least, and of an anchor.
WORDS, ANCHOR = 20, 5
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def matches(docs: DataFrame, window: int = WORDS, run: int = ANCHOR) -> DataFrame:
    """Per document, the windows that the reference holds and where: ``doc_id, found``, a list of ``place, source_id, source_at``, written to the shared folder.

    The reference is the first occurrence of every distinct block, indexed by the block's anchor. A block that stood earlier is found
    as a whole, at its first occurrence. Of a block that is new as a whole, each window is looked up among those of all reference blocks
    under its anchor, and found where it stands first. Only places before the window itself count.
    """
    found = occurrences(docs, "words", window, run)
    distinct = blocks(found)
    source = [F.col("head.doc_id").alias("source_id"), F.col("head.at").alias("source_at")]
    again = found.join(distinct.where("n > 1").select("anchor", "content", "head"), ["anchor", "content"])
    whole = again.where("doc_id <> head.doc_id or at <> head.at").select("doc_id", "at", "count", *source)
    some = materialize(windows(docs, rivals(distinct), "words", window))
    first = some.groupBy("anchor", "string").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.count("*").alias("n")).where("n > 1")
    later = some.join(first, ["anchor", "string"]).where("doc_id <> head.doc_id or at <> head.at")
    every = whole.unionByName(later.select("doc_id", "at", F.lit(1).alias("count"), *source))
    place = (F.col("at") * PACK + F.col("count")).alias("place")
    out = materialize(every.groupBy("doc_id").agg(F.collect_list(F.struct(place, "source_id", "source_at")).alias("found")))
    forget(found, distinct, some)
    return out


class Parse(NamedTuple):
    """The factors of a document in their order: first word, words, source document, source word, and whether a factor was found at a boundary."""

    at: np.ndarray
    words: np.ndarray
    source_id: np.ndarray
    source_at: np.ndarray
    boundary: np.ndarray


def parse(place: np.ndarray, source_id: np.ndarray, source_at: np.ndarray, window: int) -> Parse:
    """Greedy parse of a document against the reference, from its windows with a place there.

    The walk goes from the left. Where the window at a word has a place, the factor from there is as long as the following windows
    stand one after another in that source, and the walk goes on behind it; a word without one is a literal. The windows that begin in
    a factor and end behind it are in no factor: they are checked too, and those that have a place, in runs, are
    factors at a boundary. So every factor has ``window`` words or more, and each window with a place is in one.
    """
    order = np.argsort(place)
    at, count, source_id, source_at = place[order] // PACK, place[order] % PACK, source_id[order], source_at[order]
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + count[:-1]) | (source_id[1:] != source_id[:-1]) | (source_at[1:] - source_at[:-1] != at[1:] - at[:-1])
    first = np.flatnonzero(opens)
    out = []
    free = 0  # where the walk is
    for k, lo, n in zip(first.tolist(), at[first].tolist(), (np.add.reduceat(count, first) if len(first) else count).tolist(), strict=True):
        hi = lo + n
        begin = min(max(lo, free), hi)
        if begin > lo:
            out.append((lo, begin - lo + window - 1, source_id[k], source_at[k], True))
        if begin < hi:
            free = hi + window - 1
            out.append((begin, free - begin, source_id[k], source_at[k] + begin - lo, False))
    at, words, source_id, source_at, boundary = zip(*out, strict=True) if out else [()] * 5
    return Parse(*(np.array(x, np.int64) for x in (at, words, source_id, source_at)), np.array(boundary, bool))


def _parsed(parts: Iterator[pa.RecordBatch], window: int, schema: str) -> Iterator[pa.RecordBatch]:
    for part in parts:
        found = [_parse_of(x, window) for x in part.column(1)]
        columns = [np.concatenate([getattr(f, c) for f in found]) for c in Parse._fields]
        yield rows(schema, np.repeat(part.column(0).to_numpy(), [len(f.at) for f in found]), *columns)


def _parse_of(found: pa.ListScalar, window: int) -> Parse:
    values = found.values
    if values is None or not len(values):
        return parse(*[np.zeros(0, np.int64)] * 3, window)
    return parse(*(values.field(k).to_numpy() for k in range(3)), window)


def factors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WORDS, run: int = ANCHOR) -> DataFrame:
    """The factors of all documents, ``doc_id, at, words, source_id, source_at, boundary``; ids, nulls and repeated rows as in ``remove_repeats``."""
    schema = "doc_id long, at long, words long, source_id long, source_at long, boundary boolean"
    return matches(one_per_id(df, id_col, text_col), window, run).mapInArrow(partial(_parsed, window=window, schema=schema), schema)


def covered(factor: Parse, n: int) -> np.ndarray:
    """Which of a document's ``n`` words are in a factor."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, factor.at, 1)
    np.add.at(steps, factor.at + factor.words, -1)
    return np.cumsum(steps[:n]) > 0


def _keep(parts: Iterator[pa.RecordBatch], window: int, schema: str, spaced: bool) -> Iterator[pa.RecordBatch]:
    for part in parts:
        data, starts = text_bytes(part.column(1))
        lists, n_words, n_removed, kept = part.column(2), [], [], []
        for lo, hi in batches(starts):
            own, at = data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
            found = Words(own, at)
            for i in range(hi - lo):
                begin, end = found.begin[found.first[i] : found.first[i + 1]] - at[i], found.end[found.first[i] : found.first[i + 1]] - at[i]
                gone = covered(_parse_of(lists[lo + i], window), len(begin))
                text = own[at[i] : at[i + 1]]
                n_words.append(len(begin))
                n_removed.append(int(gone.sum()))
                if spaced and not gone.any():
                    kept.append(text.tobytes())
                    continue
                begin, end = begin[~gone], end[~gone]
                steps = np.zeros(len(text) + 2, np.int8)
                steps[begin] += 1
                steps[end + 1] -= 1
                line = np.append(text, np.uint8(32))
                line = np.where(_SPACES[line], np.uint8(32), line) if not spaced else line
                kept.append(line[np.cumsum(steps[: len(line)], dtype=np.int8) > 0][:-1].tobytes())
        yield rows(schema, part.column(0), n_words, n_removed, kept)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WORDS, run: int = ANCHOR, spaced: bool = False) -> DataFrame:
    """Documents without the words that a window of ``window`` words, found earlier, covers: ``doc_id, n_words, n_removed, kept``.

    Words are runs of other than U+0020 and U+0009 to U+000D, unchanged. Earlier is a smaller id,
    or an earlier word of the same document; windows are judged on the input. ``kept`` is
    UTF-8: the words left, joined by one space; with ``spaced`` each word left keeps
    the white space character after it, and a text that loses nothing is as it was. Null and empty texts, and those with fewer
    words than a window, lose nothing; null counts as empty. Rows without an id go; of rows that repeat an id
    the text that sorts last counts. Other columns are ignored; an empty table gives an empty table.

    Each document is parsed into factors (see ``parse``); their words go. A window is known by 128 bits of hashes, a word by 64. No group is
    gathered: first occurrences are combined before the shuffle, so a passage that stands in a third
    of all documents costs as much per occurrence as any.
    """
    docs = one_per_id(df, id_col, text_col)
    schema = "doc_id long, n_words long, n_removed long, kept binary"
    work = docs.join(matches(docs, window, run), "doc_id", "left").select("doc_id", "text", "found")
    return work.mapInArrow(partial(_keep, window=window, schema=schema, spaced=spaced), schema)


def digest(kept: DataFrame) -> DataFrame:
    """The kept bytes as a lowercase SHA-256."""
    return kept.select(*[c for c in kept.columns if c != "kept"], F.sha2("kept", 256).alias("kept_sha256"))
