"""Byte-level BPE on padded matrices: encoding and decoding of whole texts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import rows, without_cycles

_U = np.uint64
#: Words whose ids a Python worker keeps between batches.
CACHE_WORDS = 400_000
#: Cells of a matrix of words; a word longer than LONG is a matrix of one row, which merges several places in a round.
CELLS, LONG = 1 << 18, 2048
_NONE = np.int32(0x7FFFFFFF)
#: The white space of the tokenizer's own pattern language, which lacks U+001C to U+001F.
WHITE = r"\t\n\x0b\f\r \x85\xa0  -     　"


class Pairs:
    """Merge ranks and results by pair of ids, in an open hash table that is probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(8, int(len(rank) * 3).bit_length())
        self.shift, self.size = _U(64 - bits), 1 << bits
        self.keys = np.full(self.size, np.iinfo(np.int64).max, np.int64)
        self.rank = np.full(self.size, _NONE, np.int32)
        self.merged = np.zeros(self.size, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == np.iinfo(np.int64).max
            self.keys[at[todo][free]] = keys[todo][free]  # of several for one place the last stays
            placed = self.keys[at[todo]] == keys[todo]
            self.rank[at[todo][placed]] = rank[todo][placed]
            self.merged[at[todo][placed]] = merged[todo][placed]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & (self.size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and merged id of each pair; a negative id is in no pair."""
        keys = left.astype(np.int64) << 32 | right
        at = self._home(keys)
        found = self.keys[at]
        wrong = np.flatnonzero((found != keys) & (found != np.iinfo(np.int64).max))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (self.size - 1)
            found = self.keys[at[wrong]]
            wrong = wrong[(found != keys[wrong]) & (found != np.iinfo(np.int64).max)]
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], _NONE), self.merged[at]

    def merge_all(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words one after another and their lengths, after all merges.

        Words of like length are rows of a padded matrix. Each round merges, in every row, the
        leftmost pair of least rank, looks up the two pairs beside it, closes the gap, and
        drops the rows that have no pair left.
        """
        start = np.cumsum(length) - length
        out, size = symbols.copy(), length.copy()
        order = np.argsort(length, kind="stable")
        ordered = length[order]
        k = int(np.searchsorted(ordered, 1, "right"))
        while k < len(order):
            longest = int(ordered[k])
            if longest > LONG:
                w = order[k]
                ids = self._one(symbols[start[w] : start[w] + longest])
                out[start[w] : start[w] + len(ids)], size[w] = ids, len(ids)
                k += 1
                continue
            width = longest + longest // 4
            stop = min(int(np.searchsorted(ordered, width, "right")), k + max(1, CELLS // width))
            self._bucket(symbols, start, order[k:stop], out, size)
            k = stop
        place = np.arange(len(symbols)) - np.repeat(start, length)
        return out[place < np.repeat(size, length)], size

    def _bucket(self, symbols: np.ndarray, start: np.ndarray, row: np.ndarray, out: np.ndarray, length: np.ndarray) -> None:
        size = length[row]
        width = int(size.max())
        columns = np.arange(width + 1)
        inside = columns[None, :] < size[:, None]
        ids = np.full((len(row), width + 1), -1, np.int32)
        ids[inside] = symbols[(start[row][:, None] + columns[None, :])[inside]]
        rank, merged = self.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        rank, merged = rank.reshape(len(row), width), merged.reshape(len(row), width)
        while len(row):
            at = np.arange(len(row))
            best = rank.argmin(axis=1)
            more = rank[at, best] != _NONE
            if not more.all():
                done = ~more
                inside = columns[None, : ids.shape[1]] < size[done][:, None]
                out[(start[row[done]][:, None] + columns[None, : ids.shape[1]])[inside]] = ids[done][inside]
                length[row[done]] = size[done]
                row, size, ids, rank, merged, best = row[more], size[more], ids[more], rank[more], merged[more], best[more]
                if not len(row):
                    return
                at = np.arange(len(row))
            ids[at, best] = merged[at, best]
            w = int(size.max())
            keep = np.ones((len(row), w + 1), bool)
            keep[at, best + 1] = False
            ids = ids[:, : w + 1][keep].reshape(len(row), w)
            rank, merged = rank[:, :w], merged[:, :w]
            keep = keep[:, 1:]
            rank, merged = rank[keep].reshape(len(row), w - 1), merged[keep].reshape(len(row), w - 1)
            size -= 1
            before = np.maximum(best - 1, 0)
            left = np.where(best > 0, ids[at, before], -1)
            here = ids[at, best]
            pair_rank, pair = self.look_up(np.concatenate([left, here]), np.concatenate([here, ids[at, np.minimum(best + 1, w - 1)]]))
            n = len(row)
            last = best >= w - 1
            rank[at[best > 0], before[best > 0]], merged[at[best > 0], before[best > 0]] = pair_rank[:n][best > 0], pair[:n][best > 0]
            rank[at[~last], best[~last]], merged[at[~last], best[~last]] = pair_rank[n:][~last], pair[n:][~last]

    def _one(self, ids: np.ndarray) -> np.ndarray:
        """The same merges for a matrix of one row: a round merges all places of least rank, from the left, that do not overlap.

        That is what one place after another gives as long as no pair that a merge makes has that rank or a lower one; where one has, the
        round merges the leftmost place alone.
        """
        rank, merged = self.look_up(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != _NONE:
            at = np.flatnonzero(rank == least)
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, at, 0))
            at = at[(at - run) % 2 == 0]
            while True:
                new = ids.copy()
                new[at] = merged[at]
                new = np.delete(new, at + 1)
                here = at - np.arange(len(at))
                left, right = here[here > 0] - 1, here[here < len(new) - 1]
                pair_rank, pair = self.look_up(new[np.concatenate([left, right])], new[np.concatenate([left, right]) + 1])
                if len(at) == 1 or not len(pair_rank) or pair_rank.min() > least:
                    break
                at = at[:1]
            ids, rank, merged = new, np.delete(rank, at), np.delete(merged, at)
            rank[left], merged[left] = pair_rank[: len(left)], pair[: len(left)]
            rank[right], merged[right] = pair_rank[len(left) :], pair[len(left) :]
        return ids


class ByteBpe:
    """A vocabulary of byte strings whose ids are their merge ranks."""

    def __init__(self, ranks_path: str, pattern: str, digesting: bool = False):
        self.digesting = digesting
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            self.tokens[r] = token
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        values = np.array(rank, np.int32)
        self.decimal = [f" {i}" for i in range(len(self.tokens))]
        self.pairs = Pairs(np.array(left, np.int64), np.array(right, np.int64), values, values)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks = ranks
        self.find = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        self.odd = regex.compile(f"^[{WHITE}]|[{WHITE}]$").search
        self.cache: dict[str, list[int] | tuple[int, str, bytes] | None] = {}
        self.start: dict[str, list[list[int]]] = {}  # first words of texts

    def _split(self, piece: str) -> list[str] | None:
        """The pattern's matches of a piece after one blank; None if white space at its ends ties it to what is around it."""
        if piece.isalpha():
            return [" " + piece]
        if piece[:-1].isalpha() and piece[-1] in ".,":
            return [" " + piece[:-1], piece[-1]]
        return self.find(" " + piece) if piece and not self.odd(piece) else None

    def _learn(self, pieces: set[str]) -> None:
        """Ids of pieces between two single blanks: such a piece with the blank before it is split by itself."""
        split = [self._split(p) for p in pieces]
        words = [w for some in split if some for w in some]
        ids, keep = iter(self._ids(words)), self.told if self.digesting else list
        for piece, some in zip(pieces, split, strict=True):
            if some is None:
                self.cache[piece] = None
            elif len(some) == 1:
                self.cache[piece] = keep(next(ids))
            else:
                self.cache[piece] = keep([i for _ in some for i in next(ids)])

    def told(self, ids: list[int]) -> tuple[int, str, bytes]:
        """How many ids, each in decimal after a blank, and the bytes that they decode to."""
        return len(ids), "".join(map(self.decimal.__getitem__, ids)), self.decode(ids)

    def _ids(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8") for w in words]
        known = list(map(self.ranks.get, raw))
        todo = [w for w, k in zip(raw, known, strict=True) if k is None]
        merged, size = self.pairs.merge_all(self.byte[np.frombuffer(b"".join(todo), np.uint8)], np.fromiter(map(len, todo), np.int64, len(todo)))
        flat, at, out = merged.tolist(), 0, []
        sizes = iter(size.tolist())
        for k in known:
            if k is None:
                n = next(sizes)
                out.append(flat[at : at + n])
                at += n
            else:
                out.append([k])
        return out

    def _pieces(self, texts: list[str]) -> Iterator[tuple[list[list[int]], list]]:
        """Per text: ids of words before the first blank, and what is kept of each piece after one; where pieces depend on each other all ids are among the former."""
        for lo in range(0, len(texts), 256):
            some = [t.split(" ") for t in texts[lo : lo + 256]]
            pieces = {p for words in some for p in words[1:]}
            if len(self.cache) + len(new := pieces - self.cache.keys()) > CACHE_WORDS:
                self.cache.clear()
                new = pieces
            self._learn(new)
            get = self.cache.get
            for text, words in zip(texts[lo : lo + 256], some, strict=True):
                found = [get(p) for p in words[1:]]
                if None in found or self.odd(words[0]):
                    yield self._ids(self.find(text)), []
                    continue
                begin = self.start.get(words[0])
                if begin is None:
                    begin = self._ids(self.find(words[0]))
                    if len(words[0]) < 40 and len(self.start) < 50_000:
                        self.start[words[0]] = begin
                yield begin, found

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for begin, found in self._pieces(texts):
            yield list(chain(*begin, *found))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """Of each text: how many ids, the ids in decimal joined by one blank, and the bytes that they decode to."""
        for begin, found in self._pieces(texts):
            n, ids, raw = zip(self.told(list(chain(*begin))), *found, strict=True)
            yield sum(n), "".join(ids)[1:], b"".join(raw)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def vocabulary(ranks_path: str, pattern: str, digesting: bool = False) -> ByteBpe:
    """One vocabulary per Python worker; a digesting one keeps digests of words and not their ids."""
    return ByteBpe(ranks_path, pattern, digesting)


def _texts(part: pa.RecordBatch) -> list[str]:
    return pc.fill_null(part.column(1), "").to_pylist()


def _encode(parts: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path, pattern)
    for part in parts:
        with without_cycles():
            ids = pa.array(list(bpe.encode(_texts(part))), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])


def _decode(parts: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path, pattern)
    for part in parts:
        raw = [bpe.decode(x or []) for x in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])


def _round_trip(parts: Iterator[pa.RecordBatch], path: str, pattern: str, schema: str) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path, pattern, True)
    for part in parts:
        n, ids_hash, text_hash = [], [], []
        with without_cycles():
            for count, ids, raw in bpe.digests(_texts(part)):
                n.append(count)
                ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hash.append(hashlib.sha256(raw).hexdigest())
        yield rows(schema, part.column(0), n, ids_hash, text_hash)


def _columns(df: DataFrame, id_col: str, value_col: str, kind: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(value_col).cast(kind).alias("value"))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the byte-level BPE ids of each whole text, a row per input row.

    Each match of the pattern is encoded by itself, without special tokens. A null or empty text has no ids; a null id and
    repeated rows stay as they are; other columns are ignored. No shuffle: each row is encoded
    where it is read, and a worker keeps the ids of CACHE_WORDS words.
    """
    run = partial(_encode, path=ranks_path, pattern=pattern)
    return _columns(df, id_col, text_col, "string").mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, bytes``: the bytes that ids stand for, a row per input row; null ids give no bytes."""
    return _columns(df, id_col, ids_col, "array<int>").mapInArrow(partial(_decode, path=ranks_path, pattern=pattern), "doc_id long, bytes binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode each text, decode its ids, and digest both in one pass."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _columns(df, id_col, text_col, "string").mapInArrow(partial(_round_trip, path=ranks_path, pattern=pattern, schema=schema), schema)
