"""Ids of a word-level BPE tokenizer file, computed for distinct words on padded matrices."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from unicodedata import ucd_3_2_0

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from changeloom.llm.bpe import WHITE, Pairs

#: Words whose ids a Python worker keeps between batches.
CACHE_WORDS = 600_000


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(more)) for b in range(256)]


class WordBpe:
    """A tokenizer file whose steps are NFC, lower case, one pattern, byte letters, and merges with an end-of-word mark.

    White space separates words in every step, so a text's ids are those of its words one after
    another, and only new words are encoded. The file's own pattern is used. As the library does by default, a string that spells a special
    token is that token, within a word too.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"not a word BPE of the expected form: {path}")
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE)).findall
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs = Pairs(left, right, np.arange(len(merges), dtype=np.int32), merged)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        """Words by number, where the ids of each begin, and the ids of all one after another."""
        self.number: dict[str, int] = {}
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _by_library(self, words: list[str]) -> list[str]:
        """Words with a special token, or with characters newer than Unicode 3.2, whose classes depend on a library's age."""
        text = "\n".join(words)
        odd = {c for c in set(text) if c > "\x7f" and ucd_3_2_0.category(c) == "Cn"}
        special = [s for s in self.special if s in text]
        if not odd and not special:
            return []
        return [w for w in words if not odd.isdisjoint(w) or any(s in w for s in special)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: each word's parts, then the ids of distinct parts."""
        apart = self._by_library(words)
        if apart:
            words = list(dict.fromkeys(words).keys() - set(apart))
        text = unicodedata.normalize("NFC", "\n".join(words))
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        parts: list[str] = []
        counts: list[int] = []
        for w in text.split("\n") if words else []:
            if w.isalpha():
                parts.append(w)
                counts.append(1)
            elif w[-1] in ".," and w[:-1].isalpha():
                parts += (w[:-1], w[-1])
                counts.append(2)
            else:
                some = self.find(w)
                parts += some
                counts.append(len(some))
        distinct = pa.array(parts, pa.string()).dictionary_encode()
        ids, size = self._merged(distinct.dictionary)
        flat, n = gather(ids, np.cumsum(size) - size, size, distinct.indices.to_numpy())
        before = np.concatenate(([0], np.cumsum(n)))
        sizes = np.diff(before[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))])
        by_library = [np.array(self.library.encode(w, add_special_tokens=False).ids, np.uint32) for w in apart]
        self.number.update(zip([*words, *apart], range(len(self.number), len(self.number) + len(words) + len(apart)), strict=True))
        sizes = np.concatenate([sizes, np.array([len(x) for x in by_library], np.int64)])
        self.ids = np.concatenate([self.ids, flat, *by_library])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])

    def _merged(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts one after another, and how many each has; no part is empty."""
        if not len(parts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
        whole = np.frombuffer(parts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        length = np.diff(offsets)
        symbols, last = self.inner[whole], np.cumsum(length) - 1
        symbols[last] = self.last[whole[last]]
        merged, size = self.pairs.merge_all(symbols, length)
        return merged.astype(np.uint32), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and how many each text has; null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        offsets = split.offsets.to_numpy()
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        new = [w for w in words if w and w not in self.number]
        if len(self.number) + len(new) > CACHE_WORDS:
            self._forget()
            new = [w for w in words if w]
        if new:
            self._learn(new)
        which = np.array([self.number[w] if w else -1 for w in words], np.int64)  # -1: no word, at the ends of a text
        size = np.where(which < 0, 0, np.diff(self.start)[which] if len(self.number) else 0)
        ids, n = gather(self.ids, self.start[np.maximum(which, 0)], size, codes)
        before = np.concatenate(([0], np.cumsum(n)))
        return ids, np.diff(before[offsets - offsets[0]])


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values one after another, run k from ``start[k]`` and ``size[k]`` long, and how long each is."""
    n = size[which]
    at = np.repeat(start[which] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return values[at], n


@lru_cache(2)
def vocabulary(path: str) -> WordBpe:
    """One vocabulary per Python worker."""
    return WordBpe(path)
