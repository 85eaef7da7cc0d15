"""Content-defined anchors: which stretches of two sequences can hold the same window.

Every window of ``window`` elements has one anchor, the leftmost run of ``run`` elements
of least hash in it. It depends on the window's content alone, so equal windows have
equal anchors, wherever they stand. Consecutive windows with one anchor are its span;
a text has about ``2 / (window - run + 2)`` spans per element.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from changeloom.llm.common import Sums

_U = np.uint64
#: Low bits of a key hold the place, so a piece has at most 2**_BITS elements.
_BITS = 24
PIECE = 1 << 20


class Spans(NamedTuple):
    """Per span: its text, the first window's place in it, how many windows, the anchor's place in the span, the anchor's hash and the span's hash."""

    text: np.ndarray
    at: np.ndarray
    count: np.ndarray
    inner: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _piece(values: np.ndarray, starts: np.ndarray, window: int, run: int) -> Spans | None:
    n = len(values)
    if n < window:
        return None
    inside = np.zeros(n + 1, np.int32)
    full = np.diff(starts) >= window
    np.add.at(inside, starts[:-1][full], 1)
    np.add.at(inside, starts[1:][full] - window + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[: n - window + 1]))
    if not len(windows):
        return None
    sums, place = Sums(values), np.arange(n - run + 1)
    runs = sums.hashes(place, place + run)
    mask = _U((1 << _BITS) - 1)
    where = (sliding_min((runs & ~mask) | place.astype(_U), window - run + 1)[windows] & mask).astype(np.int64)
    begin = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1))
    end = np.concatenate((begin[1:], [len(where)])) - 1
    first, last = windows[begin], windows[end]
    text = np.searchsorted(starts, first, "right") - 1
    return Spans(text, first - starts[text], last - first + 1, where[begin] - first, runs[where[begin]], sums.hashes(first, last + window))


def spans(values: np.ndarray, starts: np.ndarray, window: int, run: int) -> Iterator[Spans]:
    """The spans of all windows of a batch of texts; a long text is cut into pieces that share no window."""
    if len(values) <= 2 * PIECE:
        if (found := _piece(values, starts, window, run)) is not None:
            yield found
        return
    for t, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        for k in range(int(lo), max(int(lo) + 1, int(hi) - window + 1), PIECE):
            some = values[k : min(int(hi), k + PIECE + window - 1)]
            if (x := _piece(some, np.array([0, len(some)]), window, run)) is not None:
                yield Spans(x.text + t, x.at + (k - lo), x.count, x.inner, x.anchor, x.content)
