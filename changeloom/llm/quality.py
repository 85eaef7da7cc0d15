"""Quality rules: rule statistics of documents and an isolation forest over them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import Words, batches, forget, materialize, mix, rows, text_bytes

#: The forest: trees, rows that each tree of a forest made in memory splits (one grown from a table splits all rows), depth.
TREES, SUBSAMPLE, DEPTH = 100, 256, 8
#: Share of good rows that the threshold spares at least, and parts that a range of scores is counted in while it is looked for.
SPARED, PARTS = 0.995, 1024
#: Fixed rule: a document with fewer words, or a larger share of repeated words (in per cent), fails whatever the forest says.
LEAST_WORDS, MOST_REPEATED = 50, 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_marks", "n_digits"]
#: Usual shares, and how far beyond them counts: symbols, copied lines, repeated words, capitals, marks, digits, and word length's distance from 6.
USUAL, BEYOND = (0.05, 0.15, 0.25, 0.25, 0.2, 0.15, 3.0), (0.3, 0.4, 0.4, 0.4, 0.4, 0.4, 4.0)
SHAPE = [f"f{k}" for k in range(len(USUAL))]
LOW, HIGH = [f"low{k}" for k in range(len(USUAL))], [f"high{k}" for k in range(len(USUAL))]
_SHAPED = "doc_id long, " + ", ".join(f"{c} double" for c in SHAPE)
_EXTENTS = "tree int, node int, n long, " + ", ".join(f"{c} double" for c in LOW + HIGH)
_U = np.uint64
_SYMBOL, _UPPER, _MARK, _DIGIT, _CHAR = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_MARK[list(b"!?;:")] = True
_DIGIT[48:58] = True
_CHAR[:128] = _CHAR[192:] = True  # every byte but those that continue a character


def _repeated(hashes: np.ndarray) -> int:
    """Words that a window of three words found twice or more covers."""
    if len(hashes) < 4:
        return 0
    runs = mix(hashes[:-2] * _U(3) + mix(hashes[1:-1]) * _U(5) + hashes[2:])
    _, which, count = np.unique(runs, return_inverse=True, return_counts=True)
    again = np.concatenate(([False, False], count[which] > 1, [False, False]))
    return int((again[:-2] | again[1:-1] | again[2:]).sum())


def _copied_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def statistics_of(column: pa.Array) -> np.ndarray:
    """A row of BASE and MORE per text."""
    data, starts = text_bytes(column)
    out = np.zeros((len(starts) - 1, len(BASE) + len(MORE)), np.int64)
    for lo, hi in batches(starts):
        own, at = data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
        words = Words(own, at)
        sums = {}
        for name, hit in (("char", _CHAR), ("symbol", _SYMBOL), ("upper", _UPPER), ("mark", _MARK), ("digit", _DIGIT)):
            sums[name] = np.concatenate(([0], np.cumsum(hit[own])))
        chars = np.concatenate(([0], np.cumsum(sums["char"][words.end] - sums["char"][words.begin])))
        part = out[lo:hi]
        part[:, 0] = np.diff(words.first)
        part[:, 1] = np.diff(chars[words.first])
        for k, name in ((2, "symbol"), (6, "upper"), (7, "mark"), (8, "digit")):
            part[:, k] = np.diff(sums[name][at])
        whole = own.tobytes()
        for i in range(hi - lo):
            part[i, 5], part[i, 3] = _copied_lines(whole[at[i] : at[i + 1]])
            part[i, 4] = _repeated(words.hash[words.first[i] : words.first[i + 1]])
    return out


def features(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on: by how much each rule's share is beyond what ordinary texts have, up to a limit; ordinary texts are 0 throughout."""
    words, chars, lines = (np.maximum(stats[:, k], 1).astype(float) for k in (0, 1, 5))
    shares = np.stack([stats[:, 2] / words, stats[:, 3] / (lines + 4), stats[:, 4] / words, stats[:, 6] / chars, stats[:, 7] / words, stats[:, 8] / chars, np.abs(chars / words - 6)], axis=1)
    return np.clip(shares - np.array(USUAL), 0, np.array(BEYOND))


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < LEAST_WORDS) | (100 * stats[:, 4] > MOST_REPEATED * stats[:, 0])


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as arrays; ``score`` is near 1 for rows that few random splits isolate."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = []
        self.scale = _expected(min(subsample, len(x))) or 1.0
        for _ in range(trees):
            nodes: list[list[float]] = []
            self._grow(nodes, x[rng.choice(len(x), min(subsample, len(x)), replace=False)], 0, rng)
            feature, cut, left, right, path = (np.array(c) for c in zip(*nodes, strict=True))
            self.trees.append((feature.astype(int), cut, left.astype(int), right.astype(int), path))

    @classmethod
    def of(cls, trees: list[tuple], scale: float) -> Forest:
        """A forest of trees that are there: feature, cut, left, right and path of each node, and the mean path that scores are relative to."""
        forest = cls.__new__(cls)
        forest.trees, forest.scale = trees, scale
        return forest

    def _grow(self, nodes: list, x: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        at = len(nodes)
        nodes.append([0, np.inf, at, at, depth + _expected(len(x))])
        low, high = x.min(axis=0), x.max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth < DEPTH and len(x) > 1 and len(wide):
            f = rng.choice(wide)
            cut = rng.uniform(low[f], high[f])
            side = x[:, f] <= cut
            nodes[at][:2] = [f, cut]
            nodes[at][2] = self._grow(nodes, x[side], depth + 1, rng)
            nodes[at][3] = self._grow(nodes, x[~side], depth + 1, rng) if (~side).any() else at
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, cut, left, right, path in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = np.where(x[every, feature[node]] <= cut[node], left[node], right[node])
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / self.scale)


class Judge:
    """A forest and the score from which a document is rejected."""

    def __init__(self, forest: Forest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def rejects(self, stats: np.ndarray) -> np.ndarray:
        if self.forest is None or not len(stats):
            return np.zeros(len(stats), bool)
        return self.forest.score(features(stats)) > self.threshold


def _columns(part: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.stack([part.column(first + k).to_numpy() for k in range(n)], axis=1)


def _shaped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of the texts that pass the base rule."""
    for part in parts:
        stats = statistics_of(part.column(1))
        passed = ~base_failed(stats)
        yield rows(_SHAPED, part.column(0).filter(pa.array(passed)), *features(stats[passed]).T)


def _extents(parts: Iterator[pa.RecordBatch], trees: list[tuple], depth: int) -> Iterator[pa.RecordBatch]:
    """Of each node at a depth, from a partition's shapes: its rows, and the least and largest of each feature."""
    first, size, width = 2**depth - 1, 2**depth, len(SHAPE)
    count = np.zeros((len(trees), size), np.int64)
    low, high = np.full((len(trees), size, width), np.inf), np.full((len(trees), size, width), -np.inf)
    for part in parts:
        x, n = _columns(part, 0, width), part.column(width).to_numpy()
        every = np.arange(len(x))
        for t, (feature, cut, left, right, _) in enumerate(trees):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = np.where(x[every, feature[node]] <= cut[node], left[node], right[node])
            order = np.argsort(node, kind="stable")
            order = order[np.searchsorted(node[order], first) :]
            if len(order):
                own = node[order] - first
                begin = np.flatnonzero(np.diff(own, prepend=-1))
                own = own[begin]
                count[t, own] += np.add.reduceat(n[order], begin)
                low[t, own] = np.minimum(low[t, own], np.minimum.reduceat(x[order], begin))
                high[t, own] = np.maximum(high[t, own], np.maximum.reduceat(x[order], begin))
    t, own = np.nonzero(count)
    yield rows(_EXTENTS, t, own + first, count[t, own], *low[t, own].T, *high[t, own].T)


def grown(shapes: DataFrame, trees: int = TREES, seed: int = 11) -> Forest:
    """A forest whose trees split all rows of a table of SHAPE and ``n``, how many rows have that shape.

    A level takes one pass: each partition counts the rows in every open node and the range of its features, these are combined
    by node, and the driver draws a feature and a cut inside its range for each, at most 2**DEPTH a tree. Draws
    depend on the seed, the tree and the node, not on the order of rows. Node k has 2k+1 and 2k+2 below it.
    """
    size = 2 ** (DEPTH + 1) - 1
    out = [(np.zeros(size, int), np.full(size, np.inf), np.arange(size), np.arange(size), np.zeros(size)) for _ in range(trees)]
    total = 0
    for depth in range(DEPTH + 1):
        schema = [F.sum("n").alias("n"), *[F.min(c).alias(c) for c in LOW], *[F.max(c).alias(c) for c in HIGH]]
        found = shapes.mapInArrow(partial(_extents, trees=out, depth=depth), _EXTENTS).groupBy("tree", "node").agg(*schema).toPandas()
        low, high = found[LOW].to_numpy(float), found[HIGH].to_numpy(float)
        for tree, node, n, least, most in zip(found["tree"].tolist(), found["node"].tolist(), found["n"].tolist(), low, high, strict=True):
            feature, cut, left, right, path = out[tree]
            path[node] = depth + _expected(n)
            total = n if node == 0 else total
            wide = np.flatnonzero(most > least)
            if depth < DEPTH and len(wide):
                rng = np.random.default_rng([seed, tree, node])
                f = rng.choice(wide)
                feature[node], cut[node] = f, min(rng.uniform(least[f], most[f]), np.nextafter(most[f], -np.inf))
                left[node], right[node] = 2 * node + 1, 2 * node + 2
    return Forest.of(out, _expected(total) or 1.0)


def _scored(parts: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for part in parts:
        yield rows("score double, n_good long, n_bad long", forest.score(_columns(part, 0, len(SHAPE))), part.column(len(SHAPE)), part.column(len(SHAPE) + 1))


def threshold_of(scored: DataFrame) -> float | None:
    """The threshold with the best sum of true and false verdicts among those that spare SPARED of the good rows, from ``score, n_good, n_bad`` of all labelled rows; none without rows of both kinds.

    The lowest score that spares enough is found exactly, by counting the good rows in PARTS parts of a range of scores and
    going on inside the part that holds it. From there the threshold rises as long as no bad row is lost.
    """
    good, bad, low, high = scored.agg(F.sum("n_good"), F.sum("n_bad"), F.min("score"), F.max("score")).first()
    if not good or not bad:
        return None
    most, below = high, 0
    while low < high:
        inside = scored.where(F.col("score").between(low, high))
        part = F.least(F.floor((F.col("score") - low) / (high - low) * PARTS), F.lit(PARTS - 1)).alias("part")
        for r in inside.groupBy(part).agg(F.sum("n_good").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("part").collect():
            if (below + r.n) / good >= SPARED:
                low, high = r.low, r.high
                break
            below += r.n
    above = scored.where((F.col("score") > low) & (F.col("n_bad") > 0)).agg(F.min("score")).first()[0]
    cut = most if above is None else scored.where(F.col("score") < above).agg(F.max("score")).first()[0]
    return float((cut + (1.0 if above is None else above)) / 2)


def _verdicts(parts: Iterator[pa.RecordBatch], judge: Judge, schema: str) -> Iterator[pa.RecordBatch]:
    for part in parts:
        stats = statistics_of(part.column(1))
        failed = base_failed(stats)
        kept = ~failed
        kept[kept] = ~judge.rejects(stats[kept])
        yield rows(schema, part.column(0), *stats[:, : len(BASE)].T, failed, kept)


def _pair(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Judge:
    """A forest over all documents that pass the base rule, and a threshold from all of these that have a label; equal shapes are counted together."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) != 0).alias("good")).where("doc_id is not null and good is not null")
    marked = marked.groupBy("doc_id").agg(F.max("good").cast("long").alias("good"))
    if marked.select("good").distinct().count() < 2:
        return Judge(None, 1.0)
    rest = materialize(_pair(df, id_col, text_col).mapInArrow(_shaped, _SHAPED))  # one step: each that follows another would keep a Python worker of its own for every core
    shapes = materialize(rest.groupBy(*SHAPE).agg(F.count("*").alias("n")))
    forest = grown(shapes)
    known = rest.join(marked, "doc_id").groupBy(*SHAPE).agg(F.sum("good").alias("n_good"), F.sum(1 - F.col("good")).alias("n_bad"))
    scored = materialize(known.mapInArrow(partial(_scored, forest=forest), "score double, n_good long, n_bad long"))
    threshold = threshold_of(scored)
    forget(rest, shapes, scored)
    return Judge(None, 1.0) if threshold is None else Judge(forest, threshold)


def judge_documents(df: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the statistics in BASE, ``base_failed`` and ``kept``, a row per input row; no shuffle.

    A null, empty or blank text has no words and fails the base rule. Null ids and repeated rows stay; other columns are
    ignored; an empty table gives an empty table. Without labels of both kinds the forest rejects nothing.
    """
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean"
    return _pair(df, id_col, text_col).mapInArrow(partial(_verdicts, judge=judge, schema=schema), schema)


def _filter(parts: Iterator[pa.RecordBatch], judge: Judge, at: int) -> Iterator[pa.RecordBatch]:
    for part in parts:
        stats = statistics_of(part.column(at))
        keep = ~base_failed(stats)
        keep[keep] = ~judge.rejects(stats[keep])
        yield part.filter(pa.array(keep))


def keep_good(df: DataFrame, judge: Judge, text_col: str = "text") -> DataFrame:
    """The rows that ``judge_documents`` keeps, with all columns; no shuffle."""
    return df.mapInArrow(partial(_filter, judge=judge, at=df.columns.index(text_col)), df.schema)
