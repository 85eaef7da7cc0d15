"""Quality of documents from a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import batches, rows, text_bytes

#: Bytes under a filter, filters, numbers that stand for a byte, hidden units.
WIDTH, FILTERS, DIMENSIONS, HIDDEN = 6, 16, 8, 16
#: Bytes of a step; a chunk is two steps, so chunks overlap by half.
STEP = 256
#: A byte also says whether the RUN bytes that end with it stood up to LAGS bytes before.
RUN, LAGS = 8, 24
#: Labelled rows that the network learns from at most, half of each label; texts of more bytes teach nothing. Rows of part 1 of three are held out.
SAMPLE, LONGEST_TAUGHT, FOLDS = 4096, 32_768, 3
#: Passes over the sample, texts of a step, steps at least, and the first rate.
EPOCHS, GROUP, LEAST_STEPS, RATE = 6, 64, 300, 0.01
#: Steps that pass the filters together.
BLOCK = 512
_PAD = 0xFF  # in no UTF-8 text
_LEAD = WIDTH - 1  # before each text, so what is under a filter at a step's end is of that text
_GAP = LAGS + RUN  # after each text, so nothing recurs from the one before


def frames(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts in whole steps, one at least for each text, and how many steps each has. A symbol is a byte, plus 256 where it recurs, or 512 between texts."""
    size = np.diff(starts)
    steps = -(-(_LEAD + size + _GAP) // STEP)
    at = np.concatenate(([0], np.cumsum(steps))) * STEP
    out = np.full(at[-1] + _LEAD, _PAD, np.uint8)
    out[np.repeat(at[:-1] + _LEAD - starts[:-1], size) + np.arange(len(data))] = data
    return np.where(out == _PAD, 512, out + 256 * _recurs(out)).astype(np.int64), steps


def _recurs(x: np.ndarray) -> np.ndarray:
    found = np.zeros(len(x), bool)
    for lag in range(1, LAGS + 1):
        run = x[lag:] == x[:-lag]
        for k in (1, 2, 4):  # runs of 2, 4 and RUN equal bytes, marked at their ends
            run[k:] &= run[:-k]
            run[:k] = False
        found[lag:] |= run
    return found


class Network:
    """Bytes become vectors, filters slide over them, each chunk keeps the largest answer of each filter, and a text the largest and the mean over its chunks;
    two layers make these one probability."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.weights = {
            "byte": draw(256, DIMENSIONS, scale=0.5), "again": draw(DIMENSIONS, scale=0.5), "filters": draw(WIDTH, DIMENSIONS, FILTERS, scale=(WIDTH * DIMENSIONS) ** -0.5), "bias": np.zeros(FILTERS, np.float32),
            "hidden": draw(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, scale=HIDDEN**-0.5), "out_bias": np.zeros(1, np.float32),
        }

    def _symbols(self) -> np.ndarray:
        w = self.weights
        return np.concatenate((w["byte"], w["byte"] + w["again"], np.zeros((1, DIMENSIONS), np.float32)))

    def _tables(self) -> np.ndarray:
        """What each symbol adds to each filter, by place under it."""
        return np.einsum("sd,wdf->wsf", self._symbols(), self.weights["filters"])

    def _steps(self, symbols: np.ndarray, tables: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest answer of each filter in each step, and where it is. A block of steps is in memory at a time."""
        n = (len(symbols) - WIDTH + 1) // STEP
        best, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if places else None
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            m = (hi - lo) * STEP
            x = symbols[lo * STEP : lo * STEP + m + WIDTH - 1]
            out = np.take(tables[0], x[:m], axis=0)
            more = np.empty_like(out)
            for k in range(1, WIDTH):
                out += np.take(tables[k], x[k : k + m], axis=0, out=more)
            out = out.reshape(hi - lo, STEP, FILTERS)
            if places:
                where[lo:hi] = out.argmax(axis=1)
                best[lo:hi] = np.take_along_axis(out, where[lo:hi, None], axis=1)[:, 0]
            else:
                best[lo:hi] = out.max(axis=1)
        return best, where

    def _forward(self, best: np.ndarray, steps: np.ndarray) -> dict[str, np.ndarray]:
        """From the steps' answers to a probability for each text."""
        w = self.weights
        first = np.concatenate(([0], np.cumsum(steps)))
        last = np.zeros(len(best), bool)
        last[first[1:] - 1] = True
        other = np.where(last, np.arange(len(best)), np.arange(len(best)) + 1)  # a chunk begins at each step but the last, if there are two
        second = best[other] > best
        chunk = np.maximum(np.where(second, best[other], best) + w["bias"], 0)
        real = ~last
        real[first[:-1][steps == 1]] = True
        seen = np.where(real[:, None], chunk, -1.0)
        top = np.maximum.reduceat(seen, first[:-1])
        chunks = np.maximum(steps - 1, 1)
        mean = np.add.reduceat(np.where(real[:, None], chunk, 0), first[:-1]) / chunks[:, None]
        z = np.concatenate((top, mean), axis=1).astype(np.float32)
        h = np.maximum(z @ w["hidden"] + w["hidden_bias"], 0)
        p = 1 / (1 + np.exp(-np.clip(h @ w["out"] + w["out_bias"], -30, 30)))
        return {"first": first, "other": other, "second": second, "chunk": chunk, "real": real, "top": top, "chunks": chunks, "z": z, "h": h, "p": p}

    def probabilities(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        symbols, steps = frames(data, starts)
        best, _ = self._steps(symbols, self._tables())
        return self._forward(best, steps)["p"].astype(float)

    def gradients(self, symbols: np.ndarray, steps: np.ndarray, good: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean loss: only the places of the largest answers hand anything back to filters and bytes."""
        w, tables = self.weights, self._tables()
        best, where = self._steps(symbols, tables, places=True)
        f = self._forward(best, steps)
        d = (weight * (f["p"] - good) / weight.sum()).astype(np.float32)
        out = {"out": f["h"].T @ d, "out_bias": d.sum(keepdims=True)}
        dh = np.outer(d, w["out"]) * (f["h"] > 0)
        out |= {"hidden": f["z"].T @ dh, "hidden_bias": dh.sum(axis=0)}
        dz = dh @ w["hidden"].T
        text = np.repeat(np.arange(len(steps)), steps)
        top = (f["chunk"] == f["top"][text]) & f["real"][:, None]
        share = np.add.reduceat(top.astype(np.float32), f["first"][:-1])[text]
        dchunk = np.where(top, dz[:, :FILTERS][text] / np.maximum(share, 1), 0) + np.where(f["real"][:, None], dz[:, FILTERS:][text] / f["chunks"][text][:, None], 0)
        dchunk = dchunk * (f["chunk"] > 0)
        out["bias"] = dchunk.sum(axis=0)
        dstep = np.where(f["second"], 0, dchunk)
        np.add.at(dstep, f["other"], np.where(f["second"], dchunk, 0))
        at = (np.arange(len(best)) * STEP)[:, None] + where
        dtable = np.zeros(tables.shape, np.float32)
        for k in range(WIDTH):
            cell = symbols[at + k] * FILTERS + np.arange(FILTERS)
            dtable[k] = np.bincount(cell.ravel(), dstep.ravel(), 513 * FILTERS).reshape(513, FILTERS)
        out["filters"] = np.einsum("sd,wsf->wdf", self._symbols(), dtable)
        dsymbol = np.einsum("wsf,wdf->sd", dtable, w["filters"])
        out |= {"byte": dsymbol[:256] + dsymbol[256:512], "again": dsymbol[256:512].sum(axis=0)}
        return out


def taught(texts: list[str], good: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> Network:
    """A network after ``epochs`` passes over the texts in random groups, more where they are few, by Adam."""
    net, rng = Network(), np.random.default_rng(6)
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    n, each = 0, -(-len(texts) // GROUP)
    epochs = max(epochs, -(-LEAST_STEPS // each))
    total = epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), GROUP):
            some = order[k : k + GROUP]
            symbols, steps = frames(*text_bytes(pa.array([texts[i] for i in some], pa.large_string())))
            n += 1
            for name, g in net.gradients(symbols, steps, good[some], weight[some]).items():
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.01 * (g * g - square[name])
                net.weights[name] -= (RATE * (1 - n / (total + 1)) * (mean[name] / (1 - 0.9**n)) / (np.sqrt(square[name] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
    return net


class Judge:
    """A network, or without labels of both kinds the share of good ones among those there are."""

    def __init__(self, net: Network | None, share: float):
        self.net, self.share = net, share

    def probabilities(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.full(len(starts) - 1, self.share) if self.net is None else self.net.probabilities(data, starts)


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _held_out(c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string")) % FOLDS == 1, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, epochs: int = EPOCHS) -> Judge:
    """A network from at most ``sample`` labelled documents that are not held out, half of each label, those whose ids hash lowest; each counts for as many as its label has.

    Texts of more than LONGEST_TAUGHT bytes teach nothing. Of labels that repeat an id the largest counts; null ids and labels count for nothing.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) != 0).cast("int").alias("good")).where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.max("good").alias("good"))
    marked = marked.where(~_held_out())
    counts = {r.good: r["count"] for r in marked.groupBy("good").count().collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(counts) < 2:
        return Judge(None, share)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = marked.where("good = 1").orderBy(*order).limit(sample // 2).unionByName(marked.where("good = 0").orderBy(*order).limit(sample // 2))
    known = _docs(df, id_col, text_col).where(F.octet_length(F.coalesce("text", F.lit(""))) <= LONGEST_TAUGHT).join(F.broadcast(some), "doc_id")
    got = known.dropDuplicates(["doc_id"]).orderBy("doc_id").limit(sample).toArrow()
    good = got.column("good").to_numpy()
    have = np.bincount(good, minlength=2)
    if not have.all():
        return Judge(None, share)
    weight = np.array([counts[0], counts[1]]) / have
    return Judge(taught(got.column("text").to_pylist(), good, (weight / weight.mean())[good], epochs), share)


_SCORES = "doc_id long, held_out boolean, score double, predicted int"


def _scored(parts: Iterator[pa.RecordBatch], judge: Judge) -> Iterator[pa.RecordBatch]:
    for part in parts:
        data, starts = text_bytes(part.column(1))
        for lo, hi in batches(starts):
            p = judge.probabilities(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
            yield rows(_SCORES, part.column(0).slice(lo, hi - lo), part.column(2).slice(lo, hi - lo), p, (p >= 0.5).astype(np.int32))


def score_documents(df: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row per input row; no shuffle.

    Every byte of a text passes the filters, in blocks of steps, so a long text takes no more memory than its own. Only the text decides the
    score; a null or empty one is a chunk of padding. A null id is never held out. Repeated rows stay; other columns are ignored; an empty
    table gives an empty table. Without labels of both kinds every score is the share of good labels.
    """
    docs = _docs(df, id_col, text_col).withColumn("held_out", _held_out())
    return docs.mapInArrow(partial(_scored, judge=judge), _SCORES)
