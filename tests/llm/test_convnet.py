"""The convolutional network: gradients, whole texts, and held-out labels."""

import numpy as np
import pyarrow as pa
import pytest

from changeloom.llm import convnet as C
from changeloom.llm.common import text_bytes


def framed(texts):
    return text_bytes(pa.array(texts, pa.large_string()))


def test_symbols_say_what_recurs():
    symbols, steps = C.frames(*framed(["abcdefghij abcdefghij", "ab ab ab ab ab ab", "", "x" * 700]))
    assert steps.tolist() == [1, 1, 1, 3] and len(symbols) == 6 * C.STEP + C.WIDTH - 1
    one = symbols[C.WIDTH - 1 :][:21]
    assert (one[:18] < 256).all() and (one[18:] >= 256).all() and symbols[C.WIDTH + 20] == symbols[0] == 512
    two = symbols[C.STEP + C.WIDTH - 1 :][:17]
    assert (two[:10] < 256).all() and (two[10:] >= 256).all()


def test_gradients():
    texts = ["abc abc abc abc " * 30, "hello World! this is one. " * 3, "", "x|y " * 300]
    data, starts = framed(texts)
    symbols, steps = C.frames(data, starts)
    net, good, weight = C.Network(), np.array([0, 1, 1, 0]), np.array([1, 2, 1, 0.5])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    net.weights["bias"] += 0.3  # away from the corner of padding

    def loss():
        p = net._forward(net._steps(symbols, net._tables())[0].astype(float), steps)["p"]
        return -(weight * (good * np.log(p) + (1 - good) * np.log(1 - p))).sum() / weight.sum()

    got = net.gradients(symbols, steps, good, weight)
    assert set(got) == set(net.weights)
    for name, v in net.weights.items():
        flat, at = v.reshape(-1), int(np.abs(got[name]).argmax())
        was = flat[at]
        flat[at] = was + 1e-3
        up = loss()
        flat[at] = was - 1e-3
        down = loss()
        flat[at] = was
        assert got[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), name


def test_forward_is_a_plain_network():
    texts = ["some Words here | and | there " * 20, "é!!", "", "ab " * 400]
    net = C.Network()
    got = net.probabilities(*framed(texts))
    w = net.weights
    for text, p in zip(texts, got, strict=True):
        symbols, (steps,) = C.frames(*framed([text]))
        vectors = np.array([np.zeros(C.DIMENSIONS) if s == 512 else w["byte"][s % 256] + (w["again"] if s >= 256 else 0) for s in symbols])
        answers = np.array([sum(vectors[i + k] @ w["filters"][k] for k in range(C.WIDTH)) for i in range(steps * C.STEP)]) + w["bias"]
        chunks = [np.maximum(answers[k * C.STEP : (k + 2) * C.STEP].max(axis=0), 0) for k in range(max(1, steps - 1))]
        z = np.concatenate((np.max(chunks, axis=0), np.mean(chunks, axis=0)))
        assert p == pytest.approx(1 / (1 + np.exp(-(np.maximum(z @ w["hidden"] + w["hidden_bias"], 0) @ w["out"] + w["out_bias"][0]))), rel=1e-4)


def test_texts_do_not_depend_on_their_neighbours():
    texts = ["abc " * 100, "abc " * 100, "x", "Word. " * 9000]
    net = C.Network()
    together = net.probabilities(*framed(texts))
    assert np.allclose(together, [net.probabilities(*framed([t]))[0] for t in texts], rtol=1e-5)
    assert abs(net.probabilities(*framed(["calm text " * 9000]))[0] - net.probabilities(*framed(["calm text " * 9000 + "A!!B| |#$%"]))[0]) > 1e-9  # the end counts


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = C.score_documents(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), C.fit(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert len(got) > 1000 and ((got.score >= 0.5) == got.predicted).all()
    assert (got.predicted[got.quality == 1] == 1).mean() > 0.99
    assert (got.predicted[got.quality == 0] == 0).mean() > 0.97


def test_edges(spark):
    rows = [(k, ("calm words here. " if k % 2 else "ODD!! ") * 30 + f"w{k}", k % 2, k % 2) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, quality int")
    labels = df.select("doc_id", "quality")
    judge = C.fit(df, labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, 1), (5, None)], labels.schema)))
    more = spark.createDataFrame([(None, None, 1, 0), (1, "", 1, 0), (1, "", 1, 0), (2, "calm words here. " * 50_000, 0, 1), (3, "ODD!! " * 30, 0, 1)], df.schema)
    got = sorted((r.doc_id or 0, r.predicted, 0 <= r.score <= 1, r.held_out) for r in C.score_documents(more, judge).collect())
    assert [g[0] for g in got] == [0, 1, 1, 2, 3] and [g[1] for g in got[3:]] == [1, 0] and all(g[2] for g in got) and not got[0][3]
    assert C.score_documents(df.limit(0), judge).count() == 0
    none = C.fit(df.limit(0), labels.limit(0))
    assert {r.score for r in C.score_documents(df, none).collect()} == {0.5}
    assert {r.predicted for r in C.score_documents(df, C.fit(df, labels.where("quality = 1"))).collect()} == {1}
