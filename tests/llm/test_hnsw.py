import numpy as np
import pytest

from changeloom.llm.hnsw import nearest


def brute(rows, queries, top=20):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            s = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))[:top]
            out[q] = [(k + 1, i, -d) for k, (d, i) in enumerate(s)]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = result(nearest(df, df.where("vec_id % 20 = 0")))
    want = brute(rows, [i for i, _ in rows if i % 20 == 0])
    assert got.keys() == want.keys() and all([r for r, _, _ in v] == list(range(1, 21)) for v in got.values())
    assert recall(got, want) >= 0.97
    scores = dict(rows)
    assert all(abs(s - float((np.array(scores[q], float) * np.array(scores[i], float)).sum())) < 1e-12 for q, v in got.items() for _, i, s in v)


def test_lengths_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.1, 5)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = result(nearest(df, df.where("vec_id % 20 = 0"))), brute(rows, [i for i, _ in rows if i % 20 == 0])
    assert recall(got, want) >= 0.97


def test_one_very_long_vector(spark):
    """Links among ordinary vectors must not drown in the length of one."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(6000)] + [(6001, (rng.normal(size=16) * 1e5).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = result(nearest(df, df.where("vec_id % 20 = 0"), width=64)), brute(rows, [i for i, _ in rows if i % 20 == 0])
    assert recall(got, want) >= 0.95


def test_each_length_by_itself(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=2 + 2 * (i % 3)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = result(nearest(df, df.where("vec_id % 20 = 0"))), {}
    for k in range(3):
        want |= brute([r for r in rows if r[0] % 3 == k], [i for i, _ in rows if i % 20 == 0 and i % 3 == k])
    assert got.keys() == want.keys() and recall(got, want) >= 0.97


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.0]), (20, [0.5, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [None, 1.0]), (120, []), (None, [1.0, 1.0]), (140, [1.0, 2.0]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = result(nearest(df, df.where("vec_id % 20 = 0")))
    assert got == brute(rows, [0, 20, 140])
    assert result(nearest(df.limit(0), df.limit(0))) == {} == result(nearest(df.limit(1), df.limit(1)))


def test_repeated_ids_have_one_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (5, [1.0, 1.0]), (5, [3.0, 0.0]), (5, None), (6, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for some in (df, df.repartition(3)):
        assert result(nearest(some, some.where("vec_id % 20 = 0"))) == brute([(0, [1.0, 0.0]), (5, [3.0, 0.0]), (6, [0.0, 2.0])], [0])
