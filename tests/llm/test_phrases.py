"""Phrase mining against a plain count of all phrases."""

import re
from collections import Counter, defaultdict

import pytest

from changeloom.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=100, first=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        big = {p: a for p, a in c.items() if a >= least}
        gone = {p[i : i + k] for p, a in big.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * c[p[i : i + k]]}
        found = []
        for p, a in big.items():
            if len(p) > 1 and p not in gone:
                score, _, left, right = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1)]
    return sorted(out)


def test_edges(spark):
    rows = [(None, "en", 1), ("", "en", 2), (" \t\n", None, 3), ("New York\tCity, new  york\ncity", "en", 4), ("a b c d e f " * 4000, None, None), ("É é\x0bÉ é;É é", "fr", 5)]
    rows += [("new york city hall. red tape", "en", k) for k in range(100)] + [("red tape. red wine", "", k) for k in range(120)]
    df = spark.createDataFrame(rows, "text string, lang string, score int")
    got = P.mine(df)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute([r[:2] for r in rows])
    assert sorted(map(tuple, P.mine(df, least=3, first=4).collect())) == brute([r[:2] for r in rows], 3, 4)
    assert P.mine(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", [1, 8, 10**9])
def test_whole_table_whatever_the_sample(spark, part):
    """All rows in the sample, one in eight, and none: border failures make up for what a sample misses."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, P.mine(df, least=20, part=part).collect())) == brute([(r.text, r.lang) for r in df.collect()], 20)


def test_chance_hits_of_a_small_filter_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "LARGEST", 6)
    monkeypatch.setattr(P, "max", lambda *a: min(a) if a[0] == 16 else max(*a), raising=False)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    assert sorted(map(tuple, P.mine(df, least=30).collect())) == brute([(r.text, r.lang) for r in df.collect()], 30)


def test_filter_has_its_keys(spark):
    import numpy as np

    some = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    f = P.Filter(spark.createDataFrame([(int(k),) for k in some], "key long"))
    assert f.has(some.view(np.uint64)).all()
    assert f.has(np.random.default_rng(2).integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 0.02


def test_scores_beyond_64_bits(spark):
    big = 10**15
    rows = [("x", 0, "", big), ("x", 1, "a", 10**11), ("x", 1, "b", 10**12 + 1), ("x", 2, "a b", 10**10 + 7)]
    (r,) = P.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, n long")).collect()
    assert r.score == 1000 * (10**10 + 7) * big // (10**11 * (10**12 + 1))
