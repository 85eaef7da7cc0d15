import re

import pytest

from changeloom.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, component string"


def brute(rows, words=3, percent=85):
    sets = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    pairs = {(a, b) for v in by.values() for x, a in enumerate(v) for b in v[x + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def result(df):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()]
    assert all(k == (i == c) for i, _, c, k in got)
    assert len({g[0] for g in got}) == len(got)
    return {i: (n, c) for i, n, c, _ in got}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert result(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(spark):
    long = "word " * 70_000 + "end"
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one two", "y"), (5, "ONE\ttwo", None), (6, "one  two three", "z"), (7, long, "z"), (8, long, "z"), (8, long, "z"), (9, "one", ""), (None, "one two", "")]
    got = result(near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute([r[:2] for r in rows if r[0]])
    assert result(near_duplicates(spark.createDataFrame([], SCHEMA))) == {}


def test_large_cluster_in_blocks(spark, monkeypatch):
    import random

    import changeloom.llm.minhash as m

    monkeypatch.setattr(m, "BLOCK_MEMBERS", 16)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), ""))
    assert result(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute([r[:2] for r in rows])
