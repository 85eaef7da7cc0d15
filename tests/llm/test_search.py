"""Ranked search against a plain count of everything."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from changeloom.llm import search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    count = {i: Counter(terms(t)) for i, t in docs.items()}
    count = {i: c for i, c in count.items() if c}
    n, total = len(count), sum(sum(c.values()) for c in count.values())
    df = Counter(t for c in count.values() for t in c)
    out = []
    for item, text in items.items():
        found = []
        for i, c in count.items():
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in Counter(terms(text)).items() if c[t])
            if score > 0:
                found.append((-score, i))
        out += [(item, k, i, -s) for k, (s, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_edges(spark):
    rows = [(None, "alpha beta", "x"), (1, None, "x"), (2, "", None), (3, " .,-\x7f ", "x"), (4, "ÉTÉ été Beta7 beta7", "x"), (5, "beta " * 70_000 + "gamma", "x"), (6, "aaa delta", "x"), (6, "zzz gamma delta", "x"), (7, "gamma delta zzz", "x"), (8, "b" * 90_000, "x")]
    rows += [(k, "same words here delta", "x") for k in range(100, 400)] + [(-5, "same words here delta", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    asked = [(1, "same DELTA delta", 0.5), (2, None, 0.5), (3, "", 0.5), (4, "été BETA7 gamma", 0.5), (5, "nowhere", 0.5), (None, "delta", 0.5), (6, "zzz", 0.5), (6, "aaa", 0.5), (7, "b" * 90_000, 0.5), (8, "beta", 0.5)]
    items = spark.createDataFrame(asked, "item_id long, text string, score double")
    want = brute({i: t for i, t, _ in sorted(rows, key=lambda r: r[1] or "") if i is not None}, {i: t for i, t, _ in sorted(asked, key=lambda r: r[1] or "") if i is not None})
    got = S.search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == want and len([w for w in want if w[0] == 1]) == 10
    assert S.search(docs.limit(0), items).count() == 0 and S.search(docs, items.limit(0)).count() == 0
    assert S.search(docs.where("doc_id in (1, 2, 3)"), items).count() == 0


@pytest.mark.parametrize("cells,first,block", [(2, 3, 1024), (12, 64, 7)])
def test_whole_table_with_loose_bounds_and_blocks(spark, monkeypatch, cells, first, block):
    """Sketches with many collisions and small rounds need more rounds and give the same."""
    for name, value in (("CELLS", cells), ("FIRST", first), ("BLOCK", block), ("PAIRS", 900)):
        monkeypatch.setattr(S, name, value)
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute({r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()})
    assert sorted(map(tuple, S.search(docs, items).collect())) == want


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words, 400)) + " w1" * 300 for _ in range(20)]
    (part,) = list(S._sketches(iter([S.rows("doc_id long, text string", list(range(20)), texts)])))
    asked = S.ask([1, 2], [" ".join(words[:200]), "w1"])
    asked = S.replace(asked, weight=np.full(len(asked.terms), 7), size=(20, 20 * 700))
    (got,) = list(S._bounds(iter([part]), asked, S.Found.none(2), 100))
    bound = {(i, d): b for i, b, d in zip(*(got.column(k).to_pylist() for k in range(3)), strict=True)}
    for d, text in enumerate(texts):
        c = Counter(terms(text))
        for i, some in enumerate((words[:200], ["w1"])):
            m = 25 + 75 * 700 * 20 // (20 * 700)
            exact = sum(7 * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in some if c[t])
            assert bound[i, d] >= exact and (i == 0 or bound[i, d] == 7_000_000)
