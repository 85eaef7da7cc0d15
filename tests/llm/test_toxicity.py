import random
from collections import Counter, defaultdict
from math import exp, log
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from changeloom.llm import toxicity
from changeloom.llm.toxicity import DISCOUNT, ORDER, TELLING, _logistic, fit, score_documents


def grams(word, k):
    framed = b"\0" * (ORDER - 1) + word.lower().encode() + b"\0"
    return [framed[e - k : e] for e in range(ORDER, len(framed) + 1)]


def brute(rows, labels):
    """Scores by id from all n-grams of the labelled rows, in plain dicts."""
    own = Counter(), Counter()
    for i, text in rows:
        if crc32(str(i).encode()) % 5 >= 2:
            for w, n in Counter(text.split()).items():
                for g in grams(w, ORDER):
                    own[1 - labels[i]][g] += n
    kinds = [set(g for i, text in rows if crc32(str(i).encode()) % 5 >= 2 for w in set(text.split()) for g in grams(w, k)) for k in range(2, ORDER)] + [set(own[0] + own[1])]
    shared = [Counter(g[1:] for g in longer) for longer in kinds] + [own[0] + own[1]]

    def sums(count):
        out = defaultdict(lambda: [0, 0])
        for g, n in count.items():
            out[g[:-1]][0] += n
            out[g[:-1]][1] += 1
        return count, dict(out)

    shared, own = [sums(c) for c in shared], [sums(c) for c in own]

    def smooth(tables, g, lower):
        total, different = tables[1].get(g[:-1], (0, 0))
        return (max(tables[0].get(g, 0) - DISCOUNT, 0) + DISCOUNT * different * lower) / total if total else lower

    def ratio(word):
        out = 0
        for g in grams(word, ORDER):
            p = 1 / 257
            for k in range(1, ORDER + 1):
                p = smooth(shared[k - 1], g[ORDER - k :], p)
            out += log(smooth(own[0], g, p)) - log(smooth(own[1], g, p))
        return out

    known = {}
    measure = {}
    asked = [(i, text) for i, text in rows if crc32(str(i).encode()) % 5 < 2]
    for i, text in asked:
        r = [known[w] if w in known else known.setdefault(w, ratio(w)) for w in text.split()]
        measure[i] = (sum(r) / max(1, len(r)), sum(sorted(r)[-TELLING:]) / TELLING)
    some = sorted(i for i, _ in asked if crc32(str(i).encode()) % 5 == 1)
    w = _logistic(np.array([measure[i] for i in some]).reshape(-1, 2), np.array([labels[i] for i in some], float))
    return {i: 1 / (1 + exp(-max(-30, min(30, a * w[0] + b * w[1] + w[2])))) for i, (a, b) in measure.items()}


def corpus(docs, words, size):
    """Training rows of ``words`` random words each; the others have 30 of these and 10 that no training row has."""
    rng = random.Random(7)
    common = ["calm", "green", "hill", "scum", "idiot", "house"]
    random_words = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size)) for _ in range(n)]
    trained = [k for k in range(docs) if crc32(str(k).encode()) % 5 >= 2]
    own = {k: random_words(words) for k in trained}
    for k in set(range(docs)) - set(trained):
        own[k] = random_words(10) + [rng.choice(own[rng.choice(trained)]) for _ in range(30)]
    rows = [(k, " ".join(rng.choices(common, k=20) + own[k] + ["scum"] * (k % 3))) for k in range(docs)]
    return rows, {k: int(k % 3 == 0) for k in range(docs)}


def compare(spark, rows, labels):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    want = brute(rows, labels)
    got = {r.doc_id: r.score for r in score_documents(df, fit(df, marks)).where(F.col("doc_id").isin(list(want))).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_every_gram_counts(spark):
    """More than 500,000 different n-grams of a length, nearly all of them singletons."""
    rows, labels = corpus(60, 800, 24)
    trained = [t.split() for i, t in rows if crc32(str(i).encode()) % 5 >= 2]
    assert len({g for t in trained for w in t for g in grams(w, ORDER)}) > 500_000
    compare(spark, rows, labels)


def test_little_at_hand(spark, monkeypatch):
    """Ratios that tasks do not hold come by the joins, with the same scores."""
    for most in (0, 40):
        monkeypatch.setattr(toxicity, "AT_HAND", most)
        compare(spark, *corpus(60, 40, 7))
