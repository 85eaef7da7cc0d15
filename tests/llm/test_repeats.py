import hashlib
import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

import changeloom.llm.suffix as suffix
from changeloom.llm.substring import digest, factors, remove_repeats
from changeloom.llm.suffix import common_prefix, maximal_repeats, remove_repeated_bytes, repeat_groups, repeated_ranges


def brute_words(rows, n=20):
    texts = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen, out = set(), {}
    for i in sorted(texts):
        w, gone = texts[i], [False] * len(texts[i])
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone[k : k + n] = [True] * n
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(rows, n=400):
    texts = {i: (t or "").encode() for i, t in rows}
    count = {}
    for t in texts.values():
        for k in range(len(t) - n + 1):
            h = hash(t[k : k + n])
            count[h] = count.get(h, 0) + 1
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if count[hash(t[k : k + n])] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def pack(df):
    got = [tuple(r) for r in digest(df).collect()]
    assert len({g[0] for g in got}) == len(got)
    return {g[0]: g[1:] for g in got}


EDGES = [(1, None), (2, ""), (3, " \n "), (4, "a " * 500), (5, "b" * 399), (6, "b" * 399), (7, "c" * 900), (8, "x " + "w1 w2 w3 " * 300), (9, "é" * 450), (10, "word " * 60_000), (11, "q w e r t y u i o p a s d f g h j k l z"), (12, "q\tw e r t y u i o p a s d f g h j k l  z x")]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_words_against_all_windows(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert pack(remove_repeats(docs)) == brute_words([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("group", [4096, 1])
def test_bytes_against_all_strings(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert pack(remove_repeated_bytes(docs)) == brute_bytes([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    df = spark.createDataFrame([(*r, "k") for r in EDGES], "doc_id long, text string, kept string")
    assert pack(remove_repeats(df)) == brute_words(EDGES)
    assert pack(remove_repeated_bytes(df)) == brute_bytes(EDGES)
    twice = df.unionByName(df.where("doc_id = 7")).unionByName(spark.createDataFrame([(None, "z", "")], df.schema))
    assert pack(remove_repeats(twice)) == brute_words(EDGES)
    assert pack(remove_repeated_bytes(twice)) == brute_bytes(EDGES)
    assert pack(remove_repeats(df.limit(0))) == pack(remove_repeated_bytes(df.limit(0))) == {}


def test_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    passages = [[word() for _ in range(n)] for n in (15, 19, 20, 21, 60, 130)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 80))]
        for p in rng.sample(passages, rng.randrange(0, 4)):
            cut = rng.randrange(len(p))
            w += (p[:cut] + [word()] + p[cut:]) if rng.random() < 0.3 else p
            w += [word() for _ in range(rng.randrange(0, 30))]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pack(remove_repeats(df)) == brute_words(rows)
    assert pack(remove_repeated_bytes(df)) == brute_bytes(rows)


def test_maximal_repeats_hold_all_occurrences():
    texts = [b"xxABCDEFyy", b"zzABCDEFyy", b"xxABCDqqqq", b"ppABCDEFrr"]
    found = {(b, o): sorted(m) for b, o, m in maximal_repeats([t[:4][::-1] for t in texts], [t[4:] for t in texts], 4)}
    assert found == {(2, 6): [0, 1], (2, 4): [0, 1, 3], (2, 2): [0, 1, 2, 3], (4, 2): [0, 2]}


def test_factors_are_copies_and_cannot_be_longer(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    passages = [[word() for _ in range(n)] for n in (60, 90, 150)]
    rows = []
    for i in range(40):
        w = [word() for _ in range(rng.randrange(0, 30))]
        for p in rng.choices(passages, k=rng.randrange(1, 5)):
            lo, hi = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            w += p[lo:hi] + [word() for _ in range(rng.randrange(0, 3))]
        rows.append((i, " ".join(w)))
    text = {i: t.split() for i, t in rows}
    seen, first = set(), {}
    for i in sorted(text):
        for k in range(len(text[i]) - 19):
            seen.add(key := tuple(text[i][k : k + 20]))
            first.setdefault(key, (i, k))
    got = sorted(tuple(r) for r in factors(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len({g[0] for g in got}) > 20 and any(g[5] for g in got)
    begins = {g[:2] for g in got}
    copied = {i: set() for i in text}
    greedy_end = dict.fromkeys(text, 0)
    for i, at, n, source, source_at, boundary in got:
        assert n >= 20 and (source, source_at) < (i, at) and text[i][at : at + n] == text[source][source_at : source_at + n]
        copied[i] |= set(range(at, at + n - 19))
        if boundary:
            assert at < greedy_end[i] < at + n
        else:
            assert at >= greedy_end[i]
            greedy_end[i] = at + n
            if at + n < len(text[i]) and source_at + n < len(text[source]) and text[i][at + n] == text[source][source_at + n]:
                assert (i, at + n - 19) in begins  # longer in its source only where the next window was found in another block
    for i, w in text.items():
        assert copied[i] == {k for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] != (i, k)}


def begins(ranges, most):
    return {b for lo, hi in ranges for b in range(lo, min(hi, most) + 1)}


def test_ranges_are_the_union_of_the_maximal_repeats():
    rng = random.Random(3)
    for _ in range(1000):
        n, least = rng.randrange(1, 9), rng.randrange(3, 9)
        some = lambda most: "".join(rng.choice("ab") for _ in range(rng.randrange(most))).encode()
        lefts, rights = [some(6) for _ in range(n)], [b"A" + some(7) for _ in range(n)]
        got = [begins(r, least) for r in repeated_ranges(lefts, rights, least)]
        pairs = [(m, o, common_prefix(lefts[m], lefts[o]), common_prefix(rights[m], rights[o])) for m in range(n) for o in range(n) if o != m]
        assert got == [{b for k, _, back, on in pairs if k == m for b in range(back + 1) if 0 <= least - b <= on} for m in range(n)]
        held = [[] for _ in range(n)]
        for back, on, members in maximal_repeats(lefts, rights, least):
            for m in members:
                held[m].append((max(0, least - on), back))
        assert got == [begins(h, least) for h in held]


def test_nested_repeats_need_little_memory():
    rng = random.Random(4)
    base = rng.randbytes(5000)
    lefts = [b"q" * 250 + rng.randbytes(50) for _ in range(4096)]
    rights = [base[: 100 + k * 300 // 4096] + k.to_bytes(2) * 5 for k in range(4096)]
    tracemalloc.start()
    found = repeated_ranges(lefts, rights, 400)
    assert tracemalloc.get_traced_memory()[1] < 100e6 and sum(map(bool, found)) > 2000
    tracemalloc.stop()


@pytest.mark.parametrize("group", [4096, 2])
def test_groups_hold_all_occurrences_at_full_length(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rng = random.Random(12)
    some = lambda n: bytes(rng.choice(b"abcd") for _ in range(n)).decode()
    passages, whole = [some(n) for n in (30, 60, 200)], some(150)
    rows = []
    for i in range(30):
        text = some(rng.randrange(40))
        for p in rng.choices(passages, k=rng.randrange(3)):
            lo, hi = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            text += p[lo:hi] + some(rng.randrange(20))
        rows.append((i, text + (whole if i % 10 == 3 else "")))
    texts, least = dict(rows), 20
    where = {}
    for i, t in texts.items():
        for k in range(len(t) - least + 1):
            where.setdefault(t[k : k + least], set()).add((i, k))
    groups = {}
    for r in repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), window=least, run=5).collect():
        groups.setdefault((r.group_id, r.length, r.n), set()).add((r.doc_id, r.at))
    assert max(length for _, length, _ in groups) >= 150
    covered = set()
    for (_, length, n), places in groups.items():
        (string,) = {texts[i][at : at + length] for i, at in places}
        assert len(string) == length >= least and n == len(places) > 1
        assert places == {(i, k) for i, t in texts.items() for k in range(len(t) - length + 1) if t[k : k + length] == string}
        for step, edge in ((-1, 0), (1, length - least)):  # one byte more on either side
            more = {texts[i][at + edge + step : at + edge + step + least] if at + edge + step >= 0 else "" for i, at in places}
            longer = next(iter(more))
            assert len(more) > 1 or len(longer) < least or len(where[longer]) > n
        covered |= {(i, at + k) for i, at in places for k in range(length - least + 1)}
    assert covered == {p for places in where.values() if len(places) > 1 for p in places}
