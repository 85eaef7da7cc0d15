import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from changeloom.llm.packing import pack, pieces, plan, slots
from changeloom.llm.wordbpe import vocabulary

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


LIBRARY = []


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'stredlAÉé\xa0\x1c ΣİßK漢😀12"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_same_ids_as_the_library(text):
    if not LIBRARY:
        LIBRARY.append(Tokenizer.from_file(PATH))
    texts = [text, None, "", text[::-1] + " b"]
    ids, n = vocabulary(PATH).encode(pa.array(texts, pa.string()))
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [LIBRARY[0].encode(t or "", add_special_tokens=False).ids for t in texts]


def test_special_tokens_are_the_library_s(library):
    texts = ["a <|endoftext|> b", "x<|endoftext|>y,<|startoftext|>", "<|EndOfText|> <|endoftext|", "a."]
    ids, n = vocabulary(PATH).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[:3].tolist() == [320, 49407, 321]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_uses_each_piece_once(counts):
    used = Counter()
    for times, some in plan(counts, 64):
        assert sum(some) <= 64 and times > 0
        for n in some:
            used[n] += times
    assert used == Counter(counts)
    assert sum(r[2] - r[1] + 1 for r in slots(plan(counts, 64))) == sum(counts.values())


def test_plan_is_near_the_bound():
    rng = random.Random(1)
    counts = Counter(min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(50_000))
    made, least = sum(t for t, _ in plan(counts, 4096)), sum(n * c for n, c in counts.items()) / 4096
    assert made <= least * 1.002 + 2


def check_layout(got):
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for some in by.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by)


def test_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pack(pieces(df, PATH)).collect()
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in df.collect()}
    want = {(i, k // 4096): (k, len(x[k : k + 4096]), zlib.crc32(np.array(x[k : k + 4096], "<u4").tobytes())) for i, x in ids.items() for k in range(0, len(x), 4096)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert check_layout(got) <= sum(map(len, ids.values())) / 4096 * 1.01 + 1


def test_edges(spark, library):
    texts = [None, "", "  ", "a", "word " * 9000, "x" * 3000, "same text", "same text"]
    df = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)] * 2, "doc_id long, text string, offset int")
    got = pack(pieces(df, PATH)).collect()
    check_layout(got)
    assert Counter(r.doc_id for r in got) == Counter([r if r else None for r in range(8)] * 2 + [4] * 4)
    assert pack(pieces(df.limit(0), PATH)).count() == 0
    (long,) = [r.ids for r in pieces(df.where("doc_id = 5").limit(1), PATH, with_ids=True).collect()]
    assert long == [*library.encode("x" * 3000, add_special_tokens=False).ids, 1]


def test_exact_triple_behind_many_that_need_one_length_twice():
    from changeloom.llm.packing import _Stock

    lengths = [82, 110, 118, 157, 180, 244, 280, 291, 303, 329, 335, 336, 394, 418, 440, 512, 640, 686, 764, 780, 836]
    got = _Stock(dict.fromkeys(lengths, 1), 4096).exact(1000, ())
    assert got and sum(got) == 1000 and len(set(got)) == 3 and set(got) <= set(lengths)
