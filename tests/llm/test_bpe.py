import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from changeloom.llm.bpe import decode, encode, round_trip, vocabulary

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'stredl aA1é\xa0\x1c 漢😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_ids_as_the_library(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))} if not hasattr(test_same_ids_as_the_library, "e") else None
    if ranks:
        test_same_ids_as_the_library.e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = vocabulary(PATH, P.PATTERN)
    (ids,) = bpe.encode([text])
    assert ids == test_same_ids_as_the_library.e.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_long_words(library):
    rng, pairs, byte = random.Random(1), vocabulary(PATH, P.PATTERN).pairs, vocabulary(PATH, P.PATTERN).byte
    for letters, most in [("ab", 40), ("eta", 400), ("aA", 4000), ("lo", 3000), ("abcdefghijklmnopqrstuvwxyz", 60_000)] * 8:
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(2, most)))
        merged, size = pairs.merge_all(byte[np.frombuffer(word.encode(), np.uint8)], np.array([len(word)]))
        assert merged.tolist() == pairs._one(byte[np.frombuffer(word.encode(), np.uint8)]).tolist() == library.encode_ordinary(word) and size[0] == len(merged)


def test_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in round_trip(df, PATH, P.PATTERN).collect()}
    for r in df.collect():
        ids = library.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_edges(spark, library):
    texts = [None, "", " ", "  a  b ", "x" * 5000, "ab" * 1500 + " z", "don't we'll", "\n\n a\n", "é" * 3000]
    df = spark.createDataFrame([(i if i else None, t, "k") for i, t in enumerate(texts)] * 2, "doc_id long, text string, ids string")
    ids = encode(df, PATH, P.PATTERN)
    got = sorted((r.doc_id or 0, r.ids) for r in ids.collect())
    assert got == sorted((i, library.encode_ordinary(t or "")) for i, t in enumerate(texts * 2) for i in [i % len(texts)])
    assert {(r.doc_id or 0, bytes(r.bytes)) for r in decode(ids, PATH, P.PATTERN).collect()} == {(i, (t or "").encode()) for i, t in enumerate(texts)}
    assert round_trip(df.limit(0), PATH, P.PATTERN).count() == 0
