import random
import re
from collections import Counter

import corpus_pipeline as P
from changeloom.llm.pii import entities
from tests.llm.test_minhash import brute as near
from tests.llm.test_repeats import brute_words

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    good = stages["quality rules"](spark, docs, SF).cache()
    assert good.dtypes == docs.dtypes
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert sum(labels.get(i) == 0 for i in kept) <= 0.05 * sum(v == 0 for v in labels.values())
    lost = [r for r in docs.collect() if r.doc_id not in kept and labels.get(r.doc_id) == 1 and len(r.text.split()) >= 50]
    assert len(lost) <= 0.02 * len(kept)

    single = stages["near dedup"](spark, good, SF).cache()
    assert single.dtypes == docs.dtypes
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in near(list(kept.items()), 5, 80).items() if i == c}

    cut = stages["substring dedup"](spark, single, SF).cache()
    assert cut.dtypes == docs.dtypes
    want = brute_words([(r.doc_id, r.text) for r in single.collect()])
    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r for r in cut.collect()}
    assert after.keys() == before.keys()
    for i, r in after.items():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == want[i][0] - want[i][1]
        assert r.text == before[i] if want[i][1] == 0 else r.n_chars == len(r.text)

    private = stages["personal data"](spark, cut, SF).cache()
    assert private.dtypes == docs.dtypes
    values = {r.text[a:b] for r in after.values() for a, b, k in entities(r.text) if k in ("email", "card", "phone", "ip")}
    assert values and not any(v in r.text for r in private.collect() for v in values)

    packed = stages["packing"](spark, private, SF)
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(after.keys())


def test_run(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], SCHEMA)


def texts(df):
    assert ", ".join(f"{c} {t.replace('bigint', 'long')}" for c, t in df.dtypes) == SCHEMA
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in df.collect()))


def told(rows):
    return sorted((i is None, i or 0, t is None, t or "") for i, t in rows)


def test_stages_on_repeated_and_null_rows(spark):
    a, b, c = words(1, 100), words(2, 100), words(3, 100)
    stages = dict(P.STAGES)
    rows = [(2, a), (2, b), (2, b), (1, None), (1, ""), (None, c), (None, a), (3, None), (4, "x")]
    df = table(spark, rows)
    assert texts(stages["near dedup"](spark, df, SF)) == told([(2, a), (2, b), (1, None), (1, ""), (None, c), (3, None), (4, "x")])
    long = c + " " + words(4, 5)
    rows = [(2, a), (2, b + " " + a), (1, None), (1, ""), (None, long), (None, long), (5, c)]
    got = texts(stages["substring dedup"](spark, table(spark, rows), SF))
    want = told([(2, a), (2, b), (1, None), (1, ""), (None, words(4, 5)), (None, ""), (5, c)])
    other = told([(2, b + " " + a), (2, ""), (1, None), (1, ""), (None, words(4, 5)), (None, ""), (5, c)])
    assert got in (want, other)  # rows of one id are in the order of their hashes
    for n in (1, 3, 7):
        assert texts(stages["substring dedup"](spark, table(spark, rows[::-1]).repartition(n), SF)) == got
    rows = [(2, "mail me@x.org"), (2, "mail you@x.org"), (1, None), (1, ""), (None, "mail me@x.org")]
    got = stages["personal data"](spark, table(spark, rows), SF).collect()
    assert len(got) == 5 and len({r.text for r in got}) == 4 and not {r.text for r in got} & {"mail me@x.org", "mail you@x.org"}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    packed = stages["packing"](spark, table(spark, rows), SF).collect()
    assert Counter(r.doc_id for r in packed) == Counter([2, 2, 1, 1, None])
    good = stages["quality rules"](spark, table(spark, [(1, None), (1, a), (1, b), (None, c), (2, "short")]), SF)
    assert set(texts(good)) <= set(told([(1, a), (1, b), (None, c)]))


def test_stages_on_empty_tables(spark):
    none = table(spark, [(1, "x")]).limit(0)
    for name, stage in P.STAGES:
        got = stage(spark, none, SF)
        assert got.count() == 0 and (name == "packing" or got.dtypes == none.dtypes)
