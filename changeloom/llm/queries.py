"""The registered queries of the operators and of the corpus pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changeloom.llm.common import table


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changeloom.llm.pii import replace_entities

    found = replace_entities(table(spark, sf_dir, "documents"), KEY)
    return found.select("doc_id", "n_entities", "entities", "text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changeloom.llm.quality import fit, judge_documents

    documents = table(spark, sf_dir, "documents")
    return judge_documents(documents, fit(documents, table(spark, sf_dir, "labels")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changeloom.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from changeloom.llm.packing import pack, pieces

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changeloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: The key of the surrogates; a job of one's own takes a secret one.
KEY = "changeloom"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from changeloom.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changeloom.llm.substring import digest
    from changeloom.llm.suffix import remove_repeated_bytes

    return digest(remove_repeated_bytes(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changeloom.llm.toxicity import fit, score_documents

    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, fit(documents, table(spark, sf_dir, "labels")))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changeloom.llm.hnsw import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changeloom.llm.substring import digest, remove_repeats

    return digest(remove_repeats(table(spark, sf_dir, "documents")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changeloom.llm.search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changeloom.llm.phrases import mine

    return mine(table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changeloom.llm.convnet import fit, score_documents

    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, fit(documents, table(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators by number, and the pipeline."""
    found = sorted((f for name, f in globals().items() if name.startswith("op")), key=lambda f: int(f.__name__[2:].split("_")[0]))
    return {f.__name__: f for f in [*found, pipeline]}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH = rf"""with words as (select doc_id, unnest(regexp_extract_all(lowered, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select doc_id, {_LOWER} as lowered from (select doc_id, max(text) as text from documents where doc_id is not null group by 1))),
  counts as (select doc_id, term, count(*) as tf from words group by 1, 2),
  lengths as (select doc_id, cast(sum(tf) as bigint) as n from counts group by 1),
  size as (select count(*) as docs, cast(sum(n) as bigint) as terms from lengths),
  weights as (select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * count(*) + 1))) as bigint) as w from counts, size group by term, docs),
  asked as (select item_id, term, count(*) as k from (select item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select item_id, max(text) as text from benchmark where item_id is not null group by 1)) group by 1, 2),
  sums as (select item_id, doc_id, cast(sum(k * w * (1000000000 * tf // (1000 * tf + 8 * (25 + 75 * n * docs // terms)))) as bigint) as score from asked join counts using (term) join weights using (term) join lengths using (doc_id), size group by 1, 2),
  ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from sums where score > 0)
  select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10"""

PHRASES = rf"""with pieces as (select lang, row_number() over () as piece, regexp_extract_all(body, '[^\x20\x09]+') as w from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) as body from documents)),
  total as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by 1),
  runs as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) as phrase from pieces, (select unnest(range(1, 6)) as k)),
  freq as (select lang, k, phrase, count(*) as a from runs group by 1, 2, 3 having count(*) >= 100),
  split as (select *, string_split(phrase, ' ') as w from freq),
  cuts as (select c.lang, c.phrase, c.k, c.a, l.a as l, r.a as r, cast(1000 * c.a::hugeint * n // (l.a::hugeint * r.a) as bigint) as score, cut, n
    from (select *, unnest(range(1, k)) as cut from split where k > 1) c join total t on c.lang = t.lang
    join freq l on l.lang = c.lang and l.phrase = array_to_string(list_slice(c.w, 1, cut), ' ') join freq r on r.lang = c.lang and r.phrase = array_to_string(list_slice(c.w, cut + 1, c.k), ' ')),
  best as (select *, row_number() over (partition by lang, phrase order by score, cut) as place from cuts),
  held as (select distinct lang, phrase, a from (select lang, a, array_to_string(list_slice(w, s, s + k - 2), ' ') as phrase from split, (select unnest([1, 2]) as s) where k > 2)),
  ranked as (select b.lang, row_number() over (partition by b.lang order by score desc, b.a desc, encode(b.phrase)) as rank, b.phrase, b.a, b.l, b.r, b.n, b.score from best b left join held h on b.lang = h.lang and b.phrase = h.phrase and b.a = h.a where place = 1 and h.phrase is null)
  select * from ranked where rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """Operators 11 and 12; the others are tested against the library they follow, brute force, or held-out rows."""
    return {"op11_ranked_search": SEARCH, "op12_phrase_mining": PHRASES}
