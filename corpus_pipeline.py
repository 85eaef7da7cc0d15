"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage works on what the one before kept, written as Parquet and read again. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm.common import row_keys, shared_folder, table
from changeloom.llm.minhash import near_duplicates
from changeloom.llm.packing import pack, pieces
from changeloom.llm.pii import replace_entities
from changeloom.llm.quality import fit, keep_good
from changeloom.llm.queries import KEY
from changeloom.llm.substring import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: A column that tells rows apart inside a stage; ids may repeat or be null.
ROW = "__row"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep.

    Each row is judged by its own text, whatever its id. Null, empty and short texts fail the rules and go; other null
    columns stay null; an empty table stays empty.
    """
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id: five-word shingles of similarity 0.8 or more.

    Every row is a document of its own: of equal rows one stays, of different texts with one id each
    is compared, and rows without an id come after all others. A null, empty or blank text is a duplicate of nothing and stays. Other columns stay as they are; an empty
    table stays empty.
    """
    keyed = row_keys(docs, "doc_id", ROW)
    gone = near_duplicates(keyed, id_col=ROW, words=5, percent=80).where("not kept").select(F.col("doc_id").alias(ROW))
    return keyed.join(gone, ROW, "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words that a window of 20 words, found earlier, covers; ``n_chars`` follows the text.

    Every row is a document of its own and gets its own text back, whatever its id; rows without an id come after all
    others. Null and empty texts, and those that lose nothing, stay as they are, with their ``n_chars``; a text that loses all is empty. An empty table stays empty.
    """
    keyed = row_keys(docs, "doc_id", ROW)
    kept = remove_repeats(keyed, id_col=ROW, spaced=True).where("n_removed > 0").select(F.col("doc_id").alias(ROW), F.decode("kept", "UTF-8").alias("__new"))
    new = F.col("__new")
    both = keyed.join(kept, ROW, "left")
    return both.withColumns({"text": F.coalesce(new, F.col("text")), "n_chars": F.when(new.isNull(), F.col("n_chars")).otherwise(F.length(new)).cast("long")}).select(docs.columns)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; ``n_chars`` follows the text.

    Every row stays, and gets its own text; a null text stays null, an empty one empty, and one without personal data
    as it is, with its ``n_chars``. An empty table stays empty.
    """
    found = replace_entities(docs, KEY)
    return found.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the texts with their places in sequences of 4096 tokens.

    Every row is packed, with its id, null or repeated as it is; a null or empty text is one token. Longer texts than a
    sequence are cut. An empty table gives an empty one.
    """
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("personal data", pii_surrogates),
    ("packing", best_fit_packing),
]

#: SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_folder(spark)}/changeloom/{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
