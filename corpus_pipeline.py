"""A corpus pipeline of five stages: each keeps, changes or packs all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brasswork.llm import language_id, near_duplicates, packing, pii, repeats
from brasswork.llm.common import Scratch, clear_scratch, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes from which on a passage that occurs elsewhere goes: about 50 words and the spaces between them.
PASSAGE = repeats.PASSAGE


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or unlike all learned languages go.

    Null and empty texts go too. Repeated rows stay or go together; columns, whatever their names, go through unchanged, and
    an empty table stays empty. Texts of any length are read whole, here and in all stages.
    """
    return language_id.filter_documents(docs, language_id.fit_documents(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group that links of a similarity of 0.8 or more join.

    Texts without a word are linked with nothing and stay; repeated rows stay once. Columns go through unchanged.
    """
    return near_duplicates.keep_one(spark, docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE bytes or more that occur anywhere else.

    Every row stays, null texts as nulls; n_chars is counted anew, other columns go through unchanged.
    """
    return repeats.remove_repeats(spark, docs, PASSAGE)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and terms that reveal it, replaced.

    Every row stays, null texts as nulls; n_chars is counted anew, other columns go through unchanged.
    """
    return pii.sanitise(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens.

    A null text is an empty one, of which a piece of the end id alone is packed; an empty table gives no rows.
    """
    return packing.pack_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", recognised),
    ("jaccard_join", distinct),
    ("suffix_dedup", unrepeated),
    ("pii", sanitised),
    ("packing", packed),
]

#: No stage can be said in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of documents; each stage is written in the shared folder and read again.

    What a stage has written for itself is deleted once its result is written, and so is its predecessor's.
    """
    scratch = Scratch(spark)
    own = len(Scratch.made)
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        clear_scratch(own)
        if before is not None:
            scratch.drop(before)
        before = name
    return docs
