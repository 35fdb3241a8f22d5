"""From raw documents to packed training rows.

Each stage works on all that its predecessor kept and returns the columns of ``documents``,
but for the last, which returns packed rows of token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clinprep.llm import decontaminate, jaccard, language, mixing, packing
from clinprep.llm.common import load, stored

TOKENIZER = "piece_bpe_32k.model"
LEAST_WORDS = 8  # of a benchmark item whose occurrence drops a document; shorter ones, such as an answer of one word, are everyday text


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the others go."""
    return language.known_language(docs, language.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item of ``LEAST_WORDS`` words or more."""
    return decontaminate.clean_documents(docs, load(spark, sf_dir, "benchmark"), shortest=LEAST_WORDS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_copies(docs)


def packed_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the id and position matrices."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing_sources", mixing_sources), ("packed_tokens", packed_tokens)]

#: No stage but the mix can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
