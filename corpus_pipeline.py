"""From raw documents to encoded training text, stage by stage.

Every stage takes what its predecessor kept. Low-quality documents go; of each group of near-duplicates
(five words, similarity 0.8 or more) the one with the smallest id stays, once; passages of over 50 words and strings of
400 bytes that still occur twice are cut out; documents that contain a benchmark item go; what is left is encoded.

Every stage takes null, empty and very long texts, repeated rows, rows without an id, further columns of any name and
empty tables. A null text stays null and counts as empty. Repeated rows of one id and text are reduced to one by the
second stage; rows without an id are never merged. Ties: equal texts keep the smallest id. What the third
stage cuts goes from every document that has it, the first one included, as operator 2 defines it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import bpe, decontaminate, near_dups, quality_model, suffixes
from tracelode.llm.common import load, shared_table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labels."""
    model = quality_model.fit(docs, load(spark, sf_dir, "labels"), F.lit(True))
    return quality_model.good_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dups.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words, and the strings of 400 bytes, that occur more than once."""
    return suffixes.without_repeats(docs, (suffixes.BYTES, suffixes.WORDS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean_documents(docs, load(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_documents(docs, bpe.vocabulary_path())


STAGES = [
    ("quality_classifier", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: SQL expresses neither the trained classifier nor the encoder; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents of the folder; what stages return is written in between."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
