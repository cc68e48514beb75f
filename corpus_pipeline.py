"""From documents to packed training sequences, in five stages. Each stage works on what the one before it kept.

Every stage but the last returns the columns of `documents`; the last returns the pieces of sequences. A stage's result is written
as a table before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemask.llm import exact_dedup, langid, mixing, near_dedup, packing
from sievemask.llm.common import fresh, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter go. The model learns from the labelled rows' bounded sample."""
    model = langid.fitted(docs, F.lit(True))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    return langid.labelled(docs, model, lang_out=lang, score_out=score).where(F.col(lang) != langid.UNKNOWN).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the smallest id."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a similarity of 0.8 or more, the one with the smallest id."""
    return near_dedup.deduplicated(docs, width=5, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of small sources up to twice, as flat a mix as that allows."""
    return mixing.mixed_documents(docs, entropy_share=0.98, max_repetition=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens."""
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None  # language ID, near dedup and tokens are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
