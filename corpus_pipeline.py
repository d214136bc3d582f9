"""From raw documents to token ids in five stages, each a table of its own.

An empty table passes through all of them; ids may be null or repeat. Columns beyond those that a
stage reads, whatever their names, are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlens.llm import mixing, ngram_join, quality, sentencepiece_backend, suffix_dedup
from patternlens.llm.common import stash, table
from patternlens.llm.queries import tokenizer_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; learns from ``labels`` outside the held-out fold.

    Null and empty texts are judged as the text without words; rows that repeat stand or fall together.
    """
    score = quality.scorer(quality.train(docs, table(spark, sf_dir, "labels")))
    return docs.where(quality.decide(score(F.col("text")), 0.3) == 1)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates, that with the smallest id; texts without words all stay, once each."""
    return ngram_join.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes runs of over 50 words that also stand elsewhere; no row goes, and shorter repeats stay."""
    return suffix_dedup.deduplicated(docs, unit=suffix_dedup.PASSAGES)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by source up to the targets, some more than once and some in part; what has no words is not taken."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with whether decoding them gives the text back; a row for each row."""
    return sentencepiece_backend.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [("quality", keep_good), ("near_duplicates", one_of_each), ("suffix_dedup", without_repeats), ("mixing", mixed), ("sentencepiece", encoded)]

#: No SQL can say the classifier, the suffix array and the encoder; the stages are tested on brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
