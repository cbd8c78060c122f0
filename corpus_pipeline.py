"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, and encoding, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predlens.llm import bpe_codec, language_id, line_dedup, mixing, near_dedup
from predlens.llm.common import discard, fresh, save, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage has changed it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language for sure, go."""
    return language_id.keep_identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document that consists of them goes."""
    _, removed = fresh(docs, "n_lines", "n_removed")
    clean = line_dedup.line_dedup(docs)
    return _counted(clean.where((F.col(removed) == 0) | (F.length("text") > 0)).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: similarity of 0.8 on five-word shingles, the width that holds where no contract gives one."""
    return near_dedup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in the order of training, in the target shares of their sources."""
    return _counted(mixing.mix(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of every copy."""
    return bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("mixing", mixture),
    ("bpe_encoding", encoding),
]

#: Language ID, the forest and the encoding have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = save(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
