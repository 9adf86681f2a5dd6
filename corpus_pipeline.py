"""A training-text pipeline over `documents`: what is kept of it, encoded.

Each stage works on all that the stage before kept and calls one operator of
trajlab.llm; its result is written and read again as the next one's input. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trajlab.llm import decontaminate, line_dedup, near_dedup, pieces, quality
from trajlab.llm.files import removed
from trajlab.llm.tables import checkpointed, fresh_dir, quoted, table

#: least similarity, in hundredths, of two documents of a group; op4 alone has 85 as its contract
NEAR_PERCENT = 80
#: SQL can't state the isolation forest or the piece encoding.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest reject go."""
    return quality.passing(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal to an earlier one are cut at every length, those within a word of it from 8 words on;
    documents stay, if need be with an empty text."""
    return line_dedup.without_lines(docs, equal_words=1).select(*[quoted(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return near_dedup.representatives(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; null and empty texts stay, repeated rows share one fate."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of each text and the text they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.round_trip(docs, path).drop("text_key")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What the stages wrote goes once the last one is computed."""
    docs, folders = table(spark, sf_dir, "documents"), []
    try:
        for name, stage in STAGES[:-1]:
            folders.append(fresh_dir(spark, name))
            stage(spark, docs, sf_dir).write.parquet(folders[-1])
            docs = spark.read.parquet(folders[-1])
        return checkpointed(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        for folder in folders:
            removed(spark, folder)
