"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage returns as Parquet in the shared folder and reads it as the docs of
the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.llm.common import documents
from verilake.llm.langid import identified, train
from verilake.llm.linedup import without_repeated_lines
from verilake.llm.neardup import near_duplicates
from verilake.llm.packing import pack
from verilake.llm.substrings import without_repeats
from verilake.sources.scratch import delete, released, scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or between two languages go. Without labels to learn from all that have a letter stay."""
    return identified(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; those of which nothing but blanks is left go."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together; it stays
    if one of its texts is kept.
    """
    placed = near_duplicates(docs, shingle=5, num=80, den=100)
    gone = placed.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("gone")).agg(F.max("kept").alias("kept")).filter("NOT kept").select("gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier text has; those left without a word go."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL cannot express the stages: classifiers, gear hashes and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; of what is written on the way only the table that it reads stays, in the shared folder."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with released(spark):  # what the stage itself wrote goes when its result is there
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:  # and its input
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
