"""A pipeline that cleans ``documents`` for training: every stage works on all its predecessor kept.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and reread for the next one. All stages but the last return the columns of ``docs``, extra ones included.
No decision is made by id: rows without one, or with one that others have too, are judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.llm import decontaminate, jaccard, lines, pieces, toxicity
from tabprep.llm.common import table
from tabprep.workspace import pin


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic verdict. Null and empty texts stay."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; documents of which nothing is left go."""
    return lines.cut_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates (five words, similarity 0.8): that of the smallest id, rows without one last.

    Rows meet by a key that is written once and dropped at the end. Null and empty texts stay.
    """
    keyed = pin(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    found = jaccard.jaccard_components(keyed.select(F.col("__row").alias("doc_id"), "text"), width=5, percent=80)
    groups = found.select(F.col("doc_id").alias("__row"), "component_id").join(keyed.select("__row", "doc_id"), "__row")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
    return keyed.join(first.select("first.__row"), "__row", "left_semi").select(*docs.columns)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows; documents of which no word is left go."""
    return decontaminate.cut_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and digests of ids and decoded text."""
    return pieces.encode_documents(docs, with_ids=True, remembered=60_000).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", cut_benchmark_passages),
    ("sentencepiece", encode),
]

#: The models and searches of the stages go beyond SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
