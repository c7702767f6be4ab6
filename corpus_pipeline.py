"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and
returns a DataFrame; all but the last return the columns of documents.

1. quality: documents that the classifier rejects (low quality, toxic or without a word) go.
2. lines: later repeats of runs of three lines or 50 words are deleted; documents with no text left go. What a
   document shares with its own near copies stays, so that stage 3 finds these whole and not as remnants.
3. near_duplicates: one document of each group of near-duplicates stays.
4. benchmark: documents that hold a benchmark item go.
5. packing: the rest is assigned to bins; one row per piece of a document.

Rows with a null doc_id can't be compared with others: stages 2 to 4 keep them as they
are. Of rows that are equal in doc_id and text stage 3 keeps one; rows that share a doc_id
with other texts are documents of their own. Columns beside doc_id and text pass through
stages 1 to 4 whatever their names are. An empty table passes through all stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstrata.llm import decontam, linededup, packing, quality, simhash
from inkstrata.llm.common import delete_folder, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = simhash.near_duplicates(docs)
    return linededup.delete_runs(docs, linededup.repeated_runs(docs, min_words=linededup.MIN_WORDS, copies=copies))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_each(docs, simhash.near_duplicates(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier and the packing search can't be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each result is written as Parquet and read again.

    A stage's table is deleted when the next one is written; the last stays, as the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs
