"""Segments of manuscripts as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from inkstrata.functions import text as X
from inkstrata.operators.split import PRESETS, segments
from inkstrata.sources.files import _name


def stream_documents(spark: SparkSession, folder: str, suffix: str = ".md", max_files: int = 1000) -> DataFrame:
    """A stream of (doc_id, text), one row per new file."""
    files = spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", max_files).format("text").load(folder)
    return files.select(_name(suffix).alias("doc_id"), X.newlines(F.col("value")).alias("text"))


def stream_segments(docs: DataFrame, preset: str = "title_length_merge") -> DataFrame:
    """Segments of a stream of documents; splitting keeps no state, so late files change nothing."""
    return segments(docs, **PRESETS[preset])


def write_segments(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the segments to Parquet, each file's exactly once, until what is there is done."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
