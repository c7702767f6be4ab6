"""Reports on segments and on the progress of a revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstrata.functions import text as X


def segment_list(segments: DataFrame, head: int = 15) -> DataFrame:
    """(doc_id, seg_no, length, context_length, head): stripped lengths and the first line of the first characters; blank is ''."""
    target = X.strip(F.col("target"))
    return segments.select(
        "doc_id",
        "seg_no",
        F.length(target).cast("long").alias("length"),
        F.length(X.strip(F.coalesce(F.col("context"), F.lit("")))).cast("long").alias("context_length"),
        X.first_line(target, head).alias("head"),
    )


def segment_totals(segments: DataFrame) -> DataFrame:
    """(doc_id, segments, target_chars, context_chars, all_chars) by document, of stripped texts."""
    size = lambda name: F.length(X.strip(F.coalesce(F.col(name), F.lit("")))).cast("long")
    sizes = segments.select("doc_id", size("target").alias("t"), size("context").alias("c"))
    out = sizes.groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum("t").alias("target_chars"), F.sum("c").alias("context_chars"))
    return out.withColumn("all_chars", F.col("target_chars") + F.col("context_chars"))


def with_results(segments: DataFrame, latest: DataFrame) -> DataFrame:
    """Segments with their output, null while it is pending."""
    return segments.join(latest, ["doc_id", "seg_no"], "left").select(*segments.columns, "output")


def progress(joined: DataFrame) -> DataFrame:
    """(doc_id, segments, done, pending, percent, chars, done_chars, percent_chars) from with_results."""
    size = F.length("target")
    out = joined.groupBy("doc_id").agg(
        F.count("*").alias("segments"),
        F.count("output").alias("done"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("chars"),
        F.coalesce(F.sum(F.when(F.col("output").isNotNull(), size)), F.lit(0)).cast("long").alias("done_chars"),
    )
    percent: Column = F.round(100.0 * F.col("done") / F.col("segments"), 2)
    by_chars = F.when(F.col("chars") > 0, F.round(100.0 * F.col("done_chars") / F.col("chars"), 2)).otherwise(F.lit(0.0))
    return out.select("doc_id", "segments", "done", (F.col("segments") - F.col("done")).alias("pending"), percent.alias("percent"), "chars", "done_chars", by_chars.alias("percent_chars"))


def pending_list(joined: DataFrame, head: int = 20) -> DataFrame:
    """(doc_id, seg_no, head) of the segments without an output."""
    return joined.where("output is null").select("doc_id", "seg_no", X.first_line(X.strip(F.col("target")), head).alias("head"))


def ordered_text(rows: DataFrame, value: str, glue: str, order: str = "seg_no") -> DataFrame:
    """(doc_id, text): the values that aren't null, in order, with glue between them."""
    listed = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, F.col(value).alias("v")))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["v"]), glue).alias("text"))


def review_text(segments: DataFrame) -> DataFrame:
    """Targets with lines of three dashes between them."""
    return ordered_text(segments, "target", "\n---\n")


def merged_text(joined: DataFrame) -> DataFrame:
    """(doc_id, text, pending): the outputs with empty lines between them; pending ones are left out and counted."""
    listed = F.array_sort(F.collect_list(F.when(F.col("output").isNotNull(), F.struct("seg_no", F.col("output").alias("v")))))
    pending = F.count(F.when(F.col("output").isNull(), 1)).alias("pending")
    return joined.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["v"]), "\n\n").alias("text"), pending)


def token_totals(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens): the rule of thumb of token_estimate."""
    return docs.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))
