"""Explicit schemas of the text dataflow."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType())])
SEGMENT = T.StructType(
    [T.StructField("target", T.StringType()), T.StructField("context", T.StringType()), T.StructField("reference", T.StringType())]
)
SEGMENTS = T.ArrayType(SEGMENT)
RESULTS = T.ArrayType(T.StringType())
TOC_ITEM = T.StructType([T.StructField("name", T.StringType()), T.StructField("level", T.IntegerType())])
CHANGE = T.StructType([T.StructField("orig", T.StringType()), T.StructField("new", T.StringType())])
STYLED = T.StructType([T.StructField("text", T.StringType()), T.StructField("log", T.ArrayType(CHANGE))])
LOCATION = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
MATCH = T.StructType(
    [
        T.StructField("fragment_text", T.StringType()),
        T.StructField("modified_text", T.StringType()),
        T.StructField("real_text", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("ratio", T.DoubleType()),
    ]
)
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
OPCODE = T.StructType(
    [T.StructField(n, T.StringType() if n == "tag" else T.IntegerType()) for n in ("tag", "a_lo", "a_hi", "b_lo", "b_hi")]
)
DIFF_PART = T.StructType([T.StructField("op", T.StringType()), T.StructField("value", T.StringType())])
