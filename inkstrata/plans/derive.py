"""Views of the test tables that hold what the operators work on: headings, lists, blank lines, Han text.

Each view is given as a DataFrame and as the DuckDB SQL of the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATIN = "abcdefghijklmnopqrstuvwxyz"
HAN = "一丁七万丈三上下不与丐丑专且世丘丙业丛东丝丞丢两严丧"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than the session has cores is spread over them, as a file may be a single row group, which one task reads."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if len(found.inputFiles()) < cores else found


def marked(text: Column) -> Column:
    """Lines 0, 10, ... become headings of level 1, lines 5, 15, ... of level 2, lines 2 and 3 of each seven list items and line 4 a footnote; a blank line follows each odd line."""
    line = lambda x, p: F.concat(
        F.when(p % 10 == 0, "# ").when(p % 5 == 0, "## ").when((p % 7).isin(2, 3), F.concat(p.cast("string"), F.lit(". "))).when(p % 7 == 4, "  [^q7]:").otherwise(""),
        x,
        F.when(p % 2 == 1, "\n").otherwise(""),
    )
    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", marked(F.col("text")).alias("text"))


def han(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.translate(F.col("text"), LATIN, HAN)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def han_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return han(spark, sf_dir).select("doc_id", marked(F.col("text")).alias("text"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents of han_markdown; each third title is changed, so that no line matches it."""
    item = lambda x, p: F.when(
        p % 5 == 0, F.concat(F.when(p % 10 == 0, "- ").otherwise("    * "), x, F.when(p % 15 == 0, "…末 12").otherwise("… 12"))
    )
    items = F.filter(F.transform(F.split("text", "\n"), item), lambda x: x.isNotNull())
    return han(spark, sf_dir).select("doc_id", F.array_join(items, "\n").alias("text"))


def results(segments: DataFrame) -> DataFrame:
    """A finished revision of three of four segments."""
    output = F.when(F.col("seg_no") % 4 != 3, F.replace("target", F.lit("e"), F.lit("E")))
    return segments.select("doc_id", "seg_no", output.alias("output"), F.timestamp_seconds(F.lit(0)).alias("at"))


_MARKED = """array_to_string(list_transform(range(len(ls)), lambda p: CASE WHEN p % 10 = 0 THEN '# ' WHEN p % 5 = 0 THEN '## '
  WHEN p % 7 IN (2, 3) THEN p || '. ' WHEN p % 7 = 4 THEN '  [^q7]:' ELSE '' END || ls[p + 1] || CASE WHEN p % 2 = 1 THEN chr(10) ELSE '' END), chr(10))"""
SQL_MARKDOWN = f"md AS (SELECT doc_id, {_MARKED} AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
SQL_HAN = f"han AS (SELECT doc_id, translate(text, '{LATIN}', '{HAN}') AS text FROM documents)"
SQL_HAN_MARKDOWN = SQL_HAN + f", hmd AS (SELECT doc_id, {_MARKED} AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM han))"
SQL_CONTENTS = """toc AS (
  SELECT doc_id, p // 5 AS toc_no, (p % 10) // 5 + 1 AS level,
         regexp_replace(regexp_replace(ls[p + 1] || CASE WHEN p % 15 = 0 THEN '…末 12' ELSE '… 12' END, '^[*-]+', ''), '[\\s\\da-zA-Z\\[\\]{}.^…]', '', 'g') AS name
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM han), unnest(range(len(ls))) AS u(p) WHERE p % 5 = 0)"""


def sql_lines(source: str, name: str, key: str = "doc_id") -> str:
    """name(key, p, line): lines of source(key, text); a last line end adds none."""
    return f"""{name} AS (
  SELECT {key}, p, ls[p + 1] AS line
  FROM (SELECT {key}, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS ls FROM {source} WHERE text <> ''), unnest(range(len(ls))) AS u(p))"""


def sql_sections(source: str, name: str, levels: list[int]) -> str:
    """name(doc_id, sec_no, text)."""
    test = " OR ".join(f"starts_with(line, '{'#' * n} ')" for n in levels)
    return (
        sql_lines(source, f"{name}_l")
        + f""", {name}_n AS (SELECT *, sum(CASE WHEN {test} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM {name}_l),
{name}_m AS (SELECT *, s - min(s) OVER (PARTITION BY doc_id) AS sec_no FROM {name}_n),
{name} AS (SELECT doc_id, sec_no, string_agg(line, chr(10) ORDER BY p) AS text FROM {name}_m GROUP BY doc_id, sec_no)"""
    )


def sql_cut(source: str, name: str, least: int, key: str) -> str:
    """name(key, i, text): the greedy cut as a recursion over places; key is a list of columns. The query needs WITH RECURSIVE."""
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in key.split(","))
    pick = ", ".join(f"k.{c.strip()}" for c in key.split(","))
    return (
        sql_lines(source, f"{name}_l", key)
        + f""", {name}_c AS (
  SELECT *, p + 1 AS rn, sum(length(line)) OVER (PARTITION BY {key} ORDER BY p) AS cs, count(*) OVER (PARTITION BY {key}) AS tot FROM {name}_l),
{name}_k AS (
  SELECT {key}, 0 AS i, CAST(1 AS BIGINT) AS st, coalesce(min(rn) FILTER (trim(line) = '' AND cs >= {least}), max(tot)) AS en FROM {name}_c GROUP BY {key}
  UNION ALL
  SELECT {pick}, k.i + 1, k.en + 1,
         coalesce((SELECT min(c.rn) FROM {name}_c c WHERE {on('c', 'k')} AND c.rn > k.en AND trim(c.line) = '' AND c.cs - b.cs >= {least}), b.tot)
  FROM {name}_k k JOIN {name}_c b ON {on('b', 'k')} AND b.rn = k.en WHERE k.en < b.tot),
{name} AS (
  SELECT {pick}, k.i, string_agg(c.line, chr(10) ORDER BY c.rn) AS text
  FROM {name}_k k JOIN {name}_c c ON {on('c', 'k')} AND c.rn BETWEEN k.st AND k.en GROUP BY {pick}, k.i)"""
    )
