"""Chat formatting with relational expressions only.

Turns of a conversation are collected as structs and sorted. The places where the role
changes cut them into runs, each run's texts are joined, and the messages concatenated, all
in time that grows with the turns. No Python runs on the rows.

Defined results
- Order: turn, then role, then text, nulls first; equal rows stay, next to each other.
- A null or blank role becomes "unknown", a null text "". Roles are trimmed and lower-cased.
- Merged texts are joined by a blank line; an empty text adds nothing.
- The control marks "<|" and "|>" inside a text or a role become "< |" and "| >", and line
  ends inside a role blanks, so that neither can write a turn of its own.
- A turn whose conv_id is null can't be told to belong to others: each is a conversation of
  its own with a null conv_id.
- An empty table gives an empty result; columns other than the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstrata.functions.text import let


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _messages(turns: Column) -> Column:
    """Array of (role, text) of sorted turns: one for each run of turns of one role."""

    def build(roles: Column, texts: Column) -> Column:
        every = F.when(F.size(roles) > 0, F.sequence(F.lit(0), F.size(roles) - 1)).otherwise(F.array().cast("array<int>"))
        firsts = F.filter(every, lambda i: (i == 0) | (F.get(roles, i) != F.get(roles, i - 1)))
        one = lambda f, a, k: F.slice(texts, a + 1, F.coalesce(F.get(f, k + 1), F.size(roles)) - a)
        return let(
            firsts,
            lambda f: F.transform(
                f, lambda a, k: F.struct(F.get(roles, a).alias("role"), F.array_join(F.filter(one(f, a, k), lambda x: x != ""), "\n\n").alias("text"))
            ),
        )

    return let(turns["role"], lambda roles: let(turns["text"], lambda texts: build(roles, texts)))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, n_messages, text."""
    role = F.lower(F.trim(F.translate(F.coalesce(F.col("role"), F.lit("")), "\r\n", "  ")))
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.when(role == "", F.lit("unknown")).otherwise(_escaped(role)).alias("role"),
            _escaped(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    # F.array_sort puts nulls within structs first, as struct ordering does.
    chats = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    alone = rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    out = chats.unionByName(alone).select("conv_id", F.size("turns").cast("long").alias("n_turns"), _messages(F.col("turns")).alias("m"))
    return out.select(
        "conv_id",
        "n_turns",
        F.size("m").cast("long").alias("n_messages"),
        F.array_join(
            F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n<|end|>\n"))),
            "",
        ).alias("text"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, trim(translate(coalesce(role, ''), chr(13) || chr(10), '  ')) AS role,
         replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS text,
         CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone
  FROM conversations),
t AS (
  SELECT conv_id, alone, turn, text,
         CASE WHEN role = '' THEN 'unknown' ELSE replace(replace(lower(role), '<|', '< |'), '|>', '| >') END AS role
  FROM c),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS p FROM t),
f AS (
  SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id, alone ORDER BY p) THEN 0 ELSE 1 END AS starts FROM n),
g AS (
  SELECT *, sum(starts) OVER (PARTITION BY conv_id, alone ORDER BY p) AS msg FROM f),
m AS (
  SELECT conv_id, alone, msg, min(role) AS role, count(*) AS k,
         coalesce(string_agg(text, chr(10) || chr(10) ORDER BY p) FILTER (text <> ''), '') AS text
  FROM g GROUP BY conv_id, alone, msg)
SELECT conv_id, CAST(sum(k) AS BIGINT) AS n_turns, count(*) AS n_messages,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY msg) AS text
FROM m GROUP BY conv_id, alone
"""
