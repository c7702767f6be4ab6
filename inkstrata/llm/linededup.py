"""Line deduplication by winnowing over line hashes.

The lines of a document that are not blank (trimmed of spaces) are hashed in order. Of
every window of `min_lines` consecutive hashes the least is selected (of equal ones the
last): about two lines in min_lines + 1. Every run of min_lines lines holds a selected
line, in every place where it stands the same one, so a selected hash is a guaranteed
fingerprint. A row is kept for each selected line, with the hashes of its min_lines - 1
neighbours on both sides.

1. Selected lines are joined with the first place of an equal one, and the match is
   extended both ways, neighbour by neighbour, over the windows that it was selected for.
2. A line may be repeated in other company than at its first place. What didn't match
   there is joined once more, by fingerprint and neighbours, with the first place of the
   whole window. So every window that stands earlier is found, and a line in millions of
   documents costs a row for each of them.

Matches that overlap or touch are merged into runs. Every run of at least `min_lines` lines
that also occurs earlier (in order of doc_id, then of the text's hash, then line) is
deleted. With `min_words`, runs of fewer lines count too if they hold that many words; they
are selected in the same way, by their own length. The query op4_line_dedup, like its SQL,
goes without, the pipeline takes MIN_WORDS.

With `copies`, the near copies that simhash.near_duplicates finds, a document keeps the
windows whose first place is in its own group of copies: who deletes near copies as wholes
afterwards, as the pipeline does, finds them whole, instead of remnants that resemble nothing.

First places are found by partial aggregation and kept as a table before the join, whose
sides are then plain shuffles, so that adaptive execution can split a frequent fingerprint.

Defined results
- One row per deleted run: doc_id, start_line, end_line (from 0, end included),
  n_lines (not blank), first_doc_id, first_line (where its beginning stands earlier), and
  text_key, the hash of the text that the lines belong to.
- A run within one document that repeats an earlier part of it goes too.
- Texts that are null give nothing, nor do those of fewer lines than min_lines and, with
  min_words, fewer words.
- Rows with a null doc_id are not compared. Rows that share doc_id and text are the same
  document, so a repeated row doesn't delete itself; rows that share a doc_id with other
  texts are documents of their own, and a run of one never cuts the other.
- doc_id must be a column of integers; others are refused with a TypeError.
- An empty table gives an empty result; columns other than doc_id and text are ignored.
- In delete_runs, blank lines within a run go with it. A document that had a line that
  isn't blank and has none left goes; the others keep all their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions.text import let
from inkstrata.llm.common import cut_lineage, free_name, integer_id
from inkstrata.llm.words import word_count

MIN_LINES = 3
#: What the pipeline asks of runs of fewer lines. The SQL of op4_line_dedup knows whole windows of MIN_LINES only.
MIN_WORDS = 50


def selected_lines(docs: DataFrame, size: int, min_words: int | None = None) -> DataFrame:
    """A row for each selected line: doc_id, text_key, k (lines of a window), fp, i (number of the line),

    near and places (hashes and line numbers from k - 1 before to k - 1 after it, null beyond the
    text) and offs (its places in the windows of k lines whose least hash it is).
    """
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("p"), F.trim(x).alias("x"))), lambda t: t["x"] != ""
    )
    words = (lambda x: F.lit(0).cast("long")) if min_words is None else word_count
    hashed = docs.where("doc_id is not null and text is not null").select(
        integer_id(docs),
        F.xxhash64("text").alias("text_key"),
        F.transform(lines, lambda t: F.struct(t["p"].alias("p"), F.xxhash64(t["x"]).alias("h"), words(t["x"]).alias("n"))).alias("l"),
    )

    def of(k: int) -> Column:
        starts = F.when(F.size("h") >= k, F.sequence(F.lit(0), F.size("h") - k)).otherwise(F.array().cast("array<int>"))
        last_least = lambda s: let(F.slice("h", s + 1, k), lambda w: (s + k - F.array_position(F.reverse(w), F.array_min(w))).cast("int"))
        around = F.sequence(F.lit(1 - k), F.lit(k - 1))

        def counts(chosen: Column, i: Column, off: Column) -> Column:
            enough = F.lit(True)
            if k < size:
                enough = F.aggregate(F.slice("n", i - off + 1, k), F.lit(0).cast("long"), lambda a, x: a + x) >= min_words
            return F.when(F.get(chosen, i - off) == i, enough).otherwise(False)

        seeds = let(
            F.transform(starts, last_least),
            lambda chosen: F.transform(
                F.array_distinct(chosen),
                lambda i: F.struct(
                    F.lit(k).alias("k"),
                    F.get("h", i).alias("fp"),
                    i.alias("i"),
                    F.transform(around, lambda d: F.get("h", i + d)).alias("near"),
                    F.transform(around, lambda d: F.get("p", i + d)).alias("places"),
                    F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda off: counts(chosen, i, off)).alias("offs"),
                ),
            ),
        )
        return F.filter(seeds, lambda x: F.size(x["offs"]) > 0) if k < size else seeds

    least_lines = size if min_words is None else 1
    # Without a condition on the number of lines: it would be pushed down, and all hashed twice.
    spread = hashed.select("doc_id", "text_key", F.col("l.p").alias("p"), F.col("l.h").alias("h"), F.col("l.n").alias("n"))
    return spread.select("doc_id", "text_key", F.inline(F.concat(*(of(k) for k in range(least_lines, size + 1)))))


def _hits(docs: DataFrame, size: int, min_words: int | None) -> DataFrame:
    """Windows that stand earlier: doc_id, text_key, s, e (lines that aren't blank, e excluded), start_line, end_line, first_doc_id, first_text_key, first_line."""
    seeds = selected_lines(docs, size, min_words)
    place = ["doc_id", "text_key", "i", "near", "places"]
    firsts = cut_lineage(seeds.groupBy("k", "fp").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    after = lambda *names: F.struct(*names) > F.struct(*(F.col(f"first.{n}").alias(n) for n in names))
    window = lambda near, off: F.slice(near, F.col("k") - off, F.col("k"))
    same = F.filter("offs", lambda off: window("near", off) == window("first.near", off))
    met = seeds.join(firsts, ["k", "fp"]).where(after("doc_id", "text_key", "i")).withColumn("same", same)
    met = cut_lineage(met.withColumn("rest", F.array_except("offs", "same")))

    def spread(offs: str, *more: Column) -> DataFrame:
        off = F.col("off")
        at = met.select("*", F.explode(offs).alias("off"))
        return at.select(
            "doc_id", "text_key", (F.col("i") - off).alias("s"), (F.col("i") - off + F.col("k")).alias("e"),
            F.get("places", F.col("k") - 1 - off).alias("start_line"), F.get("places", 2 * F.col("k") - 2 - off).alias("end_line"), *more,
        )

    columns = ["doc_id", "text_key", "s", "e", "start_line", "end_line", "first_doc_id", "first_text_key", "first_line"]
    here = spread("same", F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_key").alias("first_text_key"), F.get("first.places", F.col("k") - 1 - F.col("off")).alias("first_line"))
    key = ["k", "off", "fp", "g"]
    others = spread("rest", "k", "off", "fp", F.xxhash64(window("near", F.col("off"))).alias("g"))
    others_first = cut_lineage(
        others.groupBy(*key).agg(F.min(F.struct("doc_id", "text_key", "s", "start_line")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    there = others.join(others_first, key).where(after("doc_id", "text_key", "s"))
    there = there.select("*", F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_key").alias("first_text_key"), F.col("first.start_line").alias("first_line"))
    return here.select(columns).unionByName(there.select(columns)).distinct()


def _of_other_groups(hits: DataFrame, copies: DataFrame) -> DataFrame:
    """The hits whose first place isn't in the document's own group of near copies."""
    for prefix in ("", "first_"):
        own = [F.col(f"{prefix}{c}") for c in ("doc_id", "text_key")]
        member = copies.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), F.struct("kept_doc_id", "kept_text_key").alias("_kept"))
        joined = hits.join(member, (own[0] == F.col("_d")) & (own[1] == F.col("_t")), "left")
        alone = F.struct(own[0].alias("kept_doc_id"), own[1].alias("kept_text_key"))
        hits = joined.withColumn(f"{prefix}group", F.coalesce("_kept", alone)).drop("_d", "_t", "_kept")
    return hits.where((F.col("group") != F.col("first_group")) | ((F.col("doc_id") == F.col("first_doc_id")) & (F.col("text_key") == F.col("first_text_key"))))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None, copies: DataFrame | None = None) -> DataFrame:
    """The runs to delete; with min_words also shorter runs of so many words, with copies none that near copies share. See the module's text."""
    if min_lines < 1:
        raise ValueError("min_lines must be 1 at least")
    by_doc = Window.partitionBy("doc_id", "text_key").orderBy("s", F.desc("e"))
    reached = F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    hits = _hits(docs, min_lines, min_words)
    runs = (hits if copies is None else _of_other_groups(hits, copies)).withColumn("new", F.coalesce(F.col("s") > reached, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy("doc_id", "text_key", "run")
        .agg(
            F.min("start_line").cast("long").alias("start_line"),
            F.max("end_line").cast("long").alias("end_line"),
            (F.max("e") - F.min("s")).cast("long").alias("n_lines"),
            F.min_by(F.struct("first_doc_id", "first_line"), F.struct("s", -F.col("e"))).alias("first"),
        )
        .select("doc_id", "start_line", "end_line", "n_lines", "first.first_doc_id", F.col("first.first_line").cast("long").alias("first_line"), "text_key")
    )


def delete_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """docs with the runs deleted from their texts, in the columns of docs."""
    spans, key, text_key = (free_name(docs, n) for n in ("_runs", "_key", "_text_key"))
    cut = cut_lineage(runs.groupBy(F.col("doc_id").alias(key), F.col("text_key").alias(text_key)).agg(F.collect_set(F.struct("start_line", "end_line")).alias(spans)))
    with_runs = docs.join(cut, (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64("text") == F.col(text_key)), "left")
    gone = F.flatten(F.transform(spans, lambda r: F.sequence(r["start_line"], r["end_line"])))
    left = let(
        F.split("text", "\n"),
        lambda lines: F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines) - F.lit(1).cast("long")), gone), lambda i: F.get(lines, i.cast("int"))),
    )
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    changed = with_runs.withColumn("text", text).where(F.col(spans).isNull() | F.col("text").rlike(r"\S"))
    return changed.select(docs.columns)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents),
k AS (
  SELECT doc_id, p, trim(x) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS s FROM l WHERE trim(x) <> ''),
w AS (
  SELECT doc_id, s, p AS start_line, lead(p, 2) OVER d AS end_line,
         x || chr(10) || lead(x, 1) OVER d || chr(10) || lead(x, 2) OVER d AS g
  FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY s)),
f AS (
  SELECT *, first_value(doc_id) OVER o AS fd, first_value(s) OVER o AS fs, first_value(start_line) OVER o AS fl
  FROM w WHERE g IS NOT NULL WINDOW o AS (PARTITION BY g ORDER BY doc_id, s)),
d AS (SELECT * FROM f WHERE (doc_id, s) <> (fd, fs)),
n AS (
  SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 3 THEN 0 ELSE 1 END AS new FROM d),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM n),
e AS (
  SELECT doc_id, run, min(start_line) AS start_line, max(end_line) AS end_line, arg_min(fd, s) AS first_doc_id, arg_min(fl, s) AS first_line
  FROM r GROUP BY doc_id, run)
SELECT e.doc_id, CAST(e.start_line AS BIGINT) AS start_line, CAST(e.end_line AS BIGINT) AS end_line,
       count(*) AS n_lines, first_doc_id, CAST(first_line AS BIGINT) AS first_line
FROM e JOIN k ON k.doc_id = e.doc_id AND k.p BETWEEN e.start_line AND e.end_line
GROUP BY ALL
"""
