"""Splitting manuscripts into ordered segments.

All of these are column expressions over one document, so they run where the document
is read, without a shuffle. Texts are null-safe: a null gives a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstrata.functions import text as X

#: The four ready-made ways to split: name -> parameters of `segments`.
PRESETS: dict[str, dict] = {
    "title_length_context": {"way": "context", "levels": [1, 2], "cut_by": 200},
    "title_length_merge": {"way": "merge", "levels": [2], "threshold": 500, "cut_by": 300, "min_length": 120},
    "title": {"way": "title", "levels": [1, 2]},
    "length": {"way": "length", "cut_by": 600},
}


def cut_by_length(text: Column, cut_by: int = 600) -> Column:
    """Pieces that end at the first blank line at which they have cut_by characters.

    Line ends aren't counted, the blank line belongs to the piece, and cut_by is 50 at
    least. A text without blank lines is one piece. The state of the fold is the count
    and the places of the cuts, not the pieces.
    """
    least = max(50, int(cut_by))

    def pieces(lines: Column) -> Column:
        state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("cuts"))

        def step(a: Column, x: Column) -> Column:
            n = a["n"] + F.length(x)
            ends = (n >= least) & X.is_blank(x)
            return F.struct(
                F.when(ends, 0).otherwise(n).alias("n"),
                (a["i"] + 1).alias("i"),
                F.when(ends, F.array_append(a["cuts"], a["i"] + 1)).otherwise(a["cuts"]).alias("cuts"),
            )

        cuts = F.aggregate(lines, state, step, lambda a: F.when(F.element_at(a["cuts"], -1) < a["i"], F.array_append(a["cuts"], a["i"])).otherwise(a["cuts"]))
        return X.let(
            cuts,
            lambda c: F.transform(
                F.slice(c, 2, F.size(c)), lambda end, k: F.array_join(F.slice(lines, F.get(c, k) + 1, end - F.get(c, k)), "\n")
            ),
        )

    return X.let(X.split_lines(text), pieces)


def cut_long(parts: Column, threshold: int = 1500, cut_by: int = 800) -> Column:
    """Cut the elements longer than threshold; the others stay."""
    return F.flatten(F.transform(parts, lambda x: F.when(F.length(x) > threshold, cut_by_length(x, cut_by)).otherwise(F.array(x))))


def split_by_title(text: Column, levels: list[int] | None = None) -> Column:
    """Sections that begin at heading lines; what stands before the first is a section too."""
    wanted = levels or [2]
    return X.groups(X.split_lines(text), lambda ls, i: X.is_title(F.get(ls, i), wanted))


def merge_short(parts: Column, min_length: int = 100) -> Column:
    """Join runs of short elements to the next long one; a short rest is one element."""
    return X.groups(parts, lambda ls, i: F.length(F.get(ls, i - 1)) >= min_length)


def split_with_context(text: Column, levels: list[int] | None = None, cut_by: int = 600) -> Column:
    """Structs (context, target): each piece with its whole section; blank pieces stay."""
    return F.flatten(
        F.transform(
            split_by_title(text, levels),
            lambda s: F.transform(cut_by_length(s, cut_by), lambda p: F.struct(s.alias("context"), p.alias("target"))),
        )
    )


def split_and_merge(text: Column, levels: list[int] | None = None, threshold: int = 1000, cut_by: int = 800, min_length: int = 120) -> Column:
    """Sections, long ones cut, short ones merged, blank ones dropped."""
    merged = merge_short(cut_long(split_by_title(text, levels), threshold, cut_by), min_length)
    return F.filter(merged, lambda x: ~X.is_blank(x))


def segments(docs: DataFrame, way: str, levels: list[int] | None = None, **sizes: int) -> DataFrame:
    """(doc_id, seg_no, target, context) by one of the four ways; see PRESETS."""
    text = F.col("text")
    if way == "context":
        found = docs.select("doc_id", F.posexplode(split_with_context(text, levels, **sizes)).alias("seg_no", "s"))
        return found.select("doc_id", "seg_no", "s.target", "s.context")
    parts = {"merge": split_and_merge, "title": split_by_title}.get(way)
    array = parts(text, levels, **sizes) if parts else cut_by_length(text, **sizes)
    found = docs.select("doc_id", F.posexplode(array).alias("seg_no", "target"))
    return found.withColumn("context", F.lit(None).cast("string"))


def preset(docs: DataFrame, name: str) -> DataFrame:
    return segments(docs, **PRESETS[name])
