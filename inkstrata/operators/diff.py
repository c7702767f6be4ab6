"""Comparison of two versions of a manuscript: sections, lines and words."""

from __future__ import annotations

import difflib
import math
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstrata.functions import text as X
from inkstrata.functions.rows import by_row
from inkstrata.functions.types import DIFF_PART, OPCODE
from inkstrata.operators.split import split_by_title
from inkstrata.sources.files import write_documents


def sections(docs: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """(doc_id, sec_no, title, section); the title is the cleaned first line."""
    found = docs.select("doc_id", F.posexplode(split_by_title(F.col("text"), levels)).alias("sec_no", "section"))
    title = X.clean_title(F.split(X.strip(F.col("section")), "\n")[0])
    return found.select("doc_id", "sec_no", title.alias("title"), "section")


def section_pairs(before: DataFrame, after: DataFrame, levels: list[int] | None = None, every: bool = False) -> DataFrame:
    """Sections of both versions by number: (doc_id, sec_no, title_a, title_b, section_a, section_b).

    Sections that one version lacks are left out, or with `every` have nulls. The documents
    are joined and cut where they meet, so that a text is shuffled once and in one piece.
    """
    both = before.select("doc_id", F.col("text").alias("a")).join(after.select("doc_id", F.col("text").alias("b")), "doc_id", "full_outer" if every else "inner")
    cut = both.select("doc_id", split_by_title(F.col("a"), levels).alias("a"), split_by_title(F.col("b"), levels).alias("b"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    count = (F.greatest if every else F.least)(*(F.when(F.col(c).isNull(), 0).otherwise(size(c)) for c in "ab"))
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    rows = cut.select("doc_id", F.inline(F.transform(numbers, lambda i: F.struct(i.alias("sec_no"), F.get("a", i).alias("section_a"), F.get("b", i).alias("section_b")))))
    title = lambda c: X.clean_title(F.split(X.strip(F.col(c)), "\n")[0])
    return rows.select("doc_id", "sec_no", title("section_a").alias("title_a"), title("section_b").alias("title_b"), "section_a", "section_b")


def titles_agree(before: DataFrame, after: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """(doc_id, sections_a, sections_b, first_difference, consistent); documents of either version.

    first_difference is the first section whose titles differ, null if none does;
    consistent also asks for equal numbers of sections.
    """
    pairs = section_pairs(before, after, levels, every=True)
    both = F.col("title_a").isNotNull() & F.col("title_b").isNotNull()
    out = pairs.groupBy("doc_id").agg(
        F.count("title_a").alias("sections_a"),
        F.count("title_b").alias("sections_b"),
        F.min(F.when(both & (F.col("title_a") != F.col("title_b")), F.col("sec_no"))).alias("first_difference"),
    )
    return out.withColumn("consistent", F.col("first_difference").isNull() & (F.col("sections_a") == F.col("sections_b")))


def tidy_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) without white space at their ends; of blank lines the first in a run stays, none at the start."""
    bare = lines.select("doc_id", "line_no", X.rstrip(F.col("line")).alias("line"))
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return bare.withColumn("_before", before).where((F.col("line") != "") | (F.coalesce("_before", F.lit("")) != "")).drop("_before")


def tidy(lines: list[str]) -> list[str]:
    """tidy_lines for one text."""
    out: list[str] = []
    for line in lines:
        line = line.rstrip()
        if line or (out and out[-1]):
            out.append(line)
    return out


LINE_STYLE = """<style>
body, table, tr, td { font-family: "Noto Serif CJK SC", SimSun, serif !important; font-size: 14px !important; }
.diff_add { text-decoration: underline; } .diff_sub { text-decoration: line-through; } .diff_chg { text-decoration: underline dotted; }
</style></head>"""


def line_table(a: list[str], b: list[str], context: bool = False, numlines: int = 3, names: tuple[str, str] = ("before", "after")) -> str:
    """A page with the lines of both texts side by side."""
    # The library wraps a line by recursion, a level for each 33 characters.
    longest = max((len(x) for x in [*a, *b]), default=0)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), longest // 16 + 1000))
    page = difflib.HtmlDiff(tabsize=4, wrapcolumn=33).make_file(tidy(a), tidy(b), *names, context=context, numlines=numlines)
    return page.replace("</head>", LINE_STYLE, 1)


def line_diff(a: Column, b: Column, context: bool = False, numlines: int = 3) -> Column:
    """Struct (ops, html) of two texts; ops are in lines after tidying."""
    kind = T.StructType([T.StructField("ops", T.ArrayType(OPCODE)), T.StructField("html", T.StringType())])

    def run(x: str | None, y: str | None) -> dict:
        p, q = (x or "").splitlines(), (y or "").splitlines()
        ops = difflib.SequenceMatcher(None, tidy(p), tidy(q), autojunk=False).get_opcodes()
        return {"ops": [dict(zip(OPCODE.names, o)) for o in ops], "html": line_table(p, q, context, numlines)}

    return by_row(run, kind)(a, b)


WORD = re.compile(r"\s+|[一-鿿]|[^\W一-鿿]+|[^\w\s]")


#: Bits of a table of _lcs that are kept at a time (8 MB), and the width of a block of its rows.
TABLE_BITS = 1 << 26
ROW_BITS = 1 << 14


def _masks(x: list[str], units: set[str]) -> dict[str, int]:
    """For each of the units, the places in x where it stands as the bits of a number."""
    at: dict[str, list[int]] = {}
    for i, unit in enumerate(x):
        if unit in units:
            at.setdefault(unit, []).append(i)
    out = {}
    for unit, places in at.items():
        bits = bytearray(places[-1] // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        out[unit] = int.from_bytes(bits, "little")
    return out


def _last_row(x: list[str], y: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of y with x[:0], x[:1] and so on to x, by bit vectors (Hyyrö 2004)."""
    steps = [np.zeros(1, np.int64)]
    carry = bytearray(len(y))  # of each row, from one block of x into the next
    units = set(y)
    for start in range(0, len(x), ROW_BITS):
        block = x[start : start + ROW_BITS]
        n = len(block)
        v = full = (1 << n) - 1
        get = _masks(block, units).get
        for j, unit in enumerate(y):
            u = v & get(unit, 0)
            total = v + u + carry[j]
            carry[j] = total >> n
            v = (total & full) | (v - u)
        bits = np.frombuffer(v.to_bytes(-(-n // 8), "little"), np.uint8)
        steps.append(1 - np.unpackbits(bits, count=n, bitorder="little").astype(np.int64))
    return np.cumsum(np.concatenate(steps))


def _lcs(x: list[str], y: list[str], at: int = 0, to: int = 0) -> Iterator[tuple[int, int]]:
    """Places of a longest common subsequence, in order; `at` and `to` are added to them.

    Hirschberg's division of y, until the table of a part has TABLE_BITS at most: time grows
    with len(x) * len(y) / 64, memory with len(x) + len(y).
    """
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        yield at + head, to + head
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    ends = at + len(x) - tail, to + len(y) - tail
    x, y, at, to = x[head : len(x) - tail], y[head : len(y) - tail], at + head, to + head
    if len(y) > 1 and len(x) * len(y) > TABLE_BITS:
        j = len(y) // 2
        i = int((_last_row(x, y[:j]) + _last_row(x[::-1], y[j:][::-1])[::-1]).argmax())
        yield from _lcs(x[:i], y[:j], at, to)
        yield from _lcs(x[i:], y[j:], at + i, to + j)
    elif x and y:
        v = full = (1 << len(x)) - 1
        get = _masks(x, set(y)).get
        rows = [v]
        for unit in y:
            u = v & get(unit, 0)
            v = ((v + u) & full) | (v - u)
            rows.append(v)
        table = [r.to_bytes(-(-len(x) // 8), "little") for r in rows]
        found = []
        i, j = len(x), len(y)
        while i and j:
            byte, bit = (i - 1) >> 3, 1 << ((i - 1) & 7)
            if table[j][byte] & bit:
                i -= 1
            else:
                j -= 1
                if table[j][byte] & bit:
                    i -= 1
                    found.append((at + i, to + j))
        yield from reversed(found)
    yield from ((ends[0] + k, ends[1] + k) for k in range(tail))


def _greedy(x: list[str], y: list[str], most: int) -> list[tuple[int, int]] | None:
    """Places of the equal units of a shortest edit script by the greedy O(ND) algorithm; None if it needs more than `most` edits."""
    n, m = len(x), len(y)
    v = array("i", [0]) * (2 * most + 3)
    trace: list[array] = []
    end = -1
    for d in range(min(n + m, most) + 1):
        trace.append(v[most + 1 - d : most + 2 + d])
        for k in range(-d, d + 1, 2):
            at = most + 1 + k
            i = v[at + 1] if k == -d or (k != d and v[at - 1] < v[at + 1]) else v[at - 1] + 1
            if d == 0:
                i = 0
            j = i - k
            while i < n and j < m and x[i] == y[j]:
                i, j = i + 1, j + 1
            v[at] = i
            if i >= n and j >= m:
                end = d
                break
        if end >= 0:
            break
    if end < 0:
        return None
    pairs: list[tuple[int, int]] = []  # equal units, from the last to the first
    i, j = n, m
    for d in range(end, 0, -1):
        before, k = trace[d], i - j
        get = lambda q: before[q + d]  # noqa: B023, E731
        down = k == -d or (k != d and get(k - 1) < get(k + 1))
        k = k + 1 if down else k - 1
        a = get(k)
        b = a - k
        start = (a, b + 1) if down else (a + 1, b)
        while i > start[0] and j > start[1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        i, j = a, b
    pairs.extend((q, q) for q in range(i - 1, -1, -1))
    return pairs[::-1]


def _edits(x: list[str], y: list[str], most: int) -> list[tuple[str, int, int, int, int]]:
    """Opcodes of a shortest edit script; beyond `most` edits it is found by _lcs, which takes the same time for any number.

    So it is, too, where the greedy algorithm would take longer for fewer edits.
    """
    n, m = len(x), len(y)
    most = min(most, math.isqrt(2 * m * (1 + n // 8192)))
    p, q = Counter(x), Counter(y)
    pairs = _greedy(x, y, most) if (p - q).total() + (q - p).total() <= most else None
    if pairs is None:
        pairs = _lcs(x, y)
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for a, b in [*pairs, (n, m)]:
        if a > i or b > j:
            out.append(("replace", i, a, j, b))
        if a < n or b < m:
            if out and out[-1][0] == "equal" and out[-1][2] == a and out[-1][4] == b:
                out[-1] = ("equal", out[-1][1], a + 1, out[-1][3], b + 1)
            else:
                out.append(("equal", a, a + 1, b, b + 1))
        i, j = a + 1, b + 1
    return out


def word_parts(a: str, b: str, most: int = 1000) -> list[tuple[str, str]]:
    """(op, value) with op equal, delete or insert; white space, words, Han characters and signs are units.

    The equal and deleted values make a, the equal and inserted ones b. The script is a
    shortest one for any two texts; `most` only says to how many edits the search by edits
    is tried first.
    """
    if a == b:
        return [("equal", a)] if a else []
    x, y = WORD.findall(a), WORD.findall(b)
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    p, q = x[head : len(x) - tail], y[head : len(y) - tail]
    out: list[tuple[str, str]] = []

    def add(op: str, units: list[str]) -> None:
        if units:
            text = "".join(units)
            if out and out[-1][0] == op:
                text = out.pop()[1] + text
            out.append((op, text))

    add("equal", x[:head])
    for op, i, j, k, m in _edits(p, q, most) if p or q else []:
        if op == "equal":
            add(op, p[i:j])
        else:
            add("delete", p[i:j])
            add("insert", q[k:m])
    add("equal", x[len(x) - tail :])
    return out


def word_diff(a: Column, b: Column) -> Column:
    """Array of (op, value); a null is an empty text."""

    return by_row(lambda x, y: [dict(zip(DIFF_PART.names, part)) for part in word_parts(x or "", y or "")], T.ArrayType(DIFF_PART))(a, b)


WORD_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>@TITLE@</title><style>
pre { white-space: pre-wrap; } .equal { color: gray; }
ins { color: green; text-decoration: wavy underline; } del { color: red; text-decoration: overline; }
</style></head><body><pre>@BODY@</pre></body></html>
"""


def escape(c: Column) -> Column:
    """Safe within HTML."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def write_diff_files(pages: DataFrame, folder: str) -> None:
    """Write (path, html) as <name of the path without its last extension>_diff.html into the folder."""
    name = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    write_documents(pages.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.col("html").alias("text")), folder, "_diff.html")


def word_page(parts: Column, title: Column) -> Column:
    """A page that shows the parts of word_diff; their texts are escaped."""
    mark = lambda p, open_, shut: F.concat(F.lit(open_), escape(p["value"]), F.lit(shut))
    shown = F.transform(
        parts,
        lambda p: F.when(p["op"] == "insert", mark(p, "<ins>", "</ins>"))
        .when(p["op"] == "delete", mark(p, "<del>", "</del>"))
        .otherwise(mark(p, '<span class="equal">', "</span>")),
    )
    head, rest = WORD_PAGE.split("@TITLE@")
    middle, tail = rest.split("@BODY@")
    return F.concat(F.lit(head), escape(title), F.lit(middle), F.array_join(shown, ""), F.lit(tail))
