"""Text expressions with Unicode white space and explicit line rules.

Java's \\s is ASCII by default and, with (?U), leaves out U+001C to U+001F, so white
space is spelled out as WS under (?U). In (?d) mode only a line feed ends a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
#: The same characters in a row, for trimming without a regular expression.
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
HAN = r"[一-鿿]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once even if use names it within lambdas."""
    return F.transform(F.array(value), use)[0]


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return c.rlike(rf"(?U)\A{WS}*\z")


def has_han(c: Column) -> Column:
    return c.rlike(HAN)


def split_lines(c: Column) -> Column:
    """Lines at any line end; a last line end adds no empty line, and an empty text has none."""
    body = F.regexp_replace(c, rf"(?:{LINE_END})\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END, -1))


def lf_lines(c: Column) -> Column:
    return F.split(c, "\n")


def newlines(c: Column) -> Column:
    """CR LF and CR become LF, as when a text file is read."""
    return F.regexp_replace(c, "\r\n?", "\n")


def clean_title(c: Column) -> Column:
    """Without white space, digits, Latin letters, brackets, dots and carets."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f\da-zA-Z\[\]{}.^]", "")


def is_title(line: Column, levels: list[int]) -> Column:
    """Starts with as many # as one of the levels, then a blank."""
    test = F.lit(False)
    for n in levels:
        test = test | line.startswith("#" * n + " ")
    return test


def groups(lines: Column, starts: Callable[[Column, Column], Column]) -> Column:
    """Join an array's elements by line feeds into runs.

    starts(lines, i) says whether element i (from 0, never 0) begins a run.
    """

    def build(ls: Column) -> Column:
        every = F.when(F.size(ls) > 0, F.sequence(F.lit(0), F.size(ls) - 1)).otherwise(F.array().cast("array<int>"))
        firsts = F.filter(every, lambda i: (i == 0) | starts(ls, i))
        joined = let(
            firsts,
            lambda f: F.transform(
                f, lambda a, k: F.array_join(F.slice(ls, a + 1, F.coalesce(F.get(f, k + 1), F.size(ls)) - a), "\n")
            ),
        )
        return F.when(ls.isNotNull(), joined)

    return let(lines, build)


def first_line(c: Column, most: int) -> Column:
    """The first line of the first `most` characters."""
    return F.split(F.substring(c, 1, most), "\n")[0]


def token_estimate(c: Column) -> Column:
    """0.6 a Han character and 0.3 any other, a rule of thumb."""
    han = F.length(F.regexp_replace(c, r"[^一-鿿]", ""))
    return F.round(han * 0.6 + (F.length(c) - han) * 0.3, 1)
