"""Cleaning and structuring book text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstrata.functions import text as X
from inkstrata.functions.rows import by_row
from inkstrata.functions.types import STYLED


def delete_images(text: Column) -> Column:
    """`![image](...){...}` becomes two blanks."""
    return F.regexp_replace(text, r"(?d)!\[image\](.+?)\{.+?\}", "  ")


STYLE = re.compile(r"\[([^\[\]]*)\]\{.s(\d+)( [^\{\}]*)?\}")
STRICT_STYLE = re.compile(r"\[([^\[\]]*)\]\{\.s(\d+)( [^\{\}]*)?\}")


def restyle(text: str, templates: dict[int, str], default: str | None = None, strict: bool = False) -> tuple[str, list[tuple[str, str]]]:
    """Replace `[content]{.sNN}` by its code's template, in one pass; the second value lists the changes.

    Empty content gives two blanks. As the dot of the mark is any sign unless strict,
    a template's own brackets can't be taken for a mark.
    """
    log: list[tuple[str, str]] = []

    def change(m: re.Match) -> str:
        content = m[1].strip()
        template = templates.get(int(m[2])) if int(m[2]) in templates else default or None
        new = "  " if not content else template.replace("$1", content) if template is not None else m[0]
        if new != m[0]:
            log.append((m[0], new))
        return new

    return (STRICT_STYLE if strict else STYLE).sub(change, text), log


def mark_styles(text: Column, templates: Column, default: str | None = None, strict: bool = False) -> Column:
    """Struct (text, log) of restyle; templates is a map<int, string> column."""

    def run(t: str | None, m: list[tuple[int, str]] | None) -> dict:
        if t is None:
            return {"text": None, "log": None}
        new, log = restyle(t, dict(m or []), default, strict)
        return {"text": new, "log": [{"orig": a, "new": b} for a, b in log]}

    return by_row(run, STYLED)(text, templates)


def restyled(text: Column, templates: Column, default: str | None = None) -> Column:
    """The text of mark_styles alone."""
    return by_row(lambda t, m: None if t is None else restyle(t, dict(m or []), default)[0], T.StringType())(text, templates)


def parse_toc(tocs: DataFrame, indent: int = 4, base_level: int = 1) -> DataFrame:
    """(doc_id, toc_no, name, level) from the bullet lines of a table of contents."""

    def item(line: Column, no: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(line, rf"(?U)^{X.WS}*([*+-])\1*", ""), r"(?U)[\s\x1c-\x1f\da-zA-Z\[\]{}.^…]", "")
        lead = F.length(F.regexp_extract(line, rf"(?U)^({X.WS}*)", 1))
        level = (F.floor(lead / indent) + base_level).cast("int")
        return F.when(line.rlike(rf"(?U)^{X.WS}*[*+-]"), F.struct(no.alias("toc_no"), name.alias("name"), level.alias("level")))

    # As elements of an array, names are made once and not again for the condition.
    return tocs.select("doc_id", F.inline(F.filter(F.transform(X.lf_lines(F.col("text")), item), lambda x: x["name"] != "")))


def mark_titles(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) whose cleaned form is a TOC name become headings.

    Of equal names the last TOC item decides.
    """
    last = toc.groupBy(F.col("doc_id").alias("_d"), F.col("name").alias("_n")).agg(F.max_by("level", "toc_no").alias("_level"))
    joined = lines.join(last, (F.col("doc_id") == F.col("_d")) & (X.clean_title(F.col("line")) == F.col("_n")), "left")
    heading = F.concat(F.repeat(F.lit("#"), F.col("_level")), F.lit(" "), X.strip(F.col("line")))
    return joined.select("doc_id", "line_no", F.when(F.col("_level").isNull(), F.col("line")).otherwise(heading).alias("line"))


def missing_titles(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """TOC items that no line matches; equal items are all listed."""
    found = lines.select("doc_id", X.clean_title(F.col("line")).alias("name"))
    return toc.join(found, ["doc_id", "name"], "left_anti").select("doc_id", "toc_no", "name", "level")


def number_footnotes(lines: DataFrame) -> DataFrame:
    """Numbered and marked footnote lines get keys a to z, then 1, 2 and so on.

    Counting goes on over blank lines and starts again after any other line. Each
    footnote gets a line feed more at its end.
    """
    line = F.col("line")
    blank = X.is_blank(line)
    numbered = ~blank & line.rlike(NUMBERED)
    marked = ~blank & ~numbered & line.rlike(MARKED)
    by_doc = Window.partitionBy("doc_id").orderBy("line_no")
    by_run = Window.partitionBy("doc_id", "_run").orderBy("line_no")
    with_kind = lines.withColumn("_kind", F.when(blank, 0).when(numbered, 1).when(marked, 2).otherwise(3))
    runs = with_kind.withColumn("_run", F.sum((F.col("_kind") == 3).cast("int")).over(by_doc))
    place = F.sum(F.col("_kind").isin(1, 2).cast("int")).over(by_run) - 1
    key = F.when(F.col("_i") < 26, F.char(F.col("_i") + 97)).otherwise((F.col("_i") - 25).cast("string"))
    first = F.regexp_extract(line, r"(?dU)^([\s\x1c-\x1f]*)\d+\.([\s\x1c-\x1f]+.+)$", 2)
    second = F.regexp_extract(line, r"(?dU)^([\s\x1c-\x1f]*)\[\^[a-zA-Z0-9]+\]:(.+)$", 2)
    indent = F.regexp_extract(line, r"(?dU)^([\s\x1c-\x1f]*)\[\^[a-zA-Z0-9]+\]:(.+)$", 1)
    new = (
        F.when(F.col("_kind") == 1, F.concat(F.lit("[^"), key, F.lit("]:"), first, F.lit("\n")))
        .when(F.col("_kind") == 2, F.concat(indent, F.lit("[^"), key, F.lit("]:"), second, F.lit("\n")))
        .otherwise(line)
    )
    return runs.withColumn("_i", place).select("doc_id", "line_no", new.alias("line"))


TONED = {c for letter in "aoeiuümnê" for tone in "\u0304\u0301\u030c\u0300" for c in unicodedata.normalize("NFC", letter + tone)} | set("üêẑĉŝŋ")
LATIN = "a-zA-Z'" + "".join(sorted(TONED | {c.upper() for c in TONED}))
PINYIN = re.compile(rf"[（(][{LATIN}]+[)）]")
LETTER_NOTE = re.compile(r"(\s*)([a-zA-Z])(\s+.+)$")


def letter_footnotes(lines: list[str]) -> list[str]:
    """Footnote lines `a text` become `[^a]:text`, and lone letters a elsewhere `[^a]`.

    Letters within bracketed romanisation stay. Its place is looked up again for each
    key, so that earlier changes don't shift it.
    """
    out = list(lines)
    keys: dict[str, None] = {}
    notes = set()
    for i, line in enumerate(lines):
        if m := LETTER_NOTE.match(line):
            keys[m[2]] = None
            notes.add(i)
            out[i] = f"[^{m[2]}]:{m[3]}\n"
    for i, line in enumerate(lines):
        if i in notes:
            continue
        for key in keys:
            inside = [m.span() for m in PINYIN.finditer(line)]
            for m in reversed(list(re.finditer(rf"(^|[^a-zA-Z])({key})($|[^a-zA-Z])", line))):
                a, b = m.span(2)
                if not any(s <= a < e for s, e in inside):
                    line = f"{line[:a]}[^{key}]{line[b:]}"
        out[i] = line
    return out


def join_broken(text: str) -> str:
    """Join a line of 30 characters or more that ends in Han to the next line that isn't blank and begins with Han.

    Joins are pairwise: a joined line is not joined again.
    """
    lines, out, i = text.split("\n"), [], 0
    han = re.compile(r"[一-鿿]")
    while i < len(lines):
        line = lines[i]
        if len(line) >= 30 and han.match(line[-1]):
            j = next((k for k in range(i + 1, len(lines)) if lines[k].strip()), None)
            if j is not None and han.match(lines[j][0]):
                out.append(line + lines[j])
                i = j + 1
                continue
        out.append(line)
        i += 1
    return "\n".join(out)


def mark_letter_footnotes(text: Column | str) -> Column:
    """letter_footnotes over the LF lines of a text."""
    return by_row(lambda t: None if t is None else "\n".join(letter_footnotes(t.split("\n"))), T.StringType())(text)


def join_broken_lines(text: Column | str) -> Column:
    return by_row(lambda t: None if t is None else join_broken(t), T.StringType())(text)


def squeeze_blank_lines(text: Column) -> Column:
    """At most one blank line between lines; the next line keeps its indent."""
    return F.regexp_replace(text, rf"(?U)\n{X.WS}*\n", "\n\n")


def join_wrong_splits(text: Column) -> Column:
    """Join a line of 31 characters or more that ends in Han to the next that begins with Han, over one empty line at most.

    What follows a join counts from the end of the match. A match can begin there or at
    the start of a line only, as a later start makes the line shorter; saying so keeps
    the search linear.
    """
    return F.regexp_replace(text, r"(?dm)(?:^|\G)(.{30,}[一-鿿])\n{1,2}([一-鿿])", "$1$2")


def strip_line_heads(text: Column) -> Column:
    return F.array_join(F.transform(X.lf_lines(text), X.lstrip), "\n")


def join_headings(text: Column) -> Column:
    """The headings for preface and contents, split over two lines, become one."""
    one = F.replace(text, F.lit("\n前\n\n言\n"), F.lit("\n前言\n"))
    return F.replace(one, F.lit("\n目\n\n录\n"), F.lit("\n目录\n"))


NUMBERED = r"(?dU)^([\s\x1c-\x1f]*)(\d+)\.([\s\x1c-\x1f]+.+)$"
MARKED = r"(?dU)^([\s\x1c-\x1f]*)\[\^([a-zA-Z0-9]+)\]:(.+)$"


def number_footnotes_in(text: Column) -> Column:
    """number_footnotes over the LF lines of a text, where it stands: no line leaves its document."""
    kind = lambda x: F.when(X.is_blank(x), 0).when(x.rlike(NUMBERED), 1).when(x.rlike(MARKED), 2).otherwise(3)
    key = lambda i: F.when(i < 26, F.char(i + 97)).otherwise((i - 25).cast("string"))

    def numbered(x: Column, k: Column) -> Column:
        lead = F.when(x["kind"] == 2, F.regexp_extract(x["line"], MARKED, 1)).otherwise("")
        rest = F.when(x["kind"] == 1, F.regexp_extract(x["line"], NUMBERED, 3)).otherwise(F.regexp_extract(x["line"], MARKED, 3))
        return F.concat(lead, F.lit("[^"), key(k), F.lit("]:"), rest, F.lit("\n"))

    def run(part: Column) -> Column:
        """A run of lines: no line after its first is of kind 3."""
        is_note = lambda x: x["kind"].isin(1, 2)
        notes = F.filter(F.transform(part, lambda x, i: F.when(is_note(x), i)), lambda i: i.isNotNull())
        return X.let(notes, lambda ns: F.transform(part, lambda x, i: F.when(is_note(x), numbered(x, (F.array_position(ns, i) - 1).cast("int"))).otherwise(x["line"])))

    def build(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        firsts = F.filter(every, lambda i: (i == 0) | (F.get(lines, i)["kind"] == 3))
        parts = X.let(firsts, lambda f: F.transform(f, lambda a, k: F.slice(lines, a + 1, F.coalesce(F.get(f, k + 1), F.size(lines)) - a)))
        return F.array_join(F.flatten(F.transform(parts, run)), "\n")

    lines = F.transform(X.lf_lines(text), lambda x: F.struct(x.alias("line"), kind(x).alias("kind")))
    return F.when(text.isNotNull(), X.let(lines, build))


def toc_levels(toc: DataFrame) -> DataFrame:
    """(doc_id, levels): a map of each document's TOC names to levels; of equal names the last item decides."""
    items = F.array_sort(F.collect_list(F.struct("name", "toc_no", "level")))
    is_last = lambda xs: lambda x, i: ~F.get(xs, i + 1)["name"].eqNullSafe(x["name"])
    last = X.let(F.col("items"), lambda xs: F.transform(F.filter(xs, is_last(xs)), lambda x: F.struct(x["name"], x["level"])))
    return toc.groupBy("doc_id").agg(items.alias("items")).select("doc_id", F.map_from_entries(last).alias("levels"))


def mark_titles_in(text: Column, levels: Column) -> Column:
    """mark_titles over the LF lines of a text with its document's map of names to levels, which may be null."""
    mark = lambda x, level: F.when(level.isNull(), x).otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), X.strip(x)))
    line = lambda x: X.let(F.try_element_at(levels, X.clean_title(x)), lambda level: mark(x, level))
    return F.when(levels.isNull(), text).otherwise(F.array_join(F.transform(X.lf_lines(text), line), "\n"))


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line); a null text has no lines."""
    return docs.select("doc_id", F.posexplode(X.lf_lines(F.col("text"))).alias("line_no", "line"))


def join_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, text) from lines, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def clean_books(docs: DataFrame, tocs: DataFrame, styles: DataFrame | None = None, default: str | None = "$1") -> DataFrame:
    """The whole cleaning: images, styles, footnotes, line heads, blank lines, headings, titles, wrong splits.

    docs and tocs are (doc_id, text), styles is (doc_id, code, template) or None. A row of
    docs is a row of the result, a null text stays null; contents and styles are joined as
    one map a document, and the text is changed where it stands.
    """
    text = F.col("text")
    books = docs.select("doc_id", delete_images(text).alias("text"))
    if styles is None:
        books = books.withColumn("styles", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")))
    else:
        maps = styles.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "template"))).alias("styles"))
        books = books.join(maps, "doc_id", "left")
    books = books.select("doc_id", restyled(text, F.col("styles"), default).alias("text"))
    smooth = books.select("doc_id", join_headings(squeeze_blank_lines(strip_line_heads(number_footnotes_in(text)))).alias("text"))
    titled = smooth.join(toc_levels(parse_toc(tocs)), "doc_id", "left").select("doc_id", mark_titles_in(text, F.col("levels")).alias("text"))
    return titled.select("doc_id", join_wrong_splits(text).alias("text"))
