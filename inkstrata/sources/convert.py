"""Conversion of HTML and of binary files to markdown."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from inkstrata.functions.rows import by_row

HEADINGS = {f"h{n}": n for n in range(1, 7)}
HIDDEN = frozenset(("script", "style", "head", "template", "noscript"))
BLOCKS = frozenset("p div article section main header footer aside nav figure figcaption address form fieldset dl dt dd".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}


NOTES = frozenset("section aside div".split())


def _is_notes(attrs: dict[str, str | None]) -> bool:
    words = f"{attrs.get('class') or ''} {attrs.get('role') or ''}".split()
    return not {"footnotes", "doc-endnotes"}.isdisjoint(words)


def _note(name: str) -> str:
    """A footnote's key from its name: fn1, fn:1 and the like are 1."""
    return re.sub(r"^(?:user-content-)?fn[:-]?(?=.)", "", name)


def contents_list(headings: list[tuple[int, str]]) -> str:
    """A table of contents: one bullet a heading, four blanks for each level below the highest."""
    top = min(level for level, _ in headings)
    anchor = lambda text: re.sub(r"[^\w-]", "", re.sub(r"\s+", "-", text.strip().lower()))
    return "\n".join(f"{'    ' * (level - top)}- [{text}](#{anchor(text)})" for level, text in headings)


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.hidden: list[str] = []
        self.lists: list[list] = []  # [ordered, number]
        self.prefix, self.quotes, self.raw = "", 0, False
        self.links: list[str] = []
        self.rows: list[list[str]] | None = None
        self.cell = False  # a cell of the innermost table is open
        self.outer: list[tuple[list[list[str]], bool, list[str]]] = []  # rows, cell and line of the tables around it
        self.headings: list[tuple[int, str]] = []
        self.level = 0  # of an open heading
        self.notes = 0  # open elements that hold footnotes, and those within them
        self.mute = False  # within a link to or from a footnote

    def end_cell(self) -> None:
        """The text since the last cell; text that stands in no cell counts as one."""
        text = " ".join("".join(self.line).split()).replace("|", "\\|")
        if self.cell or text:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(text)
        self.line, self.cell = [], False

    def end_table(self) -> None:
        """A table within a cell comes as a block of its own, before the table around it."""
        self.end_cell()
        rows = [r for r in self.rows if r]
        self.rows, self.cell, self.line = self.outer.pop() if self.outer else (None, False, [])
        if rows:
            wide = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
            self.blocks.append("\n".join([lines[0], "|" + "---|" * wide, *lines[1:]]))

    def end_block(self) -> None:
        text = "".join(self.line)
        text = text if self.raw else re.sub(r" *\n *", "\n", re.sub(r"[ \t\r\f]+", " ", text)).strip()
        self.line = []
        if text:
            if self.rows is not None:
                self.line = [text.replace("\n", " ") + " "]
                return
            if self.level:
                self.headings.append((self.level, text))
                self.level = 0
            lead = "> " * self.quotes
            first, *rest = (self.prefix + text).split("\n")
            self.blocks.append("\n".join([lead + first, *(lead + r for r in rest)]))
            self.prefix = " " * len(self.prefix) if self.lists else ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif self.hidden:
            pass
        elif tag in HEADINGS:
            self.end_block()
            self.prefix, self.level = "#" * HEADINGS[tag] + " ", HEADINGS[tag]
        elif tag in BLOCKS:
            self.end_block()
            if tag in NOTES and (self.notes or _is_notes(dict(attrs))):
                self.notes += 1
        elif tag in ("ul", "ol"):
            self.end_block()
            self.lists.append([tag == "ol", 0])
        elif tag == "li":
            self.end_block()
            if not self.lists:
                self.lists.append([False, 0])
            self.lists[-1][1] += 1
            name = dict(attrs).get("id") or ""
            if self.notes and name:
                self.prefix = f"[^{_note(name)}]: "
                return
            self.prefix = "    " * (len(self.lists) - 1) + (f"{self.lists[-1][1]}. " if self.lists[-1][0] else "- ")
        elif tag == "blockquote":
            self.end_block()
            self.quotes += 1
        elif tag == "pre":
            self.end_block()
            self.raw = True
        elif tag == "br":
            self.line.append("\n")
        elif tag == "hr":
            self.end_block()
            self.blocks.append("---")
        elif tag in MARKS:
            self.line.append(MARKS[tag])
        elif tag == "a":
            found = dict(attrs)
            href, words = found.get("href") or "", f"{found.get('class') or ''} {found.get('role') or ''}".split()
            if href.startswith("#") and not {"footnote-ref", "doc-noteref"}.isdisjoint(words):
                self.line.append(f"[^{_note(href[1:])}]")
                self.mute = True
            elif not {"footnote-back", "doc-backlink"}.isdisjoint(words):
                self.mute = True
            else:
                self.links.append(href)
                self.line.append("[")
        elif tag == "img":
            found = dict(attrs)
            self.line.append(f"![{found.get('alt') or ''}]({found.get('src') or ''})")
        elif tag == "table":
            self.end_block()
            if self.rows is not None:
                self.outer.append((self.rows, self.cell, self.line))
                self.line = []
            self.rows, self.cell = [], False
        elif tag == "tr" and self.rows is not None:
            self.end_cell()
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.end_cell()
            self.cell = True

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
        elif self.hidden:
            pass
        elif tag in HEADINGS or tag in BLOCKS or tag == "li":
            self.end_block()
            self.prefix, self.level = "", 0
            if tag in NOTES and self.notes:
                self.notes -= 1
        elif tag in ("ul", "ol"):
            self.end_block()
            self.prefix = ""
            if self.lists:
                self.lists.pop()
        elif tag == "blockquote":
            self.end_block()
            self.quotes = max(0, self.quotes - 1)
        elif tag == "pre":
            if text := "".join(self.line).strip("\n"):
                self.blocks.append(f"```\n{text}\n```")
            self.line, self.raw = [], False
        elif tag in MARKS:
            self.line.append(MARKS[tag])
        elif tag == "a" and self.mute:
            self.mute = False
        elif tag == "a" and self.links:
            self.line.append(f"]({self.links.pop()})")
        elif tag in ("td", "th", "tr") and self.rows is not None:
            self.end_cell()
        elif tag == "table" and self.rows is not None:
            self.end_table()

    def handle_data(self, data: str) -> None:
        if not self.hidden and not self.mute:
            self.line.append(data if self.raw else re.sub(r"\s+", " ", data))


def to_markdown(page: str | None, contents: bool = False) -> str | None:
    """Headings, paragraphs, lists, quotes, tables, code, links, images, emphasis and footnotes; head, script and style are left out.

    With contents, a table of contents made of the headings comes first.
    """
    if page is None:
        return None
    parser = _Markdown()
    parser.feed(page)
    parser.close()
    while parser.rows is not None:
        parser.end_table()
    parser.end_block()
    blocks = [contents_list(parser.headings)] if contents and parser.headings else []
    return "\n\n".join(blocks + parser.blocks)


def html_to_markdown(html: Column | str, contents: bool = False) -> Column:
    return by_row(lambda page: to_markdown(page, contents), T.StringType())(html)


def convert_files(spark: SparkSession, paths: str | list[str], converter: Callable[[bytes], str]) -> DataFrame:
    """(path, text, error) of binary files such as PDF; the converter runs where a file is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    text, error = converter(bytes(content)), None
                except Exception as e:  # noqa: BLE001 - a file that can't be read is reported, not fatal
                    text, error = None, f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": [path], "text": [text], "error": [error]})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, "path string, text string, error string")


def pdf_by_pymupdf(content: bytes) -> str:
    """A converter for convert_files; it needs the optional packages pymupdf and pymupdf4llm."""
    import pymupdf
    import pymupdf4llm

    return pymupdf4llm.to_markdown(pymupdf.open(stream=content, filetype="pdf"))


def pdf_by_marker(content: bytes) -> str:
    """A converter for convert_files; it needs the optional package marker. Images are left out."""
    import tempfile

    from marker.converters.pdf import PdfConverter
    from marker.models import create_model_dict
    from marker.output import text_from_rendered

    with tempfile.NamedTemporaryFile(suffix=".pdf") as file:
        file.write(content)
        file.flush()
        return text_from_rendered(PdfConverter(artifact_dict=create_model_dict())(file.name))[0]
