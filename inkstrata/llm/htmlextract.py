"""Main content of web pages by tag-path ratios.

A page is read into text nodes in order, each with its root-to-leaf tag path. Over all
nodes of a path, text length and punctuation are added up and divided by the number of
nodes: the path's two ratios. The series of both ratios along the page is smoothed with
a small symmetric kernel, scaled by its maximum and fused as a product. A path's score is
the mean of the fused series over its nodes; paths that come to `strength` standard
deviations of the series are content, and the text of their nodes is returned in order.

The parser is a single regular expression for marks, none of whose parts is tried twice, so
time grows with the page: comments, declarations and the raw text of script and style are
skipped; a quote counts after an equals sign only, and if it is closed; a tag that the page
doesn't end is text with all that follows; elements without content never open; a block
closes an open paragraph, a list item an open item and so on, as browsers do; an end tag
closes up to its start tag, or nothing if there is none. A path is a number of its parent's
number and its own tag, so deep pages cost no more than flat ones.

Defined results
- One row per row of pages: page_id, n_nodes, n_kept, text (nodes of one block joined by
  blanks, blocks by line ends).
- Null and empty pages, and pages without text, have 0 nodes and an empty text.
- If all nodes score the same, all are content. Text before or outside the body counts by
  its path; title, head, script, style, noscript and template are never content.
- page_id must be a column of integers; others are refused with a TypeError.
- Rows with null or repeated page_id are extracted each for itself. An empty table gives
  an empty result; columns other than page_id and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstrata.llm.common import bounded, integer_id

STRENGTH = 0.3
KERNEL = (0.25, 0.5, 0.25)
MARK = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z) | <(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?)*+)(>|\Z)""", re.S | re.X
)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = {t: re.compile(rf"</{t}(?:[\s/][^>]*+)?(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tr tbody thead tfoot select div article section main body html td th".split())
STOPS = {t: SCOPE - frozenset(names) - (frozenset(("td", "th")) if t == "tr" else frozenset()) for t, names in CLOSES.items()}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def scan(page: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str]]]:
    """The page's text nodes in order, (path, text, number of the block), and the paths, (parent, tag); path 0 is the root."""
    out: list[tuple[int, str, int]] = []
    paths: list[tuple[int, str]] = [(0, "")]
    number: dict[tuple[int, str], int] = {}
    shown = [True]  # whether a path's text counts
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()  # tags in the stack
    at, block = 0, 0

    def cut(k: int) -> None:
        for tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    def close(names: tuple[str, ...], stop: frozenset[str]) -> None:
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return cut(k)
            if stack[k][0] in stop:
                return

    def add(piece: str) -> None:
        text = " ".join(entities.unescape(piece).split())
        path = stack[-1][1] if stack else 0
        if text and shown[path]:
            out.append((path, text, block))

    while m := MARK.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not (tag := m[2]):
            continue
        if not m[4]:
            at = m.start()
            break
        tag = tag.lower()
        if tag in BLOCK or tag == "br":
            block += 1
        if m[1]:
            if opened[tag]:
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            if tag == "textarea":
                add(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in BLOCK:
            close(("p",), SCOPE)
        if tag in CLOSES:
            close(CLOSES[tag], STOPS[tag])
        c = CLASS.search(m[3]) if "class" in m[3].lower() else None
        name = (c[1] or c[2] or c[3] or "").strip() if c else ""
        parent = stack[-1][1] if stack else 0
        step = (parent, f"{tag}.{name}" if name else tag)
        if step not in number:
            number[step] = len(paths)
            paths.append(step)
            shown.append(shown[parent] and not (step[1] == "head" and (parent == 0 or paths[parent] == (0, "html"))))
        stack.append((tag, number[step]))
        opened[tag] += 1
    add(page[at:])
    return out, paths


def text_nodes(page: str) -> list[tuple[str, str, int]]:
    """scan with the paths written out, as html/body/p."""
    nodes, paths = scan(page)

    def name(path: int) -> str:
        parts = []
        while path:
            path, tag = paths[path]
            parts.append(tag)
        return "/".join(reversed(parts))

    return [(name(p), text, block) for p, text, block in nodes]


def content_paths(nodes: list[tuple], strength: float = STRENGTH) -> set:
    """The paths whose nodes are content; nodes are those of scan or of text_nodes."""
    index = {p: k for k, p in enumerate(dict.fromkeys(n[0] for n in nodes))}
    path = np.array([index[n[0]] for n in nodes])
    count = np.bincount(path)
    series = np.ones(len(nodes))
    for values in ([len(n[1]) for n in nodes], [len(PUNCTUATION.findall(n[1])) for n in nodes]):
        ratio = (np.bincount(path, values) / count)[path]
        smooth = np.convolve(np.pad(ratio, 1, mode="edge"), KERNEL, mode="valid")
        series *= smooth / smooth.max() if smooth.max() > 0 else 1.0
    score = np.bincount(path, series) / count
    least = strength * series.std() - 1e-12
    return {p for p, k in index.items() if score[k] >= least}


def extract(page: str | None, strength: float = STRENGTH) -> tuple[int, int, str]:
    """(text nodes, content nodes, text)."""
    nodes = scan(page)[0] if page else []
    if not nodes:
        return 0, 0, ""
    good = content_paths(nodes, strength)
    kept = [n for n in nodes if n[0] in good]
    lines: list[str] = []
    last = -1
    for _, text, block in kept:
        if block == last:
            lines[-1] += " " + text
        else:
            lines.append(text)
        last = block
    return len(nodes), len(kept), "\n".join(lines)


def extract_pages(pages: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """The content of each page; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html", 4 << 20):
            found = [extract(h, strength) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.string()),
                ],
                ["page_id", "n_nodes", "n_kept", "text"],
            )

    rows = pages.select(integer_id(pages, "page_id"), "html")
    return rows.mapInArrow(run, "page_id long, n_nodes long, n_kept long, text string")
