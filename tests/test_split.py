import random

import pytest
from pyspark.sql import functions as F

from inkstrata.functions import text as X
from inkstrata.operators import split


def lines_of(text):
    return text.splitlines()


def cut_spec(text, least):
    least = max(50, int(least))
    out, now, n = [], [], 0
    for line in lines_of(text):
        now.append(line)
        n += len(line)
        if n >= least and not line.strip():
            out.append("\n".join(now))
            now, n = [], 0
    return out + (["\n".join(now)] if now else [])


def title_spec(text, levels):
    out = []
    for line in lines_of(text):
        if not out or any(line.startswith("#" * k + " ") for k in levels):
            out.append([])
        out[-1].append(line)
    return ["\n".join(x) for x in out]


def merge_spec(parts, least):
    out, wait = [], []
    for p in parts:
        wait.append(p)
        if len(p) >= least:
            out.append("\n".join(wait))
            wait = []
    return out + (["\n".join(wait)] if wait else [])


def texts():
    random.seed(5)
    kinds = ["", " ", "\t", "# A", "## B", "### C", "#no", "word " * 9, "字" * 60, "x" * 30, "　", "a\x1cb", "c\x85d"]
    ends = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", " "]
    return ["", "\n", "a\n\n\n"] + ["".join(random.choice(kinds) + random.choice(ends) for _ in range(random.randint(1, 30))) for _ in range(120)]


def run(spark, column, values=None):
    rows = values if values is not None else texts()
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_lines(spark):
    assert run(spark, X.split_lines(F.col("text"))) == [lines_of(t) for t in texts()]


@pytest.mark.parametrize("least", [0, 50, 90, 600])
def test_cut_by_length(spark, least):
    assert run(spark, split.cut_by_length(F.col("text"), least)) == [cut_spec(t, least) for t in texts()]


def test_cut_by_length_golden(spark):
    text = "\n".join(["x" * 30, "y" * 30, "", "z", "", "w" * 60, " ", ""]) + "\n"
    assert run(spark, split.cut_by_length(F.col("text"), 50), [text]) == [["\n".join(["x" * 30, "y" * 30, ""]), "\n".join(["z", "", "w" * 60, " "]), ""]]


@pytest.mark.parametrize("levels", [[2], [1, 2], [1, 3]])
def test_split_by_title(spark, levels):
    got = run(spark, split.split_by_title(F.col("text"), levels))
    assert got == [title_spec(t, levels) for t in texts()]
    assert ["\n".join(x) for x in got] == ["\n".join(lines_of(t)) for t in texts()]


def test_merge_short(spark):
    want = [merge_spec(lines_of(t), 30) for t in texts()]
    assert run(spark, split.merge_short(X.split_lines(F.col("text")), 30)) == want


def test_split_and_merge(spark):
    def spec(t):
        parts = [q for p in title_spec(t, [2]) for q in (cut_spec(p, 80) if len(p) > 150 else [p])]
        return [p for p in merge_spec(parts, 60) if p.strip()]

    assert run(spark, split.split_and_merge(F.col("text"), [2], 150, 80, 60)) == [spec(t) for t in texts()]


def test_split_with_context(spark):
    got = run(spark, split.split_with_context(F.col("text"), [1], 60))
    assert [[tuple(x) for x in g] for g in got] == [[(s, p) for s in title_spec(t, [1]) for p in cut_spec(s, 60)] for t in texts()]


def test_null_text(spark):
    for c in (split.cut_by_length, split.split_by_title, split.split_with_context, split.split_and_merge):
        assert run(spark, c(F.col("text")), [None]) == [None]


def test_presets(spark):
    docs = spark.createDataFrame([("a", "# T\nbody\n\n## S\nmore"), ("b", None)], "doc_id string, text string")
    for name in split.PRESETS:
        out = split.preset(docs, name)
        assert out.columns == ["doc_id", "seg_no", "target", "context"]
        assert {r.doc_id for r in out.collect()} == {"a"}
