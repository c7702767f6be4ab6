import random
import re

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from inkstrata.functions import text as X
from inkstrata.operators import clean
from inkstrata.sources import convert


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_delete_images(spark):
    assert one(spark, clean.delete_images(F.col("text")), "a ![image](x){w=1} b", "![pic](x){w}", "![image](x)\n{w}", None) == ["a    b", "![pic](x){w}", "![image](x)\n{w}", None]


def test_mark_styles(spark):
    maps = F.create_map(F.lit(1), F.lit("**$1**"), F.lit(2), F.lit("【$1】"))
    out = one(spark, clean.mark_styles(F.col("text"), maps, None), "[ a ]{.s1}[b]{.s2}[c]{.s3}[ ]{.s1} [x\ny]{.s1 k=v} [q]{_s1}", "[[a]{.s2}]{.s1}", None)
    assert out[0].text == "**a**【b】[c]{.s3}   **x\ny** **q**"
    assert [tuple(x) for x in out[0].log][:2] == [("[ a ]{.s1}", "**a**"), ("[b]{.s2}", "【b】")]
    assert out[1].text == "[【a】]{.s1}" and out[2].text is None
    assert clean.restyle("[c]{.s3}[q]{_s3}", {}, "<$1>", strict=True)[0] == "<c>[q]{_s3}"


def test_toc_and_titles(spark):
    toc = spark.createDataFrame([("a", "- 甲乙…… 3\n    * 丙丁 12\n\n** 戊\nnone\n\t- 甲乙\n- 失\n- abc 1")], "doc_id string, text string")
    items = clean.parse_toc(toc)
    assert [(r.toc_no, r.name, r.level) for r in items.orderBy("toc_no").collect()] == [(0, "甲乙", 1), (1, "丙丁", 2), (3, "戊", 1), (5, "甲乙", 1), (6, "失", 1)]
    toc2 = items.withColumn("level", F.when(F.col("toc_no") == 5, 3).otherwise(F.col("level")))
    lines = spark.createDataFrame([("a", 0, " 甲 乙12 "), ("a", 1, "丙丁"), ("a", 2, "丙丁…"), ("a", 3, ""), ("b", 0, "甲乙")], "doc_id string, line_no int, line string")
    got = {(r.doc_id, r.line_no): r.line for r in clean.mark_titles(lines, toc2).collect()}
    assert got == {("a", 0): "### 甲 乙12", ("a", 1): "## 丙丁", ("a", 2): "丙丁…", ("a", 3): "", ("b", 0): "甲乙"}
    assert [(r.toc_no, r.name) for r in clean.missing_titles(lines, toc2).orderBy("toc_no").collect()] == [(3, "戊"), (6, "失")]


def test_number_footnotes(spark):
    given = ["1. A", "2. B", "", "  [^d]: C", "body", "7. D"] + ["x"] + [f"{k}. n" for k in range(30)]
    docs = spark.createDataFrame([("a", "\n".join(given))], "doc_id string, text string")
    got = clean.join_lines(clean.number_footnotes(clean.explode_lines(docs))).first().text
    keys = [chr(97 + k) for k in range(26)] + ["1", "2", "3", "4"]
    want = ["[^a]: A\n", "[^b]: B\n", "", "  [^c]: C\n", "body", "[^a]: D\n", "x"] + [f"[^{k}]: n\n" for k in keys]
    assert got == "\n".join(want)
    assert one(spark, clean.number_footnotes_in(F.col("text")), "\n".join(given), None, "", "\n1. x") == ["\n".join(want), None, "", "\n[^a]: x\n"]


def test_notes_and_titles_where_they_stand(spark):
    """The same as over exploded lines."""
    rng = random.Random(6)
    pool = ["", " ", "1. a", "  22. b c", "[^x]: d", "\t[^9]:e", "body", "甲乙", " 甲 乙 3", "丙丁", "3.", "[^]:f"]
    docs = spark.createDataFrame([(f"d{k}", "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for k in range(60)], "doc_id string, text string")
    toc = spark.createDataFrame([(f"d{k}", i, n, v) for k in range(0, 60, 2) for i, (n, v) in enumerate([("甲乙", 1), ("丙丁", 2), ("甲乙", k % 4 + 1)])], "doc_id string, toc_no int, name string, level int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(docs.select("doc_id", clean.number_footnotes_in(F.col("text")))) == rows(clean.join_lines(clean.number_footnotes(clean.explode_lines(docs))))
    here = docs.join(clean.toc_levels(toc), "doc_id", "left").select("doc_id", clean.mark_titles_in(F.col("text"), F.col("levels")))
    assert rows(here) == rows(clean.join_lines(clean.mark_titles(clean.explode_lines(docs), toc)))


def test_letter_footnotes(spark):
    text = "a first\nb second\nsee a and (b), cab a b (nǐ a)\n(a) x"
    got = one(spark, clean.mark_letter_footnotes(F.col("text")), text, None, "")
    assert got[0].split("\n\n")[0] == "[^a]: first" and "see [^a] and (b), cab [^a] [^b] (nǐ [^a])" in got[0]
    assert got[0].endswith("(a) x") and got[1:] == [None, ""]


def test_blank_lines(spark):
    got = one(spark, clean.squeeze_blank_lines(F.col("text")), "a\n\n\n\nb", "a\n \n\t\n  b", "a\nb", "\n\n\nx\n\n\n\n\ny", "a\n　\n\x1c\nb")
    assert got == ["a\n\nb", "a\n\n  b", "a\nb", "\n\nx\n\ny", "a\n\nb"]


def test_join_wrong_splits(spark):
    random.seed(2)
    parts = ["字" * 31, "字" * 30, "字" * 33, "甲", "x" * 40, "乙" * 29 + "a", "a" * 30 + "丙", "", " ", "\r" + "丁" * 31]
    given = ["".join(random.choice(parts) + "\n" for _ in range(12)) for _ in range(150)]
    want = [re.sub(r"(.{30,}[一-鿿])\n{1,2}([一-鿿])", r"\1\2", t) for t in given]
    assert one(spark, clean.join_wrong_splits(F.col("text")), *given) == want


def test_join_broken_lines(spark):
    long = "字" * 30
    given = [f"{long}\n\n \n甲", f"{long}\n{long}\n乙", f"{'字' * 29}\n甲", f"{long}\n a甲", f"{long}\n\n", None]
    assert one(spark, clean.join_broken_lines(F.col("text")), *given) == [long + "甲", long + long + "\n乙", f"{'字' * 29}\n甲", f"{long}\n a甲", f"{long}\n\n", None]


def test_small_ones(spark):
    assert one(spark, clean.strip_line_heads(F.col("text")), " a\n\t　b \n") == ["a\nb \n"]
    assert one(spark, clean.join_headings(F.col("text")), "x\n前\n\n言\ny\n目\n\n录\n") == ["x\n前言\ny\n目录\n"]
    assert one(spark, X.clean_title(F.col("text")), "# 第1章 abc[x].^… ") == ["#第章…"]


def test_clean_books(spark):
    docs = spark.createDataFrame([("n", None), ("e", ""), ("a", "![image](p){w}\n甲 乙\n\n\n\n [x]{.s1}\n1. note\n" + "字" * 31 + "\n末")], "doc_id string, text string")
    tocs = spark.createDataFrame([("a", "- 甲乙… 3")], "doc_id string, text string")
    styles = spark.createDataFrame([("a", 1, "**$1**")], "doc_id string, code int, template string")
    got = {r.doc_id: r.text for r in clean.clean_books(docs, tocs, styles).collect()}
    assert got["n"] is None and got["e"] == ""
    assert got["a"] == "\n# 甲 乙\n\n**x**\n[^a]: note\n\n" + "字" * 31 + "末"


def test_texts_stay_arrow_data(spark):
    """The columns in Python take an iterator of batches and give results back in parts; a whole batch of 10,000 is never held as Python values."""
    columns = {
        "letters": clean.mark_letter_footnotes(F.col("text")), "joined": clean.join_broken_lines(F.col("text")), "page": convert.html_to_markdown("text"),
        "styled": clean.mark_styles(F.col("text"), F.create_map(F.lit(1), F.lit("**$1**")))["text"],
    }
    text = F.when(F.col("id") % 3 != 0, F.concat(F.lit("a note\n<b>[x]{.s1} a "), "id", F.lit("</b>")))
    df = spark.range(12000).repartition(1).select("id", text.alias("text"))
    for r in df.select("id", *(c.alias(n) for n, c in columns.items())).collect():
        if r.id % 3 == 0:
            assert tuple(r)[1:] == (None,) * 4
        else:
            want = (f"[^a]: note\n\n<b>[x]{{.s1}} [^a] {r.id}</b>", f"a note\n<b>[x]{{.s1}} a {r.id}</b>", f"a note **[x]{{.s1}} a {r.id}**", f"a note\n<b>**x** a {r.id}</b>")
            assert tuple(r)[1:] == want


def test_python_columns_are_iterators(spark):
    """Spark's type of such a function is 'iterator of Arrow arrays' ; a function of whole batches has another."""
    ways = (lambda: clean.mark_letter_footnotes("t"), lambda: clean.join_broken_lines("t"), lambda: convert.html_to_markdown("t"), lambda: clean.mark_styles(F.col("t"), F.create_map(F.lit(1), F.lit("x"))))
    df = spark.createDataFrame([("x",)], "t string")
    for way in ways:
        plan = df.select(way())._jdf.queryExecution().executedPlan()
        found = [p for p in (plan.apply(k) for k in range(8)) if p is not None and "ArrowEvalPython" in p.nodeName()]
        assert [p.evalType() for p in found] == [PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF]


def test_toc_levels(spark):
    rows = [("a", 3, "甲", 2), ("a", 10, "甲", 1), ("a", 4, "乙", 3), ("a", 9, "甲", 4), ("b", 0, "甲", 5)]
    toc = spark.createDataFrame(rows, "doc_id string, toc_no int, name string, level int").repartition(3)
    found = clean.toc_levels(toc)
    assert {r.doc_id: r.levels for r in found.collect()} == {"a": {"甲": 1, "乙": 3}, "b": {"甲": 5}}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_parse_toc_makes_names_once(spark):
    tocs = spark.createDataFrame([("a", "- 甲 x\n     * 乙…12\n丙\n- 12"), ("b", None), ("c", "")], "doc_id string, text string")
    found = clean.parse_toc(tocs)
    assert sorted(map(tuple, found.collect())) == [("a", 0, "甲", 1), ("a", 1, "乙", 2)] and found.columns == ["doc_id", "toc_no", "name", "level"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
