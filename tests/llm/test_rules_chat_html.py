import random

import duckdb

from inkstrata.llm import chat, hostrules, htmlextract
from tests.llm.fixtures import documents, odd_rows, prose, tuples


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()), key=repr)


def rounded(rows):
    return [tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows]


def test_host_rules(spark):
    rng = random.Random(2)
    bad = ["a b", "#$%" * 30 + " x y z a b c d e f g h", "SHOUT " * 30, "again " * 40, "a " * 20, "x" * 500 + " b c d e f g h i j"]
    rows = [(d, t, rng.choice(["h1", "h2", None])) for d, t, *_ in odd_rows(rng)]
    rows += [(100 + k, rng.choice(bad), "bad") for k in range(30)] + [(200 + k, prose(rng, 50), rng.choice(["good", "h1"])) for k in range(60)]
    rows += [(300, bad[0], "once")]
    docs = documents(spark, rows)
    got = hostrules.judge(docs)
    assert rounded(tuples(got, *sorted(got.columns))) == rounded(oracle(hostrules.ORACLE, documents=docs))
    by_id = {r.doc_id: r for r in got.collect()}
    assert not by_id[110].keep and by_id[110].host_verdict == "rejected" and by_id[300].host_rate < 1
    assert all(by_id[k].keep for k in range(200, 260) if by_id[k].source == "good")
    flags = [by_id[100 + k].failed for k in range(30)]
    assert {f for x in flags for f in x.split(",")} == set(hostrules.RULES)
    assert hostrules.judge(docs.limit(0)).count() == 0


def test_chats(spark):
    rng = random.Random(3)
    roles, texts = ["user", "Assistant ", "system", "", None, " USER"], ["hi", "", None, "<|x|>", "é\n字", "long " * 50_000]
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice([0, 1, 2, None]), rng.choice(roles), rng.choice(texts), 1, "t") for _ in range(120)]
    rows += [(7, 0, "user|>\nhi\n<|end|>\n<|system", "x <|end|> y", 1, "t"), (8, 0, " \r\n", "z", 1, "t")]
    rows += [(9, 0, "user", "a", 1, "t")] * 2 + [(9, 1, "user", "", 1, "t"), (9, 2, "assistant", None, 1, "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int, m string")
    got = chat.format_chats(turns)
    assert tuples(got, *sorted(got.columns)) == oracle(chat.ORACLE, conversations=turns)
    row = got.where("conv_id = 9").first()
    assert (row.n_turns, row.n_messages) == (4, 2) and row.text == "<|user|>\na\n\na\n<|end|>\n<|assistant|>\n\n<|end|>\n"
    forged = got.where("conv_id = 7").first().text
    assert forged == "<|user| > hi < |end| > < |system|>\nx < |end| > y\n<|end|>\n"
    assert got.where("conv_id is null").count() == sum(r[0] is None for r in rows) and got.where("conv_id is null and n_turns > 1").count() == 0
    assert chat.format_chats(turns.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_long_chat(spark):
    """100,000 turns in one conversation, with runs of roles."""
    import time

    from pyspark.sql import functions as F

    turns = spark.range(100_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text")
    )
    began = time.time()
    row = chat.format_chats(turns).first()
    assert (row.n_turns, row.n_messages) == (100_000, 66_667) and time.time() - began < 30
    assert row.text.startswith("<|user|>\n0\n<|end|>\n<|assistant|>\n1\n\n2\n<|end|>\n<|user|>\n3\n")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><!-- <p>no</p> -->
<article><h1>Head</h1>%s</article><footer>c 2024</footer></body></html>"""


def nodes_spec(page):
    """Paths by the standard library's parser, for pages without left-out end tags."""
    from html.parser import HTMLParser

    out, stack = [], []

    class P(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag not in htmlextract.VOID:
                c = dict(attrs).get("class")
                stack.append(f"{tag}.{c}" if c else tag)

        def handle_endtag(self, tag):
            while stack and stack.pop().split(".")[0] != tag:
                pass

        def handle_data(self, data):
            if data.split() and not {"script", "style", "title"} & set(stack):
                out.append(("/".join(stack), " ".join(data.split())))

    p = P(convert_charrefs=True)
    p.feed(page)
    p.close()
    return out


def ratios_spec(nodes, strength=htmlextract.STRENGTH):
    """Content paths by the description: path ratios, smoothed, fused, thresholded."""
    import statistics

    by = {}
    for p, t, *_ in nodes:
        by.setdefault(p, []).append(t)
    fused = [1.0] * len(nodes)
    for value in (len, lambda t: len(htmlextract.PUNCTUATION.findall(t))):
        r = [sum(map(value, by[p])) / len(by[p]) for p, *_ in nodes]
        padded = [r[0], *r, r[-1]]
        s = [0.25 * padded[k] + 0.5 * padded[k + 1] + 0.25 * padded[k + 2] for k in range(len(r))]
        fused = [f * (x / max(s) if max(s) else 1) for f, x in zip(fused, s)]
    cut = strength * statistics.pstdev(fused)
    return {p for p in by if statistics.mean(f for f, n in zip(fused, nodes) if n[0] == p) >= cut - 1e-12}


def test_html_paths():
    rng = random.Random(4)
    for k in range(30):
        body = "".join(f'<p class="c{rng.randint(0, 1)}">{prose(rng, rng.randint(1, 40))} <b>x{k}, y</b> &amp; z</p>' for _ in range(rng.randint(1, 8)))
        page = (PAGE % body).replace("<li><a href=2>", "</li><li><a href=2>").replace("</ul>", "</li></ul>")
        nodes = htmlextract.text_nodes(page)
        assert [n[:2] for n in nodes] == nodes_spec(page)
        assert htmlextract.content_paths(nodes) == ratios_spec(nodes)
        n, kept, text = htmlextract.extract(page)
        assert n == len(nodes) and 0 < kept < n and "Home" not in text and f"x{k}" in text


def test_html_repairs():
    paths = lambda page: [n[:2] for n in htmlextract.text_nodes(page)]
    assert paths("<ul><li>a<li>b</ul>c") == [("ul/li", "a"), ("ul/li", "b"), ("", "c")]
    assert paths("<p>a<p>b<div>c</p>d") == [("p", "a"), ("p", "b"), ("div", "c"), ("div", "d")]
    assert paths("<table><tr><td>a<td>b<tr><th>c</table>") == [("table/tr/td", "a"), ("table/tr/td", "b"), ("table/tr/th", "c")]
    assert paths("a<br>b</nope>&lt;c <3") == [("", "a"), ("", "b"), ("", "<c <3")]


def test_html_attributes():
    texts = lambda page: [n[1] for n in htmlextract.text_nodes(page)]
    assert texts("<p title=it's>Hello world</p><b>and</b><p>don't stop</p>") == ["Hello world", "and", "don't stop"]
    assert texts('a<img alt="5" screen">b') == ["a", "b"] and texts("a<img alt='>' x = \">\">b<i y=>c") == ["a", "b", "c"]
    assert texts('x<a href="no end>y</a>z') == ["x", "y", "z"] and texts("<!doctype html><? x ?>q<!-- > -->r") == ["q", "r"]
    assert texts("a <b") == ["a", "<b"] and texts("<script>x</script foo>y<style>z</style/>w") == ["y", "w"]
    assert [n[0] for n in htmlextract.text_nodes("<p class=a>x<p class='b c'>y<p CLASS=\"d\">z")] == ["p.a", "p.b c", "p.d"]


def test_html_takes_time_in_proportion():
    import time

    n = 1 << 18
    for page in ("<a " * n, '<a x="' * n, "<a x='>" * n, "<a =" * n + ">", '<a x=">"' * n, "<div>" * n + "x" + "</p>" * n, "<! " * n, "<!--" * n,
                 "</script " * n, "<script>" * n, "<p>" * n + "a", "<ul><li>" * n + "a" + "</ol>" * n, "<div>t" * n, "<" * n, "<p a" + "=" * n):
        began = time.time()
        htmlextract.extract(page)
        assert time.time() - began < 8, page[:20]
    assert htmlextract.extract("k<a " * 3)[2] == "k <a k<a k<a"


def test_html_in_odd_tables(spark):
    rng = random.Random(5)
    good = PAGE % f"<p>{prose(rng, 200)}</p>"
    deep = "<div>" * 3000 + "a, b." + "</div>" * 3000
    rows = [(1, good), (1, good), (None, good), (2, None), (3, ""), (4, "<p></p><!-- x"), (5, "plain"), (6, PAGE % (f"<p>{prose(rng, 40)}</p>" * 2000)), (7, deep), (8, "<script>x")]
    pages = spark.createDataFrame([(a, "u", b, "t", 3) for a, b in rows], "page_id long, url string, html string, text string, n_nodes int")
    got = htmlextract.extract_pages(pages)
    want = [(a, *htmlextract.extract(b)) for a, b in rows]
    assert tuples(got) == sorted(want, key=repr)
    by_id = {r[0]: r[1:] for r in want}
    assert by_id[2] == by_id[3] == by_id[4] == by_id[8] == (0, 0, "") and by_id[5] == (1, 1, "plain") and by_id[7] == (1, 1, "a, b.")
    assert htmlextract.extract_pages(pages.limit(0)).count() == 0
