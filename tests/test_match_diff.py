import random

import pyarrow as pa
from pyspark.sql import functions as F

from inkstrata.functions import rows
from inkstrata.operators import diff, match


def lcs(x, y):
    d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            d[i + 1][j + 1] = d[i][j] + 1 if a == b else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def best_spec(t, f, o=3):
    best = None
    for k in range(len(f) - o, len(f) + o):
        for i in range(len(t) - k + 1) if k > 0 else ():
            r = (1 - (len(f) + k - 2 * lcs(f, t[i : i + k])) / (len(f) + k)) * 100
            if r > (best[2] if best else 0):
                best = (i, i + k, r)
    return best


def test_best_window():
    random.seed(3)
    for _ in range(300):
        t = "".join(random.choice("abcd字") for _ in range(random.randint(0, 25)))
        f = "".join(random.choice("abcde字") for _ in range(random.randint(0, 9)))
        assert match.best_window(t, f) == best_spec(t, f)
    t = "".join(random.choice("abcd") for _ in range(110))
    for f in (t[20:84], t[20:85], t[10:90] + "xy", "x".join(t[k : k + 9] for k in range(0, 90, 9)), t[5:30] + "y" + t[31:105]):
        assert match.best_window(t, f) == best_spec(t, f)


TEXT = "\n    春天来了，园丁在花圃里种下玫瑰和百合，花圃的四周围着矮矮的篱笆，雨后的花圃显得格外清新。\n    "
PAIRS = [(0, "种下玫瑰或百合，", "种下牡丹,"), (1, "花圃四周", "花圃的位置"), (2, "花圃", "苗床")]


def test_garden(spark, monkeypatch):
    docs = spark.createDataFrame([("a", TEXT), ("b", None), ("c", ""), ("c", "")], "doc_id string, text string")
    pairs = spark.createDataFrame(PAIRS, "pos int, fragment string, modified string")
    for listed, sent in ((1000, 1 << 20), (1, 1 << 20), (1000, 30), (1, 30)):  # one list, or blocks, or passes
        monkeypatch.setattr(match, "LISTED", listed)
        monkeypatch.setattr(match, "SENT", sent)
        got = {r.pos: r.match for r in match.find_matches(docs, pairs).where("doc_id = 'a'").collect()}
        found = [(got[k].real_text, tuple(got[k].location), round(got[k].ratio, 3)) for k in range(3)]
        assert found == [("种下玫瑰和百合，", (16, 24), 87.5), ("花圃的四周", (24, 29), 88.889), ("花圃", (13, 15), 100.0)]
        assert [(*got[k].location, got[k].ratio) for k in range(3)] == [best_spec(TEXT, f) for _, f, _ in PAIRS]
        out = sorted((r.doc_id, r.text) for r in match.apply_replacements(docs, pairs).collect())
        assert [d for d, _ in out] == ["a", "b", "c", "c"] and out[1][1] is None and out[2][1] == out[3][1] == ""
        assert out[0][1].strip() == "春天来了，园丁在苗床里种下牡丹,苗床的位置围着矮矮的篱笆，雨后的苗床显得格外清新。"


def test_replace_options(spark):
    docs = spark.createDataFrame([("a", "one two one")], "doc_id string, text string")
    pairs = spark.createDataFrame([(0, "one", "1"), (1, "two", None), (2, "zzz", "9")], "pos int, fragment string, modified string")
    m = match.find_matches(docs, pairs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "match"))).alias("m")).join(docs, "doc_id")
    m = m.withColumn("m", F.transform("m", lambda x: x["match"]))
    assert m.select(match.replace_matches(F.col("text"), F.col("m")).alias("t")).first().t == "1 two 1"
    assert m.select(match.replace_matches(F.col("text"), F.col("m"), at_location=True).alias("t")).first().t == "1 two one"
    assert m.select(match.replace_matches(F.col("text"), F.col("m"), threshold=101).alias("t")).first().t == "one two one"


def test_word_parts():
    random.seed(1)
    for _ in range(1500):
        a, b = (" ".join(random.choice(["a", "b,", "字c", "d\n"]) for _ in range(random.randint(0, 8))) for _ in range(2))
        p = diff.word_parts(a, b)
        assert "".join(v for o, v in p if o != "insert") == a and "".join(v for o, v in p if o != "delete") == b
        assert sum(len(diff.WORD.findall(v)) for o, v in p if o == "equal") == lcs(diff.WORD.findall(a), diff.WORD.findall(b))
    far = diff.word_parts("a b " * 50, "c,d;" * 50, most=10)
    assert [o for o, _ in far] == ["delete", "insert"]


def equal_units(parts):
    return sum(len(diff.WORD.findall(v)) for o, v in parts if o == "equal")


def test_word_parts_of_far_texts(monkeypatch):
    random.seed(2)
    a, b = (" ".join(random.choice(["a", "b,", "字c", "d\n", "e", "f"]) + str(random.randint(0, 9)) for _ in range(900)) for _ in range(2))
    x, y = diff.WORD.findall(a), diff.WORD.findall(b)
    want = lcs(x, y)
    assert len(x) + len(y) - 2 * want > 1000
    for bits, width in ((1 << 26, 1 << 14), (5000, 1 << 14), (5000, 100)):
        monkeypatch.setattr(diff, "TABLE_BITS", bits)
        monkeypatch.setattr(diff, "ROW_BITS", width)
        p = diff.word_parts(a, b)
        assert "".join(v for o, v in p if o != "insert") == a and "".join(v for o, v in p if o != "delete") == b
        assert equal_units(p) == want
    monkeypatch.setattr(diff, "TABLE_BITS", 6)
    monkeypatch.setattr(diff, "ROW_BITS", 3)
    for _ in range(1500):
        a, b = (" ".join(random.choice(["a", "b,", "字c", "d\n"]) for _ in range(random.randint(0, 8))) for _ in range(2))
        assert equal_units(diff.word_parts(a, b, most=0)) == lcs(diff.WORD.findall(a), diff.WORD.findall(b))


def test_pages(spark):
    df = spark.createDataFrame([("a <b>", "a & b"), (None, "x"), ("", "")], "a string, b string")
    rows = df.select(diff.word_page(diff.word_diff(F.col("a"), F.col("b")), F.lit("<t>")).alias("p"), diff.line_diff(F.col("a"), F.col("b")).alias("l")).collect()
    assert "<del>&lt;</del>" in rows[0].p and "<title>&lt;t&gt;</title>" in rows[0].p and "<ins>&amp; </ins>" in rows[0].p
    assert [o.tag for o in rows[0].l.ops] == ["replace"] and "diff_chg" in rows[0].l.html
    assert rows[2].l.ops == [] and "<ins>x</ins>" in rows[1].p
    assert "b" * 33 in diff.line_table(["a" * 60000], ["b" * 60000])


def test_sections(spark):
    a = spark.createDataFrame([("x", "intro\n## 甲\none\n## 乙\ntwo"), ("y", "## 丙\nz")], "doc_id string, text string")
    b = spark.createDataFrame([("x", "intro\n## 甲1\none\n## 丁\ntwo\n## 戊"), ("y", "## 丙\nzz")], "doc_id string, text string")
    pairs = [(r.doc_id, r.sec_no, r.title_a, r.title_b) for r in diff.section_pairs(a, b).orderBy("doc_id", "sec_no").collect()]
    assert pairs == [("x", 0, "", ""), ("x", 1, "##甲", "##甲"), ("x", 2, "##乙", "##丁"), ("y", 0, "##丙", "##丙")]
    assert diff.section_pairs(a, b, every=True).count() == 5
    got = {r.doc_id: (r.sections_a, r.sections_b, r.first_difference, r.consistent) for r in diff.titles_agree(a, b).collect()}
    assert got == {"x": (3, 4, 2, False), "y": (1, 1, None, True)}


def test_tidy(spark):
    random.seed(4)
    docs = {f"d{k}": [random.choice(["", " ", "a ", "b"]) for _ in range(12)] for k in range(40)}
    rows = spark.createDataFrame([(d, i, x) for d, ls in docs.items() for i, x in enumerate(ls)], "doc_id string, line_no int, line string")
    got = {}
    for r in diff.tidy_lines(rows).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    assert got == {d: t for d, ls in docs.items() if (t := diff.tidy(ls))}


def test_rows_are_not_gathered():
    """Results go back before the batch is done: as many are held as make HELD, whatever their shape."""
    for large, kind in (("y" * (rows.HELD // 4), pa.string()), ([{"v": "y" * (rows.HELD // 8)}] * 2, pa.list_(pa.struct([("v", pa.string())])))):
        called = []
        out = rows.results(lambda x, large=large, called=called: called.append(x) or large, kind, iter([pa.array(range(100)), pa.array([], pa.int64()), pa.array([7, None])]))
        sizes = []
        for part in out:
            sizes.append(len(part))
            assert len(called) == sum(sizes)
        assert sum(sizes) == 102 and max(sizes) <= 4 and called[-2:] == [7, None]


def test_line_diff_goes_back_in_parts(spark):
    """Batches of Spark are no bounds of what goes back: each row keeps its own result, nulls and two columns in one query included."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 != 0, F.concat(F.lit("a\n"), "id", F.repeat(F.lit("\nz"), 30))).alias("a"))
    both = df.select("id", diff.line_diff(F.col("a"), F.replace("a", F.lit("a\n"), F.lit("b\n"))).alias("l"), diff.word_diff(F.col("a"), F.lit("")).alias("w"), "a")
    for r in both.collect():
        assert [o.tag for o in r.l.ops] == (["replace", "equal"] if r.id % 10 else []) and (not r.id % 10 or f">{r.id}</td>" in r.l.html)
        assert [tuple(p) for p in r.w] == ([("delete", r.a)] if r.a else [])


def test_word_parts_of_equal_texts(monkeypatch):
    monkeypatch.setattr(diff, "WORD", None)  # they aren't cut into words
    assert diff.word_parts("a b\n字", "a b\n字") == [("equal", "a b\n字")] and diff.word_parts("", "") == []


def test_first_of_equal_windows():
    """Of windows of one length and ratio the first counts, also where a later one has its other character at the same place."""
    text = "x| enster | e, | enstge | e."
    assert match.best_window(text, "| enst≠e | e") == (1, 13, best_spec(text, "| enst≠e | e")[2]) and best_spec(text, "| enst≠e | e")[:2] == (1, 13)
