"""Named queries over the test tables, each with the DuckDB SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.functions import text as X
from inkstrata.operators import clean, diff, match, report, revise, split
from inkstrata.plans import derive as D
from inkstrata.sources import convert, files
from inkstrata.sources.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def digest(text: Column, *keys: str) -> list:
    return [*keys, F.length(text).cast("long").alias("n"), F.md5(text.cast("binary")).alias("digest")]


def _digest(keys: str, text: str = "text") -> str:
    return f"{keys}, length({text}) AS n, md5({text}) AS digest"


# splitting

SQL_CONTEXT = D.SQL_MARKDOWN + ", " + D.sql_sections("md", "sec", [1, 2]) + ", " + D.sql_cut("sec", "cut", 200, "doc_id, sec_no")
SQL_CONTEXT += """, seg AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c.sec_no, c.i) - 1 AS seg_no, c.text AS target, s.text AS context
  FROM cut c JOIN sec s USING (doc_id, sec_no))"""
SQL_MERGE = (
    D.SQL_MARKDOWN + ", " + D.sql_sections("md", "sec", [2]) + ", long AS (SELECT * FROM sec WHERE length(text) > 500), " + D.sql_cut("long", "cut", 300, "doc_id, sec_no")
) + """, part AS (
  SELECT doc_id, sec_no, 0 AS i, text FROM sec WHERE length(text) <= 500 UNION ALL SELECT doc_id, sec_no, i, text FROM cut),
grp AS (
  SELECT *, coalesce(sum(CASE WHEN length(text) >= 120 THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY sec_no, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM part),
whole AS (SELECT doc_id, g, string_agg(text, chr(10) ORDER BY sec_no, i) AS text FROM grp GROUP BY doc_id, g),
seg AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS seg_no, text AS target FROM whole WHERE NOT regexp_full_match(text, '\\s*'))"""


@query(f"""WITH RECURSIVE {SQL_CONTEXT},
n AS (SELECT doc_id, length(trim(target, ' ' || chr(10))) AS t, length(trim(context, ' ' || chr(10))) AS c FROM seg)
SELECT doc_id, count(*) AS segments, CAST(sum(t) AS BIGINT) AS target_chars, CAST(sum(c) AS BIGINT) AS context_chars,
       CAST(sum(t + c) AS BIGINT) AS all_chars FROM n GROUP BY doc_id""")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.segment_totals(split.preset(D.markdown(spark, sf_dir), "title_length_context"))


@query(f"WITH RECURSIVE {D.SQL_MARKDOWN}, {D.sql_cut('md', 'cut', 600, 'doc_id')} SELECT {_digest('doc_id, CAST(i AS INTEGER) AS seg_no')} FROM cut")
def cut_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.preset(D.markdown(spark, sf_dir), "length").select(*digest(F.col("target"), "doc_id", "seg_no"))


@query(f"""WITH RECURSIVE {D.SQL_MARKDOWN}, {D.sql_sections('md', 'sec', [1])}, long AS (SELECT * FROM sec WHERE length(text) > 1500),
{D.sql_cut('long', 'cut', 800, 'doc_id, sec_no')},
part AS (SELECT doc_id, sec_no, 0 AS i, text FROM sec WHERE length(text) <= 1500 UNION ALL SELECT doc_id, sec_no, i, text FROM cut)
SELECT {_digest('doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, i) - 1 AS INTEGER) AS part_no')} FROM part""")
def cut_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split.cut_long(split.split_by_title(F.col("text"), [1]))
    return D.markdown(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("part_no", "p")).select(*digest(F.col("p"), "doc_id", "part_no"))


@query(f"WITH {D.SQL_MARKDOWN}, {D.sql_sections('md', 'sec', [1, 2])} SELECT {_digest('doc_id, CAST(sec_no AS INTEGER) AS seg_no')} FROM sec")
def split_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.preset(D.markdown(spark, sf_dir), "title").select(*digest(F.col("target"), "doc_id", "seg_no"))


@query(f"WITH RECURSIVE {SQL_CONTEXT} SELECT {_digest('doc_id, CAST(seg_no AS INTEGER) AS seg_no', 'target')}, md5(context) AS context_digest FROM seg")
def split_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split.preset(D.markdown(spark, sf_dir), "title_length_context")
    return found.select(*digest(F.col("target"), "doc_id", "seg_no"), F.md5(F.col("context").cast("binary")).alias("context_digest"))


@query(f"""WITH {D.SQL_MARKDOWN}, {D.sql_lines('md', 'l')},
g AS (SELECT *, coalesce(sum(CASE WHEN length(line) >= 100 THEN 1 ELSE 0 END) OVER (
  PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM l),
m AS (SELECT doc_id, g, string_agg(line, chr(10) ORDER BY p) AS text FROM g GROUP BY doc_id, g)
SELECT {_digest('doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS part_no')} FROM m""")
def merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split.merge_short(X.split_lines(F.col("text")))
    return D.markdown(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("part_no", "p")).select(*digest(F.col("p"), "doc_id", "part_no"))


@query(f"WITH RECURSIVE {SQL_MERGE} SELECT {_digest('doc_id, CAST(seg_no AS INTEGER) AS seg_no', 'target')} FROM seg")
def split_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.preset(D.markdown(spark, sf_dir), "title_length_merge").select(*digest(F.col("target"), "doc_id", "seg_no"))


# cleaning


@query(f"SELECT {_digest('doc_id', x := "replace(text, '. ', '.    ')")} FROM documents")
def delete_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_images = F.replace(F.col("text"), F.lit(". "), F.lit(". ![image](a.png){width=1} "))
    return D.table(spark, sf_dir, "documents").select(*digest(clean.delete_images(with_images), "doc_id"))


@query("""SELECT doc_id, length(t) AS n, md5(t) AS digest, 3 * ((length(text) - length(replace(text, '. ', ''))) // 2) AS changes
FROM (SELECT doc_id, text, replace(text, '. ', '. **ab c** <x>    ') AS t FROM documents)""")
def mark_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    styled = F.replace(F.col("text"), F.lit(". "), F.lit('. [ab c]{.s7} [ x]{.s8 title="k"} [ ]{.s9} '))
    templates = F.create_map(F.lit(7), F.lit("**$1**"), F.lit(9), F.lit("_$1_"))
    done = D.table(spark, sf_dir, "documents").select("doc_id", clean.mark_styles(styled, templates, "<$1>").alias("s"))
    return done.select(*digest(F.col("s.text"), "doc_id"), F.size("s.log").cast("long").alias("changes"))


@query(f"WITH {D.SQL_HAN} SELECT {_digest('doc_id', "regexp_replace(text, '[\\s\\da-zA-Z\\[\\]{{}}.^]', '', 'g')")} FROM han".replace("{{}}", "{}"))
def clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.han(spark, sf_dir).select(*digest(X.clean_title(F.col("text")), "doc_id"))


@query(f"WITH {D.SQL_HAN}, {D.SQL_CONTENTS} SELECT doc_id, CAST(toc_no AS INTEGER) AS toc_no, name, CAST(level AS INTEGER) AS level FROM toc WHERE name <> ''")
def parse_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.parse_toc(D.contents(spark, sf_dir))


SQL_TITLED = f"""{D.SQL_HAN_MARKDOWN}, {D.SQL_CONTENTS},
ln AS (SELECT doc_id, p, ls[p + 1] AS line, regexp_replace(ls[p + 1], '[\\s\\da-zA-Z\\[\\]{{}}.^]', '', 'g') AS key
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM hmd), unnest(range(len(ls))) AS u(p))"""


@query(f"""WITH {SQL_TITLED},
last AS (SELECT doc_id, name, arg_max(level, toc_no) AS level FROM toc WHERE name <> '' GROUP BY doc_id, name),
j AS (SELECT ln.doc_id, p, CASE WHEN level IS NULL THEN line ELSE repeat('#', level) || ' ' || trim(line) END AS line
  FROM ln LEFT JOIN last ON ln.doc_id = last.doc_id AND key = name),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM j GROUP BY doc_id)
SELECT {_digest('doc_id')} FROM t""")
def mark_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = clean.toc_levels(clean.parse_toc(D.contents(spark, sf_dir)))
    found = D.han_markdown(spark, sf_dir).join(levels, "doc_id", "left")
    return found.select("doc_id", clean.mark_titles_in(F.col("text"), F.col("levels")).alias("text")).select(*digest(F.col("text"), "doc_id"))


@query(f"""WITH {SQL_TITLED}
SELECT doc_id, CAST(toc_no AS INTEGER) AS toc_no, name, CAST(level AS INTEGER) AS level FROM toc
WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM ln WHERE ln.doc_id = toc.doc_id AND ln.key = toc.name)""")
def missing_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.missing_titles(clean.explode_lines(D.han_markdown(spark, sf_dir)), clean.parse_toc(D.contents(spark, sf_dir)))


def sql_notes(source: str, name: str) -> str:
    """name(doc_id, text): the numbered footnotes of source(doc_id, text)."""
    return f"""{name}_l AS (SELECT doc_id, p, ls[p + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {source}), unnest(range(len(ls))) AS u(p)),
{name}_k AS (SELECT *, CASE WHEN trim(line) = '' THEN 0 WHEN regexp_matches(line, '^\\s*\\d+\\.\\s+.+$') THEN 1
  WHEN regexp_matches(line, '^\\s*\\[\\^[a-zA-Z0-9]+\\]:.+$') THEN 2 ELSE 3 END AS kind FROM {name}_l),
{name}_r AS (SELECT *, count(*) FILTER (kind = 3) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM {name}_k),
{name}_i AS (SELECT *, count(*) FILTER (kind IN (1, 2)) OVER (PARTITION BY doc_id, run ORDER BY p) - 1 AS i FROM {name}_r),
{name}_n AS (SELECT doc_id, p, CASE WHEN kind IN (1, 2) THEN CASE WHEN kind = 2 THEN regexp_extract(line, '^(\\s*)', 1) ELSE '' END
        || '[^' || CASE WHEN i < 26 THEN chr(CAST(97 + i AS INTEGER)) ELSE CAST(i - 25 AS VARCHAR) END || ']:'
        || regexp_extract(line, CASE WHEN kind = 1 THEN '^\\s*\\d+\\.(\\s+.+)$' ELSE '^\\s*\\[\\^[a-zA-Z0-9]+\\]:(.+)$' END, 1) || chr(10) ELSE line END AS line FROM {name}_i),
{name} AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM {name}_n GROUP BY doc_id)"""


@query(f"WITH {D.SQL_MARKDOWN}, {sql_notes('md', 't')} SELECT {_digest('doc_id')} FROM t")
def number_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.markdown(spark, sf_dir).select("doc_id", clean.number_footnotes_in(F.col("text")).alias("text")).select(*digest(F.col("text"), "doc_id"))


BOTH_CASES = D.LATIN + D.LATIN.upper()


@query(f"""WITH x AS (SELECT doc_id, '[^a]: one' || repeat(chr(10), 2) || '[^e]: two (pa)' || repeat(chr(10), 3)
  || replace(translate(text, '{BOTH_CASES}', '{D.HAN * 2}'), '. ', '一[^a]一 (ea) [^e]（e） ') AS text FROM documents) SELECT {_digest('doc_id')} FROM x""")
def letter_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document begins with the notes a and e; its own letters become Han, and each sentence ends in letters that refer to notes or don't."""
    body = F.replace(F.translate("text", BOTH_CASES, D.HAN * 2), F.lit(". "), F.lit("一a一 (ea) e（e） "))
    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a one\ne two (pa)\n\n"), body).alias("text"))
    return docs.select("doc_id", clean.mark_letter_footnotes("text").alias("text")).select(*digest(F.col("text"), "doc_id"))


@query(f"""WITH {D.SQL_MARKDOWN}, x AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || ' ' || chr(10) || chr(9) || chr(10) || '  ') AS text FROM md)
SELECT {_digest('doc_id', "regexp_replace(text, '\\n\\s*\\n', chr(10) || chr(10), 'g')")} FROM x""")
def squeeze_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.replace(F.col("text"), F.lit(". "), F.lit(".\n \n\t\n  "))
    return D.markdown(spark, sf_dir).select(*digest(clean.squeeze_blank_lines(spread), "doc_id"))


@query(f"""WITH {D.SQL_HAN}, x AS (SELECT doc_id, replace(replace(text, '. ', chr(10)), ', ', chr(10) || chr(10)) AS text FROM han)
SELECT {_digest('doc_id', "regexp_replace(text, '(.{{30,}}[一-鿿])\\n{{1,2}}([一-鿿])', '\\1\\2', 'g')")} FROM x""".replace("{{", "{").replace("}}", "}"))
def join_wrong_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("\n")), F.lit(", "), F.lit("\n\n"))
    return D.han(spark, sf_dir).select(*digest(clean.join_wrong_splits(broken), "doc_id"))


@query(f"""WITH RECURSIVE {D.SQL_HAN},
l AS (SELECT doc_id, p, ls[p + 1] AS line FROM (
  SELECT doc_id, string_split(replace(replace(text, '. ', chr(10)), ', ', chr(10) || chr(10)), chr(10)) AS ls FROM han), unnest(range(len(ls))) AS u(p)),
f AS (SELECT *, min(CASE WHEN trim(line) <> '' THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM l),
j AS (SELECT f.doc_id, f.p, f.q, f.line, n.line AS other,
        length(f.line) >= 30 AND regexp_matches(f.line, '[一-鿿]\\z') AND coalesce(regexp_matches(n.line, '^[一-鿿]'), false) AS ok
  FROM f LEFT JOIN l n ON n.doc_id = f.doc_id AND n.p = f.q),
w AS (
  SELECT doc_id, p, q, line, other, ok FROM j WHERE p = 0
  UNION ALL
  SELECT j.doc_id, j.p, j.q, j.line, j.other, j.ok FROM w JOIN j ON j.doc_id = w.doc_id AND j.p = CASE WHEN w.ok THEN w.q ELSE w.p END + 1),
t AS (SELECT doc_id, string_agg(CASE WHEN ok THEN line || other ELSE line END, chr(10) ORDER BY p) AS text FROM w GROUP BY doc_id)
SELECT {_digest('doc_id')} FROM t""")
def join_broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("\n")), F.lit(", "), F.lit("\n\n"))
    return D.han(spark, sf_dir).select("doc_id", clean.join_broken_lines(broken).alias("text")).select(*digest(F.col("text"), "doc_id"))


@query(f"""WITH x AS (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || ' ' || chr(9)), chr(10)) AS ls FROM documents),
t AS (SELECT doc_id, array_to_string(list_transform(ls, lambda s: ltrim(s, ' ' || chr(9))), chr(10)) AS text FROM x) SELECT {_digest('doc_id')} FROM t""")
def strip_line_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    indented = F.replace(F.col("text"), F.lit(". "), F.lit(".\n \t"))
    return D.table(spark, sf_dir, "documents").select(*digest(clean.strip_line_heads(indented), "doc_id"))


@query(f"SELECT {_digest('doc_id', "replace(text, ' ', chr(10) || '前言' || chr(10) || '目录' || chr(10))")} FROM documents")
def join_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.replace(F.col("text"), F.lit(" "), F.lit("\n前\n\n言\n目\n\n录\n"))
    return D.table(spark, sf_dir, "documents").select(*digest(clean.join_headings(apart), "doc_id"))


@query(f"""WITH {D.SQL_HAN_MARKDOWN}, {D.SQL_CONTENTS},
given AS (SELECT doc_id, replace(text, '. ', '.    ab c ') AS text FROM hmd), {sql_notes('given', 'noted')},
heads AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda s: ltrim(s, ' ' || chr(9))), chr(10)) AS text FROM noted),
smooth AS (SELECT doc_id, replace(replace(regexp_replace(text, '\\n\\s*\\n', chr(10) || chr(10), 'g'), chr(10) || '前' || chr(10) || chr(10) || '言' || chr(10),
  chr(10) || '前言' || chr(10)), chr(10) || '目' || chr(10) || chr(10) || '录' || chr(10), chr(10) || '目录' || chr(10)) AS text FROM heads),
ln AS (SELECT doc_id, p, ls[p + 1] AS line, regexp_replace(ls[p + 1], '[\\s\\da-zA-Z\\[\\]{{}}.^]', '', 'g') AS key
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM smooth), unnest(range(len(ls))) AS u(p)),
last AS (SELECT doc_id, name, arg_max(level, toc_no) AS level FROM toc WHERE name <> '' GROUP BY doc_id, name),
j AS (SELECT ln.doc_id, p, CASE WHEN level IS NULL THEN line ELSE repeat('#', level) || ' ' || trim(line) END AS line
  FROM ln LEFT JOIN last ON ln.doc_id = last.doc_id AND key = name),
t AS (SELECT doc_id, regexp_replace(string_agg(line, chr(10) ORDER BY p), '(.{{30,}}[一-鿿])\\n{{1,2}}([一-鿿])', '\\1\\2', 'g') AS text FROM j GROUP BY doc_id)
SELECT {_digest('doc_id')} FROM t""")
def clean_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of the books ends in an image and a style mark."""
    marked = F.replace("text", F.lit(". "), F.lit(". ![image](a.png){width=1} [ab c]{.s7} "))
    books = D.han_markdown(spark, sf_dir).select("doc_id", marked.alias("text"))
    return clean.clean_books(books, D.contents(spark, sf_dir)).select(*digest(F.col("text"), "doc_id"))


# revision

SQL_RESULTS = SQL_CONTEXT + ", res AS (SELECT *, CASE WHEN seg_no % 4 <> 3 THEN replace(target, 'e', 'E') END AS output FROM seg)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = F.when(F.col("seg_no") % 3 == 0, F.concat(F.lit("note "), F.col("seg_no").cast("string")))
    return split.preset(D.markdown(spark, sf_dir), "title_length_context").withColumn("reference", reference)


@query(f"""WITH RECURSIVE {SQL_CONTEXT},
b AS (SELECT doc_id, seg_no, CASE WHEN seg_no % 3 = 0 THEN '<reference>' || chr(10) || 'note ' || seg_no || chr(10) || '</reference>' ELSE '' END
  || CASE WHEN context <> '' AND trim(context, ' ' || chr(10)) <> trim(target, ' ' || chr(10)) THEN chr(10) || '<context>' || chr(10) || context || chr(10) || '</context>' ELSE '' END AS ref,
  '<target>' || chr(10) || target || chr(10) || '</target>' AS body FROM seg)
SELECT doc_id, CAST(seg_no AS INTEGER) AS seg_no, CASE WHEN ref = '' THEN 3 ELSE 5 END AS turns,
       CASE WHEN ref = '' THEN 'system,assistant,user' ELSE 'system,assistant,user,assistant,user' END AS roles, md5(ref || '|' || body) AS digest FROM b""")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revise.prompts(_segments(spark, sf_dir))
    contents = F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"])
    both = F.when(F.size(contents) == 2, F.array_join(contents, "|")).otherwise(F.concat(F.lit("|"), contents[0]))
    return found.select("doc_id", "seg_no", F.size("messages").alias("turns"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.md5(both.cast("binary")).alias("digest"))


@query(f"""WITH RECURSIVE {SQL_RESULTS}
SELECT doc_id, CAST(seg_no AS INTEGER) AS seg_no, md5(replace(target, 'the', 'THE')) AS digest, CAST(NULL AS VARCHAR) AS error FROM res WHERE output IS NULL""")
def revise_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _segments(spark, sf_dir)
    left = revise.pending(segments, D.results(segments))
    done = revise.revise(left, revise.ReplacingClient({"the": "THE"}), per_minute=1e9, max_concurrent=8)
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "seg_no", F.md5(F.col("output").cast("binary")).alias("digest"), "error")


@query("""WITH b AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '<reference>' || chr(10) || 'note ' || doc_id || chr(10) || '</reference>' ELSE '' END
  || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '<context>' || chr(10) || lang || chr(10) || '</context>' ELSE '' END AS block FROM documents)
SELECT doc_id, md5(block || chr(10) || text) AS digest, CAST(NULL AS VARCHAR) AS error FROM b""")
def revise_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files, some with a reference, some with a context, sent to a client that answers with what it got."""
    docs = D.table(spark, sf_dir, "documents")
    reference = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("note "), "doc_id")).otherwise("")
    triples = docs.select("doc_id", F.col("text").alias("target"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("context"), reference.alias("reference"))
    done = revise.revise_triples(triples, revise.EchoClient(), per_minute=1e9, max_concurrent=8)
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("output").cast("binary")).alias("digest"), "error")


@query(f"WITH RECURSIVE {SQL_RESULTS} SELECT doc_id, CAST(seg_no AS INTEGER) AS seg_no, md5(target) AS digest FROM res WHERE output IS NULL AND seg_no BETWEEN 1 AND 9")
def pending_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _segments(spark, sf_dir)
    return revise.pending(segments, D.results(segments), 2, 10).select("doc_id", "seg_no", F.md5(F.col("target").cast("binary")).alias("digest"))


@query(f"WITH RECURSIVE {SQL_RESULTS} SELECT doc_id, CAST(seg_no AS INTEGER) AS seg_no FROM res WHERE output IS NULL AND seg_no IN (3, 4, 7)")
def pending_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _segments(spark, sf_dir)
    return revise.pending(segments, D.results(segments), [4, 5, 8, 8]).select("doc_id", "seg_no")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _segments(spark, sf_dir)
    return report.with_results(segments, revise.latest(D.results(segments)))


@query(f"""WITH RECURSIVE {SQL_RESULTS}
SELECT doc_id, count(*) AS segments, count(output) AS done, count(*) - count(output) AS pending, round(100.0 * count(output) / count(*), 2) AS percent,
       CAST(sum(length(target)) AS BIGINT) AS chars, CAST(coalesce(sum(length(target)) FILTER (output IS NOT NULL), 0) AS BIGINT) AS done_chars,
       CASE WHEN sum(length(target)) > 0 THEN round(100.0 * coalesce(sum(length(target)) FILTER (output IS NOT NULL), 0) / sum(length(target)), 2) ELSE 0.0 END AS percent_chars
FROM res GROUP BY doc_id""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.progress(_joined(spark, sf_dir))


@query(f"""WITH RECURSIVE {SQL_RESULTS}
SELECT doc_id, CAST(seg_no AS INTEGER) AS seg_no, string_split(substring(trim(target, ' ' || chr(10)), 1, 20), chr(10))[1] AS head FROM res WHERE output IS NULL""")
def pending_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pending_list(_joined(spark, sf_dir))


@query(f"""WITH RECURSIVE {SQL_CONTEXT}
SELECT doc_id, CAST(seg_no AS INTEGER) AS seg_no, length(trim(target, ' ' || chr(10))) AS length, length(trim(context, ' ' || chr(10))) AS context_length,
       string_split(substring(trim(target, ' ' || chr(10)), 1, 15), chr(10))[1] AS head FROM seg""")
def segment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.segment_list(_segments(spark, sf_dir))


@query(f"""WITH RECURSIVE {SQL_RESULTS},
t AS (SELECT doc_id, coalesce(string_agg(output, chr(10) || chr(10) ORDER BY seg_no), '') AS text, count(*) - count(output) AS pending FROM res GROUP BY doc_id)
SELECT {_digest('doc_id')}, pending FROM t""")
def merged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.merged_text(_joined(spark, sf_dir)).select(*digest(F.col("text"), "doc_id"), "pending")


@query(f"""WITH RECURSIVE {SQL_MERGE}, t AS (SELECT doc_id, string_agg(target, chr(10) || '---' || chr(10) ORDER BY seg_no) AS text FROM seg GROUP BY doc_id)
SELECT {_digest('doc_id')} FROM t""")
def review_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.review_text(split.preset(D.markdown(spark, sf_dir), "title_length_merge")).select(*digest(F.col("text"), "doc_id"))


@query(f"""WITH RECURSIVE {SQL_MERGE},
t AS (SELECT doc_id, '[' || string_agg('{{"target":' || CAST(to_json(target) AS VARCHAR) || '}}', ',' ORDER BY seg_no) || ']' AS text FROM seg GROUP BY doc_id)
SELECT {_digest('doc_id')} FROM t""")
def segments_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.segments_json(split.preset(D.markdown(spark, sf_dir), "title_length_merge"), pretty=False).select(*digest(F.col("text"), "doc_id"))


@query(f"""WITH RECURSIVE {SQL_RESULTS},
t AS (SELECT doc_id, '[' || string_agg(coalesce(CAST(to_json(output) AS VARCHAR), 'null'), ',' ORDER BY seg_no) || ']' AS text FROM res GROUP BY doc_id)
SELECT {_digest('doc_id')} FROM t""")
def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.results_json(_joined(spark, sf_dir)).select(*digest(F.col("text"), "doc_id"))


# fuzzy search and replacement


def _replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fragments of each text of 60 characters or more, from its beginning and from its middle, each with a character that the text doesn't have."""
    docs = D.table(spark, sf_dir, "documents").where(F.length("text") >= 60)
    half = (F.length("text") / 2).cast("int")
    text = F.col("text")
    first = F.concat(F.substr(text, F.lit(11), F.lit(12)), F.lit("≠"), F.substr(text, F.lit(24), F.lit(11)))
    second = F.concat(F.substr(text, half + 1, F.lit(6)), F.lit("≠"), F.substr(text, half + 8, F.lit(5)))
    pairs = F.array(
        F.struct(F.lit(0).alias("pos"), first.alias("fragment"), F.concat(F.lit("{"), first, F.lit("}")).alias("modified")),
        F.struct(F.lit(1).alias("pos"), second.alias("fragment"), F.concat(F.lit("<"), second, F.lit(">")).alias("modified")),
    )
    return docs.select("doc_id", F.inline(pairs))


# The best window has the fragment's other characters in a row, or with one between the two parts.
SQL_PAIRS = r"""f AS (
  SELECT doc_id, text, 0 AS pos, substring(text, 11, 12) AS pre, substring(text, 24, 11) AS suf, 24 AS m, '{' AS o, '}' AS c FROM documents WHERE length(text) >= 60
  UNION ALL
  SELECT doc_id, text, 1, substring(text, length(text) // 2 + 1, 6), substring(text, length(text) // 2 + 8, 5), 12, '<', '>' FROM documents WHERE length(text) >= 60),
q AS (
  SELECT *, strpos(text, pre || suf) - 1 AS tight, length(regexp_extract(text, '(?s)^(.*?)\Q' || pre || '\E.\Q' || suf || '\E', 1)) AS loose FROM f),
p AS (
  SELECT doc_id, text, pos, pre || '≠' || suf AS f, o || pre || '≠' || suf || c AS m, CASE WHEN tight >= 0 THEN tight ELSE loose END AS a,
         CASE WHEN tight >= 0 THEN tight + m - 1 ELSE loose + m END AS e,
         CASE WHEN tight >= 0 THEN 100 * (1 - 1.0 / (2 * m - 1)) ELSE 100 * (1 - 1.0 / m) END AS ratio FROM q)"""


@query(f"""WITH {SQL_PAIRS}
SELECT doc_id, pos, f AS fragment_text, m AS modified_text, substring(text, a + 1, e - a) AS real_text, CAST(a AS BIGINT) AS start, CAST(e AS BIGINT) AS "end",
       round(CAST(ratio AS DOUBLE), 3) AS ratio FROM p""")
def find_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.find_matches(D.table(spark, sf_dir, "documents"), _replacements(spark, sf_dir))
    place = [F.col(f"match.location.{c}").cast("long").alias(c) for c in ("start", "end")]
    return found.select("doc_id", "pos", "match.fragment_text", "match.modified_text", "match.real_text", *place, F.round("match.ratio", 3).alias("ratio"))


@query(f"""WITH {SQL_PAIRS},
b AS (SELECT x.doc_id, x.a AS a1, y.a AS a2, x.m AS m1, y.m AS m2, substring(x.text, x.a + 1, x.e - x.a) AS r1, substring(y.text, y.a + 1, y.e - y.a) AS r2
  FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.pos = 0 AND y.pos = 1),
r AS (SELECT d.doc_id, CASE WHEN a1 IS NULL THEN text WHEN a2 > a1 THEN replace(replace(text, r2, m2), r1, m1) ELSE replace(replace(text, r1, m1), r2, m2) END AS text
  FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id)
SELECT {_digest('doc_id')} FROM r""")
def apply_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.apply_replacements(D.table(spark, sf_dir, "documents"), _replacements(spark, sf_dir)).select(*digest(F.col("text"), "doc_id"))


# comparison


def _after(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.replace(F.replace("text", F.lit("## E"), F.lit("E")), F.lit("on"), F.lit("ON x")).alias("text"))


SQL_AFTER = "af AS (SELECT doc_id, replace(replace(text, '## E', 'E'), 'on', 'ON x') AS text FROM md)"
SQL_TITLES = "regexp_replace(string_split(trim(text, ' ' || chr(10)), chr(10))[1], '[\\s\\da-zA-Z\\[\\]{}.^]', '', 'g')"
SQL_SECTIONS = f"{D.SQL_MARKDOWN}, {SQL_AFTER}, {D.sql_sections('md', 'sa', [2])}, {D.sql_sections('af', 'sb', [2])}"


@query(f"""WITH {SQL_SECTIONS},
a AS (SELECT doc_id, sec_no, {SQL_TITLES} AS title_a, md5(text) AS digest_a FROM sa), b AS (SELECT doc_id, sec_no, {SQL_TITLES} AS title_b, md5(text) AS digest_b FROM sb)
SELECT doc_id, CAST(sec_no AS INTEGER) AS sec_no, title_a, title_b, digest_a, digest_b FROM a JOIN b USING (doc_id, sec_no)""")
def section_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.markdown(spark, sf_dir)
    pairs = diff.section_pairs(docs, _after(docs))
    return pairs.select("doc_id", "sec_no", "title_a", "title_b", *(F.md5(F.col(f"section_{x}").cast("binary")).alias(f"digest_{x}") for x in "ab"))


@query(f"""WITH {SQL_SECTIONS},
j AS (SELECT doc_id, sec_no, a.t AS ta, b.t AS tb FROM (SELECT doc_id, sec_no, {SQL_TITLES} AS t FROM sa) a FULL JOIN (SELECT doc_id, sec_no, {SQL_TITLES} AS t FROM sb) b USING (doc_id, sec_no))
SELECT doc_id, count(ta) AS sections_a, count(tb) AS sections_b, CAST(min(sec_no) FILTER (ta <> tb) AS INTEGER) AS first_difference,
       count(*) FILTER (ta <> tb) = 0 AND count(ta) = count(tb) AS consistent FROM j GROUP BY doc_id""")
def titles_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.markdown(spark, sf_dir)
    return diff.titles_agree(docs, _after(docs))


@query(f"""WITH {D.SQL_MARKDOWN}, x AS (SELECT doc_id, string_split(replace(text, '. ', '. ' || chr(10) || ' ' || chr(10) || chr(10)), chr(10)) AS ls FROM md),
l AS (SELECT doc_id, p, rtrim(ls[p + 1], ' ') AS line FROM x, unnest(range(len(ls))) AS u(p)),
k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM l)
SELECT doc_id, CAST(p AS INTEGER) AS line_no, md5(line) AS digest FROM k WHERE line <> '' OR coalesce(before, '') <> ''""")
def tidy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = D.markdown(spark, sf_dir).select("doc_id", F.replace("text", F.lit(". "), F.lit(". \n \n\n")).alias("text"))
    return diff.tidy_lines(clean.explode_lines(spread)).select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("digest"))


@query(f"""WITH {D.SQL_MARKDOWN}, k AS (SELECT doc_id, text, (length(text) - length(replace(text, '. ', ''))) // 2 AS k FROM md)
SELECT doc_id, md5(text) AS before, md5(replace(text, '. ', '† ')) AS after, length(text) - k AS equal_chars, CAST(k AS BIGINT) AS deleted, CAST(k AS BIGINT) AS inserted FROM k""")
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stop of each sentence becomes a sign that no text has: all else is equal, and the parts make both texts."""
    docs = D.markdown(spark, sf_dir)
    after = F.replace("text", F.lit(". "), F.lit("† "))
    both = docs.select("doc_id", diff.word_diff(F.col("text"), after).alias("d"))
    value = lambda *ops: F.array_join(F.transform(F.filter("d", lambda p: p["op"].isin(*ops)), lambda p: p["value"]), "")
    made = lambda op: F.md5(value("equal", op).cast("binary"))
    size = lambda op: F.length(value(op)).cast("long")
    return both.select("doc_id", made("delete").alias("before"), made("insert").alias("after"), size("equal").alias("equal_chars"), size("delete").alias("deleted"), size("insert").alias("inserted"))


@query(f"""WITH {D.SQL_MARKDOWN}, {D.sql_lines('md', 'l')},
t AS (SELECT doc_id, p, rtrim(line, ' ') AS line, lag(rtrim(line, ' ')) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM l),
k AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (line <> '' AND p % 23 = 4) AS BIGINT) AS c FROM t WHERE line <> '' OR coalesce(before, '') <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS lines_a, coalesce(n, 0) AS lines_b, coalesce(n - c, 0) AS equal_lines, coalesce(c, 0) AS replaced FROM md LEFT JOIN k USING (doc_id)""")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later text has the same lines, some of them longer: these are replaced, the others equal."""
    docs = D.markdown(spark, sf_dir)
    longer = F.array_join(F.transform(F.split("text", "\n"), lambda x, p: F.when((p % 23 == 4) & (X.rstrip(x) != ""), F.concat(x, F.lit(" more"))).otherwise(x)), "\n")
    found = docs.select("doc_id", diff.line_diff(F.col("text"), longer)["ops"].alias("ops"))
    total = lambda side, *tags: F.aggregate(F.filter("ops", lambda o: o["tag"].isin(*tags)), F.lit(0).cast("long"), lambda n, o: n + o[f"{side}_hi"] - o[f"{side}_lo"])
    every = ("equal", "replace", "delete", "insert")
    return found.select("doc_id", total("a", *every).alias("lines_a"), total("b", *every).alias("lines_b"), total("a", "equal").alias("equal_lines"), total("a", "replace").alias("replaced"))


# files

SQL_ESCAPED = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
PAGE_HEAD, _, PAGE_REST = diff.WORD_PAGE.partition("@TITLE@")
PAGE_MIDDLE, _, PAGE_TAIL = PAGE_REST.partition("@BODY@")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"SELECT {_digest('CAST(doc_id AS VARCHAR) AS doc_id')} FROM documents")
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a file each, with other line ends, and read again."""
    folder = new_folder(spark, "documents")
    files.write_documents(D.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("text")), folder)
    return files.read_documents(spark, folder).select(*digest(F.col("text"), "doc_id"))


@query(f"WITH RECURSIVE {SQL_CONTEXT} SELECT {_digest('CAST(doc_id AS VARCHAR) AS doc_id, CAST(seg_no AS INTEGER) AS seg_no', 'target')}, md5(context) AS context_digest, CASE WHEN seg_no % 3 = 0 THEN 'note ' || seg_no END AS reference FROM seg")
def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as a JSON file a document and read again."""
    folder = new_folder(spark, "segments")
    files.write_documents(files.segments_json(_segments(spark, sf_dir)), folder, ".json")
    found = files.read_segments(spark, folder)
    return found.select(*digest(F.col("target"), "doc_id", "seg_no"), F.md5(F.col("context").cast("binary")).alias("context_digest"), "reference")


@query(f"WITH RECURSIVE {SQL_RESULTS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(seg_no AS INTEGER) AS seg_no, md5(output) AS digest FROM res")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as a JSON file a document, read again and held against the number of segments."""
    folder = new_folder(spark, "results")
    files.write_documents(files.results_json(_joined(spark, sf_dir)), folder, ".json")
    segments = _segments(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "seg_no")
    return files.checked_results(segments, files.read_results(spark, folder)).select("doc_id", "seg_no", F.md5(F.col("output").cast("binary")).alias("digest"))


@query(f"""WITH RECURSIVE {SQL_RESULTS} SELECT 'r1' AS run_id, CASE WHEN output IS NULL THEN 'failed' ELSE 'done' END AS event, doc_id, CAST(seg_no AS INTEGER) AS seg_no,
       CASE WHEN output IS NULL THEN 'busy' ELSE CAST(length(output) AS VARCHAR) END AS detail FROM res""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a run appended to its log and read again."""
    folder = new_folder(spark, "log")
    results = D.results(_segments(spark, sf_dir))
    results = results.withColumn("error", F.when(F.col("output").isNull(), "busy"))
    files.append_events(files.result_events(results, "r1"), folder)
    return spark.read.parquet(folder).select("run_id", "event", "doc_id", "seg_no", "detail")


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5({_sql(PAGE_HEAD)} || doc_id || {_sql(PAGE_MIDDLE)}
  || CASE WHEN text = '' THEN '' ELSE '<span class="equal">' || {SQL_ESCAPED} || '</span>' END || {_sql(PAGE_TAIL)}) AS digest FROM documents""")
def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of texts compared with themselves, written under the names that belong to diffs and read again."""
    folder = new_folder(spark, "diffs")
    page = diff.word_page(diff.word_diff(F.col("text"), F.col("text")), F.col("doc_id").cast("string"))
    diff.write_diff_files(D.table(spark, sf_dir, "documents").select(F.concat(F.lit("books/"), "doc_id", F.lit(".md")).alias("path"), page.alias("html")), folder)
    return files.read_documents(spark, folder, "_diff.html").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


# other


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").select("page_id", convert.html_to_markdown("html").alias("text"))


SQL_HTML_LINE = "regexp_replace(trim(x), ' +', ' ', 'g')"
HTML_END = """<ul><li>one<li><b>two</b></ul><table><tr><th>a<th>b<tr><td>c</table><p>see<a href="#fn1" class="footnote-ref"><sup>1</sup></a></p>
<section class="footnotes"><ol><li id="fn1">note</li></ol></section><script>no</script>"""
MARKDOWN_END = "- one\n\n- **two**\n\n| a | b |\n|---|---|\n| c |  |\n\nsee[^1]\n\n[^1]: note"


@query(f"""WITH l AS (SELECT doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: {SQL_HTML_LINE}), lambda x: x <> '') AS ls FROM documents),
t AS (SELECT doc_id, '- [' || lang || '](#' || lang || ')' || repeat(chr(10), 2) || '## ' || lang || repeat(chr(10), 2)
  || array_to_string(list_transform(ls, lambda x: x || repeat(chr(10), 2)), '') || {_sql(MARKDOWN_END)} AS text FROM l) SELECT {_digest('doc_id')} FROM t""")
def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put into HTML and converted back, with a table of contents."""
    lines = F.transform(F.split(diff.escape(F.col("text")), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    page = F.concat(F.lit("<html><head><title>t</title></head><body><h2>"), "lang", F.lit("</h2>"), F.array_join(lines, ""), F.lit(HTML_END))
    docs = D.table(spark, sf_dir, "documents").select("doc_id", page.alias("html"))
    return docs.select("doc_id", convert.html_to_markdown("html", contents=True).alias("text")).select(*digest(F.col("text"), "doc_id"))


@query(f"WITH {D.SQL_HAN} SELECT doc_id, CAST(round(0.6 * h + 0.3 * (length(text) - h), 1) AS DOUBLE) AS tokens FROM (SELECT *, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS h FROM han)")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.token_totals(D.han(spark, sf_dir))


@query("""SELECT doc_id, source || '.' || lang AS path, source || '.marked.' || lang AS marked, source || '.titles_marked.' || lang AS titles_marked,
       source || '.titles_original.' || lang AS titles_original FROM documents""")
def three_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = D.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", "source", "lang").alias("path"))
    return paths.select("doc_id", "path", files.three_names(F.col("path")).alias("n")).select("doc_id", "path", "n.*")
