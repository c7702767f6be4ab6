"""Quality rules with verdicts on hosts.

Five rules judge each document. Their failures are counted by host (`source`). For
each rule the hosts' failure rates give a beta prior by the method of moments, and a
host's rate is shrunk to (failures + alpha) / (documents + alpha + beta), so that a
host with few documents isn't judged by chance. A host is rejected if the shrunken
rate of any rule, or of failing any rule, is above `max_rate`; the verdict is joined
back. A document is kept if it fails no rule and its host isn't rejected.

Rules: too_short (under 10 words), symbols (over 5 % of the characters are of
#$%&*|@^~<>{}=+\\_), shouting (over half of at least 20 letters are upper case),
repeats (over 30 % of the words equal the word before), lengths (mean word length
outside 2 to 20).

The rule flags of each document are computed once and kept (a few bytes a document);
hosts are aggregated before the shuffle, so a host with most of the documents is no
bottleneck. The join with the host table is left to the planner: it is broadcast
only when its measured size is below the session's limit.

Defined results
- One row per row of documents: doc_id, source, failed (names of the rules, in the
  order above, joined by a comma), host_docs, host_rate (shrunken rate of failing any
  rule, six places), host_verdict (ok or rejected), keep.
- A null text counts as empty: too_short. Null sources form one host.
- Prior: with mean m and sample variance v of the hosts' rates, alpha + beta is
  m (1 - m) / v - 1, within 1 and 10^6; with v null or 0, it is 10. v is that of the rates
  as measured: the chance variation of small hosts is in it, so rates are shrunk less than
  they would be without it.
- Rows with null or repeated doc_id are judged each for itself. An empty table gives
  an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import cut_lineage

RULES = ("too_short", "symbols", "shouting", "repeats", "lengths")
MAX_RATE = 0.5
SYMBOLS = r"[#$%&*|@^~<>{}=+\\_]"


def rule_flags(text: Column) -> Column:
    """A struct of one boolean per rule."""
    text = F.coalesce(text, F.lit(""))
    runs = F.aggregate(
        F.split(text, r"[ \t\n\r\f]+"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("same"), F.lit("").alias("last")),
        lambda a, w: F.struct(
            (a["n"] + (w != "").cast("int")).alias("n"),
            (a["same"] + ((w == a["last"]) & (w != "")).cast("int")).alias("same"),
            w.alias("last"),
        ),
    )
    counted = F.struct(
        runs.alias("r"),
        F.length(text).alias("chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("symbols"),
        F.length(F.regexp_replace(text, r"[ \t\n\r\f]", "")).alias("solid"),
        F.length(F.regexp_replace(text, r"[^\p{L}]", "")).alias("letters"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")).alias("upper"),
    )
    # One-element transform: the counts are computed once and named once.
    return F.transform(
        F.array(counted),
        lambda c: F.struct(
            (c["r"]["n"] < 10).alias("too_short"),
            (c["symbols"] * 20 > c["chars"]).alias("symbols"),
            ((c["letters"] >= 20) & (c["upper"] * 2 > c["letters"])).alias("shouting"),
            (c["r"]["same"] * 10 > c["r"]["n"] * 3).alias("repeats"),
            ((c["r"]["n"] > 0) & ((c["solid"] < c["r"]["n"] * 2) | (c["solid"] > c["r"]["n"] * 20))).alias("lengths"),
        ),
    )[0]


def judge(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Verdicts on documents; see the module's text."""
    flags = cut_lineage(docs.select("doc_id", "source", rule_flags(F.col("text")).alias("f")).select("doc_id", "source", "f.*"))
    names = [*RULES, "any"]
    any_rule = F.greatest(*(F.col(r).cast("int") for r in RULES))
    hosts = flags.groupBy("source").agg(
        F.count("*").alias("n"), *(F.sum(F.col(r).cast("int")).alias(f"k_{r}") for r in RULES), F.sum(any_rule).alias("k_any")
    )
    prior = hosts.agg(*(x for r in names for x in (F.avg(F.col(f"k_{r}") / F.col("n")).alias(f"m_{r}"), F.var_samp(F.col(f"k_{r}") / F.col("n")).alias(f"v_{r}"))))
    rates = hosts.crossJoin(prior)  # the prior is one row
    for r in names:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight = F.when(F.coalesce(v, F.lit(0.0)) <= 0, 10.0).otherwise(F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / v - 1)))
        rates = rates.withColumn(f"p_{r}", (F.col(f"k_{r}") + m * weight) / (F.col("n") + weight))
    worst = F.greatest(*(F.col(f"p_{r}") for r in names))
    verdicts = rates.select(
        F.col("source").alias("host"),
        F.col("n").alias("host_docs"),
        F.round("p_any", 6).alias("host_rate"),
        F.when(worst > max_rate, "rejected").otherwise("ok").alias("host_verdict"),
    )
    failed = F.concat_ws(",", *(F.when(F.col(r), r) for r in RULES))
    judged = flags.join(verdicts, flags.source.eqNullSafe(verdicts.host), "left").select(
        "doc_id", "source", failed.alias("failed"), "host_docs", "host_rate", "host_verdict"
    )
    return judged.withColumn("keep", (F.col("failed") == "") & (F.col("host_verdict") == "ok"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents),
c AS (
  SELECT doc_id, source, len(w) AS n, length(text) AS chars,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same,
         length(text) - length(regexp_replace(text, '[#$%&*|@^~<>{}=+\\_]', '', 'g')) AS symbols,
         length(regexp_replace(text, '[ \t\n\r\f]', '', 'g')) AS solid,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS upper FROM d),
f AS (
  SELECT doc_id, source, n < 10 AS too_short, symbols * 20 > chars AS symbols, letters >= 20 AND upper * 2 > letters AS shouting,
         same * 10 > n * 3 AS repeats, n > 0 AND (solid < n * 2 OR solid > n * 20) AS lengths FROM c),
r AS (
  SELECT doc_id, source, unnest(['too_short', 'symbols', 'shouting', 'repeats', 'lengths', 'any']) AS rule,
         unnest([too_short, symbols, shouting, repeats, lengths, too_short OR symbols OR shouting OR repeats OR lengths]) AS bad FROM f),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (bad) AS k FROM r GROUP BY 1, 2),
p AS (SELECT rule, avg(k / n) AS m, var_samp(k / n) AS v FROM h GROUP BY 1),
q AS (SELECT *, CASE WHEN coalesce(v, 0) <= 0 THEN 10.0 ELSE least(1e6, greatest(1.0, m * (1 - m) / v - 1)) END AS s FROM p),
z AS (SELECT source, rule, n, (k + m * s) / (n + s) AS rate FROM h JOIN q USING (rule)),
g AS (
  SELECT source, max(n) AS host_docs, round(max(rate) FILTER (rule = 'any'), 6) AS host_rate,
         CASE WHEN max(rate) > 0.5 THEN 'rejected' ELSE 'ok' END AS host_verdict FROM z GROUP BY 1),
j AS (
  SELECT f.doc_id, f.source, g.host_docs, g.host_rate, g.host_verdict,
         concat_ws(',', CASE WHEN too_short THEN 'too_short' END, CASE WHEN symbols THEN 'symbols' END, CASE WHEN shouting THEN 'shouting' END,
                   CASE WHEN repeats THEN 'repeats' END, CASE WHEN lengths THEN 'lengths' END) AS failed
  FROM f JOIN g ON f.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, failed, host_docs, host_rate, host_verdict, failed = '' AND host_verdict = 'ok' AS keep FROM j
"""
