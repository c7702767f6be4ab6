r"""Token counts without token ids.

Texts are cut into pre-tokens by the byte-level BPE pattern. The number of pieces of a
pre-token is found once for each distinct pre-token, joined to the frequencies of the
pre-tokens in each document and summed.

Two kinds of pre-tokens are joined in two ways, with the same result:
- Frequent ones: every task offers its most frequent pre-tokens (by documents), their
  counts are added up over all documents, and the `hot` most frequent are counted and
  sent to the tasks, a table bounded by that parameter. They make up most of every
  document and would be the skewed keys of a shuffle.
- The others: (pre-token, document, frequency) rows are partitioned by pre-token, each
  distinct one is counted once where its rows meet, and the products are summed by
  document. No ids are ever made; a count is the length of one merge result.

Cutting is done once per distinct word of a slice: a word with the blank before it can
be cut alone, because the pattern never joins across the end of a run of blanks.

Defined results
- One row per doc_id: doc_id, n_pretokens, n_tokens. Rows that share a doc_id, null
  included, are added up.
- Null and empty texts have 0 of both. Strings of special tokens are ordinary text.
- doc_id must be a column of integers; others are refused with a TypeError. A vocabulary
  that isn't there is refused with a FileNotFoundError before anything runs.
- An empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import bounded, integer_id

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
HOT, OFFERED, COUNTED = 200_000, 20_000, 1_000_000
BLANK = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
CUT = regex.compile(PATTERN)
UNIT = re.compile(rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def pretokens(text: str) -> list[str]:
    return CUT.findall(text)


@cache
def encoder(vocabulary: bytes) -> tiktoken.Encoding:
    """An encoder of single pre-tokens: its own pattern takes any string whole."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pre-tokens in most documents of a task, by lossy counting once they are very many."""
    seen: Counter = Counter()
    for batch in bounded(batches, "text", 4 << 20):
        units: Counter = Counter()
        for text in batch.column("text").to_pylist():
            if text:
                units.update(set(UNIT.findall(text)))
        for u, n in units.items():
            for p in pretokens(u):
                seen[p] += n
        if len(seen) > COUNTED:
            seen = Counter(dict(seen.most_common(COUNTED // 2)))
    top = seen.most_common(OFFERED)
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["p", "n"])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, hot: int = HOT) -> DataFrame:
    """Tokens of each document under a byte-level BPE; see the module's text.

    vocabulary is a file of ranks that the driver reads; it is sent to the tasks.
    """
    context = docs.sparkSession.sparkContext
    with open(vocabulary, "rb") as file:
        ranks = context.broadcast(file.read())
    rows = docs.select(integer_id(docs), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_ordinary
        for batch in batches:
            n = [len(encode(p)) for p in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(n, pa.int64())], ["p", "n"])

    offered = rows.select("text").mapInArrow(_frequent, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    top = offered.orderBy(F.desc("n"), "p").limit(hot).select("p").mapInArrow(count, "p string, n long").toArrow()
    known = context.broadcast(dict(zip(top["p"].to_pylist(), top["n"].to_pylist())))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row without a pre-token per text, with what the frequent ones give; a row per other pre-token and text."""
        pieces = known.value.get
        for batch in bounded(batches, "text", 4 << 20):
            units = [UNIT.findall(t) if t else [] for t in batch.column("text").to_pylist()]
            sizes = np.array([len(u) for u in units])
            index: dict[str, int] = {u: k for k, u in enumerate(set(chain.from_iterable(units)))}
            ids = np.fromiter(map(index.__getitem__, chain.from_iterable(units)), np.int64, int(sizes.sum()))
            doc = np.repeat(np.arange(len(units)), sizes)
            del units
            sure, total = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
            rare: dict[str, int] = {}
            owner: list[int] = []
            which: list[int] = []
            for u, k in index.items():
                cut = pretokens(u)
                total[k] = len(cut)
                for p in cut:
                    if (n := pieces(p)) is not None:
                        sure[k] += n
                    else:
                        owner.append(k)
                        which.append(rare.setdefault(p, len(rare)))
            texts = batch.num_rows
            parts = [
                (
                    pa.nulls(texts, pa.string()),
                    batch.column("doc_id"),
                    np.bincount(doc, sure[ids], texts).astype(np.int64),
                    np.bincount(doc, total[ids], texts).astype(np.int64),
                )
            ]
            if rare:
                order = np.argsort(owner, kind="stable")
                owned = np.bincount(owner, minlength=len(index))
                first = np.concatenate([[0], np.cumsum(owned)[:-1]])
                at = np.flatnonzero(owned[ids])
                times = owned[ids[at]]
                inner = np.arange(times.sum()) - np.repeat(np.concatenate([[0], np.cumsum(times)[:-1]]), times)
                names = np.asarray(which)[order][np.repeat(first[ids[at]], times) + inner]
                pair, freq = np.unique(names * texts + np.repeat(doc[at], times), return_counts=True)
                name, text = np.divmod(pair, texts)
                parts.append((pa.array(list(rare), pa.string()).take(pa.array(name)), batch.column("doc_id").take(pa.array(text)), freq.astype(np.int64), np.zeros(len(pair), np.int64)))
            for p, d, n, m in parts:
                yield pa.RecordBatch.from_arrays([p, d, pa.array(n), pa.array(m)], ["p", "doc_id", "n", "m"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of a pre-token come together, so it is counted once."""
        encode = encoder(ranks.value).encode_ordinary
        last, pieces = None, 1
        for batch in batches:
            p = batch.column("p").dictionary_encode()
            names = p.dictionary.to_pylist()
            n = np.array([pieces if x == last else len(encode(x)) for x in names] + [1], np.int64)
            if names:
                last, pieces = names[-1], int(n[-2])
            at = p.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("m"), pa.array(n[at] * batch.column("n").to_numpy())], ["doc_id", "m", "n"])

    flat = rows.mapInArrow(spread, "p string, doc_id long, n long, m long")
    # Texts' own rows have no pre-token; the document spreads them over the partitions.
    key = F.when(F.col("p").isNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("p"))
    # Sorted, so that a task holds one pre-token at a time and counts it once.
    joined = flat.repartition(key).sortWithinPartitions("p").mapInArrow(join, "doc_id long, m long, n long")
    return joined.groupBy("doc_id").agg(F.sum("m").alias("n_pretokens"), F.sum("n").alias("n_tokens"))
