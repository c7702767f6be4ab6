"""Benchmark decontamination with a BM25 index and block-max WAND.

The test items are the indexed documents and every passage of every training text is
a query. Items are indexed by length: those of up to 64 words, of up to 128 and so on. The
passages for an index are twice as long as its longest item may be and overlap by half, so
that an item is whole within one of them and few words stand around it. A BM25 weight is divided by the item's score
against itself: the score of a passage is the share of the item that it covers, 0 to 1.

Retrieval returns every item with a score of at least `min_score`:
1. A bound for all passages of a slice at once: common terms are left out, what they
   can give an item at most is added to its weights for the others, and passages with
   no item that comes to min_score are dropped. The terms left out are chosen such that
   they alone can't bring any item to min_score, so this loses nothing.
2. Block-max WAND over the remaining passages: cursors sorted by item, a pivot by the
   sum of term maxima, a check by the block maxima, then the full score.
A retrieved item is verified: at least `min_overlap` of the word 5-grams of its
question and of its answer must stand in the passage. The answer is the last sentence
of the item, the question the rest; an item of one sentence is both.

The indexes are sent to the tasks and queried in one pass over the corpus. Their size
follows the test items, not the corpus, and is checked: more than `shard_bytes` of items
are sent in several parts, each of which is another pass, with the document frequencies of
all items. A benchmark of no more than that is read once, a larger one twice, row by row.

Defined results
- One row per document and item: doc_id, item_id, score, question_overlap,
  answer_overlap (four places), of the passage with the best score (ties: the greatest
  overlaps), and text_key, the hash of the document's text.
- Words are runs of non-blank characters, lower case, without signs before and after.
- Null, empty or wordless texts and items match nothing. Items with equal texts are all
  reported. Rows with a null doc_id or item_id are left out. Rows that share doc_id and
  text are the same document; rows that share a doc_id with other texts are documents of
  their own, and drop_contaminated leaves those that hold no item.
- doc_id and item_id must be columns of integers; others are refused with a TypeError.
  min_score must be above 0.
- Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import bounded, cut_lineage, free_name, integer_id
from inkstrata.llm.words import normal, split_words

K1, B = 1.2, 0.75
MIN_SCORE, MIN_OVERLAP, GRAM = 0.5, 0.5, 5
BLOCK = 8
COMMON = 0.3  # the share of min_score that left-out common terms may have together
SHARD_BYTES = 16 << 20
LEAST_PASSAGE = 64
SCHEMA = "doc_id long, text_key long, item_id long, score double, question_overlap double, answer_overlap double"
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")


def words(text: str) -> list[str]:
    return [n for w in split_words(text) if (n := normal(w))]


def grams(tokens: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(tokens))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [p for p in (words(s) for s in SENTENCE.split(text)) if p]
    if len(parts) < 2:
        return (parts or [[]])[0], (parts or [[]])[0]
    return [w for p in parts[:-1] for w in p], parts[-1]


@dataclass
class Index:
    """Postings by term; items and their parts. All items have a word at least."""

    ids: list[int]
    parts: list[tuple[list[str], list[str]]]
    term: dict[str, int]
    items: list[np.ndarray]  # per term, in order
    weights: list[np.ndarray]
    block_max: list[dict[int, float]]  # per term
    best: np.ndarray  # per term
    length: int  # of a passage's half
    flat: tuple[np.ndarray, np.ndarray, np.ndarray]  # all postings: offsets by term, items, weights
    bounds: dict[float, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def bound(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Which terms aren't left out of the first bound at this least score, and what the others can give each item."""
        if least not in self.bounds:
            rare = np.ones(len(self.term), bool)
            sums = np.zeros(len(self.ids))
            for t in sorted(range(len(self.term)), key=lambda t: -len(self.items[t])):
                new = sums.copy()
                new[self.items[t]] += self.weights[t]
                if len(self.items[t]) < 2 or new.max() > COMMON * least:
                    break
                sums, rare[t] = new, False
            self.bounds[least] = rare, sums
        return self.bounds[least]


def build_index(items: list[tuple[int, str]], df: Counter, n: int, average: float, longest: int) -> Index:
    bags = [Counter(words(t)) for _, t in items]
    term = {t: k for k, t in enumerate(sorted({t for b in bags for t in b}))}
    postings: list[list[tuple[int, float]]] = [[] for _ in term]
    for i, bag in enumerate(bags):
        size = sum(bag.values())
        raw = {
            t: float(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5))) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / average))
            for t, f in bag.items()
        }
        total = sum(raw.values())
        for t, w in raw.items():
            postings[term[t]].append((i, w / total))
    found = [np.array([i for i, _ in p]) for p in postings]
    weights = [np.array([w for _, w in p]) for p in postings]
    maxima: list[dict[int, float]] = []
    for i, w in zip(found, weights):
        m: dict[int, float] = {}
        for b, x in zip((i // BLOCK).tolist(), w.tolist()):
            m[b] = max(m.get(b, 0.0), x)
        maxima.append(m)
    at = np.cumsum([0] + [len(p) for p in found])
    flat = (at, np.concatenate(found), np.concatenate(weights))
    best = np.array([w.max() for w in weights])
    return Index([i for i, _ in items], [question_and_answer(t) for _, t in items], term, found, weights, maxima, best, longest, flat)


def block_max_wand(index: Index, terms: list[int], least: float) -> list[tuple[int, float]]:
    """All (item, score) with a score of at least `least`, by block-max WAND."""
    least -= 1e-9
    lists = [[0, t] for t in terms]
    out: list[tuple[int, float]] = []
    items, weights, best, maxima = index.items, index.weights, index.best, index.block_max

    def skip(cursor: list[int], to: int) -> None:
        cursor[0] += int(np.searchsorted(items[cursor[1]][cursor[0] :], to))

    while True:
        lists = [c for c in lists if c[0] < len(items[c[1]])]
        lists.sort(key=lambda c: items[c[1]][c[0]])
        total, pivot = 0.0, -1
        for k, c in enumerate(lists):
            total += best[c[1]]
            if total >= least:
                pivot = k
                break
        if pivot < 0:
            return out
        d = int(items[lists[pivot][1]][lists[pivot][0]])
        while pivot + 1 < len(lists) and items[lists[pivot + 1][1]][lists[pivot + 1][0]] == d:
            pivot += 1
        block = d // BLOCK
        if sum(maxima[c[1]].get(block, 0.0) for c in lists[: pivot + 1]) < least:
            after = (block + 1) * BLOCK
            if pivot + 1 < len(lists):
                after = min(after, int(items[lists[pivot + 1][1]][lists[pivot + 1][0]]))
            for c in lists[: pivot + 1]:
                skip(c, max(after, d + 1))
        elif items[lists[0][1]][lists[0][0]] == d:
            score = sum(float(weights[c[1]][c[0]]) for c in lists[: pivot + 1])
            if score >= least:
                out.append((d, score))
            for c in lists[: pivot + 1]:
                c[0] += 1
        else:
            for c in lists[:pivot]:
                if items[c[1]][c[0]] < d:
                    skip(c, d)


def _candidates(index: Index, ids: np.ndarray, doc: np.ndarray, half: np.ndarray, base: np.ndarray, least: float) -> np.ndarray:
    """Numbers of the passages that some item may match; passage = base[doc] + half or one less."""
    rare, common = index.bound(least)
    rare = rare[ids]
    ids, doc, half = ids[rare], doc[rare], half[rare]
    first = base[doc] + half
    has_before = half > 0
    passage = np.concatenate([first, first[has_before] - 1])
    term = np.concatenate([ids, ids[has_before]])
    pairs = np.unique(passage * len(index.term) + term)
    passage, term = np.divmod(pairs, len(index.term))
    at, items, weights = index.flat
    count = at[term + 1] - at[term]
    spread = np.repeat(at[term] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    n = len(index.ids)
    cell, where = np.unique(np.repeat(passage, count) * n + items[spread], return_inverse=True)
    sums = np.bincount(where, weights[spread], len(cell)) + common[cell % n]
    return np.unique(cell[sums >= least - 1e-9] // n)


def search(index: Index, texts: list[str | None] | list[list[str]], least: float = MIN_SCORE, overlap: float = MIN_OVERLAP) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap) of the verified matches; texts may be split into words."""
    raw = [t if isinstance(t, list) else split_words(t) for t in texts]
    get = index.term.get
    known = {w: get(normal(w), -1) for w in set(chain.from_iterable(raw))}.__getitem__
    sizes = np.array([len(r) for r in raw])
    ids = np.fromiter(map(known, chain.from_iterable(raw)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(raw)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    halves = np.maximum(1, -(-sizes // index.length))
    base = np.concatenate([[0], np.cumsum(halves)])
    hit = ids >= 0
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    for passage in _candidates(index, ids[hit], doc[hit], place[hit] // index.length, base[:-1], least).tolist():
        d = int(np.searchsorted(base, passage, side="right")) - 1
        start = (passage - int(base[d])) * index.length
        tokens = [n for w in raw[d][start : start + 2 * index.length] if (n := normal(w))]
        terms = sorted({get(w, -1) for w in tokens} - {-1})
        there = None
        for item, score in block_max_wand(index, terms, least):
            if there is None:
                there = {n: {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} for n in range(1, GRAM + 1)}
            shares = [len(g & there[min(GRAM, len(p))]) / len(g) for p in index.parts[item] if (g := grams(p))]
            if min(shares) >= overlap and (score, *shares) > out.get((d, item), (0.0, 0.0, 0.0)):
                out[d, item] = (score, *shares)
    return [(d, item, *x) for (d, item), x in out.items()]


def indexes(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[list[Index]]:
    """Indexes by length of item, in lists of about shard_bytes of items at most, over the statistics of all items."""
    rows = benchmark.where("item_id is not null and text is not null").select(integer_id(benchmark, "item_id"), "text").orderBy("item_id", "text")
    small = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= shard_bytes
    read = rows.collect() if small else None
    df: Counter = Counter()
    n = total = 0
    for r in read if small else rows.toLocalIterator():
        if w := words(r.text):
            df.update(set(w))
            n, total = n + 1, total + len(w)

    def built(shard: dict[int, list[tuple[int, str]]]) -> list[Index]:
        return [build_index(items, df, n, total / n, length) for length, items in sorted(shard.items())]

    shard: dict[int, list[tuple[int, str]]] = {}
    size = 0
    for r in read if small else rows.toLocalIterator():
        if words(r.text):
            length = max(LEAST_PASSAGE, 1 << (len(split_words(r.text)) - 1).bit_length())
            shard.setdefault(length, []).append((r.item_id, r.text))
            size += len(r.text.encode("utf-8", "surrogatepass"))
            if size >= shard_bytes:
                yield built(shard)
                shard, size = {}, 0
    if shard:
        yield built(shard)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The matches; see the module's text."""
    if min_score <= 0:
        raise ValueError("min_score must be above 0")
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null and text is not null").select(integer_id(docs), F.xxhash64("text").alias("text_key"), "text")
    found = spark.createDataFrame([], SCHEMA)
    for shard in indexes(benchmark, shard_bytes):
        sent = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, "text", 4 << 20):
                raw = [split_words(t) for t in batch.column("text").to_pylist()]
                for index in sent.value:
                    hits = search(index, raw, min_score, min_overlap)
                    at = pa.array([h[0] for h in hits], pa.int64())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": batch.column("doc_id").take(at),
                            "text_key": batch.column("text_key").take(at),
                            "item_id": pa.array([index.ids[h[1]] for h in hits], pa.int64()),
                            **{c: pa.array([round(h[k], 4) for h in hits], pa.float64()) for k, c in enumerate(("score", "question_overlap", "answer_overlap"), 2)},
                        }
                    )

        found = found.unionByName(rows.mapInArrow(run, SCHEMA))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("b")
    return found.groupBy("doc_id", "item_id", "text_key").agg(best).select("doc_id", "item_id", "b.*", "text_key")


def drop_contaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the documents that match an item; rows with a null doc_id stay."""
    key, text_key = free_name(docs, "_key"), free_name(docs, "_text_key")
    names = cut_lineage(found.select(F.col("doc_id").alias(key), F.col("text_key").alias(text_key)).distinct())
    return docs.join(names, (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64("text") == F.col(text_key)), "left_anti")
