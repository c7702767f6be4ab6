"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words; labels are known for documents only.
A passage is encoded from the embeddings of its words' known features (sum over the root
of the number of words) and the shares of a few word shapes, through tanh. Features are
the whole word and its runs of `GRAMS` characters, so that a stem is known in forms that
no labelled document has. Known are those that stand in `LEAST_DOCS` labelled documents
at least, near copies counted once, and whose share differs between a head's two kinds
of documents by `LEAST_Z` standard errors: other features only let a model learn its
sample by heart. Gated attention,
softmax of w (tanh(V h) * sigmoid(U h)), weights all passages of a document, so that one
bad passage among many can decide. Two logistic heads read the weighted representation:
low quality (labels.quality = 0) and toxic (labels.toxic = 1).

The model is trained on the driver with Adam on a bounded sample of labelled documents:
for each of the three classes the `per_class` documents with the least hash of their id,
of at most `most_chars` characters, as documented parameters, all of which it learns from
(`held_out` learns from four fifths and measures accuracy on the others). Scoring reads every passage of every document whole; a document is
scored where it is read, without a shuffle. The model, a few megabytes, is sent to the tasks.

Defined results
- One row per row of documents: doc_id, quality_score (1 - probability of low quality),
  toxic_score, n_passages, keep (both probabilities below `limit`).
- A text without words has no passage: null scores, 0 passages, not kept.
- Labels with a null doc_id, quality or toxic are left out of the sample; of repeated ones
  the least counts, and of the texts that share a labelled doc_id the least that is short
  enough, so the same tables give the same model. Labels without such a text take no place
  in the sample.
- doc_id must be a column of integers, in labels too; others are refused with a TypeError.
- If a head's labels lack one of both kinds, or there is no labelled
  document, that head rejects nothing and gives probability 0.
- An empty table gives an empty result; columns other than doc_id and text are ignored,
  and filter_documents passes all columns on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import bounded, cut_lineage, integer_id
from inkstrata.llm.words import normal, split_words

PASSAGE, WIDTH, ATTENTION = 64, 16, 8
PER_CLASS, MOST_CHARS, EPOCHS, LIMIT = 2500, 20_000, 10, 0.5
GRAMS, LEAST_DOCS, LEAST_Z = (5, 6), 5, 6.0
CACHED = 200_000  # words whose features a task remembers
SHAPES = 6
SIGNS = re.compile(r"[#$%&*|@^~<>{}=+\\_]")


def shape(word: str) -> int:
    """Bits: upper case, signs, exclamation, no letter, 25 characters or more."""
    if word.isalpha():
        return (len(word) > 2 and word.isupper()) | (len(word) >= 25) << 4
    return (
        (len(word) > 2 and word.isupper())
        | bool(SIGNS.search(word)) << 1
        | ("!!" in word) << 2
        | (not any(c.isalpha() for c in word)) << 3
        | (len(word) >= 25) << 4
    )


def features(word: str) -> set[str]:
    """The word, marked at both ends, and its runs of GRAMS characters."""
    w = f"<{word}>"
    out = {w}
    for n in GRAMS:
        out.update([w[k : k + n] for k in range(len(w) - n + 1)])
    return out


@dataclass
class Bags:
    """Passages of texts: distinct words with their features, words in order, where passages and texts begin, shares of shapes."""

    ids: np.ndarray  # features of the distinct words, 0 where a word has none
    begins: np.ndarray  # of distinct words in ids
    word: np.ndarray  # number of the distinct word, for each word in order
    starts: np.ndarray  # of passages in word
    sizes: np.ndarray  # words of passages
    shapes: np.ndarray  # passages x SHAPES
    firsts: np.ndarray  # of texts in passages, texts without words left out
    texts: np.ndarray  # numbers of the texts with words

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sum of a table's rows over the features of each passage."""
        return np.add.reduceat(np.add.reduceat(table[self.ids], self.begins, axis=0)[self.word], self.starts, axis=0)

    @cached_property
    def back(self) -> tuple[np.ndarray, ...]:
        """For spread: passages by word, where words begin in them; words by feature, where features begin in them; features."""
        passage = np.repeat(np.arange(len(self.sizes)), self.sizes)
        by_word = np.argsort(self.word, kind="stable")
        at = np.searchsorted(self.word[by_word], np.arange(len(self.begins)))
        owner = np.repeat(np.arange(len(self.begins)), np.diff(np.append(self.begins, len(self.ids))))
        by_feature = np.argsort(self.ids, kind="stable")
        found, first = np.unique(self.ids[by_feature], return_index=True)
        return passage[by_word], at, owner[by_feature], first, found

    def spread(self, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The reverse of sums: features, and for each the sum of a change of passages over its places."""
        passage, at, owner, first, found = self.back
        of_words = np.add.reduceat(change[passage], at, axis=0)
        return found, np.add.reduceat(of_words[owner], first, axis=0)


class Known:
    """Features, shape and normal form of words, found once each; goes with one vocabulary.

    All features of many words are found in one pass of an Aho-Corasick automaton over
    the words, so the cost doesn't depend on how many parts a word has.
    """

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.words: dict[str, tuple[list[int], int, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for f, k in vocabulary.items():
            self.automaton.add_word(f, k)
        if vocabulary:
            self.automaton.make_automaton()

    def learn(self, words: Iterable[str]) -> dict[str, tuple[list[int], int, str]]:
        if len(self.words) > CACHED:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        names = [normal(w) for w in new]
        ids: list[set[int]] = [set() for _ in new]
        if new and len(self.automaton):
            hits = list(self.automaton.iter("\n".join([f"<{n}>" for n in names])))  # no word holds a line end
            ends = np.cumsum([len(n) + 3 for n in names])
            for k, (_, f) in zip(np.searchsorted(ends, [e for e, _ in hits], side="right").tolist(), hits):
                ids[k].add(f)
        self.words.update(zip(new, ((sorted(i) or [0], shape(w), n) for w, i, n in zip(new, ids, names))))
        return self.words


def encode(texts: list[str | None], known: Known) -> Bags:
    raw = [split_words(t) for t in texts]
    index = {w: k for k, w in enumerate(set(chain.from_iterable(raw)))}
    cache = known.learn(index)
    found = [cache[w] for w in index]
    each = np.array([len(f[0]) for f in found], np.int64)
    flat = np.fromiter(chain.from_iterable(f[0] for f in found), np.int64, int(each.sum()))
    kind = np.array([f[1] for f in found], np.int64)
    same: dict[str, int] = {}
    distinct = np.array([same.setdefault(f[2], len(same)) for f in found], np.int64)
    sizes = np.array([len(r) for r in raw], np.int64)
    at = np.fromiter(map(index.__getitem__, chain.from_iterable(raw)), np.int64, int(sizes.sum()))
    texts_with = np.flatnonzero(sizes)
    count = -(-sizes[texts_with] // PASSAGE)
    begin = np.concatenate([[0], np.cumsum(sizes)])[texts_with]
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(begin, count) + inner * PASSAGE
    ends = np.minimum(starts + PASSAGE, np.repeat(begin + sizes[texts_with], count))
    begins = np.cumsum(each) - each
    if not len(starts):
        return Bags(flat, begins, at, starts, starts, np.empty((0, SHAPES)), starts, texts_with)
    n = ends - starts
    bits = kind[at]
    again = np.zeros(len(at), bool)
    again[1:] = distinct[at[1:]] == distinct[at[:-1]]
    again[begin] = False
    flags = np.column_stack([(bits >> b) & 1 for b in range(SHAPES - 1)] + [again]).astype(np.float32)
    shares = np.add.reduceat(flags, starts, axis=0) / n[:, None].astype(np.float32)
    return Bags(flat, begins, at, starts, n, shares, np.cumsum(count) - count, texts_with)


def _copies(text: str) -> int:
    """A number that near copies mostly share: the least hash of three words in a row."""
    w = split_words(text)
    return min((xxhash.xxh3_64_intdigest(" ".join(w[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(w) - 2))), default=0)


def vocabulary_of(texts: list[str], truth: np.ndarray) -> dict[str, int]:
    """Numbers, from 1, of the features that tell a column of truth; see the module's text."""
    seen: set[tuple] = set()
    use = [k for k, t in enumerate(texts) if (key := (_copies(t), *truth[k].tolist())) not in seen and not seen.add(key)]
    number: dict[str, int] = {}
    of_word: dict[str, np.ndarray] = {}
    add = number.setdefault
    parts = []
    for k in use:
        words = {n for w in split_words(texts[k]) if (n := normal(w))}
        for w in words:
            if w not in of_word:
                of_word[w] = np.array([add(f, len(number)) for f in features(w)], np.int64)
        parts.append(np.unique(np.concatenate([of_word[w] for w in words])) if words else np.empty(0, np.int64))
    total = np.bincount(np.concatenate([*parts, np.empty(0, np.int64)]), minlength=len(number))
    good = np.zeros(len(number), bool)
    for column in truth[use].T:
        a, b = int(column.sum()), int((1 - column).sum())
        if a and b:
            mine = np.bincount(np.concatenate([p for p, y in zip(parts, column) if y]), minlength=len(number))
            share = total / (a + b)
            error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / a + 1 / b))
            good |= np.abs(mine / a - (total - mine) / b) >= LEAST_Z * error
    good &= (total >= LEAST_DOCS) & (total < len(use))
    return {f: k for k, f in enumerate(sorted(f for f, i in number.items() if good[i]), 1)}


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray]
    heads: tuple[bool, bool]  # low quality, toxic: trained

    def passages(self, bags: Bags) -> np.ndarray:
        w = self.weights
        total = bags.sums(w["words"]) / np.sqrt(bags.sizes)[:, None].astype(np.float32)
        return np.tanh(total + bags.shapes @ w["shapes"] + w["bias"])

    def probabilities(self, bags: Bags) -> np.ndarray:
        """(texts with words, 2): low quality, toxic."""
        if not len(bags.texts):
            return np.empty((0, 2))
        w = self.weights
        h = self.passages(bags)
        score = (np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["w"]
        counts = np.diff(np.append(bags.firsts, len(h)))
        e = np.exp(score - np.repeat(np.maximum.reduceat(score, bags.firsts), counts))
        a = e / np.repeat(np.add.reduceat(e, bags.firsts), counts)
        z = np.add.reduceat(a[:, None] * h, bags.firsts, axis=0)
        return 1 / (1 + np.exp(-(z @ w["C"] + w["c"]))) * np.array(self.heads)


def _gradients(w: dict[str, np.ndarray], b: Bags, y: np.ndarray, heads: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of a batch; features' gradients only for those that occur."""
    root = np.sqrt(b.sizes)[:, None].astype(np.float32)
    h = np.tanh(b.sums(w["words"]) / root + b.shapes @ w["shapes"] + w["bias"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    score = (t * g) @ w["w"]
    counts = np.diff(np.append(b.firsts, len(h)))
    e = np.exp(score - np.repeat(np.maximum.reduceat(score, b.firsts), counts))
    a = e / np.repeat(np.add.reduceat(e, b.firsts), counts)
    z = np.add.reduceat(a[:, None] * h, b.firsts, axis=0)
    p = 1 / (1 + np.exp(-(z @ w["C"] + w["c"])))
    dlogit = (p - y) * heads / len(y)
    dz = np.repeat(dlogit @ w["C"].T, counts, axis=0)
    da = (dz * h).sum(axis=1)
    dscore = a * (da - np.repeat(np.add.reduceat(a * da, b.firsts), counts))
    dtg = dscore[:, None] * w["w"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = (a[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
    return {
        "C": z.T @ dlogit, "c": dlogit.sum(axis=0), "w": dscore @ (t * g), "V": h.T @ dt, "U": h.T @ dg,
        "shapes": b.shapes.T @ dh, "bias": dh.sum(axis=0), "words": b.spread(dh / root),
    }


def fit(texts: list[str], low: list[bool], toxic: list[bool], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Train on labelled texts; the same texts give the same model."""
    y = np.column_stack([low, toxic]).astype(float) if texts else np.empty((0, 2))
    vocabulary = vocabulary_of(texts, y)
    heads = tuple(bool(0 < y[:, k].sum() < len(y)) for k in range(2))
    rng = np.random.default_rng(seed)
    size = {"shapes": (SHAPES, WIDTH), "bias": (WIDTH,), "V": (WIDTH, ATTENTION), "U": (WIDTH, ATTENTION), "w": (ATTENTION,), "C": (WIDTH, 2), "c": (2,)}
    w = {k: rng.normal(0, 0.3, s) if len(s) > 1 or k == "w" else np.zeros(s) for k, s in size.items()}
    w["words"] = rng.normal(0, 0.02, (len(vocabulary) + 1, WIDTH))
    w["words"][0] = 0
    order = [k for k, t in enumerate(texts) if t and t.split()]
    rng.shuffle(order)
    batches = [order[at : at + 64] for at in range(0, len(order), 64)] if any(heads) else []
    known = Known(vocabulary)
    w = {k: x.astype(np.float32) for k, x in w.items()}
    encoded = [(encode([texts[k] for k in b], known), y[b].astype(np.float32)) for b in batches]
    m = {k: np.zeros_like(x) for k, x in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs)
        rng.shuffle(encoded)
        for bags, truth in encoded:
            grads = _gradients(w, bags, truth, np.array(heads, np.float32))
            step += 1
            for k, d in grads.items():
                rows, d = d if k == "words" else (slice(None), d)
                d = d + 1e-5 * w[k][rows]
                m[k][rows] = 0.9 * m[k][rows] + 0.1 * d
                v[k][rows] = 0.999 * v[k][rows] + 0.001 * d * d
                w[k][rows] -= rate * (m[k][rows] / (1 - 0.9**step)) / (np.sqrt(v[k][rows] / (1 - 0.999**step)) + 1e-8)
            w["words"][0] = 0
    return Model(vocabulary, w, heads)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> list:
    """Rows (doc_id, text, quality, toxic), at most per_class of each of clean, low quality and toxic."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(integer_id(labels))
    known = known.agg(F.min(F.struct("quality", "toxic")).alias("l")).select("doc_id", "l.*")
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    short = docs.where((F.length("text") <= most_chars) & F.col("doc_id").isNotNull()).select(integer_id(docs), "text")
    # Ids first, which are few bytes, then the texts of those that are chosen: 3 x per_class at most.
    there = cut_lineage(known.join(short.select("doc_id").distinct(), "doc_id").withColumn("kind", kind))
    parts = [there.where(F.col("kind") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in range(3)]
    ids = parts[0].unionByName(parts[1]).unionByName(parts[2])
    texts = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality", "toxic", "kind").agg(F.min("text").alias("text"))
    return texts.orderBy("kind", F.xxhash64("doc_id"), "doc_id").select("doc_id", "text", "quality", "toxic").collect()


def _fit_rows(rows: list) -> Model:
    return fit([r.text for r in rows], [r.quality == 0 for r in rows], [r.toxic == 1 for r in rows])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Model:
    """The model of the whole sample."""
    return _fit_rows(labelled_sample(docs, labels, per_class, most_chars))


def held_out(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> float:
    """Accuracy (keep or not), on every fifth document of the sample, of a model of the others."""
    rows = labelled_sample(docs, labels, per_class, most_chars)
    fold, held = [r for k, r in enumerate(rows) if k % 5], [r for k, r in enumerate(rows) if k % 5 == 0]
    model = _fit_rows(fold)
    right = [s is not None and (max(s) < LIMIT) == (r.quality != 0 and r.toxic != 1) for r, s in zip(held, score(model, [r.text for r in held]))]
    return float(np.mean(right)) if held else float("nan")


def score(model: Model, texts: list[str | None], known: Known | None = None) -> list[tuple[float, float] | None]:
    """(probability of low quality, of toxic) of each text; None without words."""
    bags = encode(texts, known or Known(model.vocabulary))
    out: list[tuple[float, float] | None] = [None] * len(texts)
    for k, p in zip(bags.texts.tolist(), model.probabilities(bags).tolist()):
        out[k] = (p[0], p[1])
    return out


def classify(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, per_class: int = PER_CLASS) -> DataFrame:
    """Scores and verdicts; see the module's text."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(sent.value.vocabulary)
        for batch in bounded(batches, "text", 2 << 20):
            bags = encode(batch.column("text").to_pylist(), known)
            p = sent.value.probabilities(bags)
            n = np.zeros(batch.num_rows, np.int64)
            n[bags.texts] = np.diff(np.append(bags.firsts, len(bags.starts)))
            all_p = np.ones((batch.num_rows, 2))
            all_p[bags.texts] = p
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.round(1 - all_p[:, 0], 6), mask=none),
                    pa.array(np.round(all_p[:, 1], 6), mask=none),
                    pa.array(n),
                    pa.array((all_p < limit).all(axis=1)),
                ],
                ["doc_id", "quality_score", "toxic_score", "n_passages", "keep"],
            )

    rows = docs.select(integer_id(docs), "text")
    return rows.mapInArrow(run, "doc_id long, quality_score double, toxic_score double, n_passages long, keep boolean")


def filter_documents(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs that classify keeps, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(sent.value.vocabulary)
        for batch in bounded(batches, "text", 2 << 20):
            keep = [s is not None and max(s) < limit for s in score(sent.value, batch.column("text").to_pylist(), known)]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
