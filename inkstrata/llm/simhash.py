"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has 128 bits: the majority, bit by bit, of the hashes of
its distinct words (runs of non-blank characters in lower case, without the signs before
and after; each Han character is a word). Documents with equal fingerprints are one class.
The fingerprint of each class is cut into seven segments and a Hamming ball of radius 1 is
enumerated in each segment, for the table as for the queries, so that a lookup by equal key
finds every pair of fingerprints with a segment at a distance of 2 at most. Two fingerprints
at a distance of `radius` = 20 have such a segment, as 7 * 3 > 20: the lookup is complete.
The complete distance of each pair found is verified against `radius`. Groups are the
connected components of verified pairs; the document with the least doc_id stays.

The rows of a key come sorted, so a task holds a few MB and the bucket at hand. Small buckets
are compared all together. In a large one each fingerprint meets only those that no earlier one
has reached as long as that spares comparisons, so a bucket of near copies costs a few for each
of them; the rest, which met by chance, are compared in blocks, each pair once in a bucket.

Chance meets grow with the square of the classes over 2 to the power of a segment's bits (18).
`bits`, `segment_count` and `radius` are parameters, refused where they aren't complete. More
classes than about 10^8 take more bits at the same radius: 192 bits with segment_count = 7 have
segments of 27 bits, are as complete and find copies with two thirds of the changed bits.

Defined results
- One row per document that goes: doc_id, kept_doc_id (of the document of the group that has
  the least doc_id, then hash of the text), text_key and kept_text_key, the hashes of both texts.
- A text without a word counts as one word, itself stripped; null, empty and blank
  texts have no fingerprint and are never duplicates.
- Rows with a null doc_id are not compared. Rows that share doc_id and text are the same
  document; rows that share a doc_id with other texts are documents of their own.
- doc_id must be a column of integers; others are refused with a TypeError.
- An empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import bounded, cut_lineage, free_name, integer_id, whole_buckets
from inkstrata.llm.components import components
from inkstrata.llm.words import normal, split_words

BITS, SEGMENTS, RADIUS = 128, 7, 20
SMALL = 256  # buckets of more classes are searched one by one
PAIRS = 1 << 15  # pairs that are compared at a time
CHUNK = 1 << 20  # rows of whole buckets that are compared together


def fingerprint_bytes(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as (n, bits // 8) bytes and a mask of the texts that have one."""
    raw = [set(split_words(t)) for t in texts]
    index: dict[str, int] = {}
    known = index.setdefault
    place = {w: known(normal(w), len(index)) for w in set().union(*raw)}.__getitem__
    sets = [set(map(place, s)) for s in raw]
    for t, s in zip(texts, sets):
        s.discard(index.get(""))
        if not s and t and t.strip():
            s.add(known(t.strip(), len(index)))
    rows = np.fromiter(chain.from_iterable(sets), np.int64, sum(map(len, sets)))
    words = [w.encode("utf-8", "surrogatepass") for w in index]
    digests = [b"".join(xxhash.xxh3_128_digest(w, seed=k) for w in words) for k in range(-(-bits // 128))]
    table = np.hstack([np.frombuffer(d, np.uint8).reshape(-1, 16) for d in digests]) if words else np.empty((0, bits // 8), np.uint8)
    table = np.unpackbits(table[:, : bits // 8], axis=1)
    out = np.zeros((len(texts), bits // 8), np.uint8)
    at = 0
    for k, s in enumerate(sets):
        if s:
            ones = table[rows[at : at + len(s)]].sum(axis=0, dtype=np.int32)
            out[k] = np.packbits(2 * ones > len(s))
            at += len(s)
    return out, np.array([bool(s) for s in sets], dtype=bool)


def _fingerprint_batches(bits: int):
    names = [f"f{k}" for k in range(bits // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 2 << 20):
            fp, has = fingerprint_bytes(batch.column("text").to_pylist(), bits)
            parts = fp[has].view(">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n).filter(pa.array(has)) for n in ("doc_id", "text_key")), *(pa.array(np.ascontiguousarray(parts[:, k])) for k in range(len(names)))],
                ["doc_id", "text_key", *names],
            )

    return run, names


def segments(fp: np.ndarray, bits: int, count: int) -> list[tuple[np.ndarray, int]]:
    """Each segment's values and width; fp is (n, bits // 64) words, the highest first."""
    cuts = [round(k * bits / count) for k in range(count + 1)]
    on = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(len(fp), -1), axis=1)
    return [(on[:, a:b].astype(np.int64) @ (1 << np.arange(b - a - 1, -1, -1, dtype=np.int64)), b - a) for a, b in zip(cuts, cuts[1:])]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1)


def _join(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unite u[k] and v[k] in root, where each node points at the least of its component."""
    while len(u):
        x, y = root[u], root[v]
        apart = x != y
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def _search(fp: np.ndarray, radius: int, room: list[np.ndarray]) -> np.ndarray:
    """For each fingerprint of one bucket a row of its component over verified pairs, the same for all of the component.

    While one group of near copies makes up much of the bucket, each row meets only those that no earlier one has
    reached. As soon as that gains little, all others meet in blocks. room holds arrays to work in.
    """
    root, left = np.arange(len(fp)), np.arange(len(fp))
    queue = np.empty(0, np.int64)  # rows of one component that have not met those left
    tried = reached = 0
    while len(left) and tried <= 2 + reached // 8:
        if not len(queue):
            queue, left = left[:1], left[1:]
        one, queue = queue[0], queue[1:]
        near = distances(fp[left], fp[one]) <= radius
        found, left = left[near], left[~near]
        root[found] = root[one]
        queue = np.concatenate([queue, found])
        tried, reached = tried + 1, reached + len(found)
    if len(left):
        rows = np.concatenate([queue, left])
        words = np.ascontiguousarray(fp[rows].T)
        tree = np.arange(len(rows))
        tree[: len(queue)] = 0
        at = 0
        while at < len(rows):
            begin = max(at, len(queue))  # the queue's rows need not meet one another
            wide = len(rows) - begin
            stop = min(at + max(1, PAIRS // wide), len(rows))
            block = (stop - at) * wide
            xor, count, apart = (r[:block] for r in room)
            apart[:] = 0
            for word in words:
                np.bitwise_xor(word[at:stop, None], word[None, begin:], out=xor.reshape(stop - at, wide))
                apart += np.bitwise_count(xor, out=count)
            u, v = np.divmod(np.flatnonzero(apart <= radius), wide)
            _join(tree, u + at, v + begin)
            at = stop
        root[rows] = root[rows[tree]]
    return root


def _forest(keys: np.ndarray, nodes: np.ndarray, fp: np.ndarray, n: int, radius: int) -> np.ndarray:
    """Least node of each of n nodes' components over verified pairs with an equal key; keys are sorted."""
    root = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    words = [np.ascontiguousarray(fp[:, k]) for k in range(fp.shape[1])]
    total = np.uint8 if len(words) < 4 else np.uint16  # for the bits of all words
    room = [np.empty(max(PAIRS, sizes.max(initial=0)), kind) for kind in (np.uint64, np.uint8, total)]
    ties: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(members: np.ndarray, tree: np.ndarray) -> None:
        tied = np.flatnonzero(tree != np.arange(len(tree)))
        ties.append((members[tied], members[tree[tied]]))

    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        members = nodes[start : start + size]
        keep(members, _search(fp[members], radius, room))
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():  # all buckets of a size together
        begins = starts[sizes == size]
        step = max(1, PAIRS // size)
        for at in range(0, len(begins), step):
            members = nodes[begins[at : at + step] + np.arange(size)[:, None]]  # a bucket is a column
            flat, width = members.ravel(), members.shape[1]
            own = [word[flat] for word in words]
            found = [np.empty((2, 0), np.int64)]
            for shift in range(width, len(flat), width):  # each row meets the one so many rows below
                apart = sum((np.bitwise_count(word[shift:] ^ word[:-shift]) for word in own), total(0))
                near = np.flatnonzero(apart <= radius)
                if len(near):
                    found.append(np.stack([near, near + shift]))
            tree = np.arange(len(flat))
            _join(tree, *np.concatenate(found, axis=1))
            keep(flat, tree)
    if ties:
        _join(root, *(np.concatenate(side) for side in zip(*ties)))
    return root


def near_duplicates(docs: DataFrame, bits: int = BITS, segment_count: int = SEGMENTS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, kept_doc_id, text_key, kept_text_key) of the documents that go; see the module's text."""
    if radius >= 3 * segment_count:
        raise ValueError("the lookup is complete to a radius of 3 * segment_count - 1 only")
    make, names = _fingerprint_batches(bits)
    rows = docs.where("doc_id is not null").select(integer_id(docs), F.xxhash64("text").alias("text_key"), "text")
    fields = ", ".join(f"{n} long" for n in names)
    fps = cut_lineage(rows.mapInArrow(make, f"doc_id long, text_key long, {fields}"))
    classes = fps.groupBy(*names).agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))  # written, so that the numbers stay

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.column_stack([batch.column(n).to_numpy() for n in names]).view(np.uint64)
            for k, (value, width) in enumerate(segments(fp, bits, segment_count)):
                flips = np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])
                keys = ((value[None, :] ^ flips[:, None]) * segment_count + k).ravel()
                take = pa.array(np.tile(np.arange(len(fp)), len(flips)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(n).take(take) for n in ["node", *names])], ["key", "node", *names])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_buckets(batches, CHUNK):
            key, node, *words = (c.to_numpy() for c in columns)
            ids, first, nodes = np.unique(node, return_index=True, return_inverse=True)
            fp = np.column_stack([w[first] for w in words]).view(np.uint64)  # bits of a negative number would be counted in its absolute value
            root = _forest(key, nodes, fp, len(ids), radius)
            tied = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[root[tied]])], ["u", "v"])

    # A class becomes over a hundred rows, so tasks of the usual size would spill what they write.
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    spread = classes.select("node", *names).repartition(tasks, "node").mapInArrow(balls, f"key long, node long, {fields}")
    edges = spread.repartition("key").sortWithinPartitions("key").mapInArrow(match, "u long, v long")
    roots = components(edges)
    placed = classes.join(roots, "node", "left").select(*names, "first", F.coalesce("root", "node").alias("root"))
    kept = placed.groupBy("root").agg(F.min("first").alias("kept"))
    fates = placed.join(kept, "root").select(*names, "kept")
    gone = fps.join(fates, names).where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("text_key") != F.col("kept.text_key")))
    return gone.select("doc_id", F.col("kept.doc_id").alias("kept_doc_id"), "text_key", F.col("kept.text_key").alias("kept_text_key")).distinct()


def keep_one_each(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the documents that go; of rows that are equal in doc_id and text one stays, that with the least hash of all columns.

    Rows with a null doc_id stay.
    """
    key, text_key, rank = (free_name(docs, n) for n in ("_key", "_text_key", "_rank"))
    names = gone.select(F.col("doc_id").alias(key), F.col("text_key").alias(text_key))
    left = docs.join(names, (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64("text") == F.col(text_key)), "left_anti")
    same = docs.where("doc_id is not null").groupBy("doc_id", F.xxhash64("text").alias(text_key)).agg(F.count("*").alias(rank))
    shared = cut_lineage(same.where(F.col(rank) > 1).select(F.col("doc_id").alias(key), text_key))
    if shared.isEmpty():
        return left
    on = (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(text_key))
    # One row a task of each, before they meet: a row may be repeated for a third of the table.
    least = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    again = left.join(shared, on, "left_semi").groupBy("doc_id", F.xxhash64("text").alias(text_key)).agg(F.min_by(F.struct(*docs.columns), least).alias(rank))
    return left.join(shared, on, "left_anti").select(docs.columns).unionByName(again.select(f"{rank}.*"))
