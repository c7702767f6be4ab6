"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 32 bytes cuts every text where its top bits are
zero, at least `MIN_BYTES` after the last cut and at most `MAX_BYTES`; cuts never
split a character. As cuts depend on nearby bytes only, an insertion changes the
chunks around it and no others. Chunks are told apart by a 128-bit digest. Every
occurrence of a chunk but the first (least doc_id, then hash of the text, then place) is a
repeat; repeats that follow each other directly make a span, and spans of at least
`min_span` characters are removed. That is 128, as a passage of 50 words has twice as many
at least, while licence lines and the like, of some 80, are left where they stand.

All texts of a slice are hashed at once with array operations. Digests are grouped
with partial aggregation before the shuffle, so that a chunk in very many documents
is one row a task; the first places are kept as a table before the join back, so that
both of its sides are plain shuffles and a frequent digest can be split.

Defined results
- One row per removed span: doc_id, start, end (characters, end excluded), n_chunks,
  first_doc_id (where its first chunk stands first), and text_key, the hash of the text
  that the span belongs to.
- Null and empty texts have no chunks. Texts shorter than the least chunk are one chunk.
- A chunk that repeats within its own document is a repeat after its first place.
- Rows with a null doc_id are not compared. Rows that share doc_id and text are the same
  document, so a repeated row doesn't remove itself; rows that share a doc_id with other
  texts are documents of their own, and a span of one never cuts the other.
- doc_id must be a column of integers; others are refused with a TypeError.
- An empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.llm.common import bounded, cut_lineage, free_name, integer_id, utf8

WINDOW, MIN_BYTES, MAX_BYTES, ZERO_BITS = 32, 16, 256, 5
MIN_SPAN = 128
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=32) for b in range(256)], dtype=np.uint32)
CHUNKS = "doc_id long, text_key long, start int, end int, d1 long, d2 long, again boolean"


def cut_places(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Ends of all chunks of the texts that lie one after the other in data."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    ends = np.flatnonzero((h >> np.uint32(32 - ZERO_BITS)) == 0) + 1
    within = (data & 0xC0) == 0x80
    for _ in range(3):
        move = ends < len(data)
        move[move] = within[ends[move]]
        ends = ends + move

    def whole(at: int) -> int:
        while within[at]:
            at += 1
        return at

    out: list[int] = []
    add, found, k, pos = out.append, ends.tolist(), 0, 0
    found.append(len(data) + 1)
    for end in offsets[1:].tolist():
        full = pos + WINDOW  # before, the window would reach into the text before
        while (b := found[k]) < end:
            k += 1
            if b < full:
                continue
            while b - pos > MAX_BYTES:
                pos = whole(pos + MAX_BYTES)
                add(pos)
            if b - pos >= MIN_BYTES:
                add(b)
                pos = b
        while end - pos > MAX_BYTES and (at := whole(pos + MAX_BYTES) if pos + MAX_BYTES < len(data) else end) < end:
            pos = at
            add(pos)
        if end > pos:
            add(end)
            pos = end
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, "text", 4 << 20):
        data, offsets = utf8(batch.column("text"))
        if not len(data):
            continue
        ends = np.array(cut_places(data, offsets))
        starts = np.concatenate([[0], ends[:-1]])
        raw = data.tobytes()
        digest = xxhash.xxh3_128_digest
        keys = [digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        words = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        seen: set[bytes] = set()
        again = np.zeros(len(keys), bool)
        last = -1
        for k, (d, key) in enumerate(zip(doc.tolist(), keys)):
            if d != last:
                seen, last = set(), d
            again[k] = key in seen
            seen.add(key)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = chars[offsets[doc]]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(doc)),
                batch.column("text_key").take(pa.array(doc)),
                pa.array((chars[starts] - base).astype(np.int32)),
                pa.array((chars[ends] - base).astype(np.int32)),
                pa.array(np.ascontiguousarray(words[:, 0])),
                pa.array(np.ascontiguousarray(words[:, 1])),
                pa.array(again),
            ],
            ["doc_id", "text_key", "start", "end", "d1", "d2", "again"],
        )


def repeated_spans(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """The spans to remove; see the module's text."""
    rows = docs.where("doc_id is not null and text is not null").select(integer_id(docs), F.xxhash64("text").alias("text_key"), "text")
    chunks = rows.mapInArrow(_chunks, CHUNKS)
    row = F.struct("doc_id", "text_key")
    firsts = cut_lineage(chunks.groupBy("d1", "d2").agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    repeats = chunks.join(firsts, ["d1", "d2"], "left").where(F.col("again") | (row > F.col("first")))
    by_doc = Window.partitionBy("doc_id", "text_key").orderBy("start")
    repeats = repeats.select("doc_id", "text_key", "start", "end", F.coalesce("first.doc_id", "doc_id").alias("first_doc_id")).dropDuplicates(["doc_id", "text_key", "start", "end"])
    apart = F.coalesce(F.col("start") > F.lag("end").over(by_doc), F.lit(True))
    runs = repeats.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(by_doc))
    spans = runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.min_by("first_doc_id", "start").alias("first_doc_id")
    )
    return spans.where(F.col("end") - F.col("start") >= min_span).select("doc_id", "start", "end", "n_chunks", "first_doc_id", "text_key")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the spans, in the columns of docs; a document may become empty and stays."""
    cuts, key, text_key = (free_name(docs, n) for n in ("_cuts", "_key", "_text_key"))
    listed = cut_lineage(spans.groupBy(F.col("doc_id").alias(key), F.col("text_key").alias(text_key)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(cuts)))
    joined = docs.join(listed, (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64("text") == F.col(text_key)), "left")
    # What stands before each cut and after the last one, joined once: the cuts are sorted and don't overlap.
    end_before = lambda k: F.when(k == 0, 0).otherwise(F.get(cuts, k - 1)["end"])
    between = F.transform(cuts, lambda c, k: F.substr(F.col("text"), end_before(k) + 1, c["start"] - end_before(k)))
    kept = F.concat(F.array_join(between, ""), F.substr(F.col("text"), F.element_at(cuts, -1)["end"] + 1))
    return joined.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(kept)).select(docs.columns)
