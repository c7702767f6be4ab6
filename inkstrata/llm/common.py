"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstrata.plans.derive import table
from inkstrata.sources.shared import delete_folder, shared_folder

__all__ = ["bounded", "cut_lineage", "delete_folder", "free_name", "integer_id", "shared_folder", "table", "utf8", "whole_buckets"]


def integer_id(df: DataFrame, column: str = "doc_id") -> Column:
    """The id column as a long; a column of any other type than an integer is refused before anything runs."""
    kind = dict(df.dtypes).get(column)
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} must be a column of integers, not of type {kind}")
    return F.col(column).cast("long").alias(column)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores at its end as make it new to df."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_buckets(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[pa.Array]]:
    """The columns of batches sorted by their first column, cut between its values into parts of about `least` rows or one larger bucket."""
    parts: list[pa.RecordBatch] = []
    rows = 0

    def whole() -> list[pa.Array]:
        return [pa.concat_arrays([p.column(k) for p in parts]) for k in range(parts[0].num_columns)]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        # Where what is held can end: at the last change of the key within this batch, or before it.
        cut = int(np.searchsorted(keys, keys[-1]))
        if rows + cut >= least and (cut or keys[0] != parts[-1].column(0)[-1].as_py()):
            parts.append(batch.slice(0, cut))
            yield whole()
            parts, rows = [], 0
            batch = batch.slice(cut)
        parts.append(batch)
        rows += batch.num_rows
    if parts:
        yield whole()


def bounded(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slice batches so that their text stays near max_bytes; a longer text is alone in its slice."""
    for batch in batches:
        at = np.asarray(text_offsets(batch.column(column)))
        start, n = 0, batch.num_rows
        while start < n:
            stop = int(np.searchsorted(at, at[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), n)
            yield batch.slice(start, stop - start)
            start = stop


def text_offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of each text, n + 1 of them; a null is an empty text."""
    return utf8(column)[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the n + 1 offsets into them."""
    column = column.fill_null("").cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
