"""Manuscripts, tables of contents, segments and results as files.

A file is one row, an empty one too. Names without folder and extension are document ids.
Paths are files, folders or patterns of either, on any file system that Arrow knows; names
that begin with a dot or an underscore are passed over, as by Spark's own readers.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstrata.functions import text as X
from inkstrata.functions.types import RESULTS, SEGMENTS


NAMES = 256  # file names in a row of the list of files
TASK_FILES = 2048  # files that a task reads, where there are more than the cores take
READ_BYTES = 8 << 20  # bytes of files that a task holds
PATTERN = re.compile(r"[*?\[{]")


def _file_system(folder: str) -> tuple[FileSystem, str]:
    """The file system of a folder, given by path or URI, and the path in it."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return FileSystem.from_uri(folder) if "://" in folder else (LocalFileSystem(), folder)


def _children(system: FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder, and whether they are files."""
    if isinstance(system, LocalFileSystem):
        with os.scandir(folder or "/") as found:
            yield from ((x.name, x.is_file()) for x in found)
    else:
        yield from ((x.base_name, x.type == FileType.File) for x in system.get_file_info(FileSelector(folder)))


def _alternatives(pattern: str) -> list[str]:
    """The pattern without braces: {a,b} stands for a or b."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    return [x for part in m[1].split(",") for x in _alternatives(pattern[: m.start()] + part + pattern[m.end() :])] if m else [pattern]


def _matching(system: FileSystem, path: str) -> Iterator[tuple[str, str, bool]]:
    """(folder, name, whether a file) of what a pattern names."""
    folder, _, last = path.rpartition("/")
    folders = [f"{f}/{n}" for f, n, file in _matching(system, folder) if not file] if PATTERN.search(folder) else [folder]
    test = re.compile("|".join(map(fnmatch.translate, _alternatives(last.replace("[^", "[!"))))).match
    for f in folders:
        yield from ((f, name, file) for name, file in _children(system, f) if test(name))


def _found(system: FileSystem, path: str) -> Iterator[tuple[str, str]]:
    """(folder, name) of the files of a path, a folder or a pattern."""
    seen = lambda name: not name.startswith((".", "_"))
    path = path.rstrip("/")
    if PATTERN.search(path):
        there = [(f, n, file) for f, n, file in _matching(system, path) if seen(n)]
    else:
        kind = system.get_file_info(path or "/").type
        if kind == FileType.NotFound:
            raise FileNotFoundError(path)
        folder, _, name = path.rpartition("/")
        there = [(folder, name, kind == FileType.File)]
    for folder, name, file in there:
        if file:
            yield folder, name
        else:
            yield from ((f"{folder}/{name}", n) for n, is_file in _children(system, f"{folder}/{name}") if is_file and seen(n))


def _list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(start, folder, names): files in rows of NAMES at most, spread over the tasks that read them.

    The driver holds their names and nothing else of them, about 20 bytes a file: Spark's own
    readers keep some KB of each file there, and take each for 4 MB when they form tasks.
    """
    by_folder: dict[tuple[str, str], list[pa.Array]] = {}
    some: dict[tuple[str, str], list[str]] = {}
    total = 0
    for given in [paths] if isinstance(paths, str) else paths:
        system, path = _file_system(given)
        if isinstance(system, LocalFileSystem):
            path = os.path.abspath(path)
        start = "" if isinstance(system, LocalFileSystem) else given
        for folder, name in _found(system, path):
            names = some.setdefault((start, folder), [])
            names.append(name)
            total += 1
            if len(names) == 1 << 16:
                by_folder.setdefault((start, folder), []).append(pa.array(some.pop((start, folder)), pa.string()))
    for key, names in some.items():
        by_folder.setdefault(key, []).append(pa.array(names, pa.string()))
    cores = spark.sparkContext.defaultParallelism
    wide = max(1, min(NAMES, total // (8 * cores)))
    starts, folders, lists = [], [], []
    for (start, folder), arrays in by_folder.items():
        names = pa.concat_arrays(arrays)
        ends = [*range(0, len(names), wide), len(names)]
        starts += [start] * (len(ends) - 1)
        folders += [folder] * (len(ends) - 1)
        lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names))
    if not lists:
        return spark.createDataFrame([], "start string, folder string, names array<string>")
    table = pa.table({"start": pa.array(starts, pa.string()), "folder": pa.array(folders, pa.string()), "names": pa.concat_arrays(lists)})
    return spark.createDataFrame(table).repartition(max(1, min(len(starts), max(2 * cores, total // TASK_FILES))))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, value) of the files of _list."""
    names: list[str] = []
    values: list[bytes] = []
    size = 0

    def whole() -> pa.RecordBatch:
        return pa.record_batch([pa.array(names, pa.string()), pa.array(values, pa.binary())], ["name", "value"])

    for batch in batches:
        for start, folder, listed in zip(*(batch.column(k) for k in range(3))):
            system = FileSystem.from_uri(start.as_py())[0] if start.as_py() else LocalFileSystem()
            for name in listed.as_py():
                with system.open_input_stream(f"{folder.as_py()}/{name}", compression=None) as file:
                    names.append(name)
                    values.append(file.read())
                size += len(values[-1])
                if size >= READ_BYTES:
                    yield whole()
                    names, values, size = [], [], 0
    if names:
        yield whole()


def read_files(spark: SparkSession, paths: str | list[str], suffix: str) -> DataFrame:
    """(doc_id, value) of text files."""
    files = _list(spark, paths).mapInArrow(_read, "name string, value binary")
    last = F.col("name")
    doc_id = F.when(F.endswith(last, F.lit(suffix)), F.substr(last, F.lit(1), F.length(last) - len(suffix))).otherwise(last)
    return files.select(doc_id.alias("doc_id"), F.col("value").cast("string").alias("value"))


def _name(suffix: str) -> Column:
    """The decoded file name without the suffix, where Spark reads the file."""
    last = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"([^/]*)$", 1)
    return F.when(F.endswith(last, F.lit(suffix)), F.substr(last, F.lit(1), F.length(last) - len(suffix))).otherwise(last)


def read_documents(spark: SparkSession, paths: str | list[str], suffix: str = ".md") -> DataFrame:
    """(doc_id, text) of text files; CR LF and CR become LF, a byte order mark goes."""
    return read_files(spark, paths, suffix).select("doc_id", X.newlines(F.regexp_replace("value", "^﻿", "")).alias("text"))


def read_tocs(spark: SparkSession, paths: str | list[str], suffix: str = ".toc.md") -> DataFrame:
    """(doc_id, text) of tables of contents that lie beside their documents as <doc_id><suffix>."""
    return read_documents(spark, paths, suffix)


def read_segments(spark: SparkSession, paths: str | list[str], suffix: str = ".json") -> DataFrame:
    """(doc_id, seg_no, target, context, reference) of JSON arrays of objects; a missing field is null."""
    rows = read_files(spark, paths, suffix).select("doc_id", F.posexplode(F.from_json("value", SEGMENTS)).alias("seg_no", "s"))
    return rows.select("doc_id", "seg_no", "s.target", "s.context", "s.reference")


def read_results(spark: SparkSession, paths: str | list[str], suffix: str = ".json") -> DataFrame:
    """(doc_id, seg_no, output) of JSON arrays of strings and nulls; a file that can't be read gives no row."""
    return read_files(spark, paths, suffix).select("doc_id", F.posexplode(F.from_json("value", RESULTS)).alias("seg_no", "output"))


def checked_results(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Results, with an error when run if a document has as many results as not segments; documents without results are new.

    The results are counted where they meet by document, so that their files are read once.
    """
    want = segments.groupBy("doc_id").agg(F.count("*").alias("_want"))
    counted = results.withColumn("_have", F.count("*").over(Window.partitionBy("doc_id")))
    message = F.concat(F.lit("results and segments of "), F.col("doc_id"), F.lit(" differ in number"))
    bad = F.when(F.col("_have") == F.coalesce("_want", F.lit(0)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return counted.join(want, "doc_id", "left").where(bad).select(results.columns)


def read_triples(spark: SparkSession, target: str, context: str | None = None, reference: str | None = None) -> DataFrame:
    """(doc_id, target, context, reference) of one target file and its optional companions."""
    out = read_documents(spark, target).select("doc_id", F.col("text").alias("target"))
    for name, path in (("context", context), ("reference", reference)):
        if path:
            out = out.crossJoin(read_documents(spark, path).select(F.col("text").alias(name)))  # one file, one row
        else:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out


def segments_json(segments: DataFrame, pretty: bool = True) -> DataFrame:
    """(doc_id, text): each document's segments as a JSON array, in order; null fields are left out."""
    fields = [c for c in ("target", "context", "reference") if c in segments.columns]
    listed = F.array_sort(F.collect_list(F.struct("seg_no", F.struct(*fields).alias("s"))))
    return segments.groupBy("doc_id").agg(F.to_json(F.transform(listed, lambda x: x["s"]), {"pretty": str(pretty).lower()}).alias("text"))


def results_json(joined: DataFrame) -> DataFrame:
    """(doc_id, text): each document's outputs as a JSON array with null for what is pending."""
    listed = F.array_sort(F.collect_list(F.struct("seg_no", "output")))
    return joined.groupBy("doc_id").agg(F.to_json(F.transform(listed, lambda x: x["output"]), {"ignoreNullFields": "false"}).alias("text"))


def write_documents(docs: DataFrame, folder: str, suffix: str = ".md") -> None:
    """Write (doc_id, text) as one file each into a folder that all executors share, on any file system that Arrow knows.

    A file appears whole or not at all, and a task that runs again writes the same; what a
    lost task leaves half written has a hidden name. A null text is an empty file.
    """

    def write(rows: Iterable) -> None:
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        for row in rows:
            path = f"{base}/{row.doc_id}{suffix}"
            part = f"{base}/.{row.doc_id}{suffix}.{os.getpid()}.part"
            with system.open_output_stream(part) as out:
                out.write((row.text or "").encode("utf-8", "surrogatepass"))
            system.move(part, path)

    docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").foreachPartition(write)


def append_events(events: DataFrame, path: str) -> None:
    """Append rows (run_id, event, doc_id, seg_no, detail) to the log of runs, with the time."""
    events.select("run_id", "event", "doc_id", "seg_no", "detail", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def result_events(results: DataFrame, run_id: str) -> DataFrame:
    """Events of a run, one for each result: done with the number of characters, or failed with the error."""
    return results.select(
        F.lit(run_id).alias("run_id"),
        F.when(F.col("output").isNull(), "failed").otherwise("done").alias("event"),
        "doc_id",
        "seg_no",
        F.coalesce("error", F.length("output").cast("string")).alias("detail"),
    )


def three_names(path: Column) -> Column:
    """Struct (marked, titles_marked, titles_original): the path with a word put before the last extension, or after it all if there is none."""

    def named(word: str) -> Column:
        with_dot = F.regexp_replace(path, r"(?s)^(.*)\.([^.]*)$", rf"$1.{word}.$2")
        return F.when(F.contains(path, F.lit(".")), with_dot).otherwise(F.concat(path, F.lit(f".{word}")))

    return F.struct(*(named(w).alias(w) for w in ("marked", "titles_marked", "titles_original")))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """The template with each name in it replaced by its value; values must not hold later names."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(name), value)
    return out
