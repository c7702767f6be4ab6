"""Revision of segments by an external service: resumable, paced, in any order.

Segments are (doc_id, seg_no, target, context, reference), results are rows of
(doc_id, seg_no, output, error, at). Results are only ever appended; the latest output
of a segment counts. A task that is run again may send a segment again, so clients
should treat `key`, a digest of prompt and content, as an idempotency key.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.functions import text as X
from inkstrata.sources.files import read_documents, read_triples, write_documents

PROMPT = (
    "You are a careful copy editor. Correct errors of spelling, punctuation and grammar in the text between the target marks. "
    "Context and reference are for reading only. Keep the layout. Answer with the corrected text and nothing else."
)


def load_prompt(path: str | None = None) -> str:
    """The prompt in a file, read when it is asked for, or the one above."""
    if path is None:
        return PROMPT
    with open(path, encoding="utf-8") as file:
        return file.read().strip()


RESULT = "doc_id string, seg_no int, output string, error string, at timestamp"


class Client(Protocol):
    """A service that revises; it is sent to the tasks, so it must be picklable."""

    def revise(self, messages: list[dict[str, str]], key: str) -> str | None: ...


@dataclass
class ReplacingClient:
    """Answers offline, always the same: the target with some words replaced."""

    changes: dict[str, str] = field(default_factory=lambda: {"teh": "the"})

    def revise(self, messages: list[dict[str, str]], key: str) -> str | None:
        text = messages[-1]["content"]
        for old, new in self.changes.items():
            text = text.replace(old, new)
        return text


@dataclass
class EchoClient:
    """Answers offline with all that a service would get after the instruction, in order."""

    def revise(self, messages: list[dict[str, str]], key: str) -> str | None:
        return "\n".join(m["content"] for m in messages[1:] if m["content"])


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def _setting(name: str) -> str:
    """A setting of the executor's environment; keys are never part of a plan."""
    if not (value := os.environ.get(name)):
        raise ValueError(f"set {name} in the environment of the executors")
    return value


@dataclass
class HttpChatClient:
    """A service with the usual chat completions interface; url and key are names of variables in the environment of the executors."""

    model: str
    url_variable: str = "INKSTRATA_CHAT_URL"
    key_variable: str = "INKSTRATA_CHAT_KEY"
    temperature: float = 1.3
    timeout: float = 120
    attempts: int = 3

    def wait_after(self, attempt: int) -> float:
        return 5 + 3 * attempt

    def revise(self, messages: list[dict[str, str]], key: str) -> str | None:
        body = {"model": self.model, "messages": messages, "temperature": self.temperature, "stream": False}
        headers = {"Authorization": f"Bearer {_setting(self.key_variable)}", "Idempotency-Key": key}
        return _post(_setting(self.url_variable), body, headers, self.timeout)["choices"][0]["message"]["content"]


@dataclass
class HttpGenerateClient:
    """A service that takes the instruction in a field of its own and the rest as one content; its key goes in a header of its own.

    It waits the same time after each empty answer. What it answers is passed on as it is.
    """

    model: str
    url_variable: str = "INKSTRATA_GENERATE_URL"
    key_variable: str = "INKSTRATA_GENERATE_KEY"
    temperature: float = 1.3
    timeout: float = 120
    attempts: int = 3
    strips_marks: bool = False

    def wait_after(self, attempt: int) -> float:
        return 3

    def revise(self, messages: list[dict[str, str]], key: str) -> str | None:
        told = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
        asked = "\n\n".join(m["content"] for m in messages if m["role"] == "user")
        body = {
            "system_instruction": {"parts": [{"text": told}]},
            "contents": [{"role": "user", "parts": [{"text": asked}]}],
            "generationConfig": {"temperature": self.temperature},
        }
        url = f"{_setting(self.url_variable).rstrip('/')}/{self.model}:generateContent"
        found = _post(url, body, {"X-Api-Key": _setting(self.key_variable), "Idempotency-Key": key}, self.timeout)
        parts = [p.get("text", "") for c in found.get("candidates", [])[:1] for p in c.get("content", {}).get("parts", [])]
        return "".join(parts) or None


#: Clients by the beginning of a model's name; add to it to offer more.
CLIENTS: dict[str, Callable[[str], Client]] = {
    "offline": lambda model: ReplacingClient(),
    "chat/": lambda model: HttpChatClient(model.removeprefix("chat/")),
    "generate/": lambda model: HttpGenerateClient(model.removeprefix("generate/")),
}


def client_for(model: str) -> Client | None:
    """The client of a model, by the longest name in CLIENTS that the model begins with; None if there is none."""
    names = [n for n in CLIENTS if model.startswith(n)]
    return CLIENTS[max(names, key=len)](model) if names else None


@dataclass
class Pace:
    """Calls of wait() return at least 60 / per_minute seconds apart."""

    per_minute: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float = float("-inf")

    def wait(self) -> None:
        if (rest := self.last + 60 / self.per_minute - self.clock()) > 0:
            self.sleep(rest)
        self.last = self.clock()


def with_retries(call: Callable[[], str | None], attempts: int = 3, waits: Callable[[int], float] = lambda k: 5 + 3 * k, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(answer, error) of the first call that answers; errors and empty answers count as attempts."""
    error = "no answer"
    for k in range(attempts):
        try:
            if answer := call():
                return answer, None
            error = "empty answer"
        except Exception as e:  # noqa: BLE001 - any failure of a service is retried, then recorded
            error = f"{type(e).__name__}: {e}"
        if k + 1 < attempts:
            sleep(waits(k))
    return None, error


def has_context(target: Column, context: Column) -> Column:
    """A context that isn't empty and differs from the target beyond white space at the ends."""
    return (F.coalesce(context, F.lit("")) != "") & (X.strip(context) != X.strip(target))


def reference_block(target: Column, context: Column, reference: Column) -> Column:
    """The marked reference, then the marked context if there is a use for it; each may be missing."""
    ref = F.when(F.coalesce(reference, F.lit("")) != "", F.concat(F.lit("<reference>\n"), reference, F.lit("\n</reference>"))).otherwise("")
    con = F.when(has_context(target, context), F.concat(F.lit("\n<context>\n"), context, F.lit("\n</context>"))).otherwise("")
    return F.concat(ref, con)


def file_reference_block(context: Column, reference: Column) -> Column:
    """The same for whole files: reference, an empty line, context; what is empty has no marks."""
    ref = F.when(F.coalesce(reference, F.lit("")) != "", F.concat(F.lit("<reference>\n"), reference, F.lit("\n</reference>"))).otherwise("")
    con = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("<context>\n"), context, F.lit("\n</context>"))).otherwise("")
    return F.concat(ref, F.lit("\n\n"), con)


def target_block(target: Column) -> Column:
    return F.concat(F.lit("<target>\n"), target, F.lit("\n</target>"))


def messages(content: Column, reference: Column, prompt: str = PROMPT) -> Column:
    """Chat turns: system, then the reference as a turn of its own if there is one, then the content."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    head = F.array(turn("system", F.lit(prompt)))
    ref = F.when(F.coalesce(reference, F.lit("")) != "", F.array(turn("assistant", F.lit("")), turn("user", reference))).otherwise(
        F.array().cast("array<struct<role:string,content:string>>")
    )
    return F.concat(head, ref, F.array(turn("assistant", F.lit("")), turn("user", content)))


def strip_marks(answer: Column) -> Column:
    """Without the target marks that a model may repeat."""
    return F.replace(F.replace(answer, F.lit("\n</target>"), F.lit("")), F.lit("<target>\n"), F.lit(""))


def latest(results: DataFrame) -> DataFrame:
    """(doc_id, seg_no, output): the last output of each segment that has one."""
    return results.where("output is not null").groupBy("doc_id", "seg_no").agg(F.max_by("output", "at").alias("output"))


def pending(segments: DataFrame, results: DataFrame, start: int | list[int] = 1, stop: int | None = None) -> DataFrame:
    """Segments without an output, of the numbers start to stop (from 1, both included) or of those in a list."""
    numbers = [start] if isinstance(start, int) else start
    if any(n < 1 for n in numbers):
        raise ValueError("segments are numbered from 1")
    if isinstance(start, int):
        chosen = segments.where(F.col("seg_no") >= start - 1)
        chosen = chosen if stop is None else chosen.where(F.col("seg_no") <= stop - 1)
    else:
        chosen = segments.where(F.col("seg_no").isin([n - 1 for n in set(start)]))
    return chosen.join(results.where("output is not null").select("doc_id", "seg_no"), ["doc_id", "seg_no"], "left_anti").select(segments.columns)


def prompts(segments: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """(doc_id, seg_no, messages, key) of each segment."""
    content = target_block(F.col("target"))
    reference = reference_block(F.col("target"), F.col("context"), F.col("reference"))
    return segments.select("doc_id", "seg_no", messages(content, reference, prompt).alias("messages")).withColumn("key", F.sha2(F.to_json("messages"), 256))


def revise(segments: DataFrame, client: Client, per_minute: float = 15, max_concurrent: int = 3, prompt: str = PROMPT, attempts: int | None = None, retry_wait: Callable[[int], float] | None = None) -> DataFrame:
    """Results of the segments. max_concurrent tasks call the service, each at its share of per_minute.

    A segment that fails gets an error and no output; it stays pending. Write the
    result once; computing it again calls the service again. Attempts and waits between
    them are the client's own, or 3 and 5, 8 seconds, unless they are given.
    """
    attempts = attempts or getattr(client, "attempts", 3)
    retry_wait = retry_wait or getattr(client, "wait_after", lambda k: 5 + 3 * k)
    spread = prompts(segments, prompt)
    return _answered(_called(spread, client, per_minute, max_concurrent, attempts, retry_wait), client)


def _called(asked: DataFrame, client: Client, per_minute: float, max_concurrent: int, attempts: int, retry_wait: Callable[[int], float]) -> DataFrame:
    """RESULT rows of (doc_id, seg_no, messages, key)."""
    pace, names = per_minute / max_concurrent, ["doc_id", "seg_no", "output", "error", "at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = Pace(pace)
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                turns = [{"role": m["role"], "content": m["content"]} for m in row.messages]

                def call(turns=turns, key=row.key) -> str | None:
                    limit.wait()
                    return client.revise(turns, key)

                output, error = with_retries(call, attempts, retry_wait)
                rows.append((str(row.doc_id), row.seg_no, output, error, pd.Timestamp.now("UTC")))
                if len(rows) == 64:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    spread = asked.select(F.col("doc_id").cast("string").alias("doc_id"), "seg_no", "messages", "key").repartition(max_concurrent)
    return spread.mapInPandas(run, RESULT)


def _answered(results: DataFrame, client: Client) -> DataFrame:
    return results.withColumn("output", strip_marks(F.col("output"))) if getattr(client, "strips_marks", True) else results


def revise_pending(segments: DataFrame, results_path: str, client: Client, start: int | list[int] = 1, stop: int | None = None, **options) -> DataFrame:
    """Revise what has no output yet, append the results to the Parquet folder and return all results."""
    spark = segments.sparkSession
    try:
        done = spark.read.schema(RESULT).parquet(results_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = spark.createDataFrame([], RESULT)
    revise(pending(segments, done, start, stop), client, **options).write.mode("append").parquet(results_path)
    return spark.read.schema(RESULT).parquet(results_path)


def revise_whole(docs: DataFrame, client: Client, **options) -> DataFrame:
    """Results for whole texts (doc_id, text), each as one segment."""
    none = F.lit(None).cast("string")
    return revise(docs.select("doc_id", F.lit(0).alias("seg_no"), F.col("text").alias("target"), none.alias("context"), none.alias("reference")), client, **options)


def revise_triples(triples: DataFrame, client: Client, per_minute: float = 15, max_concurrent: int = 3, prompt: str = PROMPT) -> DataFrame:
    """Results for whole files with context and reference: rows (doc_id, target, context, reference) of read_triples, each one call."""
    asked = triples.select(
        "doc_id", F.lit(0).alias("seg_no"), messages(target_block(F.col("target")), file_reference_block(F.col("context"), F.col("reference")), prompt).alias("messages")
    ).withColumn("key", F.sha2(F.to_json("messages"), 256))
    waits = getattr(client, "wait_after", lambda k: 5 + 3 * k)
    return _answered(_called(asked, client, per_minute, max_concurrent, getattr(client, "attempts", 3), waits), client)


def write_outputs(results: DataFrame, folder: str, suffix: str = ".revised.md") -> None:
    """One file for each document that has an answer, after the call; what failed leaves the file that was there as it is."""
    write_documents(results.where("coalesce(output, '') <> ''").select("doc_id", F.col("output").alias("text")), folder, suffix)


def revise_file(spark: SparkSession, target: str, folder: str, client: Client, context: str | None = None, reference: str | None = None, **options) -> DataFrame:
    """Read one file and its optional companions, revise it in one call, write the answer into the folder; the result rows."""
    alone = context is None and reference is None
    results = revise_whole(read_documents(spark, target), client, **options) if alone else revise_triples(read_triples(spark, target, context, reference), client, **options)
    kept = spark.createDataFrame(results.collect(), RESULT)  # one row; so the service is called once
    write_outputs(kept, folder)
    return kept
