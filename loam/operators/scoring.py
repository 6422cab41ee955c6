"""Scores from a remote decision model: batching, limits, retries, a content-addressed cache.

Rows that the cache answers never reach the network; the others are asked from Arrow batches inside
the tasks. The cluster-wide rate is the per-task rate times the number of tasks, which the caller
sets with ``tasks``.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statuses worth another try, and the size of a request.
RETRIED = frozenset({408, 429, 500, 502, 503, 504, 529})
MAX_REQUEST_TOKENS = 64_000
PRICE_PER_MILLION = 0.042

Transport = Callable[[dict[str, Any]], tuple[int, dict[str, str], dict[str, Any]]]


class RequestTooLarge(ValueError):
    """A question with its text exceeds what one request may hold."""


def cache_key(model: str, state: Any, questions: dict[str, Any]) -> str:
    """Digest of the compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps({"m": model, "s": state, "q": questions}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@dataclass
class Bucket:
    """Token bucket of one task: requests and tokens a second; a refusal empties it."""

    rate: float
    clock: Callable[[], float] = time.monotonic
    level: float = field(init=False)
    at: float = field(init=False)
    lock: Any = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.level, self.at, self.lock = self.rate, self.clock(), Lock()

    def wait_for(self, amount: float) -> float:
        """Take ``amount`` and tell how long to wait before using it."""
        with self.lock:
            now = self.clock()
            self.level = min(self.rate, self.level + (now - self.at) * self.rate) - amount
            self.at = now
            return max(0.0, -self.level / self.rate)

    def drain(self) -> None:
        self.level = min(self.level, 0.0)


@dataclass(frozen=True)
class Client:
    """Where to send questions and how often; ``transport`` returns (status, headers, body)."""

    model: str
    transport: Transport
    requests_per_second: float = 30.0
    tokens_per_second: float = 80_000.0
    retries: int = 5

    def ask(self, state: Any, questions: dict[str, Any], requests: Bucket, tokens: Bucket, sleep: Callable[[float], None] = time.sleep) -> dict[str, Any]:
        body = {"model": self.model, "state": state, "questions": questions}
        size = len(json.dumps(body)) // 3 + 8
        if size > MAX_REQUEST_TOKENS:
            raise RequestTooLarge(f"{size} tokens in one request")
        for attempt in range(self.retries + 1):
            sleep(max(requests.wait_for(1), tokens.wait_for(size)))
            try:
                status, headers, answer = self.transport(body)
            except (OSError, TimeoutError) as error:  # a broken connection or a time-out is worth another try
                if attempt == self.retries:
                    raise ConnectionError(str(error)) from error
                status, headers, answer = None, {}, {}
            if status == 200:
                missing = set(questions) - set(answer.get("answers", {}))
                if missing:
                    raise ValueError(f"no answer to {sorted(missing)}")
                return answer["answers"]
            if status is not None and (status not in RETRIED or attempt == self.retries):
                raise ConnectionError(f"status {status}")
            if status == 429:
                requests.drain()
            sleep(float(headers.get("retry-after", min(2.0**attempt, 30.0))))
        raise ConnectionError("no answer")


def http_transport(url: str, key: str = "", timeout: float = 60.0) -> Transport:
    """Requests over HTTP with the standard library; every answer of the server is a status, only broken connections are raised."""

    def send(body: dict[str, Any]) -> tuple[int, dict[str, str], dict[str, Any]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(url, json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return reply.status, {k.lower(): v for k, v in reply.headers.items()}, json.loads(reply.read())
        except urllib.error.HTTPError as error:
            return error.code, {k.lower(): v for k, v in error.headers.items()}, {}

    return send


def score_rows(rows: DataFrame, client: Client, questions: dict[str, Any], state: str = "state", tasks: int = 8, at_once: int = 8) -> DataFrame:
    """Add ``answers`` (JSON) and ``error`` to distinct states; errors stay in their row.

    ``tasks`` partitions ask, each ``at_once`` requests at a time under its share of the rates; what comes before keeps its own parallelism.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        requests, tokens = Bucket(client.requests_per_second / tasks), Bucket(client.tokens_per_second / tasks)

        def one(text: str) -> tuple[str | None, str | None]:
            try:
                return json.dumps(client.ask(text, questions, requests, tokens)), None
            except Exception as error:
                return None, str(error)

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                done = list(pool.map(one, batch.column(state).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=[*batch.schema.names, "answers", "error"])

    shape = rows.schema.add("answers", "string").add("error", "string")
    return rows.repartition(tasks).mapInArrow(run, shape)


def with_cache(rows: DataFrame, cache: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answered rows, new cache rows): cached answers by key, the rest asked once per distinct key."""
    hits = rows.join(cache.select(key, "answers"), key).withColumn("error", F.lit(None).cast("string"))
    misses = rows.join(cache.select(key), key, "left_anti")
    fresh = ask(misses.dropDuplicates([key]))
    answered = misses.join(fresh.select(key, "answers", "error"), key, "left")
    new = fresh.filter("error IS NULL").select(key, "answers")
    return hits.unionByName(answered), new


def usage(calls: DataFrame) -> DataFrame:
    """(requests, failures, tokens, cost, p50_ms, p90_ms) of a log of calls (tokens, ms, error)."""
    from loam.operators.evaluate import nearest_rank_by

    sums = calls.agg(
        F.count(F.lit(1)).alias("requests"), F.count("error").alias("failures"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") * PRICE_PER_MILLION / 1e6, 6).alias("cost")
    )
    waits = nearest_rank_by(calls.withColumn("all", F.lit(1)), ["all"], "ms", {"p50_ms": 0.5, "p90_ms": 0.9}).drop("all", "n")
    return sums.join(F.broadcast(waits))


# ---------------------------------------------------------------- packing, reranking, answering

def pack(sizes: list[int], most_items: int = 40, budget: int = MAX_REQUEST_TOKENS // 2, overhead: int = 60) -> list[list[int]]:
    """Consecutive positions in one request: at most ``most_items``, at most ``budget``, each costing twice its size and overhead.

    One item larger than the budget gets a request of its own.
    """
    out: list[list[int]] = []
    room = 0
    for i, size in enumerate(sizes):
        cost = 2 * (size + overhead)
        if not out or len(out[-1]) == most_items or cost > room:
            out.append([])
            room = budget
        out[-1].append(i)
        room -= cost
    return out


def rerank_prompt(query: str, passages: list[str], most_chars: int = 1500) -> str:
    """What a language model is asked to score passages from 0 to 10, numbered from 1."""
    listed = "\n".join(f"[{n}] {p[:most_chars]}" for n, p in enumerate(passages, 1))
    return f'Score how well each passage answers the question, 0 to 10. Reply with JSON {{"scores": [{{"id": 1, "score": 0}}]}}.\nQuestion: {query}\n{listed}'


def answers(results: DataFrame, generate: Callable[[str, str], str], fallback: str = "The sources do not answer this.") -> DataFrame:
    """(query_id, answer) for results (query_id, text, prompt, abstain); abstaining rows never reach the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [generate(q, p) for q, p in zip(batch.column("text").to_pylist(), batch.column("prompt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(made, pa.string())], names=["query_id", "answer"])

    quiet = F.col("abstain") | F.col("prompt").isNull()
    asked = results.filter(~quiet).select("query_id", "text", "prompt")
    shape = f"query_id {results.schema['query_id'].dataType.simpleString()}, answer string"
    return asked.mapInArrow(run, shape).unionByName(results.filter(quiet).select("query_id", F.lit(fallback).alias("answer")))
