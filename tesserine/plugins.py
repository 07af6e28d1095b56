"""What a user can plug in: an embedder, a generator, a rewriter and a scorer, each with an offline stand-in."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, into: str = "embedding") -> DataFrame: ...


class Generator(Protocol):
    def generate(self, prompts: DataFrame) -> DataFrame: ...


class StreamingGenerator(Protocol):
    def stream(self, prompts: DataFrame) -> DataFrame:
        """request_id, seq, token, is_last for each prompt, as ``streaming.answers.stream_sentences`` takes them."""
        ...


class Rewriter(Protocol):
    def rewrite(self, pending: DataFrame) -> DataFrame: ...


class Scorer(Protocol):
    def score(self, df: DataFrame, prediction: str, reference: str) -> DataFrame:
        """``df`` with precision, recall and f1."""
        ...


def device(wanted: str | None = "auto") -> str:
    """The device that a model plug-in runs on, found where it runs: the one named, or the best there is."""
    name = (wanted or "auto").lower()
    if name != "auto":
        return name
    try:
        import torch
    except ImportError:
        return "cpu"
    if torch.cuda.is_available():
        return "cuda"
    mps = getattr(torch.backends, "mps", None)
    return "mps" if mps is not None and mps.is_available() else "cpu"


#: Names of number types.
DTYPES = {"float16": "float16", "fp16": "float16", "bfloat16": "bfloat16", "bf16": "bfloat16", "float32": "float32", "fp32": "float32"}


def dtype(wanted: str | None, on: str) -> str:
    """The number type of a model's weights: the one named, or half precision where that is usual."""
    name = (wanted or "auto").lower()
    if name == "auto":
        return "float16" if on == "cuda" else "float32"
    if name not in DTYPES:
        raise ValueError(f"unknown number type {wanted}")
    return DTYPES[name]


class HashEmbedder:
    """Character n-grams hashed into a unit vector: the same text always has the same vector. Blank texts are an error."""

    def __init__(self, dimensions: int = 64, n: int = 3):
        self.dimensions, self.n = dimensions, n

    def vector(self, text: str) -> list[float]:
        if not text or not text.strip():
            raise ValueError("text cannot be empty")
        padded = f" {' '.join(text.lower().split())} "
        v = np.zeros(self.dimensions)
        for i in range(max(1, len(padded) - self.n + 1)):
            h = int.from_bytes(hashlib.blake2b(padded[i : i + self.n].encode(), digest_size=8).digest(), "little")
            v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        length = float(np.sqrt(v @ v))
        if length == 0.0:
            v[0], length = 1.0, 1.0
        return (v / length).tolist()

    def embed(self, df: DataFrame, text: str, into: str = "embedding") -> DataFrame:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(self.vector)

        return df.withColumn(into, F.pandas_udf(run, "array<float>")(F.col(text)))


class EchoGenerator:
    """Answers with the first sentence of the context, or that there is none; stands in for a language model."""

    def generate(self, prompts: DataFrame) -> DataFrame:
        content = F.regexp_extract("context_block", r"(?s)content:\n(.*?)(?:\n\n\[|$)", 1)
        first = F.regexp_extract(content, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
        return prompts.withColumn("answer", F.coalesce(F.nullif(first, F.lit("")), F.nullif(content, F.lit("")), F.lit("Chưa có đủ thông tin.")))


    def stream(self, prompts: DataFrame) -> DataFrame:
        """The same answer, word by word."""
        words = F.split("answer", "(?<= )")
        each = self.generate(prompts).select(F.col("query_id").alias("request_id"), F.posexplode(words).alias("seq", "token"), F.size(words).alias("n"))
        return each.select("request_id", F.col("seq").cast("long").alias("seq"), "token", (F.col("seq") == F.col("n") - 1).alias("is_last"))


def _together(tasks: int) -> tuple[int, float]:
    """(number of this task, a moment that all tasks of its barrier stage agree on)."""
    if tasks == 1:
        return 0, time.time()
    context = BarrierTaskContext.get()
    return context.partitionId(), max(map(float, context.allGather(str(time.time()))))


class CallGenerator:
    """Answers prompts by ``ask``, a call from prompt to answer that ``connect`` makes once on each task.

    tasks: how many there are; profile: the resources of each, for a model that needs a whole executor's. A generator ``in_turn`` answers
    one prompt at a time over all tasks: each keeps its prompts and waits for those before it to be done.
    """

    def __init__(self, connect: Callable[[], Callable[[str], str]], *, tasks: int = 2, profile: ResourceProfile | None = None, turns: bool = False):
        if tasks < 1:
            raise ValueError("tasks must be positive")
        self.connect, self.tasks, self.profile, self.turns = connect, tasks, profile, turns

    def in_turn(self) -> CallGenerator:
        return CallGenerator(self.connect, tasks=self.tasks, profile=self.profile, turns=True)

    def generate(self, prompts: DataFrame) -> DataFrame:
        connect, turns, tasks = self.connect, self.turns and self.tasks > 1, self.tasks

        def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = connect()
            for frame in frames:
                yield frame.assign(answer=[ask(x or "") for x in frame["prompt"]])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if not turns:
                yield from answers(frames)
                return
            mine, _ = _together(tasks)
            for turn in range(tasks):
                if turn == mine:
                    yield from answers(frames)
                BarrierTaskContext.get().barrier()

        return prompts.repartition(tasks).mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType())]), barrier=turns, profile=self.profile)


class BatchRewriter:
    """Asks ``ask`` for the rewrites of a few rows at a time; what it fails at after all tries has none, and is asked again in the next run.

    ask: rows (keyword, vision_caption, question and their index) to {index: rewrite}. It is made on
    each executor by ``connect``, so that no client or key is part of a plan; None where there is no key.
    pause: seconds between two requests of all ``tasks`` together, tries included. Several tasks run as a barrier stage, all at once,
    which takes as many free slots: they agree on a moment and each has every so many-th turn from there.
    """

    def __init__(self, connect: Callable[[], Callable[[list[dict]], dict[int, str]] | None], *, size: int = 20, tries: int = 2, wait: float = 1.0, pause: float = 7.0, tasks: int = 1):
        if size < 1 or tries < 1 or tasks < 1:
            raise ValueError("size, tries and tasks must be positive")
        self.connect, self.size, self.tries, self.wait, self.pause, self.tasks = connect, size, tries, wait, pause, tasks

    def _turns(self) -> Callable[[], None]:
        """What waits for the next turn of this task: moments that are ``pause`` apart go to the tasks one after another."""
        mine, start = _together(self.tasks)
        every, last, first = self.pause * self.tasks, -1, None

        def wait() -> None:
            nonlocal last, first
            if not every:
                return
            if first is None:  # a task alone begins at once, several when all have had time to come so far
                first = time.time() if self.tasks == 1 else start + 1.0 + self.pause * mine
            last = max(last + 1, math.ceil((time.time() - first) / every - 1e-3))
            time.sleep(max(0.0, first + last * every - time.time()))

        return wait

    def _asked(self, ask: Callable[[list[dict]], dict[int, str]], items: list[dict], turn: Callable[[], None]) -> dict[int, str]:
        for left in reversed(range(self.tries)):
            turn()
            try:
                return ask(items)
            except Exception:  # noqa: BLE001 - whatever a client raises
                if left:
                    time.sleep(self.wait)
        return {}

    def rewrite(self, pending: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask, turn = self.connect(), self._turns()
            for frame in frames:
                for at in range(0, len(frame), self.size):
                    part = frame.iloc[at : at + self.size]
                    rows = part[["keyword", "vision_caption", "question"]].fillna("").map(lambda x: str(x).strip()).to_dict("records")
                    found = self._asked(ask, [{"index": i} | row for i, row in enumerate(rows)], turn) if ask is not None else {}
                    yield part[["row_index"]].assign(standalone_question=[found.get(i) for i in range(len(part))])

        return pending.repartition(self.tasks).mapInPandas(run, "row_index long, standalone_question string", barrier=self.tasks > 1)


class GreedyMatchScorer:
    """Each word with the most alike of the other text's words, by the vectors of ``embedder``; with a model's vectors, its usual greedy score."""

    def __init__(self, embedder: HashEmbedder | None = None):
        self.embedder = embedder or HashEmbedder(256)
        self.known: dict[str, list[float]] = {}

    def _vectors(self, words: list[str]) -> np.ndarray:
        """Each word is embedded once a task, of some ten thousand words held."""
        if len(self.known) > 20_000:
            self.known.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = self.embedder.vector(w)
        return np.array([self.known[w] for w in words])

    def of(self, prediction: str | None, reference: str | None) -> tuple[float, float, float]:
        """(precision, recall, f1); a text without words scores 0."""
        a, b = ((x or "").split() for x in (prediction, reference))
        if not a or not b:
            return 0.0, 0.0, 0.0
        alike = self._vectors(a) @ self._vectors(b).T
        p, r = float(alike.max(axis=1).mean()), float(alike.max(axis=0).mean())
        return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0

    def score(self, df: DataFrame, prediction: str, reference: str) -> DataFrame:
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for x, y in batches:
                yield pd.DataFrame([self.of(*pair) for pair in zip(x, y, strict=True)], columns=["precision", "recall", "f1"])

        return df.withColumn("_s", F.pandas_udf(run, "precision double, recall double, f1 double")(prediction, reference)).select(*df.columns, "_s.*")


class KeywordRewriter:
    """Puts the keyword before the question; stands in for a language model."""

    def rewrite(self, pending: DataFrame) -> DataFrame:
        return pending.withColumn("standalone_question", F.concat_ws(": ", "keyword", "question"))
