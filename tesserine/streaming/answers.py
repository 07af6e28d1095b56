"""Streams of answers: tokens to clean sentences, events of a response, and their fold back into text."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X

SENTENCES = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("part", T.LongType()), T.StructField("sentence", T.StringType())])
_ENDS = ".!?。！？"


def pop_sentences(buffer: str, known: int = 0) -> tuple[str, str]:
    """(done, rest): a buffer cut after the last sentence end that white space follows. known: so many first characters have no such end among them."""
    for i in range(len(buffer) - 1, max(known, 1) - 1, -1):
        if buffer[i].isspace() and buffer[i - 1] in _ENDS:
            stop = i
            while stop < len(buffer) and buffer[stop].isspace():
                stop += 1
            return buffer[:stop], buffer[stop:]
    return "", buffer


class SentenceBuffer(StatefulProcessor):
    """Per request, the tail of its tokens that ends no sentence yet, and how many parts it has sent.

    timeout: milliseconds after its last tokens when a request's tail is sent as it is; keep: when
    what is known of a request is forgotten. Both by the clock.
    """

    def __init__(self, timeout: int | None = None, keep: int | None = None):
        self.timeout, self.keep = timeout, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "tail string, sent long", self.keep)

    def _known(self) -> tuple[str, int]:
        known = self.tail.get() if self.tail.exists() else ("", 0)
        return known[0], known[1]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tail, sent = self._known()
        tokens = pd.concat(list(rows)).sort_values("seq")
        out = []
        for token, last in zip(tokens["token"], tokens["is_last"], strict=True):
            done, tail = pop_sentences(tail + (token or ""), len(tail))
            if last:
                done, tail = done + tail, ""
            if done.strip():
                out.append((key[0], sent, done))
                sent += 1
        self.tail.update((tail, sent))
        if self.timeout is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if tail:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)
        yield pd.DataFrame(out, columns=["request_id", "part", "sentence"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tail, sent = self._known()
        out = [(key[0], sent, tail)] if tail.strip() else []
        self.tail.update(("", sent + len(out)))  # tokens that come after all go on from here
        yield pd.DataFrame(out, columns=["request_id", "part", "sentence"])

    def close(self) -> None:
        pass


def stream_sentences(tokens: DataFrame, *, timeout: float | None = None, keep: float | None = None) -> DataFrame:
    """request_id, part, sentence from a stream of (request_id, seq, token, is_last): whole sentences as they end.

    timeout: seconds without a token after which the tail of a request that never ended is sent, once; None holds it. keep: seconds
    after which nothing is known of a request any more, by default ten times the timeout; longer than it.
    Timers go off while the stream runs, with or without new tokens; after a restart, with the first new ones.
    """
    if timeout is None:
        processor, mode = SentenceBuffer(), "None"
    else:
        keep = 10 * timeout if keep is None else keep
        if not 0 < timeout < keep:
            raise ValueError("timeout must be positive and keep longer than it")
        processor, mode = SentenceBuffer(int(1000 * timeout), int(1000 * keep)), "ProcessingTime"
    return tokens.groupBy("request_id").transformWithStateInPandas(processor, outputStructType=SENTENCES, outputMode="Append", timeMode=mode)


class ShownBefore(StatefulProcessor):
    """Per request, whether a sentence was shown yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.any = handle.getValueState("any", "shown boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = pd.concat(list(rows)).sort_values("part")
        out["later"] = True
        if not self.any.exists():
            out.iloc[0, out.columns.get_loc("later")] = False
            self.any.update((True,))
        yield out[["request_id", "part", "clean", "later"]]

    def close(self) -> None:
        pass


def clean_chunks(sentences: DataFrame) -> DataFrame:
    """request_id, part, chunk_at, chunk: sanitized sentences as words to show, with a space between all but before the first that is shown.

    A sentence that nothing is left of shows nothing, so the next may be the first. Of a stream, the request's state tells.
    """
    clean = sentences.select("request_id", "part", X.sanitize_answer("sentence").alias("clean")).where("clean <> ''")
    if clean.isStreaming:
        clean = clean.groupBy("request_id").transformWithStateInPandas(ShownBefore(), outputStructType="request_id string, part long, clean string, later boolean", outputMode="Append", timeMode="None")
    else:
        clean = clean.withColumn("later", F.col("part") > F.min("part").over(W.partitionBy("request_id")))
    chunks = F.when(F.col("later"), X.display_chunks("clean", leading_space=True)).otherwise(X.display_chunks("clean"))
    return clean.select("request_id", "part", F.posexplode(chunks).alias("chunk_at", "chunk"))


def batch_sentences(tokens: DataFrame) -> DataFrame:
    """request_id, done, rest of token tables that are complete: the same cut, over whole answers."""
    whole = tokens.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda t: t["token"]), "").alias("text"))
    return whole.select("request_id", X.complete_sentences("text").alias("cut")).select("request_id", "cut.done", "cut.rest")


def response_events(answers: DataFrame, *, debug: bool = False) -> DataFrame:
    """request_id, seq, type, payload: metadata, a token for each chunk, then done; an error in place of an answer that has one.

    answers: request_id, retrieval_query, contexts (array), prompt, answer, error, seconds.
    """
    meta = F.to_json(F.struct("retrieval_query", "contexts", *(["prompt"] if debug else [])))
    chunks = F.transform(X.display_chunks("answer"), lambda c, i: F.struct((i + 1).cast("long").alias("seq"), F.lit("token").alias("type"), F.to_json(F.struct(c.alias("text"))).alias("payload")))
    after = (F.size(chunks) + 1).cast("long")
    row = lambda seq, kind, payload: F.array(F.struct(seq.alias("seq"), F.lit(kind).alias("type"), payload.alias("payload")))
    first = row(F.lit(0).cast("long"), "metadata", meta)
    good = F.concat(first, chunks, row(after, "done", F.to_json(F.struct("seconds"))))
    bad = F.concat(first, row(F.lit(1).cast("long"), "error", F.to_json(F.struct(F.col("error").alias("message")))))
    return answers.select("request_id", F.explode(F.when(F.col("error").isNotNull(), bad).otherwise(good)).alias("e")).select("request_id", "e.seq", "e.type", "e.payload")


def fold_events(events: DataFrame) -> DataFrame:
    """request_id, answer, finished, failed: tokens up to the first done or error; bad payloads are left out."""
    stop = events.where(F.col("type").isin("done", "error")).groupBy("request_id").agg(F.min("seq").alias("stop"), F.min_by("type", "seq").alias("how"))
    known = events.where("type = 'token'").join(stop, "request_id", "left").where(F.col("stop").isNull() | (F.col("seq") < F.col("stop")))
    text = known.withColumn("text", F.try_variant_get(F.try_parse_json("payload"), "$.text", "string")).where("text IS NOT NULL")
    joined = text.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]), "").alias("answer"))
    return events.select("request_id").distinct().join(joined, "request_id", "left").join(stop, "request_id", "left").select(
        "request_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce(F.col("how") == "done", F.lit(False)).alias("finished"), F.coalesce(F.col("how") == "error", F.lit(False)).alias("failed")
    )


def parse_event_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """type, payload of server-sent event lines; what isn't a data line with a JSON object is left out."""
    body = F.regexp_extract(column, r"^data:\s*(.*)$", 1)
    v = F.try_parse_json(body)
    return lines.where((body != "") & v.isNotNull()).select("*", F.try_variant_get(v, "$.type", "string").alias("type"), body.alias("payload")).where("type IS NOT NULL")


def rewrite_stream(records: DataFrame, rewrite: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], *, checkpoint: str, pause: float = 0.0):
    """Rewrite a stream of records batch by batch, each stored before the next is asked for; a restart goes on where it stopped.

    How large a stored batch is, is the source's setting (maxFilesPerTrigger); ``pause`` seconds pass after each.
    How many records a request to a model has and how often one is sent, is the rewriter's (``plugins.BatchRewriter``).
    """

    def run(df: DataFrame, i: int) -> None:
        sink(rewrite(df), i)
        time.sleep(pause)

    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
