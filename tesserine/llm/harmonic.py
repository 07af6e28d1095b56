"""Harmonic packing of documents into sequences, each worker by itself.

Lengths belong to reciprocal-capacity classes: class k holds lengths from
``capacity`` / k on (and below ``capacity`` / (k - 1)), and a bin of class k takes
exactly k pieces. Since documents may be cut, a piece is cut to the length of its
slot, the k slots of a bin being as equal as whole tokens allow and filling it to
the last one; what is left of the document belongs to a later class, and so on.
Lengths below the last class share bins that are filled one after another. So every
bin that closes is full, and which bin a piece goes to is up to the pieces before
it in the same partition alone: nothing is shuffled, and a worker holds one open
bin for each class.

The bins that a partition leaves open are dissolved at its end. Their pieces, end
to end, fill whole bins again, and what remains becomes bins of falling powers of
two, which need no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, stored, texts
from .tokens import TEXT_BYTES, encoder

CAPACITY, END_ID, PAD_ID = 2048, 1, 0
#: Classes by count; shorter lengths share the bins that are filled one after another.
CLASSES = 32
#: Low bits of a sequence id count within a partition.
_COUNTED = 33

#: (id of the document, start, ids as bytes, tokens of the document)
Piece = tuple[Any, int, bytes, int]


class Bins:
    """The open bins of one worker. ``add`` and ``close`` give the bins that are done, each a list of pieces."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes = capacity, classes
        self.open: list[list[Piece]] = [[] for _ in range(classes + 1)]
        self.used = 0  # tokens in the bin of what is shorter than any class

    def add(self, doc: Any, ids: bytes) -> Iterator[list[Piece]]:
        n, at = len(ids) // 4, 0
        while at < n:
            k = -(-self.capacity // (n - at))
            if k <= self.classes:
                slot, last = len(self.open[k]), k
                take = (slot + 1) * self.capacity // k - slot * self.capacity // k
                full = slot + 1 == last
            else:
                k, take = 0, min(n - at, self.capacity - self.used)
                self.used = (self.used + take) % self.capacity
                full = not self.used
            self.open[k].append((doc, at, ids[4 * at : 4 * (at + take)], n))
            at += take
            if full:
                done, self.open[k] = self.open[k], []
                yield done

    def close(self) -> Iterator[list[Piece]]:
        """Dissolve what is open: whole bins as long as they fill, then one of each power of two in what is left."""
        left = list(chain.from_iterable(self.open))[::-1]
        total = sum(len(p[2]) // 4 for p in left)
        self.open, self.used = [[] for _ in self.open], 0
        while total:
            room = size = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= size
            done = []
            while room:
                doc, start, ids, n = left.pop()
                if len(ids) > 4 * room:
                    left.append((doc, start + room, ids[4 * room :], n))
                    ids = ids[: 4 * room]
                done.append((doc, start, ids, n))
                room -= len(ids) // 4
            yield done


def _checked(capacity: int, classes: int) -> None:
    if capacity < 1 or classes < 1:
        raise ValueError("capacity and classes must be at least 1")


def _bins(batches: Iterator[pa.RecordBatch], path: str | None, end: bytes, bins: Bins) -> Iterator[tuple[int, list[Piece]]]:
    """(sequence id, its pieces)"""
    known, number = encoder("word", path), TaskContext.get().partitionId() << _COUNTED
    for batch in small_batches(batches, "text", TEXT_BYTES):
        for doc, found in zip(batch.column("doc_id").to_pylist(), known.encode(texts(batch.column("text"))), strict=True):
            for done in bins.add(doc, found + end):
                yield number, done
                number += 1
    for done in bins.close():
        yield number, done
        number += 1


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, classes: int = CLASSES, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    start: the document's ids before the piece; doc_tokens: all of them, with the end
    id. Each id lies in exactly one piece, and the pieces of a sequence lie gapless
    from offset 0. A sequence has ``capacity`` tokens or a smaller power of two. The result is
    stored, as ids of sequences are up to the order of rows in a partition. Null and empty
    texts are the end id alone. Very long texts are cut like any other. Repeated rows and null ids are
    documents of their own; lengths that tie go in the order of rows. An empty table gives no rows. Other columns,
    whatever their names, have no effect.
    """
    _checked(capacity, classes)
    source, end = _source(docs, id_col, text_col), np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    shape = source.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in names[1:7]), *([F.lit(b"").alias("ids")] if with_ids else []))

    kinds = [to_arrow_type(shape.schema["doc_id"].dataType), *[pa.int64()] * 6, pa.binary()]

    def table(found: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array(x, type=k) for x, k in zip(zip(*found, strict=True), kinds, strict=False)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for number, pieces in _bins(batches, path, end, Bins(capacity, classes)):
            offset = 0
            for doc, start, part, n in pieces:
                found.append((doc, start, len(part) // 4, zlib.crc32(part), n, number, offset, *([part] if with_ids else [])))
                offset += len(part) // 4
            if len(found) >= 5_000:
                yield table(found)
                found = []
        if found:
            yield table(found)

    return stored(source.mapInArrow(run, shape.schema), "harmonic")


def sequences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, classes: int = CLASSES, end_id: int = END_ID, pad_id: int = PAD_ID, pad: bool = False, path: str | None = None) -> DataFrame:
    """One row per sequence: sequence_id, length, documents (long, pieces in it), ids (binary, little-endian unsigned 32-bit).

    The same sequences as of ``pack_documents``, written by the worker that fills them. pad: fill
    those shorter than ``capacity`` with ``pad_id`` up to it; length counts tokens without padding.
    """
    _checked(capacity, classes)
    source, end = _source(docs, id_col, text_col), np.array([end_id], dtype="<u4").tobytes()
    fill = np.array([pad_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, pieces in _bins(batches, path, end, Bins(capacity, classes)):
            ids = b"".join(p[2] for p in pieces)
            n = len(ids) // 4
            ids += fill * (capacity - n if pad else 0)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n]), pa.array([len(pieces)]), pa.array([ids], pa.binary())], names=["sequence_id", "length", "documents", "ids"])

    return stored(source.mapInArrow(run, "sequence_id long, length long, documents long, ids binary"), "sequences")
