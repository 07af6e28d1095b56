"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into
groups of bounded size, and each group packs its own by best fit, longest first.
Nearly full bins are done. The others go on as items of a single length each to
the next level, where ``fan_in`` groups meet as one, and so on up the tree until
one group is left, or until the underfull bins that are left fill groups of the
bounded size by themselves. A bin never opens again, it only joins others, so
each level is a table of (bin, bin it went to, place there).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, texts
from .tokens import TEXT_BYTES, encoder

CAPACITY, END_ID = 4096, 1
#: Items of a group, groups that meet at the next level, and free tokens with which a bin is nearly full.
GROUP, FAN_IN, SLACK = 20_000, 4, 8


def cut(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, bytes]]:
    """(piece, start, length, its ids) of a document's ids, 4 bytes each."""
    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at : at + 4 * capacity]
        yield piece, at // 4, len(part) // 4, part


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = False, forget: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit).

    Null text counts as empty: a piece of the end id alone. forget: drop a worker's words at the end of each
    task, where the memory is worth more than meeting them again.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = source.select("doc_id", F.lit(0).alias("piece"), *(F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32")), *([F.lit(b"").alias("ids")] if with_ids else []))
    names = shape.columns
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder("word", path)
        for batch in small_batches(batches, "text", TEXT_BYTES):
            at, out = [], []
            for row, ids in enumerate(known.encode(texts(batch.column("text")))):
                for piece, start, length, part in cut(ids + end, capacity):
                    at.append(row)
                    out.append((piece, start, length, zlib.crc32(part), *([part] if with_ids else [])))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = [pa.array(x, type=k) for x, k in zip(zip(*out, strict=True), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *cols], names=names)
        if forget:
            known.forget()

    return source.mapInArrow(run, shape.schema)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and place of each item (lengths longest first), and how full each bin is.

    An item goes into the bin that it leaves the least room in. Bins are listed by
    the room they have, and the bits of one integer tell which lists hold any.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    has, bins, places, fill = 0, [], [], []
    for n in lengths:
        fits = has >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                has ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins.append(b)
        places.append(fill[b])
        fill[b] += n
        if room > n:
            free[room - n].append(b)
            has |= 1 << (room - n)
    return bins, places, fill


def _fit(level: int, capacity: int) -> Callable:
    def fit(key: tuple, table: pa.Table) -> pa.Table:
        item, length, grp = table.column("item").to_numpy(), table.column("length").to_numpy(), key[0].as_py()
        order = np.lexsort((item, -length))  # the same order whatever order the rows came in
        bins, places, fill = best_fit(length[order].tolist(), capacity)
        at = np.array(bins, dtype=np.int64)
        return pa.table({"item": item[order], "bin": at + ((level << 58) | (grp << 32)), "place": pa.array(places, pa.int64()), "fill": np.array(fill, dtype=np.int64)[at], "grp": pa.array([grp] * len(item), pa.int32())})

    return fit


def pack(items: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP, fan_in: int = FAN_IN, slack: int = SLACK) -> DataFrame:
    """item, sequence_id, offset for rows (item long, unique; length 1 to ``capacity``)."""
    full = items.where(F.col("length") == capacity).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    level, rest = 0, items.where(F.col("length") < capacity).select("item", "length")
    n = rest.count()
    groups = max(1, -(-n // group))
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    placed = None
    while True:
        moved = stored(rest.groupBy("grp").applyInArrow(_fit(level, capacity), "item long, bin long, place long, fill long, grp int"), f"level{level}")
        if placed is None:
            placed = moved.select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
        else:
            up = moved.select(F.col("item").alias("sequence_id"), "bin", "place")
            placed = placed.join(up, "sequence_id", "left").select("item", F.coalesce("bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("place", F.lit(0))).alias("offset"))
        if groups == 1 or level == 15:
            return full.unionByName(placed)
        rest = moved.where(F.col("fill") < capacity - slack).groupBy("bin").agg(F.max("fill").alias("length"), F.max("grp").alias("grp")).withColumnRenamed("bin", "item")
        left = rest.count()
        # As many groups as keep to the bounded size; where that isn't fewer, all that could meet have met.
        fewer = max(-(-groups // fan_in), -(-left // group))
        if not left or fewer >= groups:
            return full.unionByName(placed)
        level, groups = level + 1, fewer
        rest = rest.select("item", "length", F.pmod(F.col("grp"), F.lit(groups)).alias("grp"))


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = False, group: int = GROUP, forget: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    Documents longer than ``capacity`` tokens (end id included) are cut into pieces
    of that size, the last maybe shorter; no other is cut. offset is the piece's
    place in its sequence, gapless from 0. Sorting by (sequence_id, offset) and
    joining ids gives the sequences. Null and empty texts are the end id alone, and very long texts are read whole. Repeated rows and null ids are pieces like
    any other; an empty table gives no rows. Of bins that an item leaves the same room in, the
    one last filled takes it. Other columns, whatever their names, have no effect.
    """
    each = pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, path=path, with_ids=with_ids, forget=forget)
    each = stored(each.withColumn("item", F.monotonically_increasing_id()), "pieces")
    return each.join(pack(each.select("item", "length"), capacity=capacity, group=group), "item").drop("item")
