"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits, and each segment counts
its set bits: a point with 32 coordinates of 0 to 2. Each differing bit moves one
coordinate by one at most, so the Manhattan distance of two points is a lower
bound of the Hamming distance of their fingerprints. A count written in unary
(00, 01, 11) takes two bits, so that the Manhattan distance of whole points is the
number of differing bits of two 64-bit words.

Grid range join: if two points are within 3, then in one of the two halves of the
coordinates they are within 1. A half is the cell of a grid. Half points that are
equal meet in their own cell; of two that differ by one, exactly one has an even
sum, and it alone also goes to the cells next to its own. In a cell, the
bound over all coordinates is checked first, then the exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, rows, small_batches, stored, utf8
from .components import components, union

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: A cell with more rows is cut into chunks, and each pair of chunks is a cell of its own.
CELL = 4096
_LOW = np.uint64(0x5555555555555555)


def shingle_hashes(text: bytes, words_each: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text; of fewer words, of the whole sequence."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < words_each:
        whole = [b" ".join(words)]
    else:
        whole = list(map(b" ".join, zip(*(words[i:] for i in range(words_each)), strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, whole, repeat(seed)), dtype=np.uint64, count=len(whole))


def fingerprint(text: bytes, words_each: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if set in over half the shingle hashes; no words give 0."""
    h = shingle_hashes(text, words_each, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long); null text counts as empty."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = source.select("doc_id", F.lit(0).cast("long").alias("fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            fp = np.fromiter((fingerprint(x, words_each) for x in utf8(batch.column("text"))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return source.mapInArrow(run, out.schema)


def unary(fp: np.ndarray) -> np.ndarray:
    """The point of each fingerprint, its counts in unary: 00, 01 or 11."""
    low, high = fp & _LOW, (fp >> np.uint64(1)) & _LOW
    return low | high | ((low & high) << np.uint64(1))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def cell_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, index of the fingerprint, own) for each cell that a fingerprint goes to."""
    cells, at, own = [], [], []
    u, every = unary(fp), np.arange(len(fp))
    for half in (0, 1):
        mark = np.uint64(half << 32)
        point = (u >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        cells.append(point | mark)
        at.append(every)
        own.append(np.ones(len(fp), dtype=bool))
        even = every[popcount(point) % 2 == 0]
        p = point[even]
        for k in range(16):
            one, two = np.uint64(1 << (2 * k)), np.uint64(2 << (2 * k))
            has_one, has_two = (p & one) != 0, (p & two) != 0
            for can, step in ((~has_two & has_one, two), (has_two, two), (~has_one, one), (has_one & ~has_two, one)):
                cells.append((p[can] ^ step) | mark)
                at.append(even[can])
                own.append(np.zeros(int(can.sum()), dtype=bool))
    return np.concatenate(cells), np.concatenate(at), np.concatenate(own)


def linked(fp: np.ndarray, own: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within ``max_bits`` in one cell: a spanning forest, not all pairs.

    Each fingerprint that was reached looks for those not yet reached. A close
    group is thus reached by its first members, whatever its size.
    """
    u = unary(fp)
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = popcount(u[left] ^ u[x]) <= max_bits
            near &= popcount(fp[left] ^ fp[x]) <= max_bits
            if not own[x]:
                near &= own[left]
            if near.any():
                got = left[near]
                a.append(np.full(len(got), x))
                b.append(got)
                todo.extend(got)
                left = left[~near]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def cell_links(cell: np.ndarray, fp: np.ndarray, own: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole cells: columns sorted by cell, fingerprints unsigned."""
    n = len(cell)
    if n < 2:
        return fp[:0], fp[:0]
    order = np.lexsort((~own, cell))
    cell, fp, own = cell[order], fp[order], own[order]
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[start, n])
    out_a, out_b = [], []
    small = np.repeat(size <= 48, size)
    stop = np.repeat(start + size, size)
    u, at, lag = unary(fp), np.flatnonzero(small & own), 1
    labels = np.arange(n)
    while len(at):
        at = at[at + lag < stop[at]]  # those of a cell stand together, its own fingerprints first
        other = at + lag
        near = popcount(u[at] ^ u[other]) <= max_bits
        x, y = at[near], other[near]
        near = popcount(fp[x] ^ fp[y]) <= max_bits
        union(labels, x[near], y[near])
        lag += 1
    joined = np.flatnonzero(labels != np.arange(n))
    out_a.append(fp[joined])
    out_b.append(fp[labels[joined]])
    for i in np.flatnonzero(size > 48):
        s = slice(start[i], start[i] + size[i])
        x, y = linked(fp[s], own[s], max_bits)
        out_a.append(fp[s][x])
        out_b.append(fp[s][y])
    return np.concatenate(out_a), np.concatenate(out_b)


def fingerprint_links(distinct: DataFrame, *, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """a, b: links that join all fingerprints (column fp, distinct) within ``max_bits``, up to 3."""
    if max_bits not in (0, 1, 2, 3):
        raise ValueError("the grid serves 0 to 3 bits")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for part in range(0, len(fp), 20_000):
                f = fp[part : part + 20_000]
                c, at, own = cell_rows(f)
                yield rows(schema, [c.view(np.int64), f[at].view(np.int64), own])

    schema = pa.schema([("cell", pa.int64()), ("fp", pa.int64()), ("own", pa.bool_())])
    placed = stored(distinct.select("fp").mapInArrow(place, "cell long, fp long, own boolean"), "cells")
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("own").alias("owned")).where("n > 1 and owned > 0").select("cell", F.ceil(F.col("n") / cell).cast("int").alias("chunks"))
    met = placed.join(counts, "cell")
    # A crowded cell is dealt as pairs of chunks; most cells have one chunk and one such pair.
    own_chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    met = met.withColumn("mine", own_chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "own")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            got = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "i", "j", "fp", "own"))
            if kept:
                got = tuple(np.concatenate(x) for x in zip(kept[0], got, strict=True))
            c, i, j, fp, own = got
            if not len(c):
                continue
            new = np.r_[True, (c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            last = int(np.flatnonzero(new)[-1])  # the last cell may go on in the next batch
            kept = [tuple(x[last:] for x in got)]
            if last:
                yield links(np.cumsum(new[:last]), fp[:last], own[:last])
        if kept:
            yield links(np.zeros(len(kept[0][0]), dtype=np.int64), kept[0][3], kept[0][4])

    def links(run: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        a, b = cell_links(run, fp.view(np.uint64), own.astype(bool), max_bits)
        return rows(pa.schema([("a", pa.int64()), ("b", pa.int64())]), [a.view(np.int64), b.view(np.int64)])

    return met.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, kept.

    Texts are lower-cased in A-Z and cut into words at ASCII white space. Texts
    without words, null ones included, have fingerprint zero, which links like any
    other. component_id is the smallest id reachable over links of at most
    ``max_bits`` differing bits (null ids lose to any other); kept marks its row.
    An empty table gives no rows; repeated rows are each returned. A bit that half the shingles
    have is 0. Very long texts are hashed whole. Other columns, whatever their names, have no effect.
    """
    each = stored(fingerprints(docs, id_col=id_col, text_col=text_col, words_each=words_each), "fingerprints")
    groups = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    roots = stored(components(fingerprint_links(groups, max_bits=max_bits)), "roots")
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "component_id")
    return each.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the smallest id; all columns stay, whatever their names.

    Null ids come after any other. Rows are told apart by a key of their own, so that rows
    that share an id stay or go each by its text. An empty table stays empty.
    """
    held = keyed(docs, "near_rows")
    name = F.col(f"row.`{id_col}`")
    ids = held.select(F.struct(name.isNull().alias("none"), name.alias("id"), F.col("key")).alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"))
    # Stored, so of a size that Spark then knows: if it is small, texts aren't shuffled.
    gone = stored(near_duplicates(ids, words_each=words_each, max_bits=max_bits).where(~F.col("kept")).select("doc_id.key"), "near_copies")
    return held.join(gone, "key", "left_anti").select("row.*")
