"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors become one, with their number. Vectors are scaled to unit length and
turned onto principal axes, the axis of most variance first. Tiles are boxes: a
sample is halved again and again across the leading axis on which it is widest, and a vector is at
home in the box whose side of each cut it is on. Two tiles meet with those of their vectors
that aren't farther from the other box, on the cut axes, than vectors at the threshold can
be; boxes that no link can join never meet.

Two vectors in a tile are compared by adding up products of the leading
axes; what the rest can still add is at most the product of the two suffix norms
(Cauchy-Schwarz), and a pair stops as soon as that can't reach the threshold. What
is left is measured in the vectors as given, in double precision. The axes and the cuts
only decide how early pairs stop, never which pairs are links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components, union

THRESHOLD = 0.9
#: Numbers in a tile (its rows by their length; two tiles are in memory at once), rows of a block within it, and vectors that fit axes and cuts.
TILE_CELLS, BLOCK, FIT = 1 << 20, 512, 4096
#: Axes that may be cut, and the most tasks that tiles meet in; beyond that, a task has several meetings, one after another.
CUT_AXES, TASKS = 16, 20_000
_SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors as columns, most variance first."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(vectors[:, ::-1])


def stops(dim: int) -> list[int]:
    """How many leading axes are added up before each test."""
    return sorted({min(dim, max(1, dim * k // 8)) for k in (2, 4, 6)}) if dim > 8 else [dim]


def compare(u: np.ndarray, r: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float = THRESHOLD, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of first, j of second, as rows of u) with cosine >= threshold, block by block.

    u: unit vectors; r: the same on the axes. If first is second, each pair comes
    once and none of a row with itself.
    """
    same, dim = first is second, u.shape[1]
    cuts = stops(dim)
    square = np.cumsum(r[:, ::-1] ** 2, axis=1)[:, ::-1]
    suffix = {k: np.sqrt(square[:, k]) if k < dim else np.zeros(len(r)) for k in cuts}
    far = np.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
    first = first[np.argsort(r[first, 0], kind="stable")]
    second = first if same else second[np.argsort(r[second, 0], kind="stable")]
    for s in range(0, len(first), block):
        i = first[s : s + block]
        for t in range(s if same else 0, len(second), block):
            j = second[t : t + block]
            if r[j[0], 0] - r[i[-1], 0] > far or r[i[0], 0] - r[j[-1], 0] > far:
                continue  # apart on the leading axis alone
            x, y = _survivors(r, suffix, cuts, i, j, threshold)
            if same and s == t:
                x, y = x[x < y], y[x < y]
            if len(x):
                near = _cosines(u, i, j, x, y) >= threshold
                if near.any():
                    yield i[x[near]], j[y[near]]


def _survivors(r: np.ndarray, suffix: dict, cuts: list[int], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    k = cuts[0]
    at, total = 0, None
    for k in cuts:
        more = r[i, at:k] @ r[j, at:k].T
        total = more if total is None else total + more
        left = total + np.outer(suffix[k][i], suffix[k][j]) >= threshold - _SLACK
        found = np.count_nonzero(left)
        if not found or found < left.size // 64 or k == cuts[-1]:
            break
        at = k
    x, y = np.nonzero(left)
    if len(x) and k < cuts[-1] and len(x) < left.size // 64:
        part = total[x, y]
        for at, to in zip(cuts, cuts[1:], strict=False):
            if at < k:
                continue
            part = part + np.einsum("ij,ij->i", r[i[x], at:to], r[j[y], at:to])
            keep = part + suffix[to][i[x]] * suffix[to][j[y]] >= threshold - _SLACK
            x, y, part = x[keep], y[keep], part[keep]
    return x, y


def _cosines(u: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if len(x) > len(i) * len(j) // 32:
        return (u[i] @ u[j].T)[x, y]
    return np.einsum("ij,ij->i", u[i[x]], u[j[y]])


class Cuts:
    """Boxes of the space of leading axes: a binary tree of cuts across axes."""

    def __init__(self, sample: np.ndarray, boxes: int, least: int = 16):
        """sample: turned vectors; at most ``boxes`` boxes, none of which is cut that has fewer than twice ``least`` of the sample."""
        #: Of each node its axis and place of the cut and its children; or of a box only its number.
        self.nodes: list[tuple] = [()]
        open_, self.boxes = [(0, sample[:, :CUT_AXES])], 1
        while open_:
            k, part = open_.pop(0)
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if len(part) else 0
            at = float(np.median(part[:, axis])) if len(part) else 0.0
            low = part[:, axis] < at if len(part) else np.zeros(0, dtype=bool)
            if self.boxes >= boxes or len(part) < 2 * least or not low.any():
                continue
            children = len(self.nodes), len(self.nodes) + 1
            self.nodes[k] = axis, at, children
            self.nodes += [(), ()]
            open_ += [(children[0], part[low]), (children[1], part[~low])]
            self.boxes += 1
        leaves = [k for k, node in enumerate(self.nodes) if not node]
        for number, k in enumerate(leaves):
            self.nodes[k] = (number,)

    def near(self, r: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each turned vector's own box; and, as pairs (row, box), the boxes within ``far`` of it, its own included."""
        own, at, boxes = np.zeros(len(r), dtype=np.int64), [], []
        gap = np.zeros((len(r), min(CUT_AXES, r.shape[1])))
        todo = [(0, np.arange(len(r)), gap, np.ones(len(r), dtype=bool))]
        while todo:
            k, rows, gap, home = todo.pop()
            if len(self.nodes[k]) == 1:
                own[rows[home]] = self.nodes[k][0]
                at.append(rows)
                boxes.append(np.full(len(rows), self.nodes[k][0], dtype=np.int64))
                continue
            axis, place, children = self.nodes[k]
            off = r[rows, axis] - place
            for child, beyond, side in ((children[0], np.maximum(off, 0), off < 0), (children[1], np.maximum(-off, 0), off >= 0)):
                wide = gap.copy()
                wide[:, axis] = np.maximum(wide[:, axis], beyond)
                here = np.einsum("ij,ij->i", wide, wide) <= far * far
                if here.any():
                    todo.append((child, rows[here], wide[here], (home & side)[here]))
        return own, np.concatenate(at), np.concatenate(boxes)


def tile_links(weight: np.ndarray, u: np.ndarray, r: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each row links with, and each row's root among rows linked here."""
    count, labels = np.zeros(len(u)), np.arange(len(u))
    for i, j in compare(u, r, first, second, threshold):
        count += np.bincount(i, weights=weight[j], minlength=len(u)) + np.bincount(j, weights=weight[i], minlength=len(u))
        union(labels, i, j)
    return count.astype(np.int64), labels


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int | None = None, fit: int = FIT) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    All rows are compared by cosine in double precision. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, and those
    of different lengths don't link with each other. component_id is the smallest
    id reachable by links (null ids lose to any other). Rows that repeat an id are
    vectors of their own, and equal vectors link with each other. Axes and cuts are fitted on
    at most ``fit`` distinct vectors, chosen by hash; this has no effect on the result. A box
    with more than ``tile`` vectors (by default what ``TILE_CELLS`` numbers make) is several
    tiles. An empty table gives no rows; other columns, whatever their names, have no effect.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    e = F.col("e")
    good = F.coalesce((F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    # Single precision is shuffled as it is and widened where it is used; anything else is widened first.
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    taken = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(kind).alias("e")).select("vec_id", F.when(good, e).alias("e"), F.monotonically_increasing_id().alias("row"))
    taken = stored(taken.withColumn("hash", F.xxhash64("e")), "vectors")
    # One row stands for all copies of a vector; each copy links with all others.
    valid = stored(taken.where("e is not null").groupBy("hash", "e").agg(F.min("row").alias("rep"), F.count("*").alias("weight")).withColumn("dim", F.size("e")), "distinct_vectors")
    sizes = {r["dim"]: r["n"] for r in valid.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one number for each length
    most = {dim: tile or max(256, TILE_CELLS // dim) for dim in sizes}
    turn: dict[int, tuple[np.ndarray, Cuts]] = {}
    for dim, part in valid.select("rep", "e", "dim").orderBy(F.xxhash64("rep"), "rep").limit(fit).toPandas().groupby("dim"):
        x = unit(np.array(part["e"].tolist(), dtype=np.float64))
        matrix = axes(x)
        turn[dim] = matrix, Cuts(x @ matrix, -(-sizes[dim] // most[dim]))
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    shared = spark.sparkContext.broadcast(turn)  # for each length among ``fit`` vectors a matrix and fewer than ``fit`` cuts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                own, near = np.zeros(len(at), dtype=np.int32), [[0]] * len(at)
                if dim in shared.value:
                    matrix, cuts = shared.value[dim]
                    x = np.asarray(part.column("e").flatten(), dtype=np.float64).reshape(len(at), dim)
                    own, rows, boxes = cuts.near(unit(x) @ matrix, far)
                    order = np.argsort(rows, kind="stable")
                    near = np.split(boxes[order], np.cumsum(np.bincount(rows, minlength=len(at)))[:-1])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("rep", "weight", "dim", "e")] + [pa.array(own, pa.int32()), pa.array(near, pa.list_(pa.int32()))], names=["rep", "weight", "dim", "e", "box", "near"])

    placed = stored(valid.select("rep", "weight", "dim", "e").mapInArrow(place, f"rep long, weight long, dim int, e {kind}, box int, near array<int>"), "boxed")
    limit = F.coalesce(*[F.when(F.col("dim") == d, F.lit(m)) for d, m in most.items()], F.lit(1)) if most else F.lit(1)
    # At most ``fit`` boxes for each length.
    boxes = stored(placed.groupBy("dim", "box").agg(F.count("*").alias("n")).select("dim", "box", F.ceil(F.col("n") / limit).cast("int").alias("chunks")), "boxes")
    mine = F.struct("box", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"))
    dealt = placed.join(boxes, ["dim", "box"]).withColumn("mine", mine).drop("box", "chunks").withColumn("box", F.explode("near")).join(boxes, ["dim", "box"])
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("other", F.struct("box", "chunk"))
    pairs = dealt.select("dim", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("is_first"), "rep", "weight", "e")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        dim, i, j = key[0].as_py(), *(tuple(x.as_py().values()) for x in key[1:])
        rows = table.column("rep").to_numpy()
        order = np.argsort(rows, kind="stable")  # the same order whatever order the rows came in
        flat = table.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        u = unit(flat.reshape(len(rows), dim)[order].astype(np.float64))
        rows, weight, is_first = (table.column(c).to_numpy()[order] for c in ("rep", "weight", "is_first"))
        r = u @ shared.value[dim][0] if dim in shared.value else u
        first = np.flatnonzero(is_first)
        count, labels = tile_links(weight, u, r, first, first if i == j else np.flatnonzero(~is_first), threshold)
        at = np.flatnonzero(count)
        return pa.table({"rep": rows[at], "n": count[at], "root": rows[labels[at]]}, schema=pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    tiles = boxes.agg(F.sum("chunks")).first()[0] or 1
    pairs = pairs.repartition(int(min(TASKS, tiles * (tiles + 1) // 2)), "dim", "i", "j")
    found = stored(pairs.groupBy("dim", "i", "j").applyInArrow(meet, "rep long, n long, root long"), "tile_links")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    linked = valid.select("hash", "e", "rep", "weight").join(found.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(roots, "rep", "left")
    linked = linked.select("hash", "e", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    each = taken.where("e is not null").join(linked, ["hash", "e"]).select("vec_id", "n_links", "root")
    alone = taken.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), (-F.col("row") - 1).alias("root"))
    rooted = stored(each.unionByName(alone), "rooted")
    least = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return rooted.join(least, "root").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def brute_force(frame: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """The same result over a small frame of finite vectors with ids, pair by pair; for tests."""
    u = unit(np.array(frame["embedding"].tolist(), dtype=np.float64))
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    ids, root = frame["vec_id"].to_numpy(), np.arange(len(frame))
    for x, y in zip(*np.nonzero(near), strict=True):
        root[root == root[x]] = root[y]
    least = {k: ids[root == k].min() for k in set(root)}
    return pd.DataFrame({"vec_id": ids, "n_links": near.sum(axis=1), "component_id": [least[k] for k in root]})
