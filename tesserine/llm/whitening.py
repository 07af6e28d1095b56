"""Whitening of embeddings from exact covariances, by products of digit slices.

A vector's entries become integers x = floor(scale * c) + shift. With n distinct
vectors x and their sums S per dimension, every statistic is over the centred
integers y = n * x - S, which are exact. They are split into small limbs in base
2^16, with digits from -2^15 to 2^15 - 1, and the limbs of a block of rows are multiplied by
float64 BLAS: no sum of products of a block reaches 2^53, so each is an exact
integer. Limb products are recombined as big integers, partitions' matrices are added
up a tree, and the covariance is rounded once, before its eigenvectors are taken.
Eigenvalues are measured along these in the exact matrix.

What passes through the driver is a matrix of dimensions by dimensions, never a row of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Bits of a limb, and rows of a block: 30 bits of a product and 12 of their number stay below 2^53.
LIMB_BITS, BLOCK = 16, 4096
#: Partitions whose matrices meet in one sum, and bytes of an integer on its way there.
FAN_IN, WIDTH = 32, 32
#: Scaled entries from here on can't become longs.
_WIDEST = float(1 << 62)
#: A component has at least this share of the largest eigenvalue; less can't be told from none in double precision.
_LEAST = 1e-13


def integer_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x (array of long) of the rows whose vector is neither null nor empty and whose entries are all finite.

    Entries that scaled leave the range of -2^62 to 2^62 can't become longs and count as not finite.
    """
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * scale) < _WIDEST), F.lit(False)))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fine).select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + shift).alias("x"))


def centred(x: np.ndarray, n: int, sums: np.ndarray, bound: int) -> np.ndarray:
    """n * x - S, in 64 bits where ``bound`` says that they suffice, else in Python's integers."""
    if bound < 1 << 62:
        low = sums // n  # taken off first, so that nothing on the way is much larger than what comes out
        return (x - low.astype(np.int64)) * np.int64(n) - (sums - low * n).astype(np.int64)
    return x.astype(object) * n - sums


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Digits of y in base 2^16 as float64, lowest first; y is the sum of digit * 2^(16 * place)."""
    half, base, out = 1 << (LIMB_BITS - 1), 1 << LIMB_BITS, []
    while not out or y.any():
        digit = (y + half) % base - half
        out.append(digit.astype(np.float64))
        y = (y - digit) // base
    return out


class Products:
    """Y'Y, gathered block by block."""

    def __init__(self, d: int):
        self.d, self.sums = d, {}

    def add(self, y: np.ndarray) -> None:
        for at in range(0, len(y), BLOCK):
            parts = limbs(y[at : at + BLOCK])
            for i, a in enumerate(parts):
                for j, b in enumerate(parts[: i + 1]):
                    exact = (a.T @ b).astype(np.int64)  # below 2^42: 2^21 blocks keep to 64 bits
                    self.sums[i, j] = self.sums[i, j] + exact if (i, j) in self.sums else exact

    def total(self) -> np.ndarray:
        """The matrix in Python's integers."""
        out = np.zeros((self.d, self.d), dtype=object)
        for (i, j), p in self.sums.items():
            p = p.astype(object)
            out += (p if i == j else p + p.T) * (1 << (LIMB_BITS * (i + j)))
        return out


def _packed(values: np.ndarray) -> bytes:
    return b"".join(int(v).to_bytes(WIDTH, "little", signed=True) for v in values)


def _unpacked(data: bytes) -> np.ndarray:
    return np.array([int.from_bytes(data[i : i + WIDTH], "little", signed=True) for i in range(0, len(data), WIDTH)], dtype=object)


_PART = pa.schema([("part", pa.int32()), ("row", pa.int32()), ("v", pa.binary())])
_PART_DDL = "part int, row int, v binary"


def _summed(parts: DataFrame, name: str) -> dict[int, np.ndarray]:
    """Rows of big integers by their number, summed over parts: ``FAN_IN`` of them at a time, up a tree."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = sum(_unpacked(v) for v in t.column("v").to_pylist())
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([_packed(total)], pa.binary())], schema=_PART)

    parts = stored(parts, name)
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // FAN_IN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part", "row").applyInArrow(add, _PART_DDL)
    return {r["row"]: _unpacked(r["v"]) for r in parts.collect()}  # a row for each dimension at most


@dataclass
class Whitening:
    """n vectors with sums S, components (rows of unit eigenvectors), their eigenvalues and shares of the trace."""

    n: int
    sums: np.ndarray
    bound: int
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / self.n) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviation(self, y: np.ndarray) -> list[int]:
        exact = y if y.shape[1] * self.bound**2 < 1 << 63 else y.astype(object)
        return (exact * exact).sum(axis=1).tolist()


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def eigen(products: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components, eigenvalues and shares of the trace of V = products / n^3, products in exact integers."""
    d, cube = len(products), n**3
    trace = int(np.trace(products))
    if not trace:
        return np.zeros((0, d)), np.zeros(0), np.zeros(0)
    _, vectors = np.linalg.eigh((products / cube).astype(np.float64))
    vectors = vectors.T[::-1][:most]
    # A double times 2^60 is an integer here to all the digits that matter; the quotient is along that very vector.
    whole = np.array([[round(v * (1 << 60)) for v in row] for row in vectors.tolist()], dtype=object)
    raw, norms = ((whole @ products) * whole).sum(axis=1), (whole * whole).sum(axis=1)
    keep = [k for k in sorted(range(len(raw)), key=lambda k: -(raw[k] / norms[k])) if raw[k] / norms[k] > _LEAST * (max(raw) / norms[0])]
    values = np.array([raw[k] / (norms[k] * cube) for k in keep])
    return vectors[keep], values, np.array([raw[k] / (norms[k] * trace) for k in keep])


def fit(vectors: DataFrame, d: int, *, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors x (arrays of ``d`` longs), and these, stored. None if there are none."""
    distinct = stored(vectors.select("x").distinct(), "distinct")
    n, low, high = distinct.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not n:
        return None, distinct

    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, dtype=object)
        for _, x in _blocks(batches, d):
            total += (x - low).sum(axis=0) + low * len(x) if (high - low) * BLOCK < 1 << 62 else x.astype(object).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((TaskContext.get().partitionId(), 0, _packed(total)), _PART.types, strict=True)], schema=_PART)

    sums = _summed(distinct.mapInArrow(part_sums, _PART_DDL), "sums")[0]
    bound = max(1, n * (high - low))

    def part_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Products(d)
        for _, x in _blocks(batches, d):
            found.add(centred(x, n, sums, bound))
        if found.sums:
            total, part = found.total(), TaskContext.get().partitionId()
            for i in range(d):
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((part, i, _packed(total[i])), _PART.types, strict=True)], schema=_PART)

    found = _summed(distinct.mapInArrow(part_products, _PART_DDL), "products")
    return Whitening(n, sums, bound, *eigen(np.array([found[i] for i in range(d)], dtype=object), n, components)), distinct


def identity_error(distinct: DataFrame, d: int, made: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(made.values)
        total = np.zeros((k, k))
        for _, x in _blocks(batches, d):
            z = made.whitened(centred(x, made.n, made.sums, made.bound))
            total += z.T @ z
        a, b = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total.ravel())], names=["a", "b", "v"])

    cov = distinct.mapInArrow(run, "a int, b int, v double").groupBy("a", "b").agg((F.sum("v") / made.n).alias("v"))
    return cov.agg(F.max(F.abs(F.col("v") - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)))).first()[0] or 0.0


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS, dimensions: int | None = None) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Rows whose vector is null or empty, or holds null, non-finite or too large entries (``integer_vectors``), are left out, as are vectors
    of another length than ``dimensions``, by default the commonest length (of several, the
    largest). The fit is over distinct vectors; repeated rows are each returned. deviation is the sum of
    (n * x - S)^2 over dimensions, null beyond 38 digits. Components go by falling eigenvalue, equal ones in any order;
    those without variance (below 1e-13 of the largest, all of them where vectors are equal)
    are left out. An empty table gives no rows. Null ids are ids like any other; other columns, whatever their names, have no effect.
    """
    if components < 1:
        raise ValueError("components must be at least 1")
    vectors = integer_vectors(df, id_col=id_col, vector_col=vector_col, scale=scale, shift=shift)
    out = vectors.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")))
    if dimensions is None:
        sizes = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        if not sizes:
            return out.limit(0)
        dimensions = sizes[0]["d"]
    d = dimensions
    vectors = vectors.where(F.size("x") == d)
    made, distinct = fit(vectors, d, components=components)
    if made is None or not len(made.values):
        return out.limit(0)
    error, k = identity_error(distinct, d, made), len(made.values)
    names, most = out.columns, 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, d):
            y = centred(x, made.n, made.sums, made.bound)
            far = pa.array([Decimal(v) if v < most else None for v in made.deviation(y)], pa.decimal128(38, 0))
            m, at = len(x), pa.array(np.repeat(np.arange(len(x)), k))
            cols = [part.column("vec_id").take(at), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, made.n), far.take(at), made.whitened(y).ravel(), np.tile(made.explained, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return vectors.mapInArrow(run, out.schema)
