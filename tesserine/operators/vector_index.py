"""An approximate vector index: k-means cells, residual codes and a table partitioned by cell.

A quantizer is trained on a bounded sample. Every row goes to the cell of its nearest
center, and what is left of its unit vector after the center is taken off is coded in a byte for
each few dimensions. The table has a folder for each cell, so that a search reads the
cells that its queries probe and no others. Candidates are ranked by what their codes
stand for, and the best of them by their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import sinks
from . import retrieval

#: Vectors that a quantizer is trained on, about, rounds of training, and vectors of the sample for each cell.
SAMPLE, ROUNDS, EACH = 32_768, 12, 16
#: Values of a code, dimensions that a code stands for, and cells that a search probes.
VALUES, WIDTH, PROBE = 256, 2, 8
#: The cell of rows that can't be found: null, zero or non-finite vectors.
NOWHERE = -1


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row."""
    half, out = (centers * centers).sum(axis=1) / 2, []
    for at in range(0, len(x), 2048):
        out.append(np.argmax(x[at : at + 2048] @ centers.T - half, axis=1))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def k_means(x: np.ndarray, k: int, *, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """k centers of the rows of x, or as many as there are different rows if that is less; a center without rows moves to a row far from its own."""
    rng, different = np.random.default_rng(seed), np.unique(x, axis=0)
    centers = different[rng.permutation(len(different))[:k]].copy()
    for _ in range(rounds if len(different) > k else 0):
        at = _nearest(x, centers)
        sums, n = np.zeros_like(centers), np.bincount(at, minlength=len(centers))
        np.add.at(sums, at, x)
        centers = sums / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centers[empty] = x[np.argsort(-((x - centers[at]) ** 2).sum(axis=1), kind="stable")[: len(empty)]]
    return centers


@dataclass(frozen=True)
class Quantizer:
    """Centers of cells, and for each few dimensions the values that what is left is coded by."""

    centers: np.ndarray
    books: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.centers.shape[1]

    def _cut(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        wide = np.zeros((len(x), parts * width))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), parts, width)

    def code(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        left = self._cut(x - self.centers[cell])
        return np.stack([_nearest(left[:, i], book) for i, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for: their products with a query are the sums of what each value adds to its score."""
        left = np.stack([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1).reshape(len(codes), -1)
        return self.centers[cell] + left[:, : self.dimensions]

    def closeness(self, x: np.ndarray) -> np.ndarray:
        """(rows, cells): larger the nearer a cell's center is."""
        return x @ self.centers.T - (self.centers * self.centers).sum(axis=1) / 2

    def nearest_cells(self, x: np.ndarray, probe: int | None) -> np.ndarray:
        """(rows, probe): the nearest cells of each row, in any order; None for all."""
        n = len(self.centers) if probe is None else min(probe, len(self.centers))
        return np.argpartition(-self.closeness(x), n - 1, axis=1)[:, :n].astype(np.int32)


def train(index: DataFrame, *, doc_id: str = "doc_id", vector: str = "embedding", cells: int | None = None, width: int = WIDTH, sample: int = SAMPLE, seed: int = 0) -> Quantizer:
    """A quantizer from about ``sample`` vectors, chosen by a hash of their ids, and never twice as many. cells: by default the square root of the number of rows, and a cell for each 16 vectors of the sample at most."""
    known = index.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(doc_id, F.col(vector).cast("array<double>").alias("v"))
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 31)) < int(share * (1 << 31))).limit(2 * sample).select(F.col(doc_id).alias("id"), "v").orderBy("id").toArrow()
    if not len(chosen):
        raise ValueError("there are no vectors to train on")
    x = retrieval.unit_rows(chosen)
    x = x[np.isfinite(x).all(axis=1)]
    if not len(x):
        raise ValueError("no vector has a direction")
    centers = k_means(x, max(1, cells or min(int(n**0.5), len(x) // EACH)), seed=seed)
    parts, d = -(-x.shape[1] // width), x.shape[1]
    left = np.zeros((len(x), parts * width))
    left[:, :d] = x - centers[_nearest(x, centers)]
    books = np.zeros((parts, VALUES, width))
    for i in range(parts):
        found = k_means(left[:, i * width : (i + 1) * width], VALUES, seed=seed)
        books[i, : len(found)], books[i, len(found) :] = found, found[0]
    return Quantizer(centers, books)


def assigned(df: DataFrame, quantizer: Quantizer, *, vector: str = "embedding") -> DataFrame:
    """``df`` with cell and code (the cell's number and the codes, as bytes)."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(vector)
            cell, code = np.full(len(batch), NOWHERE, dtype=np.int32), [None] * len(batch)
            full = np.flatnonzero((pc.list_value_length(v).fill_null(-1)).to_numpy(zero_copy_only=False) == quantizer.dimensions)
            if len(full):
                x = retrieval.unit_rows(pa.table({"v": v.take(pa.array(full))}))
                fine = np.isfinite(x).all(axis=1)
                full, x = full[fine], x[fine]
                cell[full] = _nearest(x, quantizer.centers)
                rows = np.concatenate([cell[full].astype("<i4")[:, None].view(np.uint8), quantizer.code(x, cell[full])], axis=1)
                for i, row in zip(full.tolist(), rows, strict=True):
                    code[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(code, pa.binary())], names=[*names, "cell", "code"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())]))


def _directed(batches: Iterator[pa.RecordBatch], vector: str, dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, unit vectors), some at a time, of rows whose vector has so many dimensions and a direction."""
    for batch in batches:
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            part = part.filter(pc.equal(pc.list_value_length(part.column(vector)), dimensions))
            if len(part):
                x = retrieval.unit_rows(pa.table({"v": part.column(vector)}))
                fine = np.isfinite(x).all(axis=1)
                yield part.filter(pa.array(fine)), x[fine]


class VectorIndex:
    """A stored index: ``path``/model and ``path``/rows, the latter with a folder for each cell."""

    def __init__(self, spark: SparkSession, path: str, *, doc_id: str = "doc_id", vector: str = "embedding"):
        self.spark, self.path, self.doc_id, self.vector = spark, path, doc_id, vector
        found = spark.read.parquet(f"{path}/model").first()
        take = lambda name, shape: np.frombuffer(found[name]).reshape(shape)
        self.quantizer = Quantizer(take("centers", found["center_shape"]), take("books", found["book_shape"]))

    @classmethod
    def build(cls, index: DataFrame, path: str, *, doc_id: str = "doc_id", vector: str = "embedding", quantizer: Quantizer | None = None, **training) -> VectorIndex:
        """Store every row of ``index`` by its cell; train a quantizer first unless one is given."""
        spark = index.sparkSession
        q = quantizer or train(index, doc_id=doc_id, vector=vector, **training)
        model = (bytearray(q.centers.tobytes()), list(q.centers.shape), bytearray(q.books.tobytes()), list(q.books.shape))
        spark.createDataFrame([model], "centers binary, center_shape array<int>, books binary, book_shape array<int>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        _by_cell(assigned(index, q, vector=vector)).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        return cls(spark, path, doc_id=doc_id, vector=vector)

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The stored rows, of some cells only if they are given: a filter on folders."""
        df = self.spark.read.parquet(f"{self.path}/rows")
        return df if cells is None else df.where(F.col("cell").isin(cells))

    def probes(self, queries: DataFrame, probe: int | None, *, vector: str = "embedding") -> DataFrame:
        """``queries`` once for each of the ``probe`` cells whose centers are nearest to their vector; None for all cells."""
        quantizer, names = self.quantizer, [c for c in queries.columns if c != "cell"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x in _directed(batches, vector, quantizer.dimensions):
                near = quantizer.nearest_cells(x, probe)
                rows = part.take(pa.array(np.repeat(np.arange(len(x)), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel())], names=[*names, "cell"])

        return queries.select(*names).mapInArrow(run, T.StructType([*queries.select(*names).schema.fields, T.StructField("cell", T.IntegerType())]))

    def probed(self, queries: DataFrame, probe: int, *, vector: str = "embedding") -> list[int]:
        """The cells that some query probes; tasks send numbers of cells, each at most once."""
        quantizer = self.quantizer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = np.zeros(len(quantizer.centers), dtype=bool)
            for _, x in _directed(batches, vector, quantizer.dimensions):
                met[quantizer.nearest_cells(x, probe).ravel()] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(met).astype(np.int32))], names=["cell"])

        return sorted(r["cell"] for r in queries.select(vector).mapInArrow(run, "cell int").distinct().collect())

    def search(self, queries: DataFrame, *, k: int = retrieval.DEFAULT_K, probe: int | None = PROBE, refine: int | None = 64, threshold: float | None = None, by: tuple[str, ...] = (), query_id: str = "query_id", vector: str = "embedding", tiles: tuple[int, int] | None = None) -> DataFrame:
        """As ``retrieval.search``, among rows of the ``probe`` nearest cells of each query; None for all cells.

        refine: how many candidates of each query, the best by codes, a pair of tiles compares by
        their vectors, so the best of all are among them; None compares all, and with ``probe=None`` gives the exact result. Only cells that some query
        probes are read: their numbers, as many as there are cells at most, become a filter on folders. A query goes
        once to each tile of rows, however many cells it probes; where it meets them, those of cells that it doesn't probe are left out.
        """
        k = k or retrieval.DEFAULT_K
        if k < 0 or (probe is not None and probe < 1) or (refine is not None and refine < k):
            raise ValueError("k and probe must be positive, and refine at least k")
        probe = None if probe is None or probe >= len(self.quantizer.centers) else probe
        asked = queries.where(F.size(vector) == self.quantizer.dimensions).select(F.col(query_id).alias("_q"), F.col(vector).alias("_v"), *by)
        rows = self.rows().where(F.col("cell") != NOWHERE) if probe is None else self.rows(self.probed(queries, probe, vector=vector))
        plain = probe is None and refine is None  # all is compared, so cells and codes tell nothing
        tiles = tiles if tiles or plain else retrieval.TILES
        hits = retrieval.tile_hits(asked, rows, k, retrieval.nearest if plain else self._near(probe, refine), vectors=("_v", self.vector), more=() if plain else ("code",), by=by, query_id="_q", doc_id=self.doc_id, tiles=tiles)
        found = retrieval.best(hits, k)
        kept = found if threshold is None else found.where(F.col("score") >= threshold)
        return kept.select(F.col("q").alias(query_id), "rank", F.col("d").alias(self.doc_id), "score", (1 - F.col("score")).alias("distance"))

    def probe_for(self, queries: DataFrame, target: float, *, k: int = retrieval.DEFAULT_K, query_id: str = "query_id", vector: str = "embedding", exact: DataFrame | None = None) -> int:
        """The least number of cells to probe so that a share of ``target`` of these queries' exact hits lies in them. exact: the hits, if they are known; else a search of all cells.

        How many that are is up to the vectors: a few where they are clustered, a large share of the cells where they fill
        the space evenly.
        """
        hits = self.search(queries, k=k, probe=None, refine=None, query_id=query_id, vector=vector) if exact is None else exact
        where = hits.select(F.col(query_id).alias("_q"), self.doc_id).join(self.rows().select(self.doc_id, F.col("cell").alias("of")), self.doc_id)
        both = queries.select(F.col(query_id).alias("_q"), F.col(vector).alias("v")).join(where.groupBy("_q").agg(F.collect_list("of").alias("of")), "_q").select("v", "of")
        quantizer = self.quantizer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(quantizer.centers), dtype=np.int64)
            for part, x in _directed(batches, "v", quantizer.dimensions):
                order = np.argsort(-quantizer.closeness(x), axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
                of = part.column("of")
                row = np.repeat(np.arange(len(x)), pc.list_value_length(of).to_numpy(zero_copy_only=False))
                n += np.bincount(place[row, of.flatten().to_numpy()], minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["place", "n"])

        places = both.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("count")).orderBy("place").collect()
        total, seen = sum(r["count"] for r in places), 0
        for r in places:
            seen += r["count"]
            if seen >= target * total:
                return r["place"] + 1
        return 1

    def _near(self, probe: int | None, refine: int | None):
        quantizer = self.quantizer

        def near(q: pa.Table, d: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The best by codes, or all, of rows whose cells a query probes, by their vectors. Queries of one cell are taken together, as they probe much the same."""
            a, b = retrieval.unit_rows(q), retrieval.unit_rows(d)
            codes = np.frombuffer(b"".join(d.column("code").to_pylist()), dtype=np.uint8).reshape(len(d), -1)
            cell = np.ascontiguousarray(codes[:, :4]).view("<i4").ravel()
            by_id = pc.sort_indices(d.column("id")).to_numpy().astype(np.int64)
            seen = b if refine is None else quantizer.decoded(codes[:, 4:], cell)
            fine = np.flatnonzero(np.isfinite(a).all(axis=1))
            turn = fine[np.argsort(_nearest(a[fine], quantizer.centers), kind="stable")]
            out = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)]
            for at in range(0, len(turn), 128):
                part, rows = turn[at : at + 128], by_id
                probed = np.ones((len(part), len(quantizer.centers)), dtype=bool)
                if probe is not None:
                    probed[:] = False
                    np.put_along_axis(probed, quantizer.nearest_cells(a[part], probe), True, axis=1)
                    rows = by_id[probed.any(axis=0)[cell[by_id]]]

                def scores(some: slice, part=part, rows=rows, probed=probed) -> np.ndarray:
                    found = np.round(a[part[some]] @ seen[rows].T, 9)
                    return found if probe is None else np.where(probed[some][:, cell[rows]], found, -np.inf)

                row, col, score = retrieval.nearest_of(scores, len(part), rows, refine or k)
                if refine is not None and len(row):
                    score = np.round((a[part[row]] * b[col]).sum(axis=1), 9)
                    order = np.lexsort((d.column("id").to_numpy()[col], -score, row))
                    row, col, score = row[order], col[order], score[order]
                    first = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, col, score = row[first], col[first], score[first]
                out.append((part[row], col, score))
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))

        return near

    def upsert(self, new: DataFrame, *, order: str | None = None) -> list[int]:
        """Put rows in place of those of the same id. Only cells that have or get such a row are written, by partition; their numbers are returned."""
        key = self.doc_id
        latest = retrieval.upsert(new.limit(0), new, key=key, order=order)
        made = assigned(latest, self.quantizer, vector=self.vector).persist()
        old = self.rows().join(made.select(key), key, "left_semi").select("cell").distinct()
        touched = sorted(r["cell"] for r in old.union(made.select("cell")).distinct().collect())
        stay = self.rows(touched).join(made.select(key), key, "left_anti")
        merged = stay.unionByName(made, allowMissingColumns=True)
        # Its own old rows are read while it is written, so it is written beside them first.
        staged = f"{self.path}/staged"
        _by_cell(merged).write.mode("overwrite").partitionBy("cell").parquet(staged)
        again = self.spark.read.schema(self.rows().schema).parquet(staged)
        empty = set(touched) - {r["cell"] for r in again.select("cell").distinct().collect()}
        _by_cell(again).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{self.path}/rows")
        for cell in empty:  # a cell that has lost its last row
            sinks.delete(self.spark, f"{self.path}/rows/cell={cell}")
        sinks.delete(self.spark, staged)
        made.unpersist()
        self.spark.catalog.refreshByPath(f"{self.path}/rows")
        return touched


def _by_cell(df: DataFrame) -> DataFrame:
    """Rows of a cell together, in as few files as sizes allow; adaptive execution cuts a crowded cell into several."""
    return df.hint("rebalance", F.col("cell"))


def recall(found: DataFrame, exact: DataFrame, *, query_id: str = "query_id", doc_id: str = "doc_id") -> float:
    """The share of the exact hits that were found."""
    n, hits = exact.select(query_id, doc_id).join(found.select(query_id, doc_id, F.lit(1).alias("hit")), [query_id, doc_id], "left").agg(F.count("*"), F.count("hit")).first()
    return hits / n if n else 1.0
