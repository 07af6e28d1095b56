"""Exact top-k vector search, and upkeep of the index table."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tiles of queries and of the index that an exact search makes, whatever its size, so that what it shuffles grows as its
#: tables do; a pair of tiles is one task's. A filter has its share of them, and more only beyond ``LARGE`` bytes of vectors
#: in a tile, two of which a task must hold.
GRID, LARGE = (6, 3), 1 << 26
#: Rows of the index that are compared at a time, and queries.
BLOCK, PART = 4096, 128
#: The most rows of a tile of queries and of a tile of the index where more than vectors must be held. A query is sent once for
#: each tile of the index and a row once for each tile of queries, so larger tiles shuffle less.
TILES = (32768, 32768)
#: So many tiles are a filter's queries cut into at least, if they then hold ``SMALL`` each: for tasks to have something to do.
SPREAD, SMALL = 12, 1024
#: So many components a tile's vectors have at most, if that is ``SMALL`` vectors or more.
VALUES = 1 << 21
#: So many filters' sizes are broadcast at most; more are joined.
FILTERS = 10_000
DEFAULT_K, DEFAULT_THRESHOLD = 5, 0.35


def search(queries: DataFrame, index: DataFrame, *, k: int = DEFAULT_K, threshold: float | None = None, by: tuple[str, ...] = (), query_id: str = "query_id", doc_id: str = "doc_id", vector: str = "embedding", tiles: tuple[int, int] | None = None) -> DataFrame:
    """query_id, rank, doc_id, score, distance: the k nearest by cosine, at or above the threshold.

    by: columns that both tables have; a query with a value there is searched only
    among rows of that value. The threshold applies after the top k, which is the
    same as before, since both go by score. Ties go to the smaller doc_id. Queries of the same
    filter and the rows that pass it are cut into tiles, each pair of tiles multiplies as matrices in one task, and
    only its top k per query are shuffled; neither side is broadcast, and rows that no query asks for
    go nowhere. Null and zero vectors find nothing and aren't found. tiles: the most rows of a tile of queries and of rows;
    by default there are as many tiles as ``GRID`` says.
    """
    k = k or DEFAULT_K
    if k < 0:
        raise ValueError("k must be positive")
    each = tile_hits(queries, index, k, nearest, by=by, query_id=query_id, doc_id=doc_id, vectors=(vector, vector), tiles=tiles)
    ranked = best(each, k)
    kept = ranked if threshold is None else ranked.where(F.col("score") >= threshold)
    return kept.select(F.col("q").alias(query_id), "rank", F.col("d").alias(doc_id), "score", (1 - F.col("score")).alias("distance"))


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best of (q, d, score) for each q, with their rank; ties go to the smaller d."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.asc("d")))).where(F.col("rank") <= k)


def tile_hits(queries: DataFrame, index: DataFrame, k: int, near: Callable[[pa.Table, pa.Table, int], tuple[np.ndarray, np.ndarray, np.ndarray]], *, by: tuple[str, ...], query_id: str, doc_id: str, vectors: tuple[str, str], more: tuple[str, ...] = (), tiles: tuple[int, int] | None = None) -> DataFrame:
    """q, d, score: of each pair of tiles, what ``near`` finds among the rows that a query's filter passes, k for each query.

    vectors: the columns of the queries and of the index that ``near`` gets as v; more: further columns of the index that it gets.
    """
    blank = F.lit("")
    values = [F.coalesce(F.col(c).cast("string"), blank) for c in by]

    def side(df: DataFrame, key: str, vector: str, wants: Column, *more: str) -> DataFrame:
        kind = df.schema[vector].dataType
        v = F.col(vector) if kind in (T.ArrayType(T.FloatType()), T.BinaryType()) else F.col(vector).cast("array<double>")
        return df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), v.alias("v"), *more, F.explode(wants).alias("want"))

    def want(chosen: tuple[bool, ...]) -> Column:
        """A filter as text; columns that aren't chosen don't filter."""
        return F.to_json(F.array(*(F.when(v != "", F.concat(F.lit("="), v)).otherwise(blank) if on else blank for on, v in zip(chosen, values, strict=True))).cast("array<string>"))

    asked = side(queries, query_id, vectors[0], F.array(want((True,) * len(by))))
    # A row passes a filter on any choice of columns: as many copies here, of which those that are asked for go on.
    known = side(index, doc_id, vectors[1], F.array_distinct(F.array(*map(want, itertools.product((False, True), repeat=len(by))))), *more)
    sizes = _sizes(asked, known, tiles)
    left = asked.join(sizes, "want").select("id", "v", "want", F.pmod(F.xxhash64("id"), "rows").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("j"))
    right = known.join(sizes, "want").select("id", "v", *more, "want", F.pmod(F.xxhash64("id"), "cols").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i"))
    shape = T.StructType([T.StructField("q", queries.schema[query_id].dataType), T.StructField("d", index.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])

    def top(q: pa.Table, d: pa.Table) -> pa.Table:
        names = [t.column("id").combine_chunks() for t in (q, d)]
        at_q, at_d, scores = near(q, d, k) if len(q) and len(d) else (np.zeros(0, dtype=np.int64),) * 3
        return pa.table({"q": names[0].take(pa.array(at_q)), "d": names[1].take(pa.array(at_d)), "score": pa.array(scores, pa.float64())})

    return left.groupBy("want", "i", "j").cogroup(right.groupBy("want", "i", "j")).applyInArrow(top, shape)


def _sizes(asked: DataFrame, known: DataFrame, tiles: tuple[int, int] | None) -> DataFrame:
    """want, rows, cols: into how many tiles each filter's queries and rows are cut; filters that both sides have.

    Up to FILTERS of them are read here and broadcast; more stay a table to join with.
    """
    n, length = F.count("*"), F.greatest(F.max(F.size("v")), F.lit(1))
    if tiles is None:
        # Each filter has its share of the tiles, unless they were smaller than SMALL or larger than LARGE.
        counts = lambda df, side: df.groupBy("want").agg(n.alias(f"n_{side}"), length.alias(f"length_{side}"))
        met = counts(asked, "rows").join(counts(known, "cols"), "want")

        def cut_evenly(df: DataFrame, tiles: int, side: str) -> Column:
            size, n = 4 if df.schema["v"].dataType == T.ArrayType(T.FloatType()) else 8, F.col(f"n_{side}")
            most = F.greatest(F.lit(SMALL), LARGE / (size * F.col(f"length_{side}")))
            return F.greatest(F.least(F.ceil(tiles * n / F.col(f"all_{side}")), F.ceil(n / SMALL)), F.ceil(n / most)).alias(side)

        both = met.crossJoin(met.agg(F.sum("n_rows").alias("all_rows"), F.sum("n_cols").alias("all_cols"))).select("want", cut_evenly(asked, GRID[0], "rows"), cut_evenly(known, GRID[1], "cols"))
    else:
        # One tile of queries is as small as SPREAD asks for, as large as ``tiles`` and the vectors' length let it be.
        cut = lambda most: F.ceil(n / F.least(F.lit(most), F.greatest(F.lit(SMALL), F.lit(VALUES) / length)))
        rows = F.greatest(cut(tiles[0]), F.least(cut(SMALL), F.lit(SPREAD))) if tiles[0] > SMALL else cut(tiles[0])
        both = asked.groupBy("want").agg(rows.alias("rows")).join(known.groupBy("want").agg(cut(tiles[1]).alias("cols")), "want")
    few = both.limit(FILTERS + 1).collect()
    return both if len(few) > FILTERS else F.broadcast(asked.sparkSession.createDataFrame(few, both.schema))


def nearest(q: pa.Table, d: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of each query of a pair of tiles, by their places in them.

    Rows are compared a block at a time, in the order of their ids, and meet the k best of the blocks before.
    """
    a, v, by_id = unit_rows(q), d.column("v").combine_chunks(), pc.sort_indices(d.column("id"))
    # The k best so far: their scores, falling, and their places in by_id.
    held, place = np.full((len(a), k), -np.inf), np.zeros((len(a), k), dtype=np.int64)
    for at in range(0, len(v), BLOCK):
        b = unit_rows(pa.table({"v": v.take(by_id.slice(at, BLOCK))}))
        if a.shape[1] != b.shape[1]:
            raise ValueError("queries and index have vectors of different lengths")
        for start in range(0, len(a), PART):
            score = a[start : start + PART] @ b.T
            least = held[start : start + PART, -1]
            if score.shape[1] > k and np.isneginf(least).any():
                score[~np.isfinite(score)] = -np.inf
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
            # Scores are rounded where they may count: all that may tie with the k-th once rounded stay in the race.
            row, col = np.divmod(np.flatnonzero(score > (least - 2e-9)[:, None]), score.shape[1])
            score = np.round(score[row, col], 9)
            fine = np.isfinite(score)
            if not fine.any():
                continue
            row, col, score = row[fine] + start, col[fine] + at, score[fine]
            met = np.unique(row)
            row, col, score = (np.concatenate(x) for x in ((np.repeat(met, k), row), (place[met].ravel(), col), (held[met].ravel(), score)))
            order = np.lexsort((col, -score, row))
            row, col, score = row[order], col[order], score[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            held[met], place[met] = score[first].reshape(-1, k), col[first].reshape(-1, k)
    found = np.isfinite(held)
    return np.nonzero(found)[0], by_id.to_numpy()[place[found]], held[found]


def nearest_of(scores: Callable[[slice], np.ndarray], n: int, by_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of each of n queries, from the scores of a few at a time over rows in the order ``by_id``."""
    out = []
    for start in range(0, n, 128):
        score = scores(slice(start, start + 128))
        score[~np.isfinite(score)] = -np.inf
        near = np.isfinite(score)
        if score.shape[1] > k:  # all that tie with the k-th stay in the race
            near &= score >= np.partition(score, -k, axis=1)[:, -k, None]
        row, col = np.nonzero(near)
        s = score[row, col]
        order = np.lexsort((col, -s, row))
        row, col, s = row[order], col[order], s[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < k
        out.append((row[best] + start, by_id[col[best]], s[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def unit_rows(t: pa.Table) -> np.ndarray:
    """Unit vectors as rows of a matrix; null components make a vector that is near nothing."""
    lists = t.column("v").combine_chunks()
    if pc.min_max(pc.list_value_length(lists))["min"] != pc.min_max(pc.list_value_length(lists))["max"]:
        raise ValueError("vectors of different lengths")
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        for at in range(0, len(v), BLOCK):  # in place, a few at a time
            part = v[at : at + BLOCK]
            part /= np.sqrt((part * part).sum(axis=1))[:, None]
    return v


def with_documents(hits: DataFrame, index: DataFrame, *, doc_id: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """Hits with the index's other columns."""
    return hits.join(index.drop(vector), doc_id)


def upsert(index: DataFrame, new: DataFrame, *, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """The index with new rows in place of those of the same key; of new rows that share a key, the last by ``order`` stays."""
    if order:
        last = W.partitionBy(key).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates([key])
    return index.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)
