"""Language identification by rank-order profiles.

A profile is a list of the most frequent n-grams of letters, best first. A
document is compared to each language's profile by out-of-place distance: for
each of its own n-grams, how many places its rank there is from its rank here,
and a full ``profile`` places if the language lacks it. The nearest profile wins.

Letters are lower-cased; anything that isn't a letter parts words. An n-gram of up to
three code points is one 63-bit number, so that no two letters of any script are
taken for one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_hash, rows, small_batches, stored, texts

#: n-gram lengths (three at most), entries of a profile, most training documents of a language, and shards that each language's are found in.
ORDERS, PROFILE, FIT, SHARDS = (1, 2, 3), 400, 3000, 64
UNKNOWN = "und"
#: A gap, as a code point that is no letter, and the bits of a code point.
_GAP, _BITS = 1, 21


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


_LETTER = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x20000)), dtype=np.uint8).astype(bool)


def is_letter(points: np.ndarray) -> np.ndarray:
    low = _LETTER[np.minimum(points, 0x1FFFF)]
    if len(points) and points.max() >= 0x20000:
        high = points >= 0x20000
        low[high] = [chr(c).isalpha() for c in points[high]]
    return low


def letters(text: str) -> np.ndarray:
    """Code points with one gap before, between and after words; empty if there is no letter."""
    points = codepoints(text.lower()).astype(np.int64)
    points = np.concatenate(([_GAP], np.where(is_letter(points), points, _GAP), [_GAP]))
    points = points[np.r_[True, (points[1:] != _GAP) | (points[:-1] != _GAP)]]
    return points if len(points) > 1 else points[:0]


def values(points: np.ndarray) -> np.ndarray:
    """The n-grams of all orders, as often as they occur. None is a gap alone."""
    out = [points[:0]]
    for n in ORDERS:
        if len(points) < n:
            break
        value = points[: len(points) - n + 1].copy()
        for i in range(1, n):
            value <<= _BITS
            value |= points[i : len(points) - n + 1 + i]
        out.append(value if n > 1 else value[value != _GAP])
    return np.concatenate(out)


def counts(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and how often each occurs."""
    every = np.sort(every)
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, dtype=np.int64)
    return every[first], np.diff(np.r_[first, len(every)])


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one text, and their counts."""
    return counts(values(points))


def top(gram: np.ndarray, count: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, best first; ties by n-gram."""
    return gram[np.lexsort((gram, -count))][:most]


class Profiles:
    """A fitted model: the profile of each language, best first.

    Held as three arrays of ``PROFILE`` entries a language, sorted by n-gram.
    """

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        gram = np.concatenate([profiles[x] for x in self.names] or [np.zeros(0, dtype=np.int64)])
        rank = np.concatenate([np.arange(len(profiles[x])) for x in self.names] or [gram])
        lang = np.repeat(np.arange(len(self.names)), [len(profiles[x]) for x in self.names])
        order = np.argsort(gram, kind="stable")
        self.gram, self.rank, self.lang = gram[order], rank[order].astype(np.int32), lang[order].astype(np.int32)

    def distances(self, mine: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's n-grams, best first, to each language."""
        first = np.searchsorted(self.gram, mine, side="left")
        many = np.searchsorted(self.gram, mine, side="right") - first
        place = np.repeat(np.arange(len(mine)), many)
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(place))
        saved = np.bincount(self.lang[at], weights=PROFILE - np.abs(self.rank[at] - place), minlength=len(self.names))
        return PROFILE * len(mine) - saved

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1): how much nearer the first profile is than the second."""
        points = letters(text or "")
        if not len(points) or not self.names:
            return UNKNOWN, 0.0
        mine = top(*grams(points))
        total = self.distances(mine)
        best = int(np.argmin(total))  # ties: the first name
        if len(total) == 1:
            return self.names[0], 1.0 - float(total[0]) / (PROFILE * len(mine))
        second = float(np.partition(total, 1)[1])
        return self.names[best], (second - float(total[best])) / second if second else 0.0


def training_rows(docs: DataFrame, train: Column, *, id_col: str, text_col: str, lang_col: str, fit: int) -> DataFrame:
    """lang, text of about ``fit`` documents of each language, chosen by hash of id and text; repeated rows count once."""
    held = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("turn"), F.col(text_col).cast("string").alias("text"))
    # A language may have most rows: each of its shards finds its own first ones, and only their hashes meet,
    # several times as many as are to be chosen, so that the last hash to choose is among them.
    shard = W.partitionBy("lang", "shard").orderBy("turn")
    near = held.select("lang", "turn", F.pmod("turn", F.lit(SHARDS)).alias("shard")).distinct()
    near = near.withColumn("n", F.row_number().over(shard)).where(F.col("n") <= -(-4 * fit // SHARDS) + 64)
    met = F.sort_array(F.collect_list("turn"))  # 4 ``fit`` + 65 ``SHARDS`` numbers at most, whatever the corpus
    last = stored(near.groupBy("lang").agg(met.alias("met")).select("lang", F.element_at("met", F.least(F.lit(fit), F.size("met"))).alias("last")), "lang_last")
    return held.join(last, "lang").where(F.col("turn") <= F.col("last")).dropDuplicates(["lang", "turn"]).select("lang", "text")


def fit(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = FIT) -> Profiles:
    """Profiles of every language among the rows of ``train``.

    About ``most`` documents of each language are read, whole. What comes to the
    driver is ``PROFILE`` n-grams of each language.
    """
    sample = stored(training_rows(docs, train, id_col=id_col, text_col=text_col, lang_col=lang_col, fit=most), "lang_fit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text")), strict=True):
                by.setdefault(lang, []).append(values(letters(text)))  # of each text by itself
            for lang, found in by.items():
                gram, n = counts(np.concatenate(found))
                yield rows(pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]), [[lang] * len(gram), gram, n])

    tallied = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = tallied.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    profiles: dict[str, dict[int, int]] = {}
    for r in ranked.toLocalIterator():
        profiles.setdefault(r["lang"], {})[r["rank"]] = r["gram"]
    return Profiles({k: np.array([v[i] for i in sorted(v)], dtype=np.int64) for k, v in profiles.items()})


def identify(docs: DataFrame, model: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row; texts that are null or have no letter are ``und`` with score 0."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = source.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [shared.value.predict(x) for x in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, shape)


def identify_held_out(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, out: int = 2) -> DataFrame:
    """Fit on the rows whose crc32 of the id isn't ``out`` modulo ``folds``; doc_id, held_out, lang_pred, score of all.

    Rows whose language is null are no training rows but are identified as any
    other. Without training rows, every text is ``und``. Of languages equally near, the first by
    name is given. Repeated rows are each identified, and count once in training. Very long texts are read whole. An empty table gives no rows. Other columns,
    whatever their names, have no effect.
    """
    held = F.pmod(id_hash(F.col(id_col)), F.lit(folds)) == out
    model = fit(docs, ~held, id_col=id_col, text_col=text_col, lang_col=lang_col)
    scored = identify(docs, model, id_col=id_col, text_col=text_col)
    return scored.select("doc_id", (F.pmod(id_hash(F.col("doc_id")), F.lit(folds)) == out).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, *, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, out: int = 2) -> DataFrame:
    """``docs`` without documents in no language, and those whose score is below ``least``; all columns stay.

    Each row is decided by its own text, whatever other rows share its id; repeated rows stay or go each. Rows with null or
    empty text go, as do all if no row has a language. Of languages equally near, the first by name counts.
    Very long texts are read whole. An empty table stays empty; other columns may have any names.
    """
    model = fit(docs, F.pmod(id_hash(F.col(id_col)), F.lit(folds)) != out, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            found = [shared.value.predict(x) for x in texts(batch.column(text_col).cast(pa.string()))]
            yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
