"""Spelling variants by letter-parity masks.

A word's mask has a bit for each letter, set if the word has that letter an odd
number of times. Inserting or deleting a letter flips one bit, replacing one flips
two, and nothing else changes a mask. The bits are dealt to three bands, so two
words that are one edit apart have at least one band in common.

A cell is a band with its value and a length L. Words of length L are its own, words
of length L + 1 its guests; own words meet own words (two bits apart) and guests (one
bit apart). Where two words meet in several cells, the first band counts. What the
masks let pass must also agree in the first or the last half of the shorter word,
which one edit can't both change, and is verified letter by letter. Crowded cells are
cut into chunks, and each pair of chunks is a group of its own, of bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows, small_batches, stored, utf8

#: Occurrences and code points of a word, and how many times as frequent the form of a word is.
LEAST, SHORTEST, RATIO = 5, 6, 5
#: Of the hashes of (document, run), those divisible by this lose a code point.
MISPELT = 199
#: Distinct words that a task holds before it passes their counts on.
HELD = 300_000
#: Rows of a cell's chunk, comparisons at a time, and comparisons of a partition.
CHUNK, BLOCK, SHARE = 16_384, 1 << 18, 1_000_000_000


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, shortest: int = SHORTEST, mispelt: int | None = MISPELT) -> DataFrame:
    """word, n: the words of all texts that have ``shortest`` code points and occur ``least`` times.

    A run of letters is lower-cased in A-Z. mispelt: where the crc32 of "<doc_id>:<run>"
    is divisible by it, the run loses the code point at that crc32 modulo its length; None takes runs as they
    are. Null texts have no words, and a null id counts as the empty text.
    """
    if least < 1 or shortest < 1:
        raise ValueError("least and shortest must be at least 1")
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Letters a-z and U+00C0 to U+00FF in UTF-8; shorter runs can't become words.
        find = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % shortest).findall
        crc, held = zlib.crc32, {}
        for batch in small_batches(batches, "text"):
            for doc, text in zip(utf8(batch.column("doc_id")), utf8(batch.column("text")), strict=True):
                each: dict[bytes, int] = {}
                for w in find(text.lower()):  # of bytes: A-Z only
                    each[w] = each.get(w, 0) + 1
                if mispelt:
                    base = crc(doc + b":")
                    for w in [w for w in each if not crc(w, base) % mispelt]:
                        letters, n = w.decode(), each.pop(w)
                        at = crc(w, base) % len(letters)
                        changed = (letters[:at] + letters[at + 1 :]).encode()
                        held[changed] = held.get(changed, 0) + n
                for w, n in each.items():
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield counted(held)
                    held = {}
        if held:
            yield counted(held)

    def counted(held: dict[bytes, int]) -> pa.RecordBatch:
        found = [(w, n) for w, n in held.items() if len(w) - w.count(b"\xc3") >= shortest]
        return rows(schema, [[w.decode() for w, _ in found], [n for _, n in found]])

    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def bands(word: Column) -> list[Column]:
    """The three bands of a word's mask. Letters are dealt in alphabetical order, so that each band gets frequent ones."""
    code = F.transform(F.split(word, ""), lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(F.ascii(c) - 192 + 26))
    flip = lambda k: lambda mask, i: F.when(i % 3 == k, mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.floor(i / 3).cast("int")))).otherwise(mask)
    return [F.aggregate(code, F.lit(0), flip(k)) for k in range(3)]


def near(a: str, b: str) -> bool:
    """Whether b is a with one code point replaced, or with one more."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] and a != b if n == len(b) else n + 1 == len(b) and a[i:] == b[i + 1 :]


def _meet(own: dict[str, np.ndarray], other: dict[str, np.ndarray], flips: int, band: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``own`` and ``other`` that masks, bands before this one and halves let pass. same: both are the same rows."""
    low, out_a, out_b = np.int64((1 << 30) - 1), [], []
    step = max(1, BLOCK // max(1, len(other["rest"])))
    for at in range(0, len(own["rest"]), step):
        apart = own["rest"][at : at + step, None] ^ other["rest"][None, :]
        a, b = np.nonzero(np.bitwise_count(apart) == flips)
        if band:  # the rest holds the lower of the other two bands in its low bits
            met = apart[a, b]
            first = (met & low) != 0
            a, b = (a[first], b[first]) if band == 1 else (a[first & (met > low)], b[first & (met > low)])
        a = a + at
        fits = (own["head"][a] == other["head"][b]) | (own["tail"][a] == other["tail"][b])
        if same:
            fits &= a < b
        out_a.append(a[fits])
        out_b.append(b[fits])
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(out_a or none), np.concatenate(out_b or none)


def chunk_pairs(band: int, i: int, j: int, group: dict[str, np.ndarray], words: list[str]) -> Iterator[tuple[int, int]]:
    """Near pairs (positions) of one group: rows of chunk i and of chunk j of a cell."""

    def part(chunk: int, own: bool) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        at = np.flatnonzero((group["chunk"] == chunk) & (group["own"] == own))
        return at, {c: group[c][at] for c in ("rest", "head", "tail")}

    own = part(i, True)
    meetings = [(own, part(j, True), 2), (own, part(j, False), 1)]
    if i != j:
        meetings.append((part(j, True), part(i, False), 1))
    for (at, left), (bt, right), flips in meetings:
        a, b = _meet(left, right, flips, band, i == j and flips == 2)
        for x, y in zip(at[a].tolist(), bt[b].tolist(), strict=True):
            if near(words[x], words[y]):
                yield x, y


def near_words(words: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """word, n, other, other_n: each two words one edit apart, both ways round. words: word (distinct), n, stored."""
    parts = ["b0", "b1", "b2"]
    masked = words.select("word", "n", F.char_length("word").alias("size"), *(b.alias(c) for b, c in zip(bands(F.col("word")), parts, strict=True)))
    rest = lambda x, y: F.col(x).cast("long").bitwiseOR(F.call_function("shiftleft", F.col(y).cast("long"), F.lit(30)))
    each = F.array(*(F.struct(F.lit(k).alias("band"), F.col(parts[k]).alias("value"), rest(*[p for p in parts if p != parts[k]]).alias("rest")) for k in range(3)))
    placed = masked.select("word", "n", "size", F.explode(each).alias("c")).select("word", "n", "c.*", F.explode(F.array(F.struct(F.col("size"), F.lit(True).alias("own")), F.struct((F.col("size") - 1).alias("size"), F.lit(False).alias("own")))).alias("s"))
    half = F.floor(F.col("size") / 2).cast("int")
    placed = placed.select("word", "n", "band", "value", "rest", "s.*").select(
        "word", "n", "band", "value", "size", "own", "rest", F.xxhash64(F.substring("word", F.lit(1), half)).alias("head"), F.xxhash64(F.substring("word", half - F.col("size"), F.col("size") - half)).alias("tail")
    )
    placed = stored(placed, "bands")
    cell = ["band", "value", "size"]
    counts = placed.groupBy(*cell).agg(F.count("*").alias("rows"), F.count_if("own").alias("owned")).where("owned > 0 and rows > 1")
    counts = stored(counts.select(*cell, F.ceil(F.col("rows") / chunk).cast("int").alias("chunks"), (F.col("owned") * F.col("rows")).alias("work")), "cells")
    work = counts.agg(F.sum("work")).first()[0] or 0
    shares = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-work // SHARE))
    met = placed.join(counts.drop("work"), cell).withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select(*cell, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "own", "rest", "head", "tail", "word", "n")
    key = [*cell, "i", "j"]
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string()), ("other_n", pa.int64())])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of the same key; those of a key stand together, but may go on in the next batch."""
        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            new = np.zeros(t.num_rows, dtype=bool)
            for c in key:
                x = t.column(c).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            starts = [0, *np.flatnonzero(new).tolist()]
            for a, b in zip(starts, starts[1:], strict=False):
                yield t.slice(a, b - a)
            left = t.slice(starts[-1])
        if left is not None and left.num_rows:
            yield left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, str, int]] = []
        for t in groups(batches):
            if t.num_rows > 1:
                group = {c: t.column(c).to_numpy() for c in ("chunk", "own", "rest", "head", "tail")}
                names, ns = t.column("word").to_pylist(), t.column("n").to_pylist()
                band, i, j = (t.column(c)[0].as_py() for c in ("band", "i", "j"))
                for x, y in chunk_pairs(band, i, j, group, names):
                    out += [(names[x], ns[x], names[y], ns[y]), (names[y], ns[y], names[x], ns[x])]
                    if len(out) >= 10_000:
                        yield rows(schema, [list(c) for c in zip(*out, strict=True)])
                        out = []
        if out:
            yield rows(schema, [list(c) for c in zip(*out, strict=True)])

    return met.repartition(shares, *key).sortWithinPartitions(*key).mapInArrow(run, "word string, n long, other string, other_n long")


def variants(words: DataFrame, *, ratio: float = RATIO, chunk: int = CHUNK) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (distinct) with counts n.

    form: the near word (one code point inserted, deleted or replaced) of largest n,
    ties going to the smallest in code-point order, if its n is at least ``ratio`` (over 1) times
    the word's, else null; form_n its n. root: where following forms from the word ends. Words without a
    near one have n_near 0. Other columns have no effect; an empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, or forms could lead round in a circle")
    words = stored(words.select("word", "n"), "words")
    best = near_words(words, chunk=chunk).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best"))
    found = stored(found.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n")), "forms")
    # Each round every word that has a form learns what its present root leads to: chains shrink by half.
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = stored(roots, "roots")
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = roots.join(ahead, "root", "left")
        if not step.where("next is not null").take(1):
            break
        roots = step.select("word", F.coalesce("next", "root").alias("root"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, shortest: int = SHORTEST, mispelt: int | None = MISPELT, ratio: float = RATIO, chunk: int = CHUNK) -> DataFrame:
    """``variants`` of the words of all texts: word, form, root, n, n_near, form_n.

    Null and empty texts have no words and an empty table gives no rows; a null id counts as the
    empty text. Very long texts are read whole, and repeated rows count each. Other columns, whatever their names, have no effect.
    """
    return variants(word_counts(docs, id_col=id_col, text_col=text_col, least=least, shortest=shortest, mispelt=mispelt), ratio=ratio, chunk=chunk)


def grouped(variant_rows: DataFrame) -> DataFrame:
    """root, words, n: the groups that roots make, with the number of their words and all occurrences."""
    return variant_rows.groupBy("root").agg(F.count("*").alias("words"), F.sum("n").alias("n"))


#: crc32 goes byte by byte over a table that its polynomial makes; letters beyond ASCII become single bytes for levenshtein, which compares bytes.
ORACLE = """
WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS run FROM documents),
each AS (SELECT run, count(*) AS n, encode(doc || run) AS bytes FROM runs GROUP BY doc, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(bytes)), lambda i: CAST(('0x' || substr(hex(bytes), CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) AS h FROM each, poly),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS size, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[]^_`{|') AS plain
  FROM spelt GROUP BY word HAVING sum(n) >= 5 AND length(word) >= 6),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM words a JOIN words b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND levenshtein(a.plain, b.plain) = 1),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n,
  CASE WHEN b.top >= 5 * w.n THEN (SELECT min(p.other) FROM pairs p WHERE p.word = w.word AND p.other_n = b.top) END AS form FROM words w LEFT JOIN best b ON w.word = b.word),
steps AS (SELECT word, word AS at FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word JOIN forms e ON e.word = s.at AND e.form IS NULL
"""
