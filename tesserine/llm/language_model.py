"""Scoring with a hierarchical Pitman-Yor language model.

The model has a restaurant for each word before (the empty token at a text's start),
whose dishes are the tokens that follow it in the training texts. All have one parent, the
restaurant of words, whose customers are their tables. Its own parent spells words: restaurants of letters, one for each context of up
to three letters before, each of whose parents is the restaurant of the context one
letter shorter; all contexts that end alike share one.

``score`` is over the V tokens of the training texts and one more event, any other
token, just as the base score is: that event has what the restaurant of words keeps for
new tables times what the letters leave for words outside the vocabulary.
``open_score`` spells tokens outside the vocabulary instead, so that it tells texts of
rubbish from texts with a few rare words.

Seating is sampled by Gibbs. Given what its parent predicts and how many tables
its restaurant has, the customers of one dish are seated anew one after another, a
new table costing its parent's probability; every table sends one customer to
the parent.

Contexts start with a table for each word and get their parent's predictions from that. Then
all are sampled in turns: the contexts are seated anew given their parent, the restaurants of words and letters
given the contexts' tables, and the next turn starts from there. ``SEATINGS`` turns are kept, each a sample of all
restaurants, and their predictions are averaged. All draws depend on the turn and on the word, or
the pair of words, alone, so whoever needs a word's or a pair's tables finds those that were sampled: probabilities
add up to one, and scores don't depend on how rows are dealt.

How it is spread: texts become shares, stored rows that each hold the tokens of some megabytes of
text as numbers and the share's distinct words, in order of a hash, and pairs of words next to each other. What has to be known of all
shares, of a word or of a pair of words, is found in buckets, ranges of that hash: a share sends its part of each
bucket as one packed row, the bucket puts equal entries together, and the reply has one
number for each entry of the share, in the share's own order, so that no key travels back. Words and
buckets grow in number with the corpus, and neither shares nor buckets grow in size. Pairs of words are told apart by 64-bit hashes.
The letters' restaurants have ``ALPHABET`` to the 4 cells whatever the corpus; the counts
that reach them are summed in tasks, and only those cells come to the driver. Replies are read by
a share's task from the shared folder, where they stand by share.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_hash, rows, shared_dir, small_batches, stored, utf8

#: Letter codes (0 ends a word, the last is any other letter), letters before, and sweeps over the letters' seating.
ALPHABET, ORDER, SWEEPS, SEED = 48, 3, 4, 5
#: Turns over all restaurants that are kept.
SEATINGS = 2
OTHER = ALPHABET - 1
CELLS = ALPHABET ** (ORDER + 1)
CONTEXT_STRENGTH, WORD_STRENGTH, LETTER_STRENGTH = 1.0, 50.0, 2.0
#: Bytes of text in a share, and of all texts for each bucket.
SHARE, BUCKET = 8 << 20, 16 << 20
#: The most tasks that shares are dealt to; beyond that, a task has several, one after another.
TASKS = 20_000
_CODEPOINTS = 0x110000


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, lower-cased in A-Z; the end is the empty token, which no word is."""
    return [*text.lower().split(), b""]


def seat(count: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after ``count`` customers sat down one by one.

    The next customer opens a table with probability strength / (strength + seated -
    discount * tables). The first 32 are seated singly; from there on in runs that
    lengthen by a tenth, the tables opened in a run being drawn from a Poisson law with the
    sum of its probabilities, at most one for each customer.
    """
    tables = np.minimum(count, 1).astype(np.float64)
    for n in range(1, 32):
        at = np.flatnonzero(count > n)
        if not len(at):
            return tables
        tables[at] += rng.random(len(at)) * (strength[at] + n - discount * tables[at]) < strength[at]
    at, n = np.flatnonzero(count > 32), 32.0
    while len(at):
        stop = np.minimum(count[at], np.floor(n * 1.1))
        base = strength[at] - discount * tables[at]
        mean = strength[at] * np.log(np.maximum(base + stop, 1e-9) / np.maximum(base + n, 1e-9))
        tables[at] += np.minimum(rng.poisson(np.clip(mean, 0, 1e15)), stop - n)
        n = float(np.floor(n * 1.1))
        at = at[count[at] > n]
    return tables


def mean_log(each: list[np.ndarray]) -> np.ndarray:
    """Log10 of the mean of numbers given by their logarithms."""
    if len(each) == 1:
        return each[0]
    top = np.max(each, axis=0)
    return top + np.log10(np.mean(10.0 ** (np.array(each) - top), axis=0))


def discount_of(one: int, two: int) -> float:
    """From the numbers of dishes that occur once and twice."""
    return float(np.clip(one / (one + 2 * two), 0.1, 0.9)) if one + two else 0.5


class Letters:
    """Log10 probability of each letter after each context, averaged over seatings; and the letters' codes."""

    def __init__(self, letters: list[int], logs: np.ndarray):
        self.letters, self.logs = letters, logs
        self._code: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_code": None}

    def cells(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The cell (context, letter) of every letter and end of the words, and where each word starts."""
        if self._code is None:
            self._code = np.full(_CODEPOINTS, OTHER, dtype=np.int64)
            self._code[self.letters] = np.arange(1, len(self.letters) + 1)
            self._code[0x0A] = 0
        points = np.frombuffer("".join(w + "\n" for w in words).encode("utf-32-le", "replace"), dtype="<u4")
        code = self._code[points]
        ends = np.flatnonzero(points == 0x0A)
        start = np.r_[0, ends[:-1] + 1]
        place = np.arange(len(code)) - np.repeat(start, np.diff(np.r_[start, len(code)]))
        cell = code.copy()
        for k in range(1, ORDER + 1):
            back = np.zeros_like(code)
            back[k:] = code[:-k]
            cell += np.where(place >= k, back, 0) * ALPHABET**k
        return cell, start

    def spell(self, words: list[str]) -> np.ndarray:
        """Log10 probability of each word's letters and end. A letter without a code is one of all code points."""
        return self.spell_cells(*self.cells(words)) if words else np.zeros(0)

    def spell_cells(self, cell: np.ndarray, start: np.ndarray) -> np.ndarray:
        log = self.logs[cell].astype(np.float64)
        log[cell % ALPHABET == OTHER] -= np.log10(_CODEPOINTS)
        return np.add.reduceat(log, start)


def sample_letters(cell: np.ndarray, count: np.ndarray, letters: list[int], rng: np.random.Generator, sweeps: int = SWEEPS) -> Letters:
    """Seat the customers of the longest contexts, their tables in the next shorter ones, and so on; again in each sweep.

    cell, count: distinct cells with the customers sent by the restaurant of words. At
    most CELLS of them, whatever the corpus.
    """
    total = np.zeros(CELLS)
    dense: list[np.ndarray] = []
    tables: list[np.ndarray | None] = [None] * (ORDER + 1)
    kept = 0
    # The prediction of the order below for each order's cells, at first as if every letter were as likely.
    for sweep in range(sweeps):
        keys, counts, ups = [cell], [count.astype(np.float64)], []
        for k in range(ORDER, -1, -1):
            size = ALPHABET**k  # contexts of this order
            key, n = keys[-1], counts[-1]
            below = dense[k - 1][key % (size if k else 1)] if dense and k else np.full(len(key), 1.0 / ALPHABET)
            context = key // ALPHABET
            d = discount_of(int((n == 1).sum()), int((n == 2).sum()))
            held = tables[k] if tables[k] is not None and len(tables[k]) == len(key) else np.minimum(n, 1)
            by_context = np.bincount(context, weights=held, minlength=size)[context] if len(key) else held
            t = seat(n, (LETTER_STRENGTH + d * np.maximum(by_context - held, 0)) * below, d, rng)
            tables[k] = t
            ups.append((k, key, n, t, d))
            if k:
                short, where = np.unique(key % (size), return_inverse=True)
                keys.append(short)
                counts.append(np.bincount(where, weights=t, minlength=len(short)))
        dense = []
        for k, key, n, t, d in reversed(ups):
            size = ALPHABET**k
            below = np.full((size, ALPHABET), 1.0 / ALPHABET) if not k else np.tile(dense[-1].reshape(-1, ALPHABET), (ALPHABET, 1))
            context = key // ALPHABET
            customers, opened = np.bincount(context, weights=n, minlength=size), np.bincount(context, weights=t, minlength=size)
            below *= ((LETTER_STRENGTH + d * opened) / (LETTER_STRENGTH + customers))[:, None]
            flat = below.reshape(-1)
            flat[key] += (n - d * t) / (LETTER_STRENGTH + customers)[context]
            dense.append(flat)
        if sweep >= sweeps // 2:
            total += dense[-1]
            kept += 1
    return Letters(letters, np.log10(total / max(kept, 1)).astype(np.float32))


class Words:
    """The restaurant of words: its size and, for each sample, how many tables all words have, and the letters below it."""

    def __init__(self, customers: int, discount: float):
        self.customers, self.discount = customers, discount
        #: For each sample its number, the letters, how many tables all words had when words were seated and have since, and
        #: the letters' probability outside the vocabulary.
        self.samples: list[tuple[int, Letters, float, float, float]] = []

    def tables(self, sample: int, key: np.ndarray, count: np.ndarray, spelled: np.ndarray, total: float) -> np.ndarray:
        """Tables of words with hashes ``key``: the same for a word wherever it is asked for."""
        strength = (WORD_STRENGTH + self.discount * max(total, 0.0)) * 10.0**spelled
        return seat_pairs(_mixed(key.view(np.uint64) + np.uint64(sample + 1)), count, np.maximum(strength, 1e-300), self.discount)

    def predict(self, words: list[str], key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Log10 of the averaged predictive probability of each word, given its hash and its count in training."""
        each = []
        if not words:
            return np.zeros(0)
        cells = self.samples[0][1].cells(words)  # all samples have the same codes
        for sample, letters, before, total, _ in self.samples:
            spelled = letters.spell_cells(*cells)
            new = np.log10((WORD_STRENGTH + self.discount * total) / (WORD_STRENGTH + self.customers)) + spelled
            own = np.maximum(count - self.discount * np.where(count > 0, self.tables(sample, key, count, spelled, before), 0), 0) / (WORD_STRENGTH + self.customers)
            each.append(np.where(own > 0, np.log10(np.maximum(own, 1e-300) + 10.0 ** np.maximum(new, -290)), new))
        return mean_log(each)

    def unknown(self) -> float:
        """Log10 probability that a token is any one outside the vocabulary."""
        return float(np.log10(np.mean([(WORD_STRENGTH + self.discount * total) / (WORD_STRENGTH + self.customers) * outside for _, _, _, total, outside in self.samples])))


def vocabulary(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, counts), some at a time, of packed rows (a: words, n: counts); words that don't count are left out."""
    for batch in batches:
        for words, numbers in zip(batch.column("a"), batch.column("n"), strict=True):
            n, words = unpacked(numbers.as_py(), np.uint64).astype(np.int64), unpacked_words(words.as_py())
            known = np.flatnonzero(n)
            for at in range(0, len(known), most):
                yield [words[i] for i in known[at : at + most]], n[known[at : at + most]]


def sizes_of(counts: DataFrame) -> dict[str, int]:
    """Of packed rows (a, n): customers n, words v, and words that occur once and twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4, dtype=np.int64)
        for _, n in vocabulary(batches):
            total += n.sum(), len(n), (n == 1).sum(), (n == 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in total], names=["n", "v", "one", "two"])

    found = counts.select("a", "n").mapInArrow(run, "n long, v long, one long, two long")
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in found.columns)).first().asDict()


@dataclass(frozen=True)
class Last:
    """Where a chain of samples stands: the last one's number, the letters that have codes, the cells that its words' tables reach, and how many tables that is."""

    sample: int
    known: list[int]
    cell: np.ndarray
    n: np.ndarray
    total: float


def fit(counts: DataFrame, after: Last | None = None) -> tuple[Words, Last]:
    """A sample of the restaurants of words and letters from packed rows (a: words, n: their customers), which goes on from an earlier one, or from a table for each word."""
    sizes = sizes_of(counts)
    model = Words(sizes["n"], discount_of(sizes["one"], sizes["two"]))
    context = counts.sparkSession.sparkContext
    counts = counts.select("a", "n")
    rng = np.random.default_rng(SEED + (after.sample if after else 0))

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CODEPOINTS, dtype=np.int64)
        for words, _ in vocabulary(batches):
            points = np.frombuffer(b"".join(words).decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype="<u4")
            value, n = np.unique(points, return_counts=True)
            total[value] += n
        at = np.flatnonzero(total)
        yield rows(pa.schema([("letter", pa.int64()), ("n", pa.int64())]), [at, total[at]])

    if after is None:
        found = counts.mapInArrow(letters, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
        known = [r["letter"] for r in found.where("letter <> 10").orderBy(F.desc("n"), "letter").limit(ALPHABET - 2).collect()]
    else:
        known = after.known

    def seated(sample: int, state: tuple[Letters, float] | None) -> tuple[Last, float]:
        """The words' tables given the letters and how many tables there were, or one for each; and what the letters leave for words outside the vocabulary."""
        shared = context.broadcast((Words(model.customers, model.discount), state, Letters(known, np.zeros(0, dtype=np.float32))))

        def reseat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words_, state_, coder = shared.value
            sums, opened, inside = np.zeros(CELLS), 0.0, 0.0
            for each, n in vocabulary(batches):
                words, count = [w.decode("utf-8", "replace") for w in each], n.astype(np.float64)
                cell, start = coder.cells(words)
                t = np.ones(len(words))
                if state_ is not None:
                    spelled = state_[0].spell_cells(cell, start)
                    t = words_.tables(sample, word_hash(each), count, spelled, state_[1])
                    inside += float((10.0**spelled).sum())
                opened += float(t.sum())
                np.add.at(sums, cell, np.repeat(t, np.diff(np.r_[start, len(cell)])))
            at = np.flatnonzero(sums)
            yield rows(pa.schema([("cell", pa.int64()), ("n", pa.float64())]), [np.r_[at, -1, -2], np.r_[sums[at], opened, inside]])

        summed = counts.mapInArrow(reseat, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        shared.destroy()
        cell, n = summed.column("cell").to_numpy(), summed.column("n").to_numpy()
        kept = np.flatnonzero(cell >= 0)
        kept = kept[np.argsort(cell[kept])]
        return Last(sample, known, cell[kept], np.rint(n[kept]), float(n[cell == -1].sum())), max(1 - float(n[cell == -2].sum()), 0.0)

    before = after or seated(0, None)[0]
    sampled = sample_letters(before.cell, before.n, known, rng)
    last, outside = seated(before.sample + 1, (sampled, before.total))
    model.samples.append((last.sample, sampled, before.total, last.total, outside))
    return model, last


def word_hash(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word, which Spark's ``xxhash64`` gives as well, as signed numbers."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), dtype=np.uint64, count=len(words)).view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's last steps over unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One number for each pair of signed word hashes."""
    return _mixed(_mixed(before.view(np.uint64)) + word.view(np.uint64))


def seat_pairs(key: np.ndarray, count: np.ndarray, strength: np.ndarray, discount: float) -> np.ndarray:
    """``seat`` with draws that depend on each dish's key alone, so that whoever needs its tables draws the same.

    The tables opened in a run are its mean, rounded up or down at random.
    """
    draw = lambda at, n: (_mixed(key[at] + np.uint64(n)) >> np.uint64(11)) / 2.0**53
    tables = np.minimum(count, 1).astype(np.float64)
    for n in range(1, 32):
        at = np.flatnonzero(count > n)
        if not len(at):
            return tables
        tables[at] += draw(at, n) * (strength[at] + n - discount * tables[at]) < strength[at]
    at, n = np.flatnonzero(count > 32), 32
    while len(at):
        stop = np.minimum(count[at], int(n * 1.1))
        base = strength[at] - discount * tables[at]
        mean = strength[at] * np.log(np.maximum(base + stop, 1e-9) / np.maximum(base + n, 1e-9))
        tables[at] += np.minimum(np.floor(mean + draw(at, n)), stop - n)
        n = int(n * 1.1)
        at = at[count[at] > n]
    return tables


def packed(x: np.ndarray) -> bytes:
    """Numbers as bytes, equal bytes of all of them together, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def packed_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(words) + b"\n")


def unpacked_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")[:-1]


def packed_ascending(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def bounds(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of so many equal ranges of 64-bit numbers starts and stops in ascending keys."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.r_[0, np.searchsorted(key, edges), len(key)]


@dataclass(frozen=True)
class Shares:
    """Stored shares: where they are, a table of their numbers dealt one to a task, and the type of document ids."""

    path: str
    numbers: DataFrame
    kind: str


def shares(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> Shares:
    """About ``share`` bytes of text in each share, at least one document: doc_ids, lengths, train, before, word, at, words.

    before, word: the distinct pairs of words next to each other, in order of their keys, as places among ``words``, the share's
    distinct words in order of their hash. at: the pair of each token. A text is cut into tokens, and pairs are found, once, here.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), train.cast("int").alias("train"))
    kind = held.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, size = TaskContext.get().partitionId(), 0, 0
        place: dict[bytes, int] = defaultdict(count().__next__)  # a new word gets the next number
        names: list[pa.Array] = []
        ids: list[np.ndarray] = []
        marks: list[int] = []

        def done() -> pa.RecordBatch:
            nonlocal place, names, ids, marks, made, size
            words = list(place)
            key = word_hash(words).view(np.uint64)
            order = np.argsort(key, kind="stable")
            at = np.empty(len(words), dtype=np.uint32)
            at[order] = np.arange(len(words), dtype=np.uint32)
            doc_ids = pa.concat_arrays(names)
            listed = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
            cols = [pa.array([(part << 32) | made], pa.int64()), listed]
            before, word, pair_at = pairs_of(at[np.concatenate(ids)].astype(np.int64), key[order])
            blobs = [packed(np.array([len(x) for x in ids], dtype=np.uint64)), packed(np.array(marks, dtype=np.uint8)), *(packed(x.astype(np.uint32)) for x in (before, word, pair_at)), packed_words([words[i] for i in order])]
            place, names, ids, marks, made, size = defaultdict(count().__next__), [], [], [], made + 1, 0
            return pa.RecordBatch.from_arrays(cols + [pa.array([x], pa.binary()) for x in blobs], names=["share", "doc_ids", "lengths", "train", "before", "word", "at", "words"])

        for batch in small_batches(batches, "text", 1_000_000):
            for i, text in enumerate(utf8(batch.column("text"))):
                t = tokens(text)
                ids.append(np.fromiter(map(place.__getitem__, t), dtype=np.uint32, count=len(t)))
                marks.append(batch.column("train")[i].as_py())
                names.append(batch.column("doc_id").slice(i, 1))
                size += len(text)
                if size >= share:
                    yield done()
        if ids:
            yield done()

    shape = f"share long, doc_ids array<{kind}>, lengths binary, train binary, before binary, word binary, at binary, words binary"
    path = f"{shared_dir(docs.sparkSession)}/shares-{uuid.uuid4().hex}"
    held.mapInArrow(run, shape).write.partitionBy("share").option("compression", "none").parquet(path)
    numbers = docs.sparkSession.read.schema(shape).parquet(path).select("share").distinct()
    return Shares(_uri(path), numbers.repartitionByRange(max(1, min(TASKS, numbers.count())), "share"), kind)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///", 1)


def _rows_at(path: str, share: int) -> pa.Table:
    system, base = fs.FileSystem.from_uri(path)
    return dataset.dataset(f"{base}/share={share}", filesystem=system, format="parquet").to_table()


def pairs_of(ids: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, word, at): the distinct pairs of tokens next to each other, as places among words of hashes ``key``, in order of their keys, and the pair of each token."""
    end = int(ids[-1])  # each text ends with it, and it stands before each text's first word
    code = np.r_[end, ids[:-1]] * len(key) + ids
    distinct, at = np.unique(code, return_inverse=True)
    before, word = distinct // len(key), distinct % len(key)
    order = np.argsort(pair_key(key[before].view(np.int64), key[word].view(np.int64)))
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return before[order], word[order], back[at]


class Pairs:
    """The distinct pairs of words next to each other of a share, in order of their keys.

    before, word: their places among the share's words; n: how often training texts of the share have them;
    at: the pair of each token.
    """

    def __init__(self, row: dict, key: np.ndarray):
        self.lengths, marks = unpacked(row["lengths"], np.uint64).astype(np.int64), unpacked(row["train"], np.uint8)
        self.before, self.word, self.at = (unpacked(row[c], np.uint32).astype(np.int64) for c in ("before", "word", "at"))
        self.key = pair_key(key[self.before].view(np.int64), key[self.word].view(np.int64))
        self.n = np.bincount(self.at, weights=None if marks.all() else np.repeat(marks, self.lengths), minlength=len(self.key)).astype(np.int64)


def _share(row: dict) -> tuple[list[bytes], np.ndarray, Pairs]:
    """A share's words, their unsigned hashes, and its pairs."""
    words = unpacked_words(row["words"])
    key = word_hash(words).view(np.uint64)
    return words, key, Pairs(row, key)


_SENT = "bucket int, share long, a binary, b binary, c binary"


def _sent(share: int, edges: np.ndarray, columns: list[list[bytes | None]]) -> pa.RecordBatch:
    n = len(edges) - 1
    columns = columns + [[None] * n] * (3 - len(columns))
    cols = [pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, share), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)]
    keep = pa.array(np.diff(edges) > 0)
    return pa.RecordBatch.from_arrays(cols, names=["bucket", "share", "a", "b", "c"]).filter(keep)


def _each_share(over: Shares, send: Callable[[dict], Iterator[pa.RecordBatch]], shape: str) -> DataFrame:
    """``send`` of each share, one at a time: a share and, as ``doc_ids``, an array of its documents' ids."""
    path = over.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share in batch.column("share").to_pylist():
                table = _rows_at(path, share)
                row = table.drop_columns(["doc_ids"]).to_pylist()[0]
                yield from send(row | {"share": share, "doc_ids": table.column("doc_ids").combine_chunks().flatten()})

    return over.numbers.mapInArrow(run, shape)


def _each_bucket(over: DataFrame, merge: Callable[[int, list[dict]], Iterator[tuple]], shape: str = _SENT) -> DataFrame:
    """``merge`` of the rows of each bucket, in order of their shares; it gives rows share, a, b, c."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["share"])
        out = list(zip(*merge(key[0].as_py(), found), strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        cols = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
        return pa.table([pa.array([key[0].as_py()] * len(cols[0]), pa.int32()), *cols], names=["bucket", "share", "a", "b", "c"])

    return over.groupBy("bucket").applyInArrow(run, shape)


def by_share(replies: DataFrame, name: str) -> str:
    """Where replies are stored by share."""
    path = f"{shared_dir(replies.sparkSession)}/{name}-{uuid.uuid4().hex}"
    replies.repartition("share").sortWithinPartitions("share", "bucket").write.partitionBy("share").option("compression", "none").parquet(path)
    return _uri(path)


def reply(path: str, share: int) -> list[dict]:
    """A share's replies, bucket by bucket."""
    return sorted(_rows_at(path, share).to_pylist(), key=lambda r: r["bucket"])


def _joined(replies: list[dict], column: str, kind: type) -> np.ndarray:
    return np.concatenate([unpacked(r[column], kind) for r in replies])


def count_words(over: Shares, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, places): of each bucket its words and counts in training texts (a, b); of each share and bucket its words' places there (a)."""

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        words, key, p = _share(row)
        n = np.bincount(p.word, weights=p.n, minlength=len(words)).astype(np.uint64)
        edges = bounds(key, buckets)
        yield _sent(row["share"], edges, [[packed_words(words[i:j]) for i, j in zip(edges, edges[1:], strict=False)], [packed(n[i:j]) for i, j in zip(edges, edges[1:], strict=False)]])

    def merge(bucket: int, found: list[dict]) -> Iterator[tuple]:
        place: dict[bytes, int] = {}
        total = np.zeros(0, dtype=np.uint64)
        for r in found:
            words = unpacked_words(r["a"])
            for w in words:
                if w not in place:
                    place[w] = len(place)
            at = np.fromiter(map(place.__getitem__, words), dtype=np.uint32, count=len(words))
            total = np.concatenate([total, np.zeros(len(place) - len(total), dtype=np.uint64)])
            total[at] += unpacked(r["b"], np.uint64)
            yield r["share"], packed(at), None, None
        yield -1, packed_words(list(place)), packed(total), None

    merged = stored(_each_bucket(_each_share(over, send, _SENT), merge), "words")
    return merged.where("share < 0"), merged.where("share >= 0").select("bucket", "share", "a")


def count_pairs(over: Shares, buckets: int) -> str:
    """Where shares find, of each of their pairs, how often all training texts have it (a), and whether it is this share's to tell of (b)."""

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        p = _share(row)[2]
        edges = bounds(p.key, buckets)
        cut = list(zip(edges, edges[1:], strict=False))
        yield _sent(row["share"], edges, [[packed_ascending(p.key[i:j]) for i, j in cut], [packed(p.n[i:j].astype(np.uint32)) for i, j in cut]])

    def merge(bucket: int, found: list[dict]) -> Iterator[tuple]:
        keys = [unpacked_ascending(r["a"]) for r in found]
        n = np.concatenate([unpacked(r["b"], np.uint32) for r in found])
        _, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(at, weights=n, minlength=len(first)).astype(np.uint32)[at]
        lead = np.zeros(len(at), dtype=np.uint8)
        lead[first] = 1
        lead[total == 0] = 0
        start = 0
        for r, k in zip(found, keys, strict=True):
            yield r["share"], packed(total[start : start + len(k)]), packed(lead[start : start + len(k)]), None
            start += len(k)

    sent = _each_share(over, send, _SENT)
    return by_share(_each_bucket(sent, merge), "pairs")


def _told(row: dict, path: str) -> tuple[Pairs, np.ndarray, np.ndarray, np.ndarray]:
    """A share's pairs, their counts in all training texts, those that are its to tell of, and its words' hashes."""
    _, key, p = _share(row)
    found = reply(path, row["share"])
    return p, _joined(found, "a", np.uint32).astype(np.int64), np.flatnonzero(_joined(found, "b", np.uint8)), key


def first_tables(over: Shares, path: str, buckets: int) -> DataFrame:
    """Of each share and bucket, over the pairs that it tells of: of its words as the word after, how many pairs (a), and as the word before, their customers (b) and pairs (c).

    Bucket -1 has in a how many pairs occur once and twice.
    """

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        p, c, lead, key = _told(row, path)
        k, cu, t0 = (np.bincount(x[lead], weights=w, minlength=len(key)).astype(np.uint64) for x, w in ((p.word, None), (p.before, c[lead]), (p.before, None)))
        edges = bounds(key, buckets)
        yield _sent(row["share"], edges, [[packed(x[i:j]) for i, j in zip(edges, edges[1:], strict=False)] for x in (k, cu, t0)])
        met = np.array([(c[lead] == 1).sum(), (c[lead] == 2).sum()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([row["share"]], pa.int64()), pa.array([met.tobytes()], pa.binary()), *(pa.array([None], pa.binary()) for _ in "bc")], names=["bucket", "share", "a", "b", "c"])

    return _each_share(over, send, _SENT)


def _summed(size: int, places: list[dict], sent: list[dict], column: str) -> np.ndarray:
    """Sums over shares of a number of each word of a bucket."""
    total, at = np.zeros(size, dtype=np.uint64), {r["share"]: unpacked(r["a"], np.uint32) for r in places}
    for r in sent:
        total[at[r["share"]]] += unpacked(r[column], np.uint64)
    return total


def _kinds(**tables: DataFrame) -> DataFrame:
    """Tables of one shape as one, each row with the name of its table."""
    return reduce(DataFrame.unionByName, (df.withColumn("kind", F.lit(name)) for name, df in tables.items()))


def _of(found: list[dict]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in found:
        out.setdefault(r["kind"], []).append(r)
    return out


def context_strength(tables: np.ndarray, log0: np.ndarray, discount: float) -> np.ndarray:
    return np.maximum((CONTEXT_STRENGTH + discount * tables) * 10.0 ** np.asarray(log0, dtype=np.float64), 1e-300)


def _seated(p: Pairs, c: np.ndarray, among: np.ndarray, t0: np.ndarray, log0: np.ndarray, discount: float, turn: int = 0) -> np.ndarray:
    """Tables of the pairs ``among`` a share's in a turn: whichever share asks, they are the same."""
    tables = np.minimum(c[among], 1).astype(np.float64)
    several = np.flatnonzero(c[among] > 1)  # a pair that occurs once has one table whatever is drawn
    at = among[several]
    key = _mixed(p.key[at] + np.uint64(turn)) if turn else p.key[at]
    tables[several] = seat_pairs(key, c[at], context_strength(t0[p.before[at]], log0[p.word[at]], discount), discount)
    return tables


def _start(found: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(tables of each of a share's words as the word before, log10 of its probability) of replies at the start."""
    return _joined(found, "a", np.uint64).astype(np.float64), _joined(found, "b", np.float32)


def _end(found: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log10 of the probability, counts, customers, tables) of each of a share's words, of replies at the end of a turn."""
    each = [np.split(unpacked(r["b"], np.uint64).astype(np.float64), 3) for r in found]
    return _joined(found, "a", np.float32), *(np.concatenate([x[j] for x in each]) for j in range(3))


def _given(path: str, share: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """What a turn is seated from: tables and log10 of probabilities, of the start or of the turn before."""
    found = reply(path, share)
    if not turn:
        return _start(found)
    log, _, _, t = _end(found)
    return t, log


def second_tables(over: Shares, pairs: str, start: str, buckets: int, discount: float, turn: int = 0) -> DataFrame:
    """Of each share and bucket, over the pairs that it tells of, seated anew: tables of its words as the word after (a), and before (b)."""

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        p, c, lead, key = _told(row, pairs)
        t = _seated(p, c, lead, *_given(start, row["share"], turn), discount, turn)
        k, t1 = (np.bincount(x[lead], weights=t, minlength=len(key)).astype(np.uint64) for x in (p.word, p.before))
        edges = bounds(key, buckets)
        yield _sent(row["share"], edges, [[packed(x[i:j]) for i, j in zip(edges, edges[1:], strict=False)] for x in (k, t1)])

    return _each_share(over, send, _SENT)


def predicted(words: list[bytes], count: np.ndarray, model: Words) -> np.ndarray:
    """Log10 of each word's probability in the restaurant of words, given its customers there; spelled if it has none."""
    parts = [model.predict([w.decode("utf-8", "replace") for w in words[i : i + 50_000]], word_hash(words[i : i + 50_000]), count[i : i + 50_000].astype(np.float64)) for i in range(0, len(words), 50_000)]
    return np.concatenate(parts or [np.zeros(0)]).astype(np.float32)


@dataclass(frozen=True)
class Turn:
    """A kept sample of all restaurants: where what it was told at its end is, and its model."""

    end: str
    model: Words | None


def seat_all(over: Shares, buckets: int, later: list[Turn] | None = None) -> tuple[DataFrame, DataFrame, str, str, str, Words | None, float]:
    """(vocabulary, second vocabulary, replies on pairs, at the start and at the end, the model, the contexts' discount) of the first turn.

    later: a list, which gets the further turns up to ``SEATINGS``, each seated from the one before; None takes none.

    vocabulary: of each bucket its words (a) and counts (b). Second vocabulary: words (a), their customers in the restaurant of words (b),
    and as the word before, their customers and tables (c). Replies at the start: t0 (a) and log0 (b); at the end: log (a), and counts, customers
    and tables (b).
    """
    counted, places = count_words(over, buckets)
    pairs = count_pairs(over, buckets)
    first = stored(first_tables(over, pairs, buckets), "first_tables")
    met = np.zeros(2, dtype=np.int64)
    for r in first.where("bucket < 0").select("a").toLocalIterator():  # two numbers of each share
        met += np.frombuffer(r["a"], dtype=np.uint64).astype(np.int64)
    discount = discount_of(int(met[0]), int(met[1]))
    blank = F.lit(None).cast("binary")
    placed = places.withColumns({"b": blank, "c": blank})
    context = over.numbers.sparkSession.sparkContext

    def open_(bucket: int, found: list[dict]) -> Iterator[tuple]:
        of = _of(found)
        words = of["vocabulary"][0]["a"]
        size = len(unpacked(of["vocabulary"][0]["b"], np.uint64))
        k, cu, t0 = (_summed(size, of["places"], of["first"], x) for x in "abc")
        yield -1, words, packed(k), packed(np.concatenate([cu, t0]))

    start_rows = stored(_each_bucket(_kinds(vocabulary=counted, places=placed, first=first.where("bucket >= 0")), open_), "start")
    start, last = fit(start_rows.select("a", F.col("b").alias("n")))
    usable = bool(start.customers)
    shared = context.broadcast(start)

    def tell(bucket: int, found: list[dict]) -> Iterator[tuple]:
        of = _of(found)
        mine = of["start"][0]
        words, k = unpacked_words(mine["a"]), unpacked(mine["b"], np.uint64)
        log0 = predicted(words, k, shared.value) if usable else np.zeros(len(words), dtype=np.float32)
        t0 = unpacked(mine["c"], np.uint64)[len(words) :]
        for r in of["places"]:
            at = unpacked(r["a"], np.uint32)
            yield r["share"], packed(t0[at]), packed(log0[at]), None

    told = by_share(_each_bucket(_kinds(start=start_rows, places=placed), tell), "told_start")
    def close(bucket: int, found: list[dict]) -> Iterator[tuple]:
        of = _of(found)
        mine = of["start"][0]
        cu = np.split(unpacked(mine["c"], np.uint64), 2)[0]
        k, t1 = (_summed(len(cu), of["places"], of["second"], x) for x in "ab")
        yield -1, mine["a"], packed(k), packed(np.concatenate([cu, t1]))

    def turned(turn: int, given: str, last: Last) -> tuple[DataFrame, Turn, Last]:
        """Contexts seated anew from what they are given, then words and letters from the contexts' tables."""
        second = stored(second_tables(over, pairs, given, buckets, discount, turn), "second_tables")
        end_rows = stored(_each_bucket(_kinds(start=start_rows, places=placed, second=second), close), "end")
        model, last = fit(end_rows.select("a", F.col("b").alias("n")), last) if usable else (None, last)
        ended = context.broadcast(model)

        def finish(bucket: int, found: list[dict]) -> Iterator[tuple]:
            of = _of(found)
            words, k = unpacked_words(of["end"][0]["a"]), unpacked(of["end"][0]["b"], np.uint64)
            log = predicted(words, k, ended.value) if usable else np.zeros(len(words), dtype=np.float32)
            c = unpacked(of["vocabulary"][0]["b"], np.uint64)
            cu, t1 = np.split(unpacked(of["end"][0]["c"], np.uint64), 2)
            for r in of["places"]:
                at = unpacked(r["a"], np.uint32)
                yield r["share"], packed(log[at]), packed(np.concatenate([c[at], cu[at], t1[at]])), None

        return end_rows, Turn(by_share(_each_bucket(_kinds(end=end_rows, vocabulary=counted, places=placed), finish), "told_end"), model), last

    end_rows, first_turn, last = turned(0, told, last)
    now = first_turn
    for turn in range(1, SEATINGS if later is not None else 1):
        _, now, last = turned(turn, now.end, last)
        later.append(now)
    return counted, end_rows, pairs, told, first_turn.end, first_turn.model, discount


def score_shares(over: Shares, pairs: str, start: str, end: str, model: Words | None, discount: float, n: int, v: int, later: list[Turn] | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, open_score of each document of the shares, by the mean of the first turn's probabilities and the later ones'."""
    base_new = float(np.log10(1.0 / (n + (v + 1))))
    turns = [Turn(end, model), *(later or [])]
    usable, unknown, ends = model is not None, [t.model.unknown() if t.model else base_new for t in turns], [t.end for t in turns]  # a task needs no more of the models

    def scored(row: dict) -> Iterator[pa.RecordBatch]:
        _, _, p = _share(row)
        count = _joined(reply(pairs, row["share"]), "a", np.uint32).astype(np.int64)
        met = np.flatnonzero(count)
        given = _given(start, row["share"], 0)
        total, behinds, closed = np.zeros(len(count)), [], []
        for turn, path in enumerate(ends):
            log, c, cu, t1 = _end(reply(path, row["share"]))
            own_log = log.astype(np.float64) if usable else np.full(len(c), base_new)
            new = np.flatnonzero(c[p.word] == 0)  # pairs with such a word have no customers
            held = cu + CONTEXT_STRENGTH
            back = np.log10((CONTEXT_STRENGTH + discount * t1) / held)
            own = np.zeros(len(count))
            own[met] = (count[met] - discount * _seated(p, count, met, *given, discount, turn)) / held[p.before[met]]
            behinds.append(back[p.before] + own_log[p.word])
            closed.append(back[p.before[new]] + unknown[turn])
            total += own + 10.0 ** np.maximum(behinds[-1], -290)
            given = t1, log
        open_ = np.log10(total / len(ends))
        low = np.flatnonzero(total < 1e-280)  # long words that are spelled
        open_[low] = mean_log([x[low] for x in behinds])
        both = [open_.copy(), open_]
        both[0][new] = mean_log(closed)
        base = np.log10(c + 1.0) + base_new
        stop = np.cumsum(p.lengths)
        sums = [np.add.reduceat(x[p.at], stop - p.lengths) for x in ((c > 0)[p.word].astype(np.int64), base[p.word], *both)]
        cols = [row["doc_ids"], pa.array(p.lengths, pa.int64()), pa.array(sums[0], pa.int64()), *(pa.array(x, pa.float64()) for x in sums[1:])]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_known", "base_score", "score", "open_score"])

    return _each_share(over, scored, f"doc_id {over.kind}, n_tokens long, n_known long, base_score double, score double, open_score double")


def score_held_out(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, out: int = 2) -> DataFrame:
    """Learn from the rows whose crc32 of the id isn't ``out`` modulo ``folds`` and score all.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, open_score; the
    perplexity of a text is 10 ** (-score / n_tokens). Null text counts as empty:
    its one token is the end. Counts cover all training rows, repeated ones as
    often as they occur; repeated rows, and texts that tie, have the same score. Without training rows, all scores are the base score. An empty table
    gives no rows. Null ids are ids like any other. Very long texts are read whole. Other columns, whatever their names, have no effect.
    """
    held = F.pmod(id_hash(F.col(id_col)), F.lit(folds)) == out
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    over = shares(docs, ~held, id_col=id_col, text_col=text_col)
    later: list[Turn] = []
    counted, _, pairs, start, end, model, discount = seat_all(over, max(1, -(-size // BUCKET)), later)
    sizes = sizes_of(counted.select("a", F.col("b").alias("n")))
    scored = score_shares(over, pairs, start, end, model, discount, sizes["n"], sizes["v"], later)
    return scored.select(
        "doc_id", (F.pmod(id_hash(F.col("doc_id")), F.lit(folds)) == out).alias("held_out"), "n_tokens", "n_known", F.lit(sizes["n"]).cast("long").alias("train_tokens"), "base_score", "score", "open_score"
    )
