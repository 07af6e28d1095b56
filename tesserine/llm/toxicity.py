"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A
text is cut into windows at white space, each is compressed with either
dictionary, and the distance of a window is the number of bytes by which the
toxic dictionary makes it shorter. What so many bytes tell is learned from the
windows of training documents, a document's distance is what its most telling
windows tell, and its score the share of toxic documents among training documents
at that distance, made monotone.

Toxic documents are ordinary text for the most part, and dictionaries trained on
two samples of ordinary text differ by chance far more than by a few words. So the samples
that zstandard trains the toxic dictionary on are distilled first: of the training half's toxic
documents, those stretches that toxic ones have in many different surroundings and ordinary ones hardly at all. What of
them enters the dictionary, how often and in which order, is the trainer's choice. The other dictionary is trained on
ordinary text, and as common ground it also stands before the toxic one's material, so that a
difference in length is about that material.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_hash, small_batches, utf8
from .quality import training_rows

#: Bytes of a window and of the ordinary dictionary, compression level, and most training documents of either label.
WINDOW, DICTIONARY, LEVEL, FIT = 96, 16 << 10, 8, 3000
#: Stands before each window and in both dictionaries, so that a window always has a match and is never stored as it is.
LEAD = bytes(range(0x80, 0xC0)) + b" "
#: Bytes saved that count as most, and windows that make up a document's distance: the most telling of all its windows.
MOST, TOP = 12, 5
#: Bytes of a toxic fragment (the shortest is zstandard's shortest match here), surroundings that it has at least, times as
#: common as in ordinary texts at least, and times as many texts that have it.
FRAGMENT, CONTEXTS, RATIO, HELD = (5, 7), 6, 30.0, 5.0
#: Least bytes of the toxic dictionary, its bytes for each byte of distinct fragments, and occurrences in one training sample.
TOXIC, REPEATS, TOGETHER = 512, 4, 8


def normal(text: bytes) -> bytes:
    """Lower-cased in A-Z, white space as single spaces, with a space at either end."""
    return b" " + b" ".join(text.lower().split()) + b" "


def windows(text: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """The whole of a normal text in pieces of about ``size`` bytes, cut at spaces where there are any."""
    at, n = 0, len(text)
    while n - at > size:
        stop = text.rfind(b" ", at + 1, at + size)
        stop = at + size if stop <= at else stop
        yield text[at : stop + 1]
        at = stop
    if n - at > 1 or not at:
        yield text[at:]


def distil(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Fragments that toxic texts have and ordinary ones hardly do, the widest spread first.

    Of all strings of the lengths ``FRAGMENT`` that start words, those in enough toxic texts
    and ``RATIO`` times as common there as in ordinary text are candidates. The one in most texts is taken, the
    words that hold it are struck out, and so on with what is left, until none is in
    enough texts. A few documents can't make a fragment of theirs look widespread:
    it must occur in that many different surroundings (``CONTEXTS``, or 1% of texts).
    """
    if not toxic:
        return []
    least = max(CONTEXTS, len(toxic) // 100)
    each = [_grams(t) for t in toxic]
    gram, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
    docs = np.bincount(at, minlength=len(gram))
    wide = docs >= least
    often = np.bincount(at, weights=np.concatenate([n for _, n in each]), minlength=len(gram))[wide]
    gram, docs = gram[wide], docs[wide]
    if not len(gram):
        return []
    against, other = np.zeros(len(gram)), np.zeros(len(gram))
    for t in ordinary:
        g, n = _grams(t)
        at = np.minimum(np.searchsorted(gram, g), len(gram) - 1)
        same = gram[at] == g
        against[at[same]] += n[same]
        other[at[same]] += 1
    rate = often / sum(map(len, toxic)) / ((against + 0.5) / (sum(map(len, ordinary)) + 1))
    held_by = docs / len(toxic) / ((other + 0.5) / (len(ordinary) + 1))
    good = (rate >= RATIO) & (held_by >= HELD)
    gram, against = gram[good], against[good]
    clean = set(gram[against == 0].tolist())
    rest = np.unique(np.concatenate([_grams(t, True)[0] for t in ordinary])) if ordinary else None
    texts = list(toxic)
    held = [g[np.isin(g, gram, assume_unique=True)] for g, _ in each]
    chosen: list[bytes] = []
    while True:  # each turn strikes out words of several texts
        value, n = np.unique(np.concatenate(held), return_counts=True)
        picked, passed = None, []
        for k in np.lexsort((value, -n)):
            if n[k] < least:
                break
            if _surroundings(_fragment(value[k]), texts, held, value[k]) >= least:
                picked = value[k]
                break
            passed.append(value[k])
        if picked is None:
            break
        fragment = _fragment(picked)
        chosen.append(_extended(fragment, texts, held, picked, rest if picked in clean else None))
        word = re.compile(rb"[^ ]*" + re.escape(fragment.strip(b" ")) + rb"[^ ]*")
        for i, h in enumerate(held):
            if np.any(h == picked):
                texts[i] = word.sub(b"", texts[i])
                g, _ = _grams(texts[i])
                held[i] = g[np.isin(g, gram, assume_unique=True)]
        if passed:
            held = [h[~np.isin(h, passed)] for h in held]
    return chosen


def _grams(text: bytes, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of each fragment length at the starts of words (or within them as well), as numbers (the length, then its bytes), and their counts."""
    raw = np.frombuffer(text, dtype=np.uint8).astype(np.int64)
    gaps = np.cumsum(np.r_[0, raw == 0x20])
    out = [np.zeros(0, dtype=np.int64)]
    for size in FRAGMENT:
        if len(raw) >= size:
            n = len(raw) - size + 1
            value = np.full(n, size, dtype=np.int64)
            for i in range(size):
                value = value * 256 + raw[i : n + i]
            inner = gaps[size - 1 : size - 1 + n] - gaps[1 : n + 1]  # spaces but at its ends
            out.append(value[(inner == 0) & ((raw[:n] == 0x20) | every)] << (8 * (7 - size)))
    return np.unique(np.concatenate(out), return_counts=True)


def _number(fragment: bytes) -> int:
    return int.from_bytes(bytes([len(fragment)]) + fragment.ljust(7, b"\0"), "big")


def _fragment(number: int) -> bytes:
    raw = int(number).to_bytes(8, "big")
    return raw[1 : 1 + raw[0]]


def _extended(fragment: bytes, texts: list[bytes], held: list[np.ndarray], value: int, common: np.ndarray | None, most: int = 12) -> bytes:
    """A fragment with the bytes that nearly always follow it.

    common: strings of ordinary text. None of them may then end the longer fragment,
    so that ordinary windows find no part of it; a fragment that ordinary text has
    as well gets no such list, since it needs its length to be told from others.
    """
    following = []
    for t, h in zip(texts, held, strict=True):
        if np.any(h == value):
            at = t.find(fragment) + len(fragment)
            following.append(t[at : at + most])
    while len(fragment) < most:
        byte = max((f[:1] for f in following), key=[f[:1] for f in following].count)
        following = [f[1:] for f in following if f[:1] == byte] if [f[:1] for f in following].count(byte) >= 0.9 * len(following) else []
        longer = fragment + byte
        if not byte or not following or (common is not None and common[np.minimum(np.searchsorted(common, _number(longer[-FRAGMENT[0] :])), len(common) - 1)] == _number(longer[-FRAGMENT[0] :])):
            break
        fragment = longer
    return fragment


def _surroundings(fragment: bytes, texts: list[bytes], held: list[np.ndarray], value: int) -> int:
    """In how many different surroundings texts have a fragment."""
    found: set[bytes] = set()
    for t, h in zip(texts, held, strict=True):
        if np.any(h == value):
            at = t.find(fragment)
            found.add(t[max(0, at - 8) : at] + t[at + len(fragment) : at + len(fragment) + 8])
    return len(found)


def unlike(texts: list[bytes], words_each: int = 5, most: float = 0.4) -> list[bytes]:
    """The texts without those of which too many word shingles were seen in those before them."""
    seen: set[int] = set()
    kept = []
    for t in texts:
        words = t.split()
        mine = {hash(tuple(words[i : i + words_each])) for i in range(max(1, len(words) - words_each + 1))}
        if len(mine & seen) <= most * len(mine):
            kept.append(t)
            seen |= mine
    return kept


def occurrences(fragments: list[bytes], texts: list[bytes], together: int = TOGETHER) -> list[bytes]:
    """Training samples: the fragments as the texts have them, in a fixed random order, several to a sample.

    They are parted by a byte that no UTF-8 text has, so that no match runs over two of them.
    """
    if not fragments:
        return []
    any_of = re.compile(b"|".join(re.escape(f) for f in sorted(fragments, key=len, reverse=True)))
    found = [f for t in texts for f in any_of.findall(t)]
    found = [found[i] for i in np.random.default_rng(0).permutation(len(found))]
    return [b"\xff" + b"\xff".join(found[i : i + together]) + b"\xff" for i in range(0, len(found), together)]


def trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary's content; of samples too few or too small to train on, they themselves."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], size: int = DICTIONARY) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary contents; texts are normal ones. They are of equal length, the ordinary one filled up."""
    fragments = distil(unlike(toxic), unlike(ordinary))
    own = trained(max(TOXIC, REPEATS * sum(len(f) + 1 for f in fragments)), occurrences(fragments, toxic))
    base = trained(size, [w for t in ordinary for w in windows(t, 512)])
    base = base[-(size * 3 // 4) :]  # its content stands at its end, after its tables
    return LEAD + base + own, LEAD + base + b"\xff" * len(own)


class Model:
    """The two dictionaries and the calibration: share of toxic documents for each distance."""

    def __init__(self, toxic: bytes, ordinary: bytes, shares: np.ndarray, low: int):
        self.contents, self.shares, self.low = (toxic, ordinary), shares, low
        self.evidence = np.arange(MOST + 1, dtype=float)
        self._open: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": None}

    def _compressors(self) -> tuple:
        if self._open is None:
            given = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=FRAGMENT[0], source_size=WINDOW, dict_size=len(self.contents[0]), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False)
            self._open = tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=given).compress for c in self.contents)
        return self._open

    def saved(self, text: bytes) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window, 0 to MOST."""
        toxic, ordinary = self._compressors()
        return np.clip([len(ordinary(w)) - len(toxic(w)) for w in map(LEAD.__add__, windows(normal(text)))], 0, MOST)

    def distance(self, text: bytes) -> int:
        """Sum of the evidence of the ``TOP`` most telling windows, in quarters of a natural logarithm."""
        found = np.sort(self.evidence[self.saved(text)])[-TOP:]
        return int(4 * found.sum() + 0.5)

    def score(self, text: bytes) -> float:
        return float(self.shares[np.clip(self.distance(text) - self.low, 0, len(self.shares) - 1)])


def evidence(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> np.ndarray:
    """For each number of bytes saved, how much likelier windows of toxic documents save as much: a logarithm, 0 at least, rising."""
    a, b = (np.bincount(np.concatenate(x), minlength=MOST + 1) for x in (toxic, ordinary))
    # At least so many bytes: a window that saves more tells no less.
    a, b = (np.cumsum(x[::-1])[::-1] for x in (a, b))
    return np.maximum.accumulate(np.maximum(0.0, np.log((a + 0.1) / a[0] / ((b + 0.5) / b[0]))))


def calibrate(distance: np.ndarray, label: np.ndarray, share: float) -> tuple[np.ndarray, int]:
    """Monotone shares of label 1 from the lowest to the highest distance, by pooling adjacent violators.

    share: that of label 1 where documents come from; the sample's own may differ.
    """
    low, high = int(distance.min()), int(distance.max())
    n1, n0 = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
    weight = np.where(label == 1, share / n1, (1 - share) / n0) * len(label)
    pools: list[list[float]] = []
    for d in range(low, high + 1):
        at = distance == d
        pools.append([float(weight[at & (label == 1)].sum()) + 0.02 * share, float(weight[at].sum()) + 0.02, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            one, all_, k = pools.pop()
            pools[-1] = [pools[-1][0] + one, pools[-1][1] + all_, pools[-1][2] + k]
    return np.concatenate([np.full(int(k), one / all_) for one, all_, k in pools]), low


def train(toxic: list[bytes], ordinary: list[bytes], share: float | None = None) -> Model:
    """Half of the documents make the dictionaries, the other half calibrate them."""
    texts = [[normal(t) for t in x] for x in (toxic, ordinary)]
    model = Model(*dictionaries(texts[0][::2], texts[1][::2]), np.array([0.0]), 0)
    left = [(t, label) for label, x in ((1, toxic[1::2]), (0, ordinary[1::2])) for t in x]
    label = np.array([x for _, x in left])
    if len(left) and label.min() != label.max():
        model.evidence = evidence(*([model.saved(t) for t, y in left if y == x] for x in (1, 0)))
        distance = np.array([model.distance(t) for t, _ in left])
        model.shares, model.low = calibrate(distance, label, share if share is not None else len(toxic) / (len(toxic) + len(ordinary)))
    elif len(toxic) and not len(ordinary):
        model.shares = np.array([1.0])
    return model


def fit(docs: DataFrame, labels: DataFrame, train_rows, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = FIT) -> Model:
    """A model from at most ``most`` labelled documents of either label, read whole."""
    both = [[t for t, _ in training_rows(docs, labels.where(F.col(label_col) == x), train_rows, id_col=id_col, text_col=text_col, label_col=label_col, fit=most)] for x in (1, 0)]
    n = {r[label_col]: r["count"] for r in labels.where(F.col(label_col).isin(0, 1) & train_rows).groupBy(label_col).count().collect()}
    return train(*both, share=n.get(1, 0) / max(1, sum(n.values())))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", at: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of each row; null text counts as empty."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    shape = source.select("doc_id", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [shared.value.score(x) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return source.mapInArrow(run, shape).withColumn("predicted", (F.col("score") >= at).cast("int"))


def classify_held_out(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, out: int = 2, at: float = 0.3) -> DataFrame:
    """Fit on labelled rows whose crc32 of the id isn't ``out`` modulo ``folds``; doc_id, held_out, score, predicted of all rows.

    Without labelled rows every score is 0; with toxic ones only, 1. An id with
    both labels is in either sample. Null and empty texts have the lowest distance and its
    score. A score of just ``at`` counts as 1. Repeated rows are each scored; of rows that share a labelled id, each is training text. Very long texts are cut into windows whole. An empty
    table gives no rows. Other columns, whatever their names, have no effect.
    """
    held = F.pmod(id_hash(F.col(id_col)), F.lit(folds)) == out
    model = fit(docs, labels, ~held, id_col=id_col, text_col=text_col, label_col=label_col)
    scored = score(docs, model, id_col=id_col, text_col=text_col, at=at)
    return scored.select("doc_id", (F.pmod(id_hash(F.col("doc_id")), F.lit(folds)) == out).alias("held_out"), "score", "predicted")
