"""Token ids in compressed files: an adaptive, context-mixing range coder.

A file is a header, the documents' ids and lengths, and blocks. Each block is coded by
itself: its model starts anew, its bytes end with their CRC, and the ids in it have
another, so a damaged block is found and costs no other one.

Symbols. What is coded are symbols, each of which stands for one id or for several: all ids of the file
have one, words that are frequent in the file have one, and so have pairs of symbols that are frequent in
the spellings of its other words. The header says what each stands for.

Model. For each symbol there are up to three predictions: order 2, the symbol that last followed
the two before; order 1, the symbol that last followed the one before; order 0, all
symbols of the file by how often they occur. For order 0 the header has several tables of frequencies, each
fitted to stretches of the file that are alike (texts in one language, say), with some weight for any symbol. A block
starts with the first, keeps account of how well each would have coded its last symbols, and
goes over to whichever does best; so order 0 adapts as well, and is reset with the block.
The other two are remembered in small tables that both sides keep alike. All are
mixed: the order-0 distribution has a part of the probability, and the predicted symbols have
the rest as spikes on top of it. How much a spike weighs adapts to how often predictions
of that order and confidence came true in the block so far. The mixed distribution
drives a 32-bit range coder. In the coder's own names, a symbol is an id.

Speed. Blocks don't depend on each other, so all blocks of a file are coded in step, one
numpy lane for each: the loop over a block's ids is the only one in Python.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, small_batches
from .tokens import encoder

END_ID, BLOCK, FILE_IDS, PART_BYTES = 2, 512, 1 << 23, 16 << 20
#: Parts whose totals are summed in one window, and tasks that read files at most: beyond that many files, each reads several.
TOGETHER, TASKS = 4096, 1 << 17
MAGIC, VERSION, SHAPE = b"TSTK", 3, "<4sHHQQIIIII"
#: How often a word occurs in a file that has a symbol of its own, a pair in the spellings of others, and rounds of pairing.
OFTEN, PAIRED, PAIRINGS = 4, 16, 2
#: Bytes of text whose words are told apart at a time.
FILE_TEXT_BYTES = 16 << 20
#: Order-0 tables of a file, ids of a stretch that they are fitted to, rounds of fitting, and how fast a block forgets how well they did.
TABLES, STRETCH, ROUNDS, FORGET = 12, 128, 6, 0.97
#: Bits of the mixed distribution, and slots of a lane's table of order 2 at most; it has about one for each symbol of a block, order 1 half as many.
_BITS, _SLOTS = 22, 2048
_TOTAL = 1 << _BITS
_MASK, _ONE, _THREE, _EIGHT, _32 = (np.uint64(n) for n in (0xFFFFFFFF, 1, 3, 8, 32))
_CUT, _SMALL, _CUT_MASK = np.uint64(_BITS), np.uint64(1 << _BITS + 2), np.uint64((1 << _BITS + 2) - 1)
_ALIKE = [np.uint64(1 << n) for n in (24, 16, 8)]
#: Confidence classes: has the prediction of this slot come true last time, and before.
_CLASSES = 4
#: The class after one that failed, and after one that came true.
_SURER = np.array([0, 0, 1, 2, 1, 2, 3, 3])


class _Model:
    """The lanes' tables and adaptive weights; encoder and decoder step through it alike.

    Arrays of two rows hold order 1 in the first and order 2 in the second.
    """

    def __init__(self, lanes: int, longest: int, tables: "Tables"):
        self.tables = tables
        self.slots2 = min(_SLOTS, 1 << max(8, (longest - 1).bit_length()))
        self.slots1 = self.slots2 // 2
        #: How many bits each table would have saved on the lane's last ids, and the one in use, as an offset.
        self.saved = np.zeros((lanes, tables.many), dtype=np.float32)
        self.offset = np.zeros(lanes, dtype=np.int64)
        # All lanes' slots of order 1, then those of order 2; hits and trials likewise, but lane by lane.
        lane = np.arange(lanes)
        self.slots = np.stack([lane * self.slots1, lanes * self.slots1 + lane * self.slots2])
        # A slot holds its id times _CLASSES, plus its class; ids are places among the file's own, far fewer than would fit.
        self.slot = np.full(lanes * (self.slots1 + self.slots2), -_CLASSES, dtype=np.int32)
        # Hits and trials of each order and class, per lane; the start favours what usually holds.
        start = np.array([[0.05, 0.2, 0.5, 0.8], [0.15, 0.5, 0.8, 0.95]])
        self.classes = np.stack([lane * 2 * _CLASSES, lane * 2 * _CLASSES + _CLASSES])
        self.hits = np.repeat(start[None] * 4, lanes, axis=0).reshape(-1)
        self.trials = np.full(lanes * 2 * _CLASSES, 4.0)
        self.before = np.zeros(lanes, dtype=np.int64)
        self.last = np.zeros(lanes, dtype=np.int64)
        self.at = np.empty((2, lanes), dtype=np.int64)
        self.room = _TOTAL - max(1 << 17, tables.total)  # order 0 always has its part, so that any id can be coded

    def step(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predicted ids (-1: none), their spikes (nothing where there is none), and what order 0 has, of _TOTAL."""
        one = self.last * 40503
        np.bitwise_and(one >> 4, self.slots1 - 1, out=self.at[0])
        np.bitwise_and((one ^ (self.before * 30011)) >> 3, self.slots2 - 1, out=self.at[1])
        self.at += self.slots
        found = self.slot.take(self.at).astype(np.int64)
        self.held = found & (_CLASSES - 1)
        self.p = p = found >> (_CLASSES.bit_length() - 1)
        self.c = self.classes + self.held
        self.hit, self.tried = self.hits.take(self.c), self.trials.take(self.c)
        self.known = (p >= 0).astype(np.float64)
        w = self.hit / self.tried
        w *= self.known
        w[0] *= p[0] != p[1]
        w[0] *= 1.0 - w[1]
        w *= self.room
        s = w.astype(np.int64)
        return p, s, _TOTAL - s[0] - s[1]

    def learn(self, ids: np.ndarray, came: np.ndarray) -> None:
        """came: where the predictions were the ids."""
        fade = self.known * -0.02
        fade += 1.0
        self.hit *= fade
        self.hit += came
        self.tried *= fade
        self.tried += self.known
        # By indices in one row: numpy stores by those several times as fast.
        c = self.c.reshape(-1)
        self.hits[c], self.trials[c] = self.hit.reshape(-1), self.tried.reshape(-1)
        # A prediction that came true grows surer; a sure one that failed once is kept, less sure.
        value = np.where(self.held > 1, self.p, ids)
        value *= _CLASSES
        self.held += came.astype(np.int64) * _CLASSES
        value += _SURER.take(self.held)
        self.slot[self.at.reshape(-1)] = value.astype(np.int32).reshape(-1)
        self.before, self.last = self.last, ids
        if self.tables.many > 1:
            self.saved *= np.float32(FORGET)
            self.saved += self.tables.bits.take(ids, axis=0)
            self.offset = self.saved.argmax(axis=1) * self.tables.step


def order0(counts: np.ndarray) -> np.ndarray:
    """Cumulative frequencies of all ids, each 1 at least; ids that occur share 2 to the 16."""
    total = max(1, int(counts.sum()))
    share = counts.astype(np.int64) * (1 << 16) // total + 1
    return np.concatenate(([0], np.cumsum(share)))


class Tables:
    """Several order-0 tables as one: table k's cumulative frequencies stand at ``step`` * k."""

    def __init__(self, counts: np.ndarray):
        """counts: a row of counts for each table."""
        each = [order0(c) for c in counts]
        # One total for all, so that a stretch of each is found by one search.
        self.total = max(int(c[-1]) for c in each)
        for c in each:
            c[-1] = self.total
        self.many, self.step = len(each), len(each[0])
        self.flat = np.concatenate(each)
        self.starts = self.flat.astype(np.float64)
        share = np.stack([np.diff(c) for c in each], axis=1)
        self.bits = np.log2(share).astype(np.float32)
        self.share = share

    def scaled(self, at: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Where the lane's table, which has ``part`` of _TOTAL, puts the start of an id; at: the table's offset and the id.

        Products and totals are far below 2 to the 53, so a quotient of doubles has the integers' whole part.
        """
        found = self.starts.take(at)
        found *= part
        found /= self.total
        return found.astype(np.int64)

    def holders(self) -> np.ndarray:
        """The id that holds each of the ``total`` places of a table, one table after another."""
        ids = np.arange(self.step - 1, dtype=np.int32)
        return np.concatenate([np.repeat(ids, self.share[:, k]) for k in range(self.many)])


def fit_tables(ids: np.ndarray, size: int, tables: int = TABLES) -> np.ndarray:
    """Counts of ids, all below ``size``, in groups of stretches that one table codes well: k-means by coded length, from stretches far apart.

    The first group is the whole file. Fitted on all stretches, however many; which groups are found
    has an effect on the size of the file only.
    """
    whole = np.bincount(ids, minlength=size)
    n = len(ids) // STRETCH
    if not n:
        return whole[None]
    local = ids[: n * STRETCH].reshape(n, STRETCH)
    prior = np.maximum(whole, 1) / whole.sum()
    logs = lambda c: np.log((c + 200 * prior) / (c.sum() + 200)).astype(np.float32)
    coded = lambda c: logs(c)[local].sum(axis=1)
    # Each further start is the stretch that the ones before code worst.
    counts = [np.bincount(local[0], minlength=size)]
    cost = coded(counts[0])
    for _ in range(tables - 2):
        counts.append(np.bincount(local[int(cost.argmin())], minlength=size))
        cost = np.maximum(cost, coded(counts[-1]))
    group = np.zeros(0, dtype=np.int64)
    for _ in range(ROUNDS):
        before, group = group, np.stack([coded(c) for c in counts]).argmax(axis=0)
        if np.array_equal(before, group):
            break
        counts = [np.bincount(local[group == k].reshape(-1), minlength=size) for k in range(len(counts))]
        # A table that few stretches have is not worth its place in the header; the others code those from then on.
        worth = [k for k, c in enumerate(counts) if c.sum() > 4 * size]
        if not worth:
            return whole[None]
        if len(worth) < len(counts):
            counts, group = [counts[k] for k in worth], np.zeros(0, dtype=np.int64)
    return np.stack([whole, *counts])


def encode_blocks(blocks: list[np.ndarray], tables: Tables) -> list[bytes]:
    """The coded bytes of each block of ids."""
    if not blocks:
        return []
    lanes, longest = len(blocks), max(map(len, blocks))
    size = np.array([len(b) for b in blocks])
    order = np.argsort(-size, kind="stable")
    rows = np.zeros((lanes, longest), dtype=np.int64)
    for lane, k in enumerate(order):
        rows[lane, : size[k]] = blocks[k]
    ids = np.ascontiguousarray(rows.T)
    del rows
    live = np.searchsorted(-size[order], -np.arange(longest), side="left")
    model = _Model(lanes, longest, tables)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 0xFFFFFFFF, dtype=np.uint64)
    # Carry-less output: the range is cut so that its top byte is settled; bytes go to a growing matrix. All four
    # of ``low`` are put, of which those that aren't settled are put again later.
    room = longest * 4 + 8
    out = np.zeros(lanes * room + 4, dtype=np.uint8)
    words = np.ndarray(lanes * room, dtype=">u4", buffer=out, strides=(1,))
    n = np.arange(lanes) * room

    def put(at: slice | np.ndarray, low: np.ndarray, settled: np.ndarray) -> None:
        words[n[at]] = low.astype(">u4")
        n[at] += settled

    for t in range(longest):
        x = ids[t]
        p, s, part = model.step()
        start, share, came = _share(tables, model.offset + x, x, p, s, part)
        _narrow(low, width, live[t], start, share, put)
        model.learn(x, came)
    words[n] = low
    coded = [out[room * lane : stop].tobytes() for lane, stop in enumerate((n + 4).tolist())]
    result = [b""] * lanes
    for lane, k in enumerate(order):
        result[k] = coded[lane]
    return result


def _share(tables: Tables, at: np.ndarray, x: np.ndarray, p: np.ndarray, s: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the mixed distribution has ``x``, how much it has of it, and which predictions it is."""
    part = part.astype(np.float64)
    start = tables.scaled(at, part)
    share = tables.scaled(at + 1, part)
    share -= start
    came = p == x
    below = s * (p < x)
    at_x = s * came
    start += below[0]
    start += below[1]
    share += at_x[0]
    share += at_x[1]
    return start, share, came


def _settled(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """How many of the top bytes are settled."""
    differ = low + width
    differ ^= low
    n = (differ < _ALIKE[0]).view(np.uint8) + (differ < _ALIKE[1]).view(np.uint8)
    n += (differ < _ALIKE[2]).view(np.uint8)
    return n.astype(np.uint64)


def _narrow(low: np.ndarray, width: np.ndarray, live: int, start: np.ndarray, share: np.ndarray, pass_on: Callable[[slice | np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """The ranges of the first ``live`` lanes, cut to the stretch of an id, without the top bytes that are settled then.

    pass_on: called with lanes, their ``low`` and how many of its bytes are settled, before those go.
    """
    l, w = low[:live], width[:live]
    w >>= _CUT
    l += w * start[:live].view(np.uint64)
    l &= _MASK
    w *= share[:live].view(np.uint64)
    n = _settled(l, w)
    pass_on(slice(0, live), l, n.view(np.int64))
    n <<= _THREE
    l <<= n
    l &= _MASK
    w <<= n
    # Ranges that are too small to wait for their top byte are cut where it would change.
    small = w < _SMALL
    while small.any():
        at = np.flatnonzero(small)
        l, w = low[at], (np.uint64(0) - low[at]) & _CUT_MASK
        pass_on(at, l, np.ones(len(at), dtype=np.int64))
        low[at], width[at] = (l << _EIGHT) & _MASK, w << _EIGHT
        small = width[:live] < _SMALL


def decode_blocks(coded: list[bytes], sizes: list[int], tables: Tables) -> list[np.ndarray]:
    """The ids of each block."""
    if not coded:
        return []
    size = np.array(sizes)
    lanes, longest = len(coded), int(size.max(initial=0))
    order = np.argsort(-size, kind="stable")
    room = max(map(len, coded)) + 16
    data = np.zeros(lanes * room + 4, dtype=np.uint8)
    for lane, k in enumerate(order):
        data[lane * room : lane * room + len(coded[k])] = np.frombuffer(coded[k], dtype=np.uint8)
    #: Four bytes from each place on.
    words = np.ndarray(lanes * room, dtype=">u4", buffer=data, strides=(1,)).astype(np.uint32)
    live = np.searchsorted(-size[order], -np.arange(longest), side="left")
    model = _Model(lanes, longest, tables)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 0xFFFFFFFF, dtype=np.uint64)
    n, last = np.arange(lanes) * room, np.arange(1, lanes + 1) * room - 8
    code = words[n].astype(np.uint64)
    n += 4
    ids = np.zeros((longest, lanes), dtype=np.int64)
    holders = tables.holders()

    def shift(at: slice | np.ndarray, low: np.ndarray, settled: np.ndarray) -> None:
        bits = settled.view(np.uint64) << _THREE
        next_ = words.take(n[at]).astype(np.uint64)
        next_ >>= _32 - bits
        bits = code[at] << bits
        bits &= _MASK
        bits |= next_
        code[at] = bits
        n[at] = np.minimum(n[at] + settled, last[at])

    for t in range(longest):
        p, s, part = model.step()
        m = live[t]
        value = np.minimum(((code - low) & _MASK) / np.maximum(width >> _CUT, _ONE), _TOTAL - 1).astype(np.int64)
        x = _find(tables, holders, model.offset, value, p, s, part)
        x[m:] = 0
        start, share, came = _share(tables, model.offset + x, x, p, s, part)
        _narrow(low, width, m, start, share, shift)
        ids[t] = x
        model.learn(x, came)
    rows = np.ascontiguousarray(ids.T)
    result: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * lanes
    for lane, k in enumerate(order):
        result[k] = rows[lane, : size[k]]
    return result


def _find(tables: Tables, holders: np.ndarray, offset: np.ndarray, value: np.ndarray, p: np.ndarray, s: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The id whose stretch of the mixed distribution holds ``value``.

    A spike stands at the start of its id's stretch. What lies of it before the value is taken off, first
    of the smaller id's, so that a value inside it becomes the start of the stretch; order 0 alone says whose that is.
    """
    first = p[0] <= p[1]
    both = s[0] + s[1]
    starts = tables.scaled(offset + np.maximum(p, 0), part)
    lower, size = np.where(first, starts[0], starts[1]), np.where(first, s[0], s[1])
    for spike, size in ((lower, size), (starts[0] + starts[1] - lower, both - size)):
        over = value - spike
        np.maximum(over, 0, out=over)
        value = value - np.minimum(over, size, out=over)
    # The last place c of the table with floor(c * part / total) <= value.
    least = value + 1
    least *= tables.total
    least -= 1
    least = (least / part).astype(np.int64)
    return holders.take(np.minimum(least, tables.total - 1) + offset // tables.step * tables.total).astype(np.int64)


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, rising, and each id's place among them; by hash, as only the few distinct ones need sorting."""
    coded = pa.array(ids).dictionary_encode()
    met = coded.dictionary.to_numpy()
    order = np.argsort(met)
    rank = np.empty(len(met), dtype=np.int64)
    rank[order] = np.arange(len(met))
    return met[order], rank[coded.indices.to_numpy()]


def _expand(flat: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of ``flat``, which have ``lens`` elements (one at least), that ``codes`` number, one after another."""
    if not len(codes):
        return flat[:0]
    size = lens[codes]
    first = (np.cumsum(lens) - lens)[codes]
    stop = np.cumsum(size)
    # Steps from place to place: one within a run, and from a run's last place to the next one's first.
    at = np.ones(int(stop[-1]), dtype=np.int64)
    at[0] = first[0]
    at[stop[:-1]] = first[1:] - first[:-1] - size[:-1] + 1
    return flat[np.cumsum(at, out=at)]


class _Units:
    """Symbols to code a file by: its ids, words that are frequent in it and frequent pairs of what the others are spelled with.

    A word is a run of ids that the caller tells apart; words that are not frequent are spelled with other symbols.
    """

    def __init__(self, words: np.ndarray, flat: np.ndarray, lens: np.ndarray):
        """words: numbers of words; flat, lens: the ids of each, one word after another."""
        n = np.bincount(words, minlength=len(lens))
        met = n > 0
        number = np.cumsum(met) - 1
        flat, lens, n = flat[np.repeat(met, lens)], lens[met], n[met]
        self.used, ranks = distinct(flat)
        whole = (n >= OFTEN) & (lens > 1)
        rare = ~whole & (lens > 1)
        spelled = ranks[np.repeat(whole, lens)]
        sizes = [np.ones(len(self.used), dtype=np.int64), lens[whole]]
        parts = [np.arange(len(self.used)), spelled]
        many = len(self.used) + int(whole.sum())
        # The rare words, each as often as it occurs, by pairs of symbols that are frequent in them.
        x, word = ranks[np.repeat(rare, lens)], np.repeat(np.arange(int(rare.sum())), lens[rare])
        often = n[rare]
        for _ in range(PAIRINGS):
            at, pair, left, right = _pairs(x, word, often, many)
            if not len(left):
                break
            every, length = np.concatenate(parts), np.concatenate(sizes)
            size = length[left] + length[right]
            parts.append(_expand(every, length, np.stack([left, right], axis=1).reshape(-1)))
            sizes.append(size)
            x[at] = many + pair
            keep = np.ones(len(x), dtype=bool)
            keep[at + 1] = False
            x, word = x[keep], word[keep]
            many += len(left)
        self.flat, self.lens = np.concatenate(parts), np.concatenate(sizes)
        # Each word's symbols: one, or those that it is spelled with.
        symbols = np.ones(len(lens), dtype=np.int64)
        symbols[rare] = np.bincount(word, minlength=int(rare.sum()))
        by_word = np.empty(int(symbols.sum()), dtype=np.int64)
        first = np.cumsum(symbols) - symbols
        one = lens == 1
        by_word[first[one]] = ranks[(np.cumsum(lens) - lens)[one]]
        by_word[first[whole]] = len(self.used) + np.arange(int(whole.sum()))
        by_word[np.repeat(rare, symbols)] = x
        self.symbols = _expand(by_word, symbols, number[words])

    def table(self) -> np.ndarray:
        """The ids and what the symbols after them stand for, as read by ``symbol_ids``."""
        n = len(self.used)
        return np.concatenate([[n], np.diff(self.used, prepend=0), self.lens[n:], self.flat[n:]])


def symbol_ids(table: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that each of ``many`` symbols stands for, one after another, and how many those are."""
    n = int(table[0])
    used = np.cumsum(table[1 : n + 1])
    return used[np.concatenate([np.arange(n), table[many + 1 :]])], np.concatenate([np.ones(n, dtype=np.int64), table[n + 1 : many + 1]])


def _pairs(x: np.ndarray, word: np.ndarray, often: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of symbols to put together with the next of the same word, numbers of the pairs, and the pairs' symbols."""
    none = np.zeros(0, dtype=np.int64)
    inside = np.flatnonzero(word[:-1] == word[1:])
    if not len(inside):
        return none, none, none, none
    coded = pa.array(x[inside] * size + x[inside + 1]).dictionary_encode()
    code, weight = coded.indices.to_numpy(), often[word[inside]]
    met = coded.dictionary.to_numpy()
    n = np.zeros(len(x) + 1, dtype=np.int64)
    n[inside + 1] = np.bincount(code, weights=weight, minlength=len(met)).astype(np.int64)[code]
    # Of pairs that overlap, the more frequent one.
    here = n[inside + 1]
    best = (here >= PAIRED) & (here > n[inside]) & (here >= n[np.minimum(inside + 2, len(x))])
    left = np.bincount(code[best], weights=weight[best], minlength=len(met)) >= PAIRED
    best &= left[code]
    return inside[best], (np.cumsum(left) - 1)[code[best]], met[left] // size, met[left] % size


def write_file(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], *, start: int = 0, block: int = BLOCK) -> bytes:
    """The bytes of a file: ids of documents one after another, each with its end id.

    start: how many ids the files before it hold in the same part of the output.
    """
    used, ranks = distinct(ids)
    return write_words(ranks, used, np.ones(len(used), dtype=np.int64), doc_ids, lengths, start=start, block=block)


def write_words(words: np.ndarray, flat: np.ndarray, lens: np.ndarray, doc_ids: list[int | None], lengths: list[int], *, start: int = 0, block: int = BLOCK) -> bytes:
    """``write_file`` for ids that come as words: their numbers in the order of the file, and the ids and lengths of each number's word."""
    units = _Units(words, flat, lens)
    symbols = units.symbols
    ids = _expand(units.used.astype(np.uint32)[units.flat], units.lens, symbols)
    counts = fit_tables(symbols, len(units.lens))
    # The numbers' lowest bytes, then their second ones and so on.
    table = zlib.compress(np.ascontiguousarray(np.concatenate([units.table(), *counts]).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 6)
    names = [0 if d is None else d for d in doc_ids]
    index = zlib.compress(np.array(names, dtype="<i8").tobytes() + np.array([d is None for d in doc_ids], dtype="u1").tobytes() + np.array(lengths, dtype="<u4").tobytes(), 6)
    cut = [symbols[at : at + block] for at in range(0, len(symbols), block)]
    stop = np.cumsum(units.lens[symbols])[[min(at + block, len(symbols)) - 1 for at in range(0, len(symbols), block)]].tolist()
    coded = encode_blocks(cut, Tables(counts))
    head = struct.pack(SHAPE, MAGIC, VERSION, len(counts), start, len(ids), len(doc_ids), len(cut), len(units.lens), len(table), len(index)) + table + index
    out = [head, struct.pack("<I", zlib.crc32(head))]
    raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
    for b, c, a, z in zip(cut, coded, [0, *stop], stop):
        body = struct.pack("<III", len(b), len(c), zlib.crc32(raw[4 * a : 4 * z])) + c
        out += [body, struct.pack("<I", zlib.crc32(body))]
    return b"".join(out)


def read_file(data: bytes) -> tuple[int, list[int | None], list[int], np.ndarray]:
    """(start, doc ids, lengths, ids) of a file; raises ValueError if a checksum does not hold."""
    shape = struct.Struct(SHAPE)
    if len(data) < shape.size:
        raise ValueError("not a token file")
    magic, version, many, start, n, docs, blocks, symbols, table_len, index_len = shape.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file")
    at = shape.size + table_len + index_len
    if at + 4 > len(data) or zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("damaged header")
    table = np.frombuffer(zlib.decompress(data[shape.size : shape.size + table_len]), dtype=np.uint8).reshape(4, -1)
    table = np.ascontiguousarray(table.T).view("<u4").reshape(-1).astype(np.int64)
    counts = table[len(table) - many * symbols :].reshape(many, symbols)
    flat, lens = symbol_ids(table[: len(table) - many * symbols], symbols)
    index = zlib.decompress(data[shape.size + table_len : at])
    names = np.frombuffer(index[: 8 * docs], dtype="<i8").tolist()
    null = np.frombuffer(index[8 * docs : 9 * docs], dtype="u1")
    lengths = np.frombuffer(index[9 * docs :], dtype="<u4").tolist()
    at += 4
    coded, sizes, sums = [], [], []
    for k in range(blocks):
        if at + 12 > len(data):
            raise ValueError(f"block {k} is missing")
        size, length, crc = struct.unpack_from("<III", data, at)
        stop = at + 12 + length
        if stop + 4 > len(data) or zlib.crc32(data[at:stop]) != struct.unpack_from("<I", data, stop)[0]:
            raise ValueError(f"block {k} is damaged")
        coded.append(data[at + 12 : stop])
        sizes.append(size)
        sums.append(crc)
        at = stop + 4
    found = decode_blocks(coded, sizes, Tables(counts))
    ids = np.zeros(0, dtype=np.uint32)
    if found:
        every = np.concatenate(found)
        ids = _expand(flat.astype(np.uint32), lens, every)
        stop = np.cumsum(lens[every])[np.cumsum(sizes) - 1].tolist()
        raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
        for k, (a, z, crc) in enumerate(zip([0, *stop], stop, sums)):
            if zlib.crc32(raw[4 * a : 4 * z]) != crc:
                raise ValueError(f"block {k} does not decode to what was coded")
    if len(ids) != n:
        raise ValueError("ids are missing")
    return start, [None if x else d for d, x in zip(names, null, strict=True)], lengths, ids


def _store(folder: str, name: str, content: bytes) -> None:
    """Write a file whole under its name, so that a repeated or a rival task leaves the same file."""
    system, base = fs.FileSystem.from_uri(folder)
    draft = f"{base}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(content)
    system.move(draft, f"{base}/{name}")


def write_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, path: str | None = None, part_bytes: int = PART_BYTES, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode, append the end id and write files in ascending order of doc_id; a table of part, file, n_ids, name.

    Ids must be whole numbers or null (null first; equal ids in order of a hash of the text). Each
    part is a range of ids with about ``part_bytes`` of text, and a file holds about ``file_ids`` ids, at least one
    document. folder: where ``pyarrow.fs`` can write from all executors; it holds the files
    ``part-*.tok`` and, as ``index``, the table.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # The hash parts rows of one id, however many, and is what they are ordered by.
    spread_ = source.withColumn("turn", F.xxhash64("text"))
    ranged = spread_.repartitionByRange(max(1, -(-size // part_bytes)), F.col("doc_id").asc_nulls_first(), "turn").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "turn", "text")
    ordered = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder("byte", path)
        held: list[np.ndarray] = []
        spelled: list[bytes] = []
        names: list[int | None] = []
        lengths: list[np.ndarray] = []
        start = file = 0
        part, size, words = 0, 0, 0

        def done() -> pa.RecordBatch:
            nonlocal held, spelled, names, lengths, start, file, size, words
            # The words of all batches, equal ones with one number.
            numbers = np.concatenate(held)
            if len(held) > 1:
                coded = pa.array(spelled, pa.large_binary()).dictionary_encode()
                spelled, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy()[numbers]
            flat = np.frombuffer(b"".join(spelled), dtype="<u4").astype(np.int64)
            lens = np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled)) // 4
            name = f"part-{part:07d}-{file:07d}.tok"
            _store(folder, name, write_words(numbers, flat, lens, names, np.concatenate(lengths).tolist(), start=start))
            batch = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([size], pa.int64()), pa.array([name])], names=["part", "file", "n_ids", "name"])
            start, file, held, spelled, names, lengths, size, words = start + size, file + 1, [], [], [], [], 0, 0
            return batch

        for batch in small_batches(batches, "text", FILE_TEXT_BYTES):
            part = batch.column("part")[0].as_py()
            many, numbers, ids = known.encode_pieces(batch.column("text"))
            # The end id is a word after each document's.
            stop = np.cumsum(many)
            numbers = np.insert(numbers, stop, len(ids))
            ids.append(end)
            lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            stop += np.arange(1, len(many) + 1)
            total = np.concatenate([[0], np.cumsum(lens[numbers])[stop - 1]])
            at = 0
            while at < len(many):
                # As many documents as fill the file, the one that reaches its size included.
                to = min(int(np.searchsorted(total, total[at] + file_ids - size)), len(many))
                first = int(stop[at - 1]) if at else 0
                if to - at < len(many):
                    some, number = distinct(numbers[first : stop[to - 1]])
                    mine = [ids[k] for k in some.tolist()]
                else:
                    number, mine = numbers, ids
                held.append(number + words)
                spelled += mine
                words += len(mine)
                names += batch.column("doc_id").slice(at, to - at).to_pylist()
                lengths.append(np.diff(total[at : to + 1]))
                size += int(total[to] - total[at])
                at = to
                if size >= file_ids:
                    yield done()
        if held:
            yield done()

    ordered.mapInArrow(run, "part int, file int, n_ids long, name string").write.mode("overwrite").parquet(f"{folder}/index")
    return docs.sparkSession.read.parquet(f"{folder}/index")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files that the index of ``folder`` names.

    A file knows how many ids come before it in its part; how many come before the part is a sum over sets of
    parts and over the parts of a set, in windows of ``TOGETHER`` parts, that the file's name is joined to.
    """
    index = spark.read.parquet(f"{folder}/index")
    totals = index.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("set", F.expr(f"part div {TOGETHER}"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sets = totals.groupBy("set").agg(F.sum("n").alias("n")).select("set", earlier(W.orderBy("set")).alias("sets_before"))
    before = totals.select("set", "part", earlier(W.partitionBy("set").orderBy("part")).alias("parts_before")).join(sets, "set").select("part", (F.col("sets_before") + F.col("parts_before")).alias("before"))
    # A task takes a file at a time: names are dealt, not contents.
    named = index.join(before, "part").select("name", "before")
    tasks = max(1, min(index.count(), TASKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                system, base = fs.FileSystem.from_uri(folder)
                with system.open_input_stream(f"{base}/{name}") as stream:
                    start, names, lengths, ids = read_file(stream.read())
                raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
                stop = np.cumsum(lengths)
                first = stop - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(first + start + at, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return named.repartitionByRange(tasks, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, *, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` to files and read each document's place, length and checksum back from them.

    Null text counts as empty: its one id is the end id. Repeated rows are documents of
    their own; rows of one id go in order of a hash of their texts. Very long texts are encoded whole. An empty table gives no files and no rows. folder: by default one of its own
    in the shared folder. Other columns, whatever their names, have no effect.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    write_files(docs, folder, **options)
    return read_files(spark, folder)
