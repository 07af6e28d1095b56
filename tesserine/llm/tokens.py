"""Token ids of whole texts, with the words of a task encoded once.

Both vocabularies cut a text into words before they merge within words. A text
whose characters all lie in a range that every Unicode version cuts alike is cut
here by the vocabulary's own pattern, and only words not met before go through
the tokenizer; any other text goes through it whole. Either way the ids are those
that the tokenizer gives for the whole text.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, compress, filterfalse

import numpy as np
import pyarrow as pa

#: Letters of the plain range, for use in a character class.
_L = "a-zA-Z\u00b5\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
#: The patterns of the two vocabularies, as their files state them, over plain texts.
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+"
#: Any but Basic Latin, Latin-1 and Latin Extended A without controls, the hard space and hyphen, ordinal signs, raised digits, fractions and dotted I.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4-\u00b8\u00bb\u00bf-\u012f\u0131-\u017f]")
#: Bytes of words and ids that a worker holds before it drops those not met since it last did so (twice as many at most), and the
#: longest word it holds. They bound its memory, not what is encoded.
#: Of pieces it holds as much and those of one column more, and then drops those that the column has once.
HELD_BYTES, LONGEST = 64_000_000, 64
#: Bytes of text to encode at a time: their words are in memory one by one.
TEXT_BYTES = 2_000_000
#: Bytes of an entry beside its word and ids, and words that go through the tokenizer at a time.
_ENTRY, _PART = 180, 2_000
#: Pieces in a row that go through the tokenizer as one text.
_ROW = 100

#: Bytes that a text may be cut after where a space follows: visible ASCII, and others unless the byte before
#: them is one that white space beyond ASCII has there (a few letters have it too, and just aren't cut after).
_VISIBLE, _SPACE_LEAD = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_SPACE_LEAD[[0x80, 0x81, 0x9A, 0xA0, 0xC2]] = True
#: 1: an ASCII letter, 2: any other visible ASCII but digits.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[0x30:0x3A] = 0
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1


def pieces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where UTF-8 texts, which start at ``starts``, can be cut for byte_bpe_50k.json: the start of each piece.

    Its pattern never has a visible character and a space after it in one word, nor a letter and a mark after it, and
    looks ahead no farther than a run of white space. So the ids of the pieces are those of the text, whatever else is in it.
    """
    cut = np.zeros(len(data) + 1, dtype=bool)
    at = np.flatnonzero(data[1:] == 0x20) + 1
    before = data[at - 1]
    cut[at] = _VISIBLE[before] | ((before >= 0x80) & ~_SPACE_LEAD[data[at - 2]])
    kind = _KIND[data]
    cut[1:-1] |= (kind[1:] == 2) & (kind[:-1] == 1)
    cut[starts] = True
    cut[-1] = False
    return np.flatnonzero(cut)


class Encoder:
    """ids of a text as little-endian unsigned 32-bit integers.

    kind: "word" for word_bpe_49k.json, "byte" for byte_bpe_50k.json. path: that
    file's; by default where the public_tokenizers package has it. Strings of
    special tokens in a text are ordinary text.
    """

    def __init__(self, kind: str, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path({"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}[kind])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lower = kind == "word"
        self.token_bytes: np.ndarray | None = None
        self.words = re.compile(WORD_PATTERN if kind == "word" else BYTE_PATTERN).findall
        self.forget()

    def forget(self) -> None:
        """Drop all words, as at the end of a job that others follow in the same worker."""
        self.known: dict[str | bytes, bytes] = {}
        self.older: dict[str | bytes, bytes] = {}
        self.size = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Very long texts are cut into words like any other."""
        with no_cycles():
            return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut: list[list[str] | None] = [self.words(x.lower() if self.lower else x) if UNUSUAL.search(x) is None else None for x in texts]
        if self.size > HELD_BYTES:
            self.older, self.known, self.size = self.known, {}, 0
        new = list(set(filterfalse(self.known.__contains__, chain.from_iterable(w for w in cut if w))))
        if self.older:
            again = {w: self.older[w] for w in new if w in self.older}
            self._hold(again)
            new = [w for w in new if w not in again]
        for at in range(0, len(new), _PART):
            part = new[at : at + _PART]
            self._hold(dict(zip(part, self._ids(part), strict=True)))
        get = self.known.__getitem__
        out = [b"".join(map(get, w)) if w is not None else self._ids([x])[0] for w, x in zip(cut, texts, strict=True)]
        for w in [w for w in new if len(w) > LONGEST]:
            self.size -= len(w) + len(self.known.pop(w)) + _ENTRY
        return out

    def encode_pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The texts of a string column, null counting as empty, as pieces: how many each text has, their numbers, and the ids by number.

        For byte_bpe_50k.json only. Equal pieces of the column have one number.
        """
        with no_cycles():
            return self._encode_pieces(column)

    def _encode_pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        column = column.cast(pa.large_binary()).fill_null(b"")
        edges = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        if not len(column) or edges[0] == edges[-1]:
            return np.zeros(len(column), dtype=np.int64), np.zeros(0, dtype=np.int32), []
        text = column.buffers()[2].slice(int(edges[0]), int(edges[-1] - edges[0]))
        edges = edges - edges[0]
        data = np.frombuffer(text, dtype=np.uint8)
        starts = pieces(data, edges[:-1])
        many = np.diff(np.searchsorted(starts, edges))
        ends = np.append(starts, len(data))
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), text]).dictionary_encode()
        edges = np.frombuffer(cut.dictionary.buffers()[1], dtype=np.int64)[: len(cut.dictionary) + 1].tolist()
        words = cut.dictionary.buffers()[2].to_pybytes()
        numbers = cut.indices.to_numpy()
        ids = self._ids_of_pieces([words[a:b] for a, b in zip(edges, edges[1:])])
        if self.size > HELD_BYTES:
            # Those that occur several times in a column are the likeliest to come again.
            again = np.bincount(numbers, minlength=len(ids)) > 1
            kept = {words[edges[k] : edges[k + 1]]: ids[k] for k in np.flatnonzero(again).tolist() if edges[k + 1] - edges[k] <= LONGEST}
            self.forget()
            self._hold(kept)
            if self.size > HELD_BYTES // 2:
                self.forget()
        return many, numbers, ids

    def _ids_of_pieces(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the pieces, which differ."""
        found = list(map(self.known.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if new:
            # Pieces that start with a space and end visibly are cut again where they were put together.
            size = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
            data, last = np.frombuffer(b"".join(new), dtype=np.uint8), np.cumsum(size) - 1
            fit = (data[last - size + 1] == 0x20) & (size > 1) & (_VISIBLE[data[last]] | ((data[last] >= 0x80) & ~_SPACE_LEAD[data[last - 1]]))
            many = list(compress(new, fit.tolist()))
            for at in range(0, len(many), _PART):
                part = many[at : at + _PART]
                ids = self._ids_together(part)
                self.known.update(zip(part, ids, strict=True))
                self.size += sum(map(len, part)) + sum(map(len, ids)) + _ENTRY * len(part)
            alone = list(compress(new, (~fit).tolist()))
            for at in range(0, len(alone), _PART):
                part = alone[at : at + _PART]
                self._hold(dict(zip(part, self._ids([w.decode() for w in part]), strict=True)))
            found = list(map(self.known.__getitem__, words))
            for w in [w for w in new if len(w) > LONGEST]:
                self.size -= len(w) + len(self.known.pop(w)) + _ENTRY
        return found

    def _ids_together(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of several pieces, from those of all in a row: an id stands for as many bytes as its token has."""
        if self.token_bytes is None:
            tokens = self.tokenizer.get_vocab()
            self.token_bytes = np.zeros(max(tokens.values()) + 1, dtype=np.int64)
            self.token_bytes[list(tokens.values())] = list(map(len, tokens))
        rows = [b"".join(words[at : at + _ROW]).decode() for at in range(0, len(words), _ROW)]
        packed = b"".join(self._ids(rows))
        stop = np.cumsum(self.token_bytes[np.frombuffer(packed, dtype="<u4")])
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        at = np.searchsorted(stop, ends)
        if stop[-1] != ends[-1] or (stop[at] != ends).any():
            return self._ids([w.decode() for w in words])
        to = (4 * at + 4).tolist()
        return [packed[a:b] for a, b in zip([0, *to], to)]

    def _hold(self, found: dict[str, bytes] | dict[bytes, bytes]) -> None:
        self.known.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + _ENTRY * len(found)


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_HELD: dict[tuple[str, str | None], Encoder] = {}


def encoder(kind: str, path: str | None = None) -> Encoder:
    """The worker's encoder, which goes on knowing its words in the worker's next tasks."""
    if (kind, path) not in _HELD:
        _HELD.clear()
        _HELD[kind, path] = Encoder(kind, path)
    return _HELD[kind, path]


@contextmanager
def no_cycles() -> Iterator[None]:
    """Without the search for reference cycles, of which words and their ids have none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
