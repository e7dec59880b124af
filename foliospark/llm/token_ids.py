"""Token ids of whole texts by the tokenizers library, each distinct stretch of text encoded once a worker.

A word with the white space before it has the same ids alone as in its text: no pattern of these tokenizers goes on
from another character into white space. The library encodes new stretches in batches; their ids are remembered by a
64-bit hash, up to MEMO of them. Texts with white space beyond ASCII's, or with separators that only some regular
expressions call white space, go to the library whole.

For the same reason new stretches that begin with white space can be strung together: JOINED of them go to the library as
one text, whose ids are cut where the bytes of their tokens reach a stretch's end. That takes a vocabulary whose tokens
are bytes of the text; where one token's end doesn't meet a stretch's, the stretches go to the library one by one.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from .textbytes import NOT_SPACE, column_bytes, word_hashes, words

MEMO = 4_000_000
JOINED = 1024

_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[44, 46]] = _LETTER[65:91] = _LETTER[97:123] = True


def _odd(data: np.ndarray) -> np.ndarray:
    """Where bytes may belong to such white space."""
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xE3) & ((data == 0xC2) | (data >= 0xE1)) | (data >= 0x1C) & (data <= 0x1F))
    after = data[np.minimum(lead + 1, len(data) - 1)]
    here = data[lead]
    return lead[(here < 0x20) | (here == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (here == 0xE1) & (after == 0x9A) | (here == 0xE2) & ((after == 0x80) | (after == 0x81)) | (here == 0xE3) & (after == 0x80)]


class Encoder:
    def __init__(self, path: str, spaces: bool) -> None:
        """spaces: whether the tokenizer sees white space; if not, words alone tell."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces = Tokenizer.from_file(path), spaces
        vocabulary = self.tokenizer.get_vocab()
        # a character of a token is a byte of the text
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.reset()

    def reset(self) -> None:
        self.hashes, self.index = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted, and the number of each
        self.ids, self.used, self.n = np.empty(1 << 16, np.uint32), 0, 0
        self.start, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all texts, and each text's number of them."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _encode_joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for stretches that begin with white space and end with a word."""
        ids, _ = self._encode([b"".join(pieces[i : i + JOINED]).decode() for i in range(0, len(pieces), JOINED)])
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        reached = np.cumsum(self.bytes[ids])
        upto = np.searchsorted(reached, ends)
        if len(ids) and reached[-1] == ends[-1] and (reached[upto] == ends).all():
            return ids, np.diff(upto + 1, prepend=0)
        return self._encode([p.decode() for p in pieces])

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], joined: np.ndarray) -> None:
        """joined: whether a stretch begins with white space and ends with a word."""
        some, rest = np.flatnonzero(joined), np.flatnonzero(~joined)
        (ids, count), (more, number) = self._encode_joined([pieces[i] for i in some]), self._encode([pieces[i].decode() for i in rest])
        ids, count = np.concatenate([ids, more]), np.concatenate([count, number])
        n, used = self.n + len(count), self.used + len(ids)
        while n > len(self.start):
            self.start, self.count = (np.concatenate([x, np.empty(len(x), np.int64)]) for x in (self.start, self.count))
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint32)])
        self.ids[self.used : used] = ids
        self.start[self.n : n], self.count[self.n : n] = self.used + np.cumsum(count) - count, count
        hashes = hashes[np.concatenate([some, rest])]
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.index = np.insert(self.hashes, at, hashes[order]), np.insert(self.index, at, self.n + order)
        self.n, self.used = n, used

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and ends of the stretches, and each row's number of them."""
        begins, ends, count = words(data, offsets, NOT_SPACE)
        # a full stop or comma at a word's end, after a letter, is a token of its own
        last = np.flatnonzero((ends - begins > 1) & _STOP[data[ends - 1]] & _LETTER[data[np.maximum(ends - 2, 0)]])
        if len(last):
            row = np.searchsorted(np.cumsum(count), last, "right")
            begins, ends = np.insert(begins, last + 1, ends[last] - 1), np.insert(ends, last, ends[last] - 1)
            count = count + np.bincount(row, minlength=len(count))
        if not self.spaces:
            return begins, ends, count
        first = np.cumsum(count) - count
        before = np.empty_like(begins)
        before[1:] = ends[:-1]
        some = count > 0
        before[first[some]] = offsets[:-1][some]
        upto = offsets[:-1].copy()  # where a row's last word ends
        upto[some] = ends[(first + count)[some] - 1]
        tail = np.flatnonzero(upto < offsets[1:])
        at = (first + count)[tail]
        count = count.copy()
        count[tail] += 1
        return np.insert(before, at, upto[tail]), np.insert(ends, at, offsets[1:][tail]), count

    def __call__(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end after each text; and each text's number of ids. Null is empty."""
        data, offsets = column_bytes(column)
        odd = np.unique(np.searchsorted(offsets, _odd(data), "right") - 1)
        if len(odd):
            return self._with_odd(data, offsets, odd, end)
        if self.n > MEMO:
            self.reset()
        begins, ends, size = self._pieces(data, offsets)
        codes, unique = pd.factorize(word_hashes(data, begins, ends, lower=False))
        at = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != unique) if len(self.hashes) else np.arange(len(unique))
        if len(new):
            place = np.empty(len(unique), np.int64)
            place[codes] = np.arange(len(codes))
            raw, spot = data.tobytes(), place[new]
            begin, end_ = begins[spot], ends[spot]
            joined = ~NOT_SPACE[data[begin]] & NOT_SPACE[data[end_ - 1]]
            self._learn(unique[new], [raw[a:b] for a, b in zip(begin.tolist(), end_.tolist(), strict=True)], joined)
            at = np.searchsorted(self.hashes, unique)
        which = self.index[at][codes]
        count = self.count[which]
        at = np.cumsum(count) - count
        flat = self.ids[np.arange(int(count.sum())) + np.repeat(self.start[which] - at, count)]
        upto = np.concatenate([[0], np.cumsum(count)])
        edge = np.cumsum(size)
        number = upto[edge] - upto[edge - size]
        return np.insert(flat, np.cumsum(number), end).astype(np.uint32), number + 1

    def _with_odd(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        ids, number, at = [], [], 0
        for i in [*odd.tolist(), len(offsets) - 1]:
            if i > at:
                plain = pa.array([data[a:b].tobytes().decode() for a, b in zip(offsets[at:i].tolist(), offsets[at + 1 : i + 1].tolist(), strict=True)], pa.large_string())
                part, n = self(plain, end)
                ids.append(part)
                number.append(n)
            if i < len(offsets) - 1:
                one = self.tokenizer.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids + [end]
                ids.append(np.array(one, np.uint32))
                number.append(np.array([len(one)], np.int64))
            at = i + 1
        return np.concatenate(ids), np.concatenate(number)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """One a worker."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = Encoder(path, spaces)
    return _encoders[path, spaces]
