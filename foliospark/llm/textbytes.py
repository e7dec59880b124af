"""Words of whole texts as 64-bit hashes, found on the UTF-8 bytes of an Arrow column with numpy.

All separators are ASCII, so bytes of longer characters never split a word. Equal words have equal hashes; different
words meet with a chance of 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG = 256
#: A-Z as a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but ASCII white space; or ASCII letters, digits and all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a pair, in this order."""
    return mix(first * np.uint64(0x2545F4914F6CDD1D) + second + np.uint64(0x632BE59BD9B4E019))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if not len(offsets):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_runs(offsets: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about limit bytes, a longer row on its own: they bound the memory of the arrays below."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and each row's number of words."""
    inside = kind[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = (inside[:1], inside[-1:]) if len(data) else (np.zeros(0, bool),) * 2
    begins = edge[inside[edge]]
    ends = edge[~inside[edge]]
    if first.any():
        begins = np.concatenate([[0], begins])
    if last.any():
        ends = np.concatenate([ends, [len(data)]])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut  # words that only a row's end divides
    if len(cut):
        begins, ends = np.sort(np.concatenate([begins, cut])), np.sort(np.concatenate([ends, cut]))
    return begins, ends, np.diff(np.searchsorted(begins, offsets, "left"))


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Eight bytes of every word at a time; words over LONG bytes one by one."""
    size = ends - begins
    total = mix(size.astype(np.uint64) + _BASE)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if lower else data
    at_any_byte = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    todo, step = np.arange(len(begins)), 0
    long_ = size > LONG
    if long_.any():
        for i in np.flatnonzero(long_):
            total[i] ^= np.frombuffer(hashlib.blake2b(padded[begins[i] : ends[i]], digest_size=8).digest(), "<u8")[0]
        todo = np.flatnonzero(~long_)
    while len(todo):
        left = size[todo] - step
        part = at_any_byte[begins[todo] + step]
        part = np.where(left < 8, part & _MASK[np.minimum(left, 8)], part)
        total[todo] = mix((total[todo] ^ part) * _BASE + np.uint64(step + 1))
        todo, step = todo[left > 8], step + 8
    return total
