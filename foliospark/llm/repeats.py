"""Suffix-array dedup: removes every byte covered by a LENGTH-byte string that starts anywhere else in the corpus.

The index is a run-length compressed Burrows-Wheeler transform with samples at the ends of its runs (``RunLengthIndex``).
It holds only text that may repeat, in buckets that each fit a task:

1. Windows of LENGTH bytes are keyed by their least hash of GRAM bytes, and runs of windows with one key are stretches of
   some dozens of bytes. Equal windows have equal keys. Shards count their stretches by key and content, in packed
   requests (see ``keyed``): a copy of a thousand documents is one entry a shard. A key with one occurrence has no
   repeat; a stretch that occurs twice as a whole is repeated as a whole.
2. What is left are keys with different stretches. One of each kind goes to its key's bucket; the bucket's index
   streams the length of the longest match elsewhere at each place, and marks those of LENGTH and more.
3. Keys with more than HOT different stretches (all texts with one passage have another one at its edges) would make
   buckets uneven: their windows are counted one by one instead, dealt by the windows' own hash.

All decisions are about whole strings, by 128 bits of hash or bytes; none is dropped.

Defined results: a null text is empty; an empty text or one under LENGTH bytes keeps everything; repeated rows repeat
each other, so both lose all if they are long enough; null doc_ids stay null; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import keyed
from .common import discard, spill
from .shards import open_rest, open_shard, row_shards, text_shards
from .textbytes import mix

LENGTH, GRAM = 200, 40
SPAN = LENGTH - GRAM + 1  # grams of a window
STRETCH = 256  # windows of a stretch at most
HOT = 256
CHUNK = 1 << 20
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_MARKS = "shard string, payload binary"
_SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("shard", pa.string()), ("payload", pa.binary())])
_BASE = 0x9E3779B97F4A7C15
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _up_down() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        n = CHUNK + LENGTH + STRETCH
        _tables[0] = (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    return _tables[0]


def least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def _again(grams: np.ndarray, key: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Stretches that hold their key's gram twice: in a window that repeats in its own stretch, the first such gram comes before the repeat's start, so before the stretch's last window."""
    own = np.flatnonzero(grams[: len(key)] == key)
    seen = np.zeros(1 << 20, bool)
    low = (grams & np.uint64((1 << 20) - 1)).astype(np.int64)
    seen[low[own]] = True
    every = np.flatnonzero(seen[low])
    order = np.lexsort((every, grams[every]))
    place = every[order]
    pair = np.flatnonzero((grams[place[1:]] == grams[place[:-1]]) & (np.diff(place) < STRETCH))
    first, second = place[pair], place[pair + 1]
    stretch = np.searchsorted(starts, first, "right") - 1
    out = np.zeros(len(starts), bool)
    good = stretch >= 0
    stretch, first, second = stretch[good], first[good], second[good]
    good = (first < ends[stretch]) & (second < ends[stretch] + SPAN - 1)
    stretch = stretch[good]
    out[stretch[key[starts[stretch]] == grams[first[good]]]] = True
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A cryptographic hash of each string: unlike those of grams, nobody can write two texts that share one."""
    raw, out = memoryview(np.ascontiguousarray(data)), np.empty(len(starts), np.uint64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        out[i] = int.from_bytes(blake2b(raw[a:b], digest_size=8).digest(), "little")
    return out


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, windows, key, content hash of all stretches, and whether one may repeat a window in itself."""
    up, down = _up_down()
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    for c in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        piece = data[c : c + CHUNK + LENGTH - 1]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUE[piece] * up[: len(piece)], out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(piece) - GRAM + 1])
        key = least(grams, SPAN)
        n = len(key)
        # windows that don't leave their text
        a, b = np.searchsorted(offsets, c, "right") - 1, np.searchsorted(offsets, c + n, "left")
        first, last = np.maximum(offsets[a:b] - c, 0), np.minimum(offsets[a + 1 : b + 1] - c - LENGTH + 1, n)
        some = last > first
        first, last = first[some], last[some]
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, first, 1)
        np.add.at(inside, last, -1)
        starts = np.unique(np.concatenate([change, first]))
        starts = starts[np.cumsum(inside[:-1])[starts] > 0]
        row = np.searchsorted(first, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], n), last[row])
        if len(starts) and (ends - starts).max() > STRETCH:
            parts = -(-(ends - starts) // STRETCH)
            k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            starts, ends = np.repeat(starts, parts) + k * STRETCH, np.minimum(np.repeat(ends, parts), np.repeat(starts, parts) + (k + 1) * STRETCH)
        size = ends - starts
        content = digests(piece, starts, ends + LENGTH - 1)
        again = _again(grams, key, starts, ends)
        for f, x in zip(found, (starts + c, size, mix(key[starts] + np.uint64(1)), content, again), strict=True):
            f.append(x)
    return tuple(np.concatenate(f) if f else np.empty(0, k) for f, k in zip(found, (np.int64, np.int64, np.uint64, np.uint64, bool), strict=True))


class RunLengthIndex:
    """Run-length BWT over the places of some texts that have at least `length` bytes to their text's end.

    order: those places by their suffixes; heads and tails: the places at both ends of each run of equal preceding
    bytes, the only ones whose common prefixes with their neighbours are compared. From a run's end to the next in text
    order, these match lengths fall by one a place.
    """

    def __init__(self, texts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> None:
        self.length = length
        ends = np.cumsum(sizes)
        count = np.maximum(sizes - length + 1, 0)
        self.first = np.cumsum(count) - count  # a text's first place among all
        begin = ends - sizes
        self.place = np.arange(int(count.sum())) + np.repeat(begin - self.first, count)
        self.end = np.repeat(ends, count)
        self.opens = np.zeros(len(self.place), bool)
        self.opens[self.first[count > 0]] = True
        self.data = np.zeros(len(texts) + 8, np.uint8)
        self.data[: len(texts)] = texts
        self._eight = np.ndarray((len(texts) + 1,), ">u8", self.data, 0, (1,))
        self.order = self._sorted()
        before = self.data[self.place[self.order] - 1].astype(np.int16)
        alone = self.opens[self.order]  # no byte before: a run of its own
        change = (before[1:] != before[:-1]) | alone[1:] | alone[:-1]
        self.head = np.append(True, change)[: len(alone)]
        self.tail = np.append(change, True)[: len(alone)]
        self.runs = int(self.head.sum())

    def _chunk(self, places: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """Eight bytes of suffixes at a depth, zeros after their end."""
        at = self.place[places] + depth
        left = np.clip(self.end[places] - at, 0, 8).astype(np.uint64)
        part = self._eight[np.minimum(at, len(self._eight) - 1)].astype(np.uint64)
        return np.where(left < 8, part & ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (left * np.uint64(8))), part)

    def _sorted(self) -> np.ndarray:
        """Sorts by eight bytes at a time, only what is still equal."""
        n = len(self.place)
        order = np.arange(n)
        group = np.zeros(n, np.int64)  # by rank: where its group begins
        todo, depth = np.arange(n), 0  # ranks
        longest = int((self.end - self.place).max()) if n else 0
        while len(todo) and depth < longest:
            here = order[todo]
            key = self._chunk(here, depth)
            sub = np.lexsort((key, group[todo]))
            key, here, g = key[sub], here[sub], group[todo][sub]
            order[todo] = here
            new = np.append(True, (g[1:] != g[:-1]) | (key[1:] != key[:-1]))
            group[todo] = np.maximum.accumulate(np.where(new, todo, 0))
            last = np.append(new[1:], True)
            todo = todo[~(new & last)]
            depth += 8
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of places."""
        out, todo = np.zeros(len(a), np.int64), np.arange(len(a))
        most = np.minimum(self.end[a] - self.place[a], self.end[b] - self.place[b])
        while len(todo):
            x = self._chunk(a[todo], out[todo]) ^ self._chunk(b[todo], out[todo])
            same = np.full(len(x), 8)
            for k in range(8):
                same[(same == 8) & ((x >> np.uint64(8 * (7 - k))) & np.uint64(255) != 0)] = k
            out[todo] += same
            todo = todo[(same == 8) & (out[todo] < most[todo])]
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """By place in text order: bytes of the longest match that starts elsewhere, exact from `length` on."""
        n = len(self.order)
        best = np.zeros(n, np.int64)
        for ends, shift in ((self.head, -1), (self.tail, 1)):
            rank = np.flatnonzero(ends)
            other = rank + shift
            valid = (other >= 0) & (other < n)
            value = np.zeros(len(rank), np.int64)
            value[valid] = self._common(self.order[rank[valid]], self.order[other[valid]])
            sample = np.full(n, -1, np.int64)
            sample[self.order[rank]] = value
            last = np.maximum.accumulate(np.where(sample >= 0, np.arange(n), 0))
            best = np.maximum(best, sample[last] - (np.arange(n) - last)) if n else best
        return best


def _entries(key: np.ndarray, content: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, content), sorted; how often each occurs; whether it may repeat in itself; and the entry of each stretch."""
    order = np.lexsort((content, key))
    k, c = key[order], content[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])) if len(k) else np.empty(0, bool)
    start = np.flatnonzero(new)
    entry = np.empty(len(k), np.int64)
    entry[order] = np.cumsum(new) - 1
    return k[start], c[start], np.diff(np.append(start, len(k))).astype(np.uint32), again[order][start].astype(np.uint8), entry


def _ask(payload: bytes) -> tuple[np.ndarray, ...]:
    """A shard's entries and their figures."""
    _, _, data, offsets = open_shard(payload)
    return _entries(*stretches(data, offsets)[2:])[:4]


#: Of an entry: the stretch occurs twice; one of its kind goes to the index; its key has too many kinds for that.
TWICE, SUPPLY, WINDOWS = 1, 2, 4


def _count(columns: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    """Codes for a bucket's entries."""
    key, _, times, again = columns
    of_key = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1 if len(key) else np.empty(0, np.int64)
    kinds = np.bincount(of_key)[of_key] if len(key) else of_key
    return [(np.where(times > 1, TWICE, 0) | np.where((kinds > 1) | (again > 0), SUPPLY, 0) | np.where(kinds > HOT, WINDOWS, 0)).astype(np.uint8)], 0, 0


def _supply(n: int):
    def supply(left: pa.Table, right: pa.Table) -> pa.Table:
        """Marks that are decided (kind 0), stretches for the index (1) and windows to count (2)."""
        name = left.column("shard")[0].as_py()
        _, _, data, offsets = open_shard(left.column("payload")[0].as_py())
        start, size, key, content, again = stretches(data, offsets)
        codes = [a[0] for a in keyed.in_order(right.to_pylist())]
        entry = _entries(key, content, again)[-1]
        code = np.concatenate(codes)[entry] if codes else np.empty(0, np.uint8)
        twice = code & TWICE > 0
        rows = [{"kind": 0, "bucket": 0, "shard": name, "payload": keyed.pack(start[twice], size[twice])}]
        first = np.zeros(len(entry), bool)
        first[np.unique(entry, return_index=True)[1]] = True
        sent = np.flatnonzero((code & SUPPLY > 0) & first)
        sent = sent[np.argsort(key[sent], kind="stable")]
        for kind in (1, 2):
            pick = sent[(code[sent] & WINDOWS > 0) == (kind == 2)]
            count = size[pick]
            if kind == 2:
                at = np.sort(np.repeat(start[pick] - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))
                hashes = digests(data, at, at + LENGTH)
                own = np.searchsorted(start, at, "right") - 1
                order = np.argsort(hashes, kind="stable")
                columns = [hashes[order], key[own][order], at[order]]
            else:
                columns = [key[pick], start[pick], count, twice[pick].astype(np.uint8)]
            for i, place in keyed.parts(columns[0], n):
                part = [c[place] for c in columns]
                if kind == 1:
                    length = part[2] + LENGTH - 1
                    part.append(data[np.arange(int(length.sum())) + np.repeat(part[1] - (np.cumsum(length) - length), length)])
                rows.append({"kind": kind, "bucket": i, "shard": name, "payload": keyed.pack(*part)})
        return pa.Table.from_pylist(rows, schema=_SENT)

    return supply


def _marks(shards: pa.ChunkedArray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    return pa.table({"shard": shards, "payload": pa.array([keyed.pack(*f) for f in found], pa.binary())})


def _runs(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places as starts and lengths of runs."""
    new = np.flatnonzero(np.append(True, np.diff(place) != 1)) if len(place) else np.empty(0, np.int64)
    return place[new], np.diff(np.append(new, len(place)))


def _index(_key: tuple, table: pa.Table) -> pa.Table:
    """Streams a bucket's match lengths and marks the long ones."""
    asked = [keyed.unpack(p.as_py()) for p in table.column("payload")]
    count, twice, texts = (np.concatenate([a[i] for a in asked]) for i in (2, 3, 4))
    long_ = RunLengthIndex(texts, count + LENGTH - 1).matching_statistics() >= LENGTH
    long_ &= np.repeat(twice == 0, count)
    at, found = 0, []
    for _, start, size, _, _ in asked:
        n = int(size.sum())
        place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(n)
        found.append(_runs(np.sort(place[long_[at : at + n]])))
        at += n
    return _marks(table.column("shard"), found)


def _windows(_key: tuple, table: pa.Table) -> pa.Table:
    """Marks the windows of a bucket that occur twice."""
    asked = [keyed.unpack(p.as_py()) for p in table.column("payload")]
    hashes, key = (np.concatenate([a[i] for a in asked]) for i in range(2))
    order = np.lexsort((key, hashes))
    same = (hashes[order][1:] == hashes[order][:-1]) & (key[order][1:] == key[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order] = np.append(False, same) | np.append(same, False)
    at, found = 0, []
    for a in asked:
        found.append(_runs(np.sort(a[2][twice[at : at + len(a[2])]])))
        at += len(a[2])
    return _marks(table.column("shard"), found)


def _covered(data: np.ndarray, right: pa.Table) -> np.ndarray:
    change = np.zeros(len(data) + 1, np.int64)
    for p in right.column("payload"):
        start, size = keyed.unpack(p.as_py())
        np.add.at(change, start, 1)
        np.add.at(change, start + size + LENGTH - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _digest(left: pa.Table, right: pa.Table) -> pa.Table:
    ids, known, data, offsets = open_shard(left.column("payload")[0].as_py())
    gone = _covered(data, right)
    upto = np.concatenate([[0], np.cumsum(gone)])
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = offsets[:-1][offsets[:-1] < len(gone)]
    begins[inner] = gone[inner]
    spans = np.concatenate([[0], np.cumsum(begins)])
    kept = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=known == 0), "n_bytes": np.diff(offsets), "n_removed": np.diff(upto[offsets]), "n_spans": np.diff(spans[offsets]), "kept_sha256": pa.array(kept, pa.string())})


def _rows(place: int):
    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        """A shard's rows with what is left of their texts; bytes of broken characters go too, null stays null."""
        _, known, data, offsets = open_shard(left.column("payload")[0].as_py())
        gone = _covered(data, right)
        kept = [data[a:b][~gone[a:b]].tobytes().decode(errors="ignore") if k else None for a, b, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), known.tolist(), strict=True)]
        rest = open_rest(left.column("rest")[0].as_py())
        return rest.add_column(place, "text", pa.array(kept, pa.string()))

    return rows


def _by_shard(shards: DataFrame, other: DataFrame, n: int):
    """Both sides dealt by shard, of which there are n."""
    return keyed.dealt(shards, n, "shard").groupBy("shard").cogroup(keyed.dealt(other, n, "shard").groupBy("shard"))


def _marked(shards: DataFrame, n: int, held: int) -> DataFrame:
    """All marks of shards (shard, payload), of which there are `held`, by way of n buckets."""
    shards = shards.select("shard", "payload")
    codes = keyed.exchange(shards, _ask, _count, n, keys=2, once=SUPPLY)
    sent = spill(_by_shard(shards, codes.answers.select("shard", "bucket", "payload"), held).applyInArrow(_supply(n), "kind int, bucket int, shard string, payload binary"), "none")
    discard(*codes.spilled)
    del codes
    marks = sent.where("kind = 0").select("shard", "payload")
    for kind, fn in ((1, _index), (2, _windows)):
        of_kind = sent.where(F.col("kind") == kind).select("bucket", "shard", "payload")
        marks = marks.unionByName(keyed.dealt(of_kind, n, "bucket").groupBy("bucket").applyInArrow(fn, _MARKS))
    marks = spill(marks, "none")
    discard(sent)
    return marks


def _applied(docs: DataFrame, shards: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """What fn makes of each shard and its marks."""
    held = shards.count()
    marks = _marked(shards, keyed.buckets(docs), held)
    out = spill(_by_shard(shards, marks, held).applyInArrow(fn, schema))
    discard(shards, marks)
    return out


def removed(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. A row for each document, as in REMOVED."""
    docs = docs.select("doc_id", "text")
    return _applied(docs, spill(docs.mapInArrow(text_shards, "shard string, payload binary"), "none"), _digest, REMOVED)


def cleaned(docs: DataFrame) -> DataFrame:
    """docs: any columns, text among them. The same rows with what is left of their texts."""
    place = docs.columns.index("text")
    return _applied(docs, spill(docs.mapInArrow(row_shards(place), "shard string, payload binary, rest binary"), "none"), _rows(place), docs.schema)
