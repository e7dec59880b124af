"""Sums over all keys of a corpus, sent back to the shards that asked, without a row for each key.

A shard is a bounded stretch of documents. It asks once for each distinct key (a 64-bit hash) that it holds, so a key
that fills a third of the corpus weighs as much as any other: shards pre-aggregate before the shuffle. Requests are
sorted, cut into buckets of the hash and packed as bytes; a bucket's task merges what all shards ask, and answers each
shard in the order in which it asked. Buckets are as many as the corpus needs for bounded ones. With more shards than
FAN, requests are merged by groups of shards on their way, level by level, and the answers go back the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spill

BUCKET_BYTES = 16 << 20
#: Rows that a shard or a task sends at most.
FAN = 256
MOST_PARTITIONS = 20_000
#: Bytes of a plane from which the planes of a payload are frames of their own.
APART = 2048


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; sorted 64-bit keys as gaps, all others as they are, by planes of bytes.

    A long plane is a frame of its own, with a code that fits its bytes: most planes of keys are noise and the upper ones
    few values, which one code for both would store as noise too.
    """
    pieces = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        gaps = x.dtype == np.uint64 and len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        y = np.diff(x, prepend=np.uint64(0)) if gaps else x
        planes = [p.tobytes() for p in y.view(np.uint8).reshape(len(y), y.dtype.itemsize).T]
        head = np.array([len(x), gaps], np.int64).tobytes() + y.dtype.str.encode().ljust(8)
        pieces += [(len(head) + y.nbytes).to_bytes(8, "little") + head, *planes]
    code = zstandard.ZstdCompressor(level=1).compress
    if max(map(len, pieces), default=0) < APART:
        return code(b"".join(pieces))
    return b"".join(map(code, pieces))


def unpack(blob: bytes) -> list[np.ndarray]:
    body, out, at = zstandard.ZstdDecompressor().stream_reader(blob, read_across_frames=True).readall(), [], 0
    while at < len(body):
        size = int.from_bytes(body[at : at + 8], "little")
        head = np.frombuffer(body, np.int64, 2, at + 8)
        kind = np.dtype(body[at + 24 : at + 32].decode().strip())
        planes = np.frombuffer(body, np.uint8, int(head[0]) * kind.itemsize, at + 32).reshape(kind.itemsize, int(head[0]))
        x = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
        out.append(np.cumsum(x, dtype=np.uint64) if head[1] else x)
        at += 8 + size
    return out


def buckets(docs: DataFrame, text: str = "text", limit: int = BUCKET_BYTES) -> int:
    """As many as bound a bucket by limit bytes of text, at least a few for each core."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-int(size) // limit))


def parts(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted keys, of n by the upper half of the hash, and where each bucket's keys are."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=False):
        yield int(bucket[a]), slice(a, b)


def merge(asked: list[list[np.ndarray]], keys: int = 1) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Requests as one: distinct keys (the first columns), sorted, with the sums of their values; the entry of each row of all requests, and whether it is the entry's first."""
    columns = [np.concatenate(c) for c in zip(*asked, strict=True)]
    order = np.lexsort(columns[:keys][::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns[:keys]:
        here = c[order]
        new[1:] |= here[1:] != here[:-1]
    start = np.flatnonzero(new)
    entry, first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    entry[order], first[order[start]] = np.cumsum(new) - 1, True
    sums = [np.add.reduceat(c[order].astype(np.int64), start) if len(start) else np.empty(0, np.int64) for c in columns[keys:]]
    return [c[order][start] for c in columns[:keys]] + sums, entry, first


def in_order(rows: list[dict]) -> list[list[np.ndarray]]:
    """A shard's answers, by bucket, which is the order of its keys."""
    return [unpack(r["payload"]) for r in sorted(rows, key=lambda r: r["bucket"])]


def dealt(df: DataFrame, groups: int, *columns: str) -> DataFrame:
    """At least a partition for each bounded group, where the session has fewer."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(groups, MOST_PARTITIONS), *columns) if groups > usual else df


class Exchange(NamedTuple):
    """answers: shard, bucket, payload; totals: what the last level adds up, as a and b; spilled: to discard afterwards."""

    answers: DataFrame
    totals: DataFrame
    spilled: list[DataFrame]


def plan(shards: int, buckets_: int, fan: int = FAN) -> list[tuple[int, int]]:
    """Groups of shards and ranges of keys at each level; the last has one group.

    While there are at most fan shards, one level sends every shard's requests straight to the buckets. Beyond that, a
    level merges groups of shards, each for a part of the range, and the next one splits those parts further. A task
    holds about as much as a shard at every level, and a shard or task sends at most fan rows, so rows grow in proportion
    to the shards, not to shards times buckets.
    """
    levels = 1
    while fan**levels < shards:
        levels += 1
    if levels == 1:
        return [(1, max(1, buckets_))]
    step = next(f for f in range(2, fan + 1) if f**levels >= shards)
    return [(-(-shards // step ** (k + 1)), step ** (k + 1)) for k in range(levels)]


_ASKED = "grp long, bucket long, child string, payload binary"
_ASKED_SCHEMA = pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("child", pa.string()), ("payload", pa.binary())])
_TOLD = "child string, bucket long, payload binary, a long, b long"


def _cut_up(columns: list[np.ndarray], child: str, grp: int, bucket: int, parts: int, ranges: int) -> pa.Table:
    """Rows of one request for the parts of a bucket, of which there are `ranges` in all; empty parts have none."""
    edges = np.array([(i << 64) // ranges for i in range(bucket * parts, (bucket + 1) * parts)], np.uint64)
    at = np.append(np.searchsorted(columns[0], edges, "left"), len(columns[0]))
    some = np.flatnonzero(np.diff(at))
    payloads = [pack(*(c[at[i] : at[i + 1]] for c in columns)) for i in some]
    return pa.table([pa.array([grp] * len(some), pa.int64()), pa.array(some + bucket * parts, pa.int64()), pa.array([child] * len(some), pa.string()), pa.array(payloads, pa.binary())], schema=_ASKED_SCHEMA)


def exchange(shards: DataFrame, ask: Callable[[bytes], Iterable[np.ndarray]], answer: Callable[[list[np.ndarray]], tuple[list[np.ndarray], int, int]], n: int, keys: int = 1, once: int = 0, fan: int = FAN) -> Exchange:
    """Sums of all shards' values for each shard's keys.

    ask: a shard's payload as columns sorted by the keys, the first `keys` of them, then values to add up; answer: arrays
    for the merged columns of a bucket, and two numbers to total. Bits of `once` in the first array go to one holder of
    an entry only.
    """
    levels = plan(shards.count(), n, fan)

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, ranges = levels[0]
        for batch in batches:
            for name, payload in zip(batch.column("shard").to_pylist(), batch.column("payload"), strict=True):
                yield from _cut_up(list(ask(payload.as_py())), name, zlib.crc32(name.encode()) % groups, 0, ranges, ranges).to_batches()

    def up(level: int):
        groups, ranges = levels[level]

        def merged(key: tuple, table: pa.Table) -> pa.Table:
            grp, bucket = (k.as_py() for k in key)
            columns, _, _ = merge([unpack(p.as_py()) for p in table.column("payload")], keys)
            return _cut_up(columns, str(grp), grp % groups, bucket, ranges // levels[level - 1][1], ranges)

        return merged

    def tell(table: pa.Table, bucket: int, answers: list[np.ndarray], entry: np.ndarray, first: np.ndarray, sizes: list[int], a: int, b: int) -> pa.Table:
        rows, at = [], 0
        for size in sizes:
            mine = [x[entry[at : at + size]] for x in answers]
            if once:
                mine[0] = np.where(first[at : at + size], mine[0], mine[0] & mine[0].dtype.type(~once & 0xFF))
            rows.append(pack(*mine))
            at += size
        k = len(rows)
        return pa.table({"child": table.column("child"), "bucket": pa.array([bucket] * k, pa.int64()), "payload": pa.array(rows, pa.binary()), "a": pa.array([a] + [0] * (k - 1), pa.int64()), "b": pa.array([b] + [0] * (k - 1), pa.int64())})

    def by_name(table: pa.Table) -> pa.Table:
        """The first holder must be the same however often a task runs."""
        return table.sort_by("child")

    def top(key: tuple, table: pa.Table) -> pa.Table:
        table = by_name(table)
        asked = [unpack(p.as_py()) for p in table.column("payload")]
        columns, entry, first = merge(asked, keys)
        answers, a, b = answer(columns)
        return tell(table, key[1].as_py(), answers, entry, first, [len(x[0]) for x in asked], a, b)

    def down(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        table = by_name(table)
        asked = [unpack(p.as_py()) for p in table.column("payload")]
        parts = in_order(told.select(["bucket", "payload"]).to_pylist())
        _, entry, first = merge(asked, keys)
        return tell(table, key[1].as_py(), [np.concatenate(x) for x in zip(*parts, strict=True)], entry, first, [len(x[0]) for x in asked], 0, 0)

    requests, spilled = [shards.select("shard", "payload").mapInArrow(asks, _ASKED)], []
    if len(levels) > 1:
        requests[0] = spill(requests[0], "none")
        spilled.append(requests[0])
    for level in range(1, len(levels)):
        groups, ranges = levels[level - 1]
        rows = dealt(requests[-1], groups * ranges, "grp", "bucket").groupBy("grp", "bucket").applyInArrow(up(level), _ASKED)
        requests.append(spill(rows, "none") if level < len(levels) - 1 else rows)
        if level < len(levels) - 1:
            spilled.append(requests[-1])
    told = dealt(requests[-1], levels[-1][0] * levels[-1][1], "grp", "bucket").groupBy("grp", "bucket").applyInArrow(top, _TOLD)
    if len(levels) > 1:
        told = spill(told, "none")
        spilled.append(told)
    totals = told
    for level in range(len(levels) - 1, 0, -1):
        groups, ranges = levels[level - 1]
        parts = levels[level][1] // ranges
        above = told.select(F.col("child").cast("long").alias("grp"), F.expr(f"bucket div {parts}").alias("up"), "bucket", "payload")
        below = dealt(requests[level - 1], groups * ranges, "grp", "bucket").groupBy("grp", "bucket")
        told = below.cogroup(dealt(above, groups * ranges, "grp", "up").groupBy("grp", "up")).applyInArrow(down, _TOLD)
        if level > 1:
            told = spill(told, "none")
            spilled.append(told)
    return Exchange(told.select(F.col("child").alias("shard"), "bucket", "payload", "a", "b"), totals, spilled)
