"""Harmonic packing of documents into sequences of CAPACITY ids.

What a document has beyond whole sequences, or all of it, has a length in one of the classes (CAPACITY / (k + 1),
CAPACITY / k]; a bin of class k takes exactly k of them, whole. What then stays free in the bin, less than one more
length of the class, is closed by the first documents that fit into it, and, where too many bins wait for one, by the
head of the next document. So documents are cut only beyond the capacity or to close a bin, and closed bins have no
padding. Every task counts its own classes' bins, independently of all other tasks.

What a task has in bins that stay open at its end (less than one bin a class, and WAITING more) goes to a second round
over GROUP tasks with its ids, which packs it in the same way and then strings together what is left, so that only the
very last bin of a group of tasks may stay short.

Defined results: a null or empty text is the end id alone; null doc_ids stay null; repeated rows are each packed; an
empty table gives no pieces. ``pack`` passes no other columns on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spill
from .textbytes import column_bytes, row_runs
from .token_ids import encoder

CAPACITY, END = 2048, 1
GROUP = 16
#: Bins of a task that may wait for a document that fits before one is cut for them.
WAITING = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("task", pa.int32()), ("ids", pa.binary())])
#: A sequence's id: task or group, then round and bin. Bins of a task stay below 2**38.
_TASK_BITS, _ROUND2 = 39, 1 << 38

#: doc_id, start, ids as little-endian bytes, doc_tokens.
Piece = tuple[int | None, int, bytes | memoryview, int]


class Bin:
    """Pieces in their order, and the ids that still fit."""

    __slots__ = ("free", "pieces")

    def __init__(self) -> None:
        self.free, self.pieces = CAPACITY, []

    def put(self, piece: Piece) -> None:
        self.pieces.append((piece[0], piece[1], bytes(piece[2]), piece[3]))  # a copy, that lets go of the batch
        self.free -= len(piece[2]) // 4


class Packer:
    """Bins of each class; full bins become rows."""

    def __init__(self, base: int) -> None:
        self.next, self.rows = base, []
        self.open: dict[int, Bin] = {}  # by class, with fewer than k pieces
        self.waiting: list[Bin] = []  # with k pieces, and room

    def emit(self, pieces: list[Piece]) -> None:
        """A sequence."""
        at = 0
        for doc, start, ids, n in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, self.next, at, 0, None))
            at += len(ids) // 4
        self.next += 1

    def _close(self, at: int, piece: Piece) -> None:
        """Puts a piece into a waiting bin."""
        bin_ = self.waiting[at]
        bin_.put(piece)
        if not bin_.free:
            self.emit(bin_.pieces)
            del self.waiting[at]

    def add(self, doc: int | None, start: int, ids: bytes | memoryview, n: int) -> None:
        """A document, or a piece of one."""
        size = len(ids) // 4
        fits = [(b.free, i) for i, b in enumerate(self.waiting) if b.free >= size]
        if fits:  # whole, where least stays free
            self._close(min(fits)[1], (doc, start, ids, n))
            return
        # a document beyond the capacity is cut anyway; others only when too many bins wait
        while self.waiting and size and (size > CAPACITY or len(self.waiting) >= WAITING):
            at = max(range(len(self.waiting)), key=lambda i: self.waiting[i].free)
            k = min(self.waiting[at].free, size)
            self._close(at, (doc, start, ids[: 4 * k], n))
            start, ids, size = start + k, ids[4 * k :], size - k
        while size >= CAPACITY:
            self.emit([(doc, start, ids[: 4 * CAPACITY], n)])
            start, ids, size = start + CAPACITY, ids[4 * CAPACITY :], size - CAPACITY
        if size:
            k = CAPACITY // size  # its class
            bin_ = self.open.setdefault(k, Bin())
            bin_.put((doc, start, ids, n))
            if len(bin_.pieces) == k:
                del self.open[k]
                if bin_.free:
                    self.waiting.append(bin_)
                else:
                    self.emit(bin_.pieces)

    def left(self) -> list[Piece]:
        """The pieces of all bins that aren't full, longest first."""
        return sorted((p for b in (*self.open.values(), *self.waiting) for p in b.pieces), key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1]))

    def string_together(self) -> None:
        """Cuts what is left into sequences, one piece after the other; the last may stay short."""
        held, room = [], CAPACITY
        for doc, start, ids, n in self.left():
            while ids:
                k = min(room, len(ids) // 4)
                held.append((doc, start, ids[: 4 * k], n))
                start, ids, room = start + k, ids[4 * k :], room - k
                if not room:
                    self.emit(held)
                    held, room = [], CAPACITY
        if held:
            self.emit(held)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _cutter(path: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode = TaskContext.get().partitionId(), encoder(path, False)
        packer = Packer(task << _TASK_BITS)
        for batch in batches:
            _, offsets = column_bytes(batch.column(1))
            for a, b in row_runs(offsets):
                ids, sizes = encode(batch.column(1)[a:b], END)
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                for doc, n in zip(batch.column(0)[a:b].to_pylist(), sizes.tolist(), strict=True):
                    packer.add(doc, 0, raw[4 * at : 4 * (at + n)], n)
                    at += n
                if packer.rows:
                    yield _batch(packer.rows, _SCHEMA)
                    packer.rows = []
        left = [(doc, start, len(ids) // 4, None, n, None, None, task, ids) for doc, start, ids, n in packer.left()]
        if left:
            yield _batch(left, _SCHEMA)

    return pack


def _second(key: tuple, table: pa.Table) -> pa.Table:
    """What GROUP tasks have left."""
    packer = Packer((key[0].as_py() * GROUP << _TASK_BITS) + _ROUND2)
    for r in sorted(table.to_pylist(), key=lambda r: (-r["length"], r["task"], r["doc_id"] is None, r["doc_id"] or 0, r["start"])):
        packer.add(r["doc_id"], r["start"], memoryview(r["ids"]), r["doc_tokens"])
    packer.string_together()
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*packer.rows, strict=True))[:7]], names=_SCHEMA.names[:7])


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs: doc_id, text. A row for each piece, as in PIECES."""
    first = spill(docs.select("doc_id", "text").mapInArrow(_cutter(tokenizer), PIECES + ", task int, ids binary"))
    rest = first.where("sequence_id is null").withColumn("g", F.expr(f"int(task div {GROUP})")).groupBy("g").applyInArrow(_second, PIECES)
    return first.where("sequence_id is not null").drop("task", "ids").unionByName(rest)
