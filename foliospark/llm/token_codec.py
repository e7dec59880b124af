"""Token ids in files of independently reset, checksummed blocks, coded by an adaptive context-mixing range coder.

A block's ids are cut into lanes that are coded side by side with numpy and share one model, which begins anew in each
block. Two tables predict the next id from the last two ids and from the last one, each with a confidence; for every
pair of confidences, adaptive counts say how often the one, the other or neither is right, and so mix them into the
interval of the coder. Where neither is right, an adaptive distribution of single ids codes the id. The decoder makes the
same predictions and so reads back the ids; a checksum of block and ids each catches damage.

A file is Parquet with a row a block (any store of Spark's will do, files split between blocks): part, block, ids before
the block in its part, ids in it, its documents and the coded payload. Parts are ranges of doc_id, so ascending doc_id
is the order of part, block and document.

Defined results: null or empty texts are the end id alone; null doc_ids come first; rows with one doc_id stand side by
side, by text; an empty table gives a file without blocks. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import keyed
from .common import scratch
from .textbytes import column_bytes, row_runs
from .token_ids import encoder

END = 2
MAGIC, LANES, LANE_IDS = b"FTB1", 8192, 192
BLOCK_IDS = 1 << 21
PART_BYTES = 32 << 20
#: Parts whose sums are added up at once; parts whose offsets (16 bytes each) go to all tasks, beyond which they are joined by a shuffle.
GROUP, BROADCAST_PARTS = 4096, 1 << 20
FILE = "part int, block int, before long, n_ids long, docs binary, payload binary"
_32, _16, _LOW = np.uint64(1 << 32), np.uint64(16), np.uint64((1 << 32) - 1)
_LOW48 = np.uint64((1 << 48) - 1)
_ORDER2_BITS = 20
_STEP, _REFRESH, _LIMIT = 24, 8, 1 << 22
_TABLE_BITS = 16
#: The next confidence, in place above an id: after a wrong prediction (first four) and a right one.
_SURE = np.array([0, 0, 1, 1, 1, 2, 3, 3], np.uint64) << np.uint64(32)
#: Whether the id stays in place, in the same order.
_STAYS = np.array([0, 0, 1, 1, 1, 1, 1, 1], bool)


class Model:
    """Predictions shared by the lanes of a block; arrays have an entry a lane."""

    def __init__(self, ids: int) -> None:
        self.size2, self.size1 = 1 << _ORDER2_BITS, 1 << 16
        none = np.uint32(0xFFFFFFFF)
        # an id in the low 32 bits, its confidence above
        self.two, self.one = np.full(self.size2, none, np.uint64), np.full(self.size1, none, np.uint64)
        self.outcomes = np.tile(np.array([2, 1, 3], np.int64), (32, 1))
        self.single = np.ones(ids, np.int64)
        self.age = 0
        self._sum()
        self._mix()

    def _sum(self) -> None:
        if self.single.sum() > _LIMIT:
            self.single = (self.single >> 1) | 1
        self.upto = np.concatenate([[0], np.cumsum(self.single)]).astype(np.uint64)
        self.table = None

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids in whose intervals of single ids v lie: a table by v's upper bits, then halving."""
        if self.table is None:
            self.shift = np.uint64(max(0, int(self.upto[-1]).bit_length() - _TABLE_BITS))
            begun = np.bincount((self.upto >> self.shift).view(np.int64))
            self.table = np.concatenate([[0], np.cumsum(begun)])
        at = (v >> self.shift).view(np.int64)
        first, last = self.table[at], self.table[at + 1]  # how many intervals begin by v lies between
        todo = np.flatnonzero(first < last)
        a, b, v = first[todo], last[todo], v[todo]
        while len(todo):
            half = (a + b) >> 1
            over = self.upto[half] <= v
            a, b = np.where(over, half + 1, a), np.where(over, b, half)
            left = a < b
            if not left.all():
                first[todo[~left]] = a[~left]
                todo, a, b, v = todo[left], a[left], b[left], v[left]
        return first - 1

    def _mix(self) -> None:
        """By kind and outcome: where its interval begins, and its size; by kind: all of it."""
        self.size = self.outcomes.ravel().astype(np.uint64)
        self.begin = (np.cumsum(self.outcomes, 1) - self.outcomes).ravel().astype(np.uint64)
        self.all = self.outcomes.sum(1).astype(np.uint64)

    def predict(self, last: np.ndarray, before: np.ndarray) -> None:
        """last, before: the last two ids, uint64."""
        self.at2 = ((before * np.uint64(0x9E3779B97F4A7C15) ^ last * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _ORDER2_BITS)).view(np.int64)
        self.at1 = (last & np.uint64(0xFFFF)).view(np.int64)
        was2, was1 = self.two[self.at2], self.one[self.at1]
        self.id2, self.id1 = was2 & _LOW, was1 & _LOW
        self.sure2, self.sure1 = (was2 >> np.uint64(32)).view(np.int64), (was1 >> np.uint64(32)).view(np.int64)
        self.kind = (self.sure2 << 3) | (self.sure1 << 1) | (self.id2 == self.id1)
        self.total = self.all[self.kind]

    def learn(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        for table, at, id_, sure in ((self.two, self.at2, self.id2, self.sure2), (self.one, self.at1, self.id1, self.sure1)):
            case = ((ids == id_).view(np.int8) << 2) + sure
            table[at] = np.where(_STAYS[case], id_, ids) | _SURE[case]
        self.outcomes += np.bincount(self.kind * 3 + outcome, minlength=96).reshape(32, 3)
        full = self.outcomes.sum(1) > 1 << 16
        if full.any():
            self.outcomes[full] = (self.outcomes[full] >> 1) | 1
        self._mix()
        np.add.at(self.single, ids[outcome == 2].view(np.int64), _STEP)
        self.age += 1
        if self.age % _REFRESH == 0 or self.age < 8:
            self._sum()


def _layout(n: int) -> tuple[int, int]:
    """Lanes and steps: every lane has a step's ids, but for the last ones."""
    steps = max(1, -(-n // max(1, min(LANES, n // LANE_IDS))))
    return -(-n // steps), steps


def _by_step(ids: np.ndarray, lanes: int, steps: int) -> np.ndarray:
    """A row a step, with an id for each lane; lanes without that step have 0."""
    whole = np.zeros(lanes * steps, np.uint32)
    whole[: len(ids)] = ids
    return np.ascontiguousarray(whole.reshape(lanes, steps).T).astype(np.uint64)


def encode(ids: np.ndarray) -> bytes:
    """A block."""
    n = len(ids)
    top = int(ids.max()) + 1 if n else 1
    lanes, steps = _layout(n) if n else (0, 0)
    by_step, every = _by_step(ids, lanes, steps), np.arange(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
    out, used = np.zeros((lanes, steps + 16), np.uint16), np.zeros(lanes, np.int64)
    model, last, before = Model(top), np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)

    def carry(which: np.ndarray) -> None:
        at = used[which] - 1
        while len(which):
            out[which, at] += np.uint16(1)
            over = out[which, at] == 0
            which, at = which[over], at[over] - 1

    def narrow(k: np.ndarray | slice, upto: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        nonlocal out
        r = span[k] // total
        at, wide = low[k] + r * upto, r * size
        over = np.flatnonzero(at > _LOW48)
        if len(over):
            at[over] &= _LOW48
            carry(every[k][over])
        low[k], span[k] = at, wide
        few = np.flatnonzero(wide < _32)
        short, at, wide = every[k][few], at[few], wide[few]
        while len(short):
            end = used[short]
            if end.max() >= out.shape[1]:
                out = np.concatenate([out, np.zeros_like(out)], 1)
            out[short, end] = (at >> np.uint64(32)).astype(np.uint16)
            used[short] = end + 1
            at, wide = (at & _LOW) << _16, wide << _16
            low[short], span[short] = at, wide
            few = np.flatnonzero(wide < _32)
            short, at, wide = short[few], at[few], wide[few]

    for t in range(steps):
        k = -(-(n - t) // steps)  # lanes that have a step t
        here = by_step[t, :k]
        model.predict(last[:k], before[:k])
        outcome = np.where(here == model.id2, 0, 2 - (here == model.id1))
        cell = model.kind * 3 + outcome
        narrow(slice(0, k), model.begin[cell], model.size[cell], model.total)
        miss = np.flatnonzero(outcome == 2)
        if len(miss):
            x = here[miss].view(np.int64)
            begin = model.upto[x]
            narrow(miss, begin, model.upto[x + 1] - begin, model.upto[-1])
        model.learn(here, outcome)
        before[:k], last[:k] = last[:k], here
    for _ in range(3):
        if lanes and used.max() >= out.shape[1]:
            out = np.concatenate([out, np.zeros_like(out)], 1)
        out[np.arange(lanes), used] = (low >> np.uint64(32)).astype(np.uint16)
        used += 1
        low = (low & _LOW) << _16
    words = out[np.arange(out.shape[1]) < used[:, None]] if lanes else np.empty(0, np.uint16)
    body = np.array([n, top, zlib.crc32(ids.astype("<u4").tobytes())], "<u4").tobytes() + used.astype("<u4").tobytes() + words.astype("<u2").tobytes()
    return MAGIC + zlib.crc32(body).to_bytes(4, "little") + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it or they are damaged."""
    if block[:4] != MAGIC or zlib.crc32(block[8:]) != int.from_bytes(block[4:8], "little"):
        raise ValueError("damaged block")
    n, top, check = (int(x) for x in np.frombuffer(block, "<u4", 3, 8))
    if not n:
        return np.empty(0, np.uint32)
    lanes, steps = _layout(n)
    used = np.frombuffer(block, "<u4", lanes, 20).astype(np.int64)
    words = np.concatenate([np.frombuffer(block, "<u2", -1, 20 + 4 * lanes), np.zeros(4, "<u2")])
    at = np.cumsum(used) - used
    first = words[at[:, None] + np.arange(3)].astype(np.uint64)
    code = (first[:, 0] << np.uint64(32)) | (first[:, 1] << _16) | first[:, 2]
    at += 3
    span = np.full(lanes, 1 << 48, np.uint64)
    model, last, before = Model(top), np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
    out, every = np.zeros((steps, lanes), np.uint32), np.arange(lanes)

    def take(k: np.ndarray | slice, r: np.ndarray, upto: np.ndarray, size: np.ndarray) -> None:
        left, wide = code[k] - r * upto, r * size
        code[k], span[k] = left, wide
        few = np.flatnonzero(wide < _32)
        short, left, wide = every[k][few], left[few], wide[few]
        while len(short):
            next_ = at[short]
            left, wide = (left << _16) | words[np.minimum(next_, len(words) - 1)], wide << _16
            at[short] = next_ + 1
            code[short], span[short] = left, wide
            few = np.flatnonzero(wide < _32)
            short, left, wide = short[few], left[few], wide[few]

    for t in range(steps):
        k = -(-(n - t) // steps)
        model.predict(last[:k], before[:k])
        r = span[:k] // model.total
        v = np.minimum(code[:k] // r, model.total - np.uint64(1))
        cell = model.kind * 3
        outcome = (v >= model.begin[cell + 1]).astype(np.int64) + (v >= model.begin[cell + 2])
        cell += outcome
        take(slice(0, k), r, model.begin[cell], model.size[cell])
        here = np.where(outcome == 0, model.id2, model.id1)
        miss = np.flatnonzero(outcome == 2)
        if len(miss):
            r = span[miss] // model.upto[-1]
            v = np.minimum(code[miss] // r, model.upto[-1] - np.uint64(1))
            x = model.find(v)
            begin = model.upto[x]
            take(miss, r, begin, model.upto[x + 1] - begin)
            here[miss] = x
        model.learn(here, outcome)
        before[:k], last[:k] = last[:k], here
        out[t, :k] = here
    ids = out.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("damaged ids")
    return ids


def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, before, ids, sizes, names, held, encode_ = TaskContext.get().partitionId(), 0, 0, [], [], [], 0, encoder(path, True)

        def row() -> pa.RecordBatch:
            every = np.concatenate(ids)
            docs = keyed.pack(np.array([i or 0 for i in names], np.int64), np.array([i is not None for i in names], np.uint8), np.concatenate(sizes).astype(np.uint32))
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "before": before, "n_ids": held, "docs": docs, "payload": encode(every)}], schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.binary()), ("payload", pa.binary())]))

        for batch in batches:
            _, offsets = column_bytes(batch.column(1))
            for a, b in row_runs(offsets):
                new, n = encode_(batch.column(1)[a:b], END)
                ids.append(new)
                sizes.append(n)
                names += batch.column(0)[a:b].to_pylist()
                held += len(new)
                if held >= BLOCK_IDS:
                    yield row()
                    block, before, ids, sizes, names, held = block + 1, before + held, [], [], [], 0
        if names:
            yield row()

    return write


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """docs: doc_id, text. Writes the ids of all texts in ascending doc_id order."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(size) // PART_BYTES))
    # a hash of the text splits an id, or a null, that many rows have
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")
    ordered.mapInArrow(_writer(tokenizer), FILE).write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, docs, payload in zip(*(batch.column(c) for c in ("at", "docs", "payload")), strict=True):
            names, known, sizes = keyed.unpack(docs.as_py())
            ids = decode(payload.as_py()).astype("<u4")
            ends = np.cumsum(sizes, dtype=np.int64)
            raw = memoryview(ids.tobytes())
            begin = ends - sizes
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64(), mask=known == 0), "start": begin + at.as_py(), "n_tokens": sizes.astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})


def offsets(blocks: DataFrame) -> DataFrame:
    """part, first: the ids in all parts before; sums of GROUP parts are added up first, so that one task sees a row for GROUP parts only."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("g", F.expr(f"part div {GROUP}"))
    groups = parts.groupBy("g").agg(F.sum("n").alias("n"))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("part", "g", before("g", "part").alias("inner")).join(groups.select("g", before(F.lit(0), "g").alias("outer")), "g").select("part", (F.col("inner") + F.col("outer")).alias("first"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the file: doc_id, start, n_tokens, ids_crc32, from the decoded ids."""
    blocks = spark.read.schema(FILE).parquet(path)
    # only the parts' sums meet their parts' numbers; a block's payload is read where it lies
    first = F.broadcast(offsets(blocks)) if blocks.select("part").distinct().count() <= BROADCAST_PARTS else offsets(blocks)
    at = blocks.join(first, "part").select((F.col("first") + F.col("before")).alias("at"), "docs", "payload")
    return at.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes a file in the shared folder and reads it back."""
    path = scratch(docs.sparkSession)
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path)
