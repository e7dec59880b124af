"""Shards: bounded stretches of whole texts, packed as one row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from . import keyed
from .textbytes import column_bytes, row_runs

SHARD_BYTES = 8 << 20


def text_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a long id and a text as shard, payload; a text is never divided."""
    from pyspark import TaskContext

    part, n, ids, sizes, texts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

    def row() -> pa.RecordBatch:
        payload = keyed.pack(np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], np.uint8), np.concatenate(sizes), np.concatenate(texts))
        return pa.RecordBatch.from_pydict({"shard": [f"{part}-{n}"], "payload": [payload]})

    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        doc_ids, a = batch.column(0).to_pylist(), 0
        while a < len(doc_ids):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SHARD_BYTES - held, "right")) - 1)
            ids += doc_ids[a:b]
            sizes.append(np.diff(offsets[a : b + 1]))
            texts.append(data[offsets[a] : offsets[b]])
            held += int(offsets[b] - offsets[a])
            if held >= SHARD_BYTES - 65536:
                yield row()
                n, ids, sizes, texts, held = n + 1, [], [], [], 0
            a = b
    if ids:
        yield row()


def row_shards(place: int):
    """Shards of whole rows: the text is the column at that place, all others travel packed beside it, as `rest`."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = column_bytes(batch.column(place))
            others = batch.select([i for i in range(batch.num_columns) if i != place])
            for a, b in row_runs(offsets, SHARD_BYTES):
                text, known = batch.column(place)[a:b], batch.column(place)[a:b].is_valid()
                data, at = column_bytes(text)
                payload = keyed.pack(np.arange(b - a), np.array(known.to_pylist(), np.uint8), np.diff(at), data)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, others.schema) as out:
                    out.write_batch(others.slice(a, b - a))
                yield pa.RecordBatch.from_pydict({"shard": [f"{part}-{n}"], "payload": [payload], "rest": [zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())]})
                n += 1

    return shards


def open_rest(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()


def open_shard(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, whether each isn't null, all bytes, and the offsets of the texts."""
    ids, known, sizes, data = keyed.unpack(payload)
    return ids, known, data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
