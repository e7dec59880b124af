"""Engines that read page images: a protocol, a registry and the map over pages. None is bundled; tests use a fake one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = "doc_id long, page int, ord int, text string, confidence double, x double, y double, w double, h double, error string"
AUTO = ("surya", "tesseract", "paddle")


class Engine(Protocol):
    def recognise(self, image: bytes, width: int, height: int) -> list[dict]:
        """Blocks: text, confidence, x, y, w, h."""


_engines: dict[str, Callable[[], Engine]] = {}


def register(name: str, make: Callable[[], Engine]) -> None:
    _engines[name] = make


def candidates(preferred: str = "auto", fallback: bool = True) -> list[str]:
    """UDF-02: the preferred engine first, then the rest, as far as registered."""
    order = list(AUTO) if preferred == "auto" else [preferred, *(n for n in AUTO if n != preferred)] if fallback else [preferred]
    found = [n for n in order if n in _engines]
    if not found:
        raise ValueError(f"no engine of {order}")
    return found


#: Blocks that a Python worker holds before it hands them on.
BATCH_ROWS = 4096
_KINDS = [("doc_id", pa.int64()), ("page", pa.int32()), ("ord", pa.int32()), ("text", pa.string()), *((c, pa.float64()) for c in ("confidence", "x", "y", "w", "h")), ("error", pa.string())]


def read(pages: Iterator[tuple], makers: list[Callable[[], Engine]], accept: Callable[[list[dict]], bool]) -> Iterator[pa.RecordBatch]:
    """Blocks of pages (doc_id, page, image, width, height), of which one is held at a time."""
    engines, rows = [m() for m in makers], []
    for doc, page, image, w, h in pages:
        best, score, error = [], -1.0, None
        for e in engines:
            try:
                found = e.recognise(image, w, h)
            except Exception as x:  # a page must not fail the job
                error = str(x)
                continue
            mean = sum(f["confidence"] for f in found) / len(found) if found else 0.0
            if mean > score:
                best, score, error = found, mean, None
            if accept(found):
                break
        rows += [{"doc_id": doc, "page": page, "ord": i, "error": None, **f} for i, f in enumerate(best)] or [{"doc_id": doc, "page": page, "ord": 0, "error": error}]
        if len(rows) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_KINDS))
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_KINDS))


def blocks(pages: DataFrame, makers: list[Callable[[], Engine]], accept: Callable[[list[dict]], bool]) -> DataFrame:
    """pages: doc_id, page, image, width, height. The first engine whose blocks are accepted, else the best by mean confidence; a page that fails gives a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("doc_id", "page", "image", "width", "height")
        return read((tuple(b.column(c)[i].as_py() for c in fields) for b in batches for i in range(b.num_rows)), makers, accept)

    return pages.mapInArrow(run, BLOCKS)
