"""What a worker holds at once does not grow with the batch that it gets."""

import pyarrow as pa
import pytest

from foliospark.operators import kernels as k
from foliospark.sources import ocr


class Taken:
    """Stands for a DataFrame: hands back the function that it was to map."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def batch(n):
    return pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": ["x" * 10] * n})


@pytest.mark.parametrize(("n", "kind", "f"), [(300, "binary", lambda x: b"p" * 200_000), (3000, "string", lambda x: "y" * 30_000), (3000, "array<array<long>>", lambda x: [list(range(40))] * 100), (5000, "double", lambda x: None), (0, "long", len)])
def test_results_leave_as_they_come(n, kind, f):
    run = k._mapped(Taken(), f"doc_id long, value {kind}", f, ["doc_id"], ["text"], "value")
    got = list(run(iter([batch(n), batch(n)])))
    assert [i for b in got for i in b.column("doc_id").to_pylist()] == [*range(n)] * 2
    assert all(b.num_rows <= 512 and b.column("value").nbytes < 6e6 for b in got)
    assert not n or got[0].column("value")[0].as_py() == f("x" * 10)


def test_one_row_at_a_time():
    """A row is made into an object when its turn comes, and its result leaves before the batch is through."""
    seen = []
    out = k._mapped(Taken(), "doc_id long, value binary", lambda x: seen.append(x) or b"p" * 5_000_000, ["doc_id"], ["text"], "value")(iter([batch(50)]))
    next(out)
    assert len(seen) == 1


def test_batches_are_of_one_kind():
    """A batch of empty lists or nulls alone has the column's type all the same."""
    values = [[]] * 600 + [[[1, 2]]] * 10 + [None] * 600
    out = k._mapped(Taken(), "doc_id long, value array<array<long>>", lambda x, it=iter(values): next(it), ["doc_id"], ["text"], "value")(iter([batch(1210)]))
    assert {str(b.schema.field("value").type) for b in out} == {str(pa.list_(pa.list_(pa.int64())))}


def test_pages_are_drawn_and_read_one_by_one():
    drawn = []

    class Engine:
        def recognise(self, image, width, height):
            return [{"text": "t", "confidence": 1.0, "x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0}] * 5000

    def pages():
        for i in range(20):
            drawn.append(i)
            yield i, 0, b"", 1, 1

    out = ocr.read(pages(), [Engine], bool)
    assert next(out).num_rows == 5000 and drawn == [0]
    assert sum(b.num_rows for b in out) == 95_000
