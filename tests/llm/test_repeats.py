import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import repeats


def brute(rows, n=repeats.LENGTH):
    places = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for d, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            places[t[i : i + n]].append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for where in places.values():
        if len(where) > 1:
            for d, i in where:
                gone[d][i : i + n] = True
    out = []
    for (i, _), t, g in zip(rows, texts, gone, strict=True):
        spans = int((g & ~np.append(False, g[:-1])).sum()) if len(g) else 0
        out.append((i, len(t), int(g.sum()), spans, hashlib.sha256(bytes(b for b, x in zip(t, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string")
    return sorted((tuple(r) for r in repeats.removed(docs.repartition(parts)).collect()), key=str)


def test_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def synthetic(seed):
    r = np.random.default_rng(seed)
    word = lambda n: "".join(r.choice(list("abcde "), n))
    passage, rows = word(500), []
    for i in range(60):
        k = int(r.integers(0, 6))
        if k == 0:
            rows.append((i, word(int(r.integers(0, 400)))))
        elif k == 1:
            a = int(r.integers(0, 300))
            rows.append((i, word(90) + passage[a : a + int(r.integers(150, 260))] + word(50)))
        elif k == 2:
            rows.append((i, word(3) * int(r.integers(50, 300))))
        elif k == 3 and rows:
            rows.append((i, rows[int(r.integers(0, len(rows)))][1]))
        else:
            rows.append((i, word(30) + passage + word(1) + passage[:210]))
    return rows


@pytest.mark.parametrize("hot", [1, 2, 256])
def test_synthetic(spark, hot, monkeypatch):
    rows = synthetic(hot)
    monkeypatch.setattr(repeats, "HOT", hot)
    got = []
    shards = [repeats.keyed.pack(np.array([i for i, _ in rows[k::3]], np.int64), np.ones(len(rows[k::3]), np.uint8), np.array([len(t.encode()) for _, t in rows[k::3]], np.int64), np.frombuffer("".join(t for _, t in rows[k::3]).encode(), np.uint8)) for k in range(3)]
    got = in_process(shards, 5)
    assert sorted(got, key=str) == brute(rows)


def in_process(shards, n):
    """The operator's steps without Spark."""
    import pyarrow as pa

    def grouped(rows, key):
        out = defaultdict(list)
        for r in rows:
            out[r[key]].append(r)
        return out

    names = [str(k) for k in range(len(shards))]
    columns = [repeats._ask(p) for p in shards]
    merged, entry, first = repeats.keyed.merge(columns, 2)
    (code,), _, _ = repeats._count(merged)
    code = np.where(first, code[entry], code[entry] & ~np.uint8(repeats.SUPPLY))
    cut = np.split(code, np.cumsum([len(c[0]) for c in columns])[:-1])
    codes = [{"shard": s, "bucket": 0, "payload": repeats.keyed.pack(c)} for s, c in zip(names, cut, strict=True)]
    tables = {s: pa.table({"shard": [s], "payload": pa.array([p], pa.binary())}) for s, p in zip(names, shards, strict=True)}
    schema = pa.schema([("shard", pa.string()), ("bucket", pa.int32()), ("payload", pa.binary())])
    sent = [r for s in names for r in repeats._supply(n)(tables[s], pa.Table.from_pylist(grouped(codes, "shard")[s], schema=schema)).to_pylist()]
    marks = [r for r in sent if r["kind"] == 0]
    for kind, fn in ((1, repeats._index), (2, repeats._windows)):
        for rows in grouped([r for r in sent if r["kind"] == kind], "bucket").values():
            marks += fn((), pa.Table.from_pylist(rows)).to_pylist()
    return [tuple(r.values()) for s in names for r in repeats._digest(tables[s], pa.Table.from_pylist([{"payload": m["payload"]} for m in marks if m["shard"] == s], schema=pa.schema([("payload", pa.binary())]))).to_pylist()]


def test_nulls_empty_long_and_repeated(spark):
    rows = [(1, None), (2, ""), (3, "é" * 120), (4, "é" * 120), (None, "x" * 5000), (5, "abc " * 30000), (6, "ß" + "y" * 199), (7, "y" * 199), (8, "y" * 199 + "z"), (9, "q" * 200), (10, "q" * 200), (10, "q" * 200)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=6), st.integers(3, 20))
@settings(max_examples=60, deadline=None)
def test_index(texts, n):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    index = repeats.RunLengthIndex(data, np.array([len(t) for t in texts]), n)
    got = (index.matching_statistics() >= n).tolist()
    every = [t[i : i + n] for t in texts for i in range(len(t) - n + 1)]
    assert got == [every.count(w) > 1 for w in every]
