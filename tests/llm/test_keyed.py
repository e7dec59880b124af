import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import keyed
from foliospark.llm.shards import open_rest, open_shard, row_shards
from foliospark.llm.textbytes import ALNUM, LONG, NOT_SPACE, column_bytes, row_runs, word_hashes, words

TEXTS = st.lists(st.none() | st.text(alphabet="aB1 \t\n.,é日\x0b\x85", max_size=40), max_size=8)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@given(TEXTS)
@settings(max_examples=80, deadline=None)
def test_words(texts):
    for kind, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        data, offsets = column_bytes(pa.array(texts, pa.string()))
        begins, ends, count = words(data, offsets, kind)
        got = [data[a:b].tobytes().decode() for a, b in zip(begins, ends, strict=True)]
        want = [re.findall(pattern, t or "") for t in texts]
        assert got == [w for x in want for w in x] and count.tolist() == list(map(len, want))
        hashes = word_hashes(data, begins, ends).tolist()
        by = {}
        for w, h in zip(got, hashes, strict=True):
            by.setdefault(w.translate(LOWER), set()).add(h)
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_long_words():
    data, offsets = column_bytes(pa.array(["x" * (LONG + 1), "x" * LONG, "X" * (LONG + 1)]))
    a, b, c = word_hashes(data, *words(data, offsets, NOT_SPACE)[:2])
    assert a == c != b


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 9))
@settings(max_examples=50, deadline=None)
def test_parts(keys, n):
    keys = np.array(sorted(keys), np.uint64)
    got = list(keyed.parts(keys, n))
    assert np.concatenate([np.empty(0, np.uint64), *(keys[s] for _, s in got)]).tolist() == keys.tolist()
    assert [b for b, _ in got] == sorted({int(k) * n >> 64 if n & (n - 1) == 0 else (int(k) >> 32) * n >> 32 for k in keys})


@pytest.mark.parametrize("n", [0, 1, keyed.APART - 1, keyed.APART, 3 * keyed.APART])
def test_packed_arrays_come_back(n):
    some = np.random.default_rng(n)
    keys = some.integers(0, 2**64, n, np.uint64)
    arrays = [np.sort(keys), keys, some.integers(0, 9, n).astype(np.uint32), np.empty(0, np.uint8), some.integers(0, 256, 4 * n).astype(np.uint8), np.array([-1])]
    back = keyed.unpack(keyed.pack(*arrays))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, back, strict=True))
    assert keyed.unpack(keyed.pack()) == []


def test_merge():
    (keys, more, sums), entry, first = keyed.merge([[np.array([1, 5, 5], np.uint64), np.array([2, 1, 2], np.uint64), np.array([1, 2, 9])], [np.array([5, 7], np.uint64), np.array([1, 0], np.uint64), np.array([3, 4])]], 2)
    assert (keys.tolist(), more.tolist(), sums.tolist()) == ([1, 5, 5, 7], [2, 1, 2, 0], [1, 5, 9, 4])
    assert entry.tolist() == [0, 1, 2, 1, 3] and first.tolist() == [True, True, True, False, True]


@pytest.mark.parametrize(("shards", "fan"), [(0, 4), (1, 4), (4, 4), (5, 4), (17, 4), (40, 3)])
def test_exchange(spark, shards, fan):
    """Sums of all keys reach every shard in its order; one holder an entry keeps the bit of `once`; rows grow with the shards."""
    r = np.random.default_rng(shards)
    held = {f"{i}-0": np.unique(r.choice(np.array([1, 5 << 40, 1 << 63, 2**64 - 1, *r.integers(0, 2**63, 60)], np.uint64), 30)) for i in range(shards)}
    rows = spark.createDataFrame([(k, bytearray(keyed.pack(v))) for k, v in held.items()], "shard string, payload binary")

    def ask(payload):
        (keys,) = keyed.unpack(payload)
        return keys, np.ones(len(keys), np.uint32)

    found = keyed.exchange(rows, ask, lambda c: ([(c[1] % 100 * 2 + 1).astype(np.uint8)], int(c[1].sum()), len(c[0])), 7, once=1, fan=fan)
    every = np.concatenate([np.empty(0, np.uint64), *held.values()])
    keys, counts = np.unique(every, return_counts=True)
    answers, marked = {}, []
    for a in found.answers.collect():
        answers.setdefault(a.shard, []).append({"bucket": a.bucket, "payload": bytes(a.payload)})
    assert answers.keys() == {k for k, v in held.items() if len(v)}
    for k, v in answers.items():
        got = np.concatenate([x[0] for x in keyed.in_order(v)])
        assert (got >> 1).tolist() == counts[np.searchsorted(keys, held[k])].tolist()
        marked += held[k][got & 1 > 0].tolist()
    assert sorted(marked) == keys.tolist()
    totals = found.totals.collect()
    assert (sum(t.a for t in totals), sum(t.b for t in totals)) == (len(every), len(keys))
    levels = keyed.plan(shards, 7, fan)
    assert levels[-1][0] == 1 and (len(levels) > 1) == (shards > fan)


def test_rows_of_an_exchange_grow_with_the_shards():
    for shards in (10**3, 10**5, 10**7):
        levels = keyed.plan(shards, shards // 2)
        sent = [shards * levels[0][1], *(g * n * (levels[k + 1][1] // n) for k, (g, n) in enumerate(levels[:-1]))]
        assert sum(sent) <= len(levels) * keyed.FAN * shards * 1.1 and len(levels) <= 3


def test_rows_run_over_all():
    offsets = np.array([0, 3, 3, 50, 52])
    assert list(row_runs(offsets, 5)) == [(0, 2), (2, 3), (3, 4)]


def test_row_shards(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (None, None, None), (3, "", 1.0)], "x long, text string, y double").coalesce(1)
    rows = df.mapInArrow(row_shards(1), "shard string, payload binary, rest binary").collect()
    assert [r["x"] for s in rows for r in open_rest(bytes(s.rest)).to_pylist()] == [1, None, 3]
    assert [k for s in rows for k in open_shard(bytes(s.payload))[1].tolist()] == [1, 0, 1]
