import re

import numpy as np
import pytest

from foliospark.llm import jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def run(spark, rows):
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, node binary")
    return sorted(map(tuple, jaccard_join.classes(docs.repartition(3)).collect()), key=str)


def check(spark, rows):
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_against_brute_force(spark, sf_dir):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])


@pytest.mark.parametrize(("salt", "cell"), [(512, 4096), (7, 5)])
def test_groups_of_near_copies(spark, salt, cell, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SALT", salt)
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(int(r.integers(0, 5))):
            k = int(r.integers(0, len(w)))
            w[k : k + int(r.integers(0, 2))] = [f"n{r.integers(0, 40)}"]
        rows.append((i, " ".join(w[int(r.integers(0, 8)) :])))
    rows += [(200 + i, " ".join(base[:60] + [f"o{i}-{k}" for k in range(12 + i)])) for i in range(20)]
    check(spark, rows)


def test_greatest_ids(spark):
    check(spark, [(2**63 - 1, "a b c d e f"), (2**63 - 1, "other words stand in here"), (None, "a b c d e f"), (-(2**63), "")])


def test_nulls_short_long_and_repeated(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (4, "A b  c"), (5, "a b"), (None, "a b c"), (None, "only one"), (6, "x " * 30000), (7, "x y z " * 20000), (7, "x y z " * 20000), (8, "one two three four five"), (9, "one two three four five six"), (10, " \t ")]
    check(spark, rows)


def test_empty_table(spark):
    assert run(spark, []) == []
