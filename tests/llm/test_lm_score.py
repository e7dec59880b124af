import math
import re
import zlib
from collections import Counter

from foliospark.llm import lm_score


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None]) for i, t in rows]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts, starts = [Counter(), Counter(), Counter()], 0
    grams = lambda w: [tuple((["<s>", *w])[max(k + 2 - n, 0) : k + 2]) for k in range(len(w)) for n in (1, 2, 3) if n < k + 3]
    for i, w in docs:
        if not out(i):
            for g in grams(w):
                counts[len(g) - 1][g] += 1
            starts += 1
    one, two, three = counts
    n, v = sum(one.values()), len(one)

    def chance(g):
        if len(g) == 1:
            return (one[g] + 1) / (n + v + 1)
        h = starts if g[:-1] == ("<s>",) else counts[len(g) - 2][g[:-1]]
        mu = lm_score.MU[len(g) - 1]
        return (counts[len(g) - 1][g] + mu * chance(g[1:])) / (h + mu)

    found = []
    for i, w in docs:
        whole = ["<s>", *w]
        base = sum(math.log10(chance((x,))) for x in w)
        score = sum(math.log10(chance(tuple(whole[max(k - 1, 0) : k + 2]))) for k in range(len(w)))
        found.append((i, out(i), len(w), sum(one[x,] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return sorted(found, key=str)


def run(spark, rows, extra=False):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_tokens long, score string")
    got = lm_score.score(docs.repartition(3)).collect()
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got), key=str)


def test_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_nulls_empty_long_and_repeated(spark):
    rows = [(1, None), (2, ""), (3, "A b a B \t\n c"), (3, "A b a B \t\n c"), (None, "a b"), (5, "é É x" * 5000), (7, "word" * 50000), (8, " "), (9, "a\x0bb\x85c d")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_better_than_the_base_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [r for r in lm_score.score(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def shard(texts):
    """All of them, as one shard; even ids are held out of nothing."""
    import pyarrow as pa

    class Context:
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    import pyspark

    real, pyspark.TaskContext.get = pyspark.TaskContext.get, staticmethod(lambda: Context)
    try:
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
        return lm_score.Shard(next(iter(lm_score._shards(iter([batch])))).column("payload")[0].as_py())
    finally:
        pyspark.TaskContext.get = real


def test_chances_sum_to_one():
    import numpy as np

    s = shard(["a b a c", "a b b", "b a b a c a", "d"])
    own = np.ones(len(s.train), bool)
    s.train = own
    _, counts = s.request()
    order = np.argsort(s.keys, kind="stable")
    every = np.empty(len(order), np.int64)
    every[order] = counts
    words, pairs, triples = np.split(every, [len(s.words), len(s.words) + len(s.pairs)])
    model = s.automaton(words, pairs, triples, len(s.ids), int(words.sum()), len(words))
    unknown = 1 / (words.sum() + len(words) + 1)
    reached = set()
    end = int(np.flatnonzero(s.words == lm_score.END)[0]) + 1  # no history ends with a text's end
    for state in (i for i in range(len(model.backoff)) if end not in (i, model.fail[i])):
        to, weight, failed = model.step(np.full(len(words), state), np.arange(len(words)))
        lost, at = 1.0, state
        while at:
            lost, at = lost * 10 ** model.backoff[at], model.fail[at]
        assert abs((10**weight).sum() + lost * unknown - 1) < 1e-9
        reached |= set(to.tolist())
        assert failed.max() <= lm_score.ORDER - 1
    assert reached & set(range(model.start + 1, len(model.backoff)))  # histories of two words


def test_lanes_carry_the_same_state(monkeypatch):
    import numpy as np

    text = " ".join(np.random.default_rng(3).choice(list("abcdefgh"), 700))
    s = shard([text, "a", "", text[:99]])
    args = np.bincount(s.word, minlength=len(s.words)) % 5, np.bincount(s.pair) % 3, np.bincount(s.triple) % 2
    whole = s.automaton(*args, 2, 900, 9)
    a = whole.walk(s.word, s.first)
    monkeypatch.setattr(lm_score, "LANE", 10**9)
    b = whole.walk(s.word, s.first)
    assert np.allclose(a[0], b[0]) and (a[1] == b[1]).all() and a[1].max() == 2
