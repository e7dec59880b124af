import sys
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from foliospark.llm import decontam, quality_rules, repeats

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_jaccard_join import brute as classes  # noqa: E402
from test_quality_rules import brute as quality  # noqa: E402
from test_decontam import brute as contamination  # noqa: E402


def removed(rows):
    n, places = repeats.LENGTH, defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for d, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            places[t[i : i + n]].append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for where in places.values():
        if len(where) > 1:
            for d, i in where:
                gone[d][i : i + n] = b"\1" * n
    return [(i, None if t is None else bytes(b for b, g in zip(x, y, strict=True) if not g).decode(errors="ignore")) for (i, t), x, y in zip(rows, texts, gone, strict=True)]


def brute(rows, items):
    """(doc_id, ids) of what comes out of the stages."""
    verdicts = quality(rows)
    rows = [r for r, v in zip(rows, verdicts, strict=True) if v["kept"]]
    groups = {}
    for r, c in zip(rows, classes(rows), strict=True):
        groups.setdefault(c[2], []).append(r)
    best = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    rows = removed(best)
    hits = contamination(rows, items)
    rows = [r for r, h in zip(rows, hits, strict=True) if not h["n_hit"]]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in rows}


def test_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
    assert dict(got) == brute(rows, items)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, _d int, _row string, _id int, _key int, _doc string, shard string"
NAMES = ("z", 3, 4, "w", "s")


def test_one_item_is_enough(spark, sf_dir):
    """Planted: whole items, one window of one item, one word less than a window, a hit in a text of null id, and clean text."""
    import re

    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    long_ = [t.split() for t in items]
    window = next(" ".join(w[i : i + 8]) for w in long_ for i in range(len(w) - 8) if all(re.fullmatch("[a-z]+", x) for x in w[i : i + 8]))
    clean = " ".join(f"q{i}z" for i in range(40))
    texts = [f"{clean} {items[0]} {clean}", f"{clean} {items[1]} {items[2]}", f"{clean} {window} {clean}", f"{clean} {' '.join(window.split()[:7])} {clean}", clean, "", None]
    rows = [(i, t, "en", "s", 1, 1, "x", 1, *NAMES) for i, t in enumerate(texts)] + [(None, texts[2], "en", "s", 1, 1, "x", 1, *NAMES)]
    out = corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 5, 6]


@pytest.mark.parametrize("k", range(4))
def test_stages_return_documents_columns(spark, sf_dir, k):
    words = " ".join(f"the word{i} of" for i in range(60))
    rows = [(1, words, "en", "a", len(words), 1, "x", 1, *NAMES), (1, words, "en", "a", len(words), 1, "x", 1, *NAMES), (None,) * 13, (2, "", "en", "b", 0, 2, "y", 2, *NAMES), (3, "x " * 40000, "en", "b", 80000, 2, "y", 2, *NAMES)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    assert out.schema == docs.schema
    assert len(out.collect()) == [2, 4, 5, 5][k]


def test_empty_documents(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []
