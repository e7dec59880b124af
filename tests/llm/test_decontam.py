import hashlib
import re

from foliospark.llm import decontam

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(rows, items):
    out = []
    phrases = {(i, tuple(w[k : k + 8])) for i, t in items for w in [words(t)] if w for k in range(max(len(w) - 7, 1))}
    by = {}
    for i, p in phrases:
        by.setdefault(p, set()).add(i)
    sizes = {len(p) for p in by}
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in by:
                    hit |= set(range(k, k + n))
                    found |= by[p] - {None}
        names = ",".join(sorted(map(str, found)))
        out.append({"doc_id": d, "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(names.encode()).hexdigest(), "contaminated": len(found) >= 2})
    return out


def run(spark, rows, items):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, term string, item_id int")
    bench = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    return sorted((r.asDict() for r in decontam.contamination(docs, bench).drop("items", "text_key").collect()), key=str)


def test_against_brute_force(spark, sf_dir):
    rows, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert run(spark, rows, items) == sorted(brute(rows, items), key=str)


ITEMS = [(1, "a b c d e f g h i"), (2, "Short item"), (2, "short ITEM"), (3, None), (4, "..."), (None, "x y z"), (11, "b c d e f g h i")]


def test_odd_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "A, b; c d e f g h i short-item"), (3, "A, b; c d e f g h i short-item"), (3, "x y z"), (None, "short item"), (4, "b c d e f g h i " * 3000), (5, "a b c d e f g"), (6, "x y x y z y z")]
    want = sorted(brute(rows, ITEMS), key=str)
    assert run(spark, rows, ITEMS) == want
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert run(spark, rows, ITEMS) == want


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, [(1, "a b")], [])[0]["n_items"] == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha x x x x x beta gamma"), (4, "alpha beta gamma")], "doc_id long, text string")
    terms = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "term string")
    for rare in range(3):
        wanted = spark.createDataFrame([(7, ["alpha", "beta", "gamma"], ["alpha", "beta", "gamma"][rare], rare)], "item_id long, phrase array<string>, term string, place int")
        got = decontam.proximity(decontam.postings(docs, terms, 6), wanted, 6)
        assert sorted(r.doc_id for r in got.collect()) == [1, 4]
