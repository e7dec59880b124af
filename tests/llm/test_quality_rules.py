import re
from collections import Counter

from foliospark.llm import quality_rules as q


def brute(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[x] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = {"doc_id": i, "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_bangs": t.count("!"), "n_lines": len(lines), "n_stop": sum(x.lower() in q.STOP for x in w)}
        r["base_failed"] = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        r["kept"] = not r["base_failed"] and all(x.low * r[x.of] <= 100 * r[x.measure] <= x.high * max(r[x.of], 0 if x.high < 10**9 else 1) for x in q.RULES)
        out.append(r)
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    return sorted((r.asDict() for r in q.apply_rules(docs).collect()), key=str)


def test_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b c a b c"), (3, "x"), (3, "x"), (4, "a b"), (5, "é! " * 9000), (6, "a\n\na\n \na b\x0bc\x85d"), (7, "\n".join(["the same line of words here"] * 20)), (8, "<>|#")]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, []) == []
