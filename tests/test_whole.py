"""What reaches the queries: whole texts, whole tables, every rule."""

import random
import re

import duckdb
import pandas as pd
import pytest

from foliospark.operators import kernels as k
from foliospark.plans.dialect import DUCK, SPARK
from foliospark.plans.views import compiled

TABLES = ("documents", "events")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(spark, duck, sf_dir, select, *views):
    """A select in both engines."""
    here = [tuple(r) for r in spark.sql(compiled(SPARK, select, views, sf_dir)).collect()]
    return here, duck.sql(compiled(DUCK, select, views)).fetchall()


def test_noisy_keeps_every_line(spark, duck, sf_dir):
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    for found in rows(spark, duck, sf_dir, "SELECT doc_id, line_no, text FROM noisy", "noisy"):
        lines = {(i, n): t for i, n, t in found}
        assert len(lines) == len(found)
        for i, text in texts.items():
            for n, line in enumerate(text.split("\n")):
                assert line in lines[i, 2 * n] or line in lines.get((i, 2 * n + 1), ""), (i, n)
        assert {"PEMERINTAH KABUPATEN", "- 1 -", "Menimbang :"} <= set(lines.values())


# benchmark metrics


def distance(a, b):
    """Levenshtein's, by the whole matrix."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b):
            now.append(min(row[j + 1] + 1, now[j] + 1, row[j] + (x != y)))
        row = now
    return row[-1]


def test_distance_of_long_sequences():
    rng = random.Random(5)
    for n in (1, 31, 63, 64, 65, 200, 700):
        a = "".join(rng.choice("aeo é国x") for _ in range(n))
        b = "".join(rng.choice("aeo") if rng.random() < 0.3 else x for x in a if rng.random() > 0.1)
        assert k.edits(a, b) == k.edits(b, a) == distance(a, b)
        assert k.edits(a.split(), b.split()) == distance(a.split(), b.split())
    assert (k.cer("", ""), k.cer("x", ""), k.cer("", "x"), k.cer(" AB\n", "abcd")) == (0, 1, 1, 0.5)


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    """Texts of over 300 characters, some not ASCII, one empty."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéoß") for _ in range(rng.randint(1, 9)))
    texts = ["", "short", "x" * 320 + " aeo" * 60, *(" ".join(word() for _ in range(n)) for n in (3, 70, 120))]
    path = tmp_path_factory.mktemp("few")
    duckdb.from_df(pd.DataFrame({"doc_id": range(len(texts)), "text": texts})).write_parquet(str(path / "documents.parquet"))
    duckdb.sql("SELECT 1 AS page_id").write_parquet(str(path / "pages.parquet"))
    return str(path), texts


def readings(texts):
    for i, t in enumerate(texts):
        yield i, "paddle", t.translate(str.maketrans("aeo", "eoa")), t
        yield i, "surya", t[:-10], t
        yield i, "tesseract", t[2:].lower(), t


def test_metrics_of_whole_texts(spark, few):
    path, texts = few
    q = k.queries()
    want = {(i, e): (distance(h, r), 0 if not h + r else 1 if not h or not r else distance(h.lower().strip(), r.lower().strip()) / len(r.strip()), 0 if not h + r else distance(h.split(), r.split()) / max(len(r.split()), 1)) for i, e, h, r in readings(texts)}
    for n, (name, column) in enumerate((("MET-03", "distance"), ("MET-01", "cer"), ("MET-02", "wer"))):
        got = {(r.doc_id, r.engine): r[column] for r in q[name](spark, path).collect()}
        assert got == pytest.approx({x: w[n] for x, w in want.items()}, abs=1e-6), name  # texts that aren't ASCII too
    mean = {e: [w[1] for (_, x), w in want.items() if x == e] for e in ("paddle", "surya", "tesseract")}
    rows = {r.engine: r for r in q["MET-09"](spark, path).collect()}
    for e, values in mean.items():
        ids = [i for i, x in want if x == e]
        assert (rows[e].n, rows[e].pages, rows[e].duration_ms) == (len(ids), sum(1 + i % 5 for i in ids), sum(1000 + i for i in ids))
        assert rows[e].avg_cer == pytest.approx(sum(values) / len(values), abs=1e-5)
    best = q["SNK-11"](spark, path).collect()
    assert [r.best for r in best] == [min(mean, key=lambda e: (sum(mean[e]) / len(mean[e]), e))]


# layout


def test_blocks_hold_every_word(spark, duck, sf_dir):
    for table in ("noisy", "blocks"):
        select = f"SELECT doc_id, {'line_no' if table == 'noisy' else 'ord'} AS at, text FROM {table}"
        here, there = rows(spark, duck, sf_dir, select, table)
        assert sorted(here) == sorted(there)
        if table == "noisy":
            words = {(i, n * 1000000 + t): w for i, n, x in here for t, w in enumerate(re.findall(r"[^ \t\n\f\r\x0b]+", x))}
    assert len(here) == len(words) and {(i, o): w for i, o, w in here} == words


def test_overlaps_of_all_words(spark, sf_dir):
    from foliospark import queries

    got = queries.queries()["LAY-05"](spark, sf_dir).collect()
    assert max(r.other % 1000000 for r in got) > 4
    assert len({(r.doc_id, r.ord, r.other) for r in got}) == len(got)


# whole tables


def test_duplicates_over_the_whole_ledger(spark, duck, sf_dir):
    from foliospark import queries

    ledger, _ = rows(spark, duck, sf_dir, "SELECT id, source_url, file_hash, status, output_text, file_name FROM activities", "activities")
    urls, stored, twice, repeats, new = set(), set(), set(), [], []
    for i, url, sha, status, text, _ in sorted(ledger):
        twice |= {url} & urls
        (repeats if sha in stored else new).append((i, sha))
        urls |= {url} if status == "BERHASIL" else set()
        stored |= {sha} if status == "BERHASIL" and text is not None else set()
    q = queries.queries()
    assert {r.source_url for r in q["ACT-06"](spark, sf_dir).collect()} == twice
    assert sorted(r.id for r in q["ACT-07"](spark, sf_dir).collect()) == [i for i, _ in repeats] and repeats
    assert sorted(map(tuple, q["ACT-12"](spark, sf_dir).collect())) == new

    texts = {}
    for _, _, _, _, text, name in ledger:
        texts[name] = max(filter(None, (texts.get(name), text)), default=None)
    files, _ = rows(spark, duck, sf_dir, "SELECT file_id, base, extension, age_minutes FROM files", "files")
    there = {b for _, b, e, _ in files if e == ".txt"}
    want = {name: f"file {name}" if name in there else texts.get(name) for name in {b for _, b, _, _ in files} | texts.keys()}
    got = {r.name: (r.text, r.status) for r in q["SNK-09"](spark, sf_dir).collect()}
    assert got == {i: (t, 404 if t is None else 200) for i, t in want.items()} and {s for _, s in got.values()} == {200, 404}
    gone = {i: e.lower() in (".txt", ".md") and age >= 10 and (b in texts or age > 30 * 24 * 60) for i, b, e, age in files}
    assert {r.file_id: r.removed for r in q["SNK-10"](spark, sf_dir).collect()} == gone and len(set(gone.values())) == 2


def js_counts(text):
    import re

    flag = re.ASCII
    return [len(re.findall(p, text, flag)) for p in (r"\b[A-Za-z]{3,}\d{2,4}\b", r"\b[A-Za-z]{2,}\.[A-Za-z]{2,}\b", r"\b[A-Za-z]\b(?: [A-Za-z0-9]{1,2}\b){1,}")]


def test_verified_counts(spark, duck, sf_dir):
    from foliospark import queries

    made = ["T E SALINAN A b-C d", "ab.cd.ef.gh ab..cd x.yz", "TAHUN2020 abc12,abc345 abc12345 a1 b2", "L R 3 1 E 5. E BUPATI", "a b c,d e", "", "abc.def,ghi.jkl"]
    select = queries.DECLARED["QM-15"][1](queries.SPARK)
    values = ", ".join(f"(1, {i}, '{t}')" for i, t in enumerate(made))
    got = spark.sql(f"WITH noisy AS (SELECT * FROM VALUES {values} AS v(doc_id, line_no, text)) {select} ORDER BY line_no").collect()
    assert [[r.glued, r.dots, r.mirror_runs] for r in got] == [js_counts(t) for t in made]
    seen = queries.queries()["QM-15"](spark, sf_dir).collect()
    assert {r.anomalies > 0 for r in seen} == {True, False} and all(r.anomalies == r.cjk + r.symbols + r.mirror_runs for r in seen)


def test_files_of_every_kind(spark, duck, sf_dir):
    """Both outcomes of each rule come up, and agree with the rules written out."""
    from foliospark import queries
    from foliospark.functions import text as t

    q = queries.queries()
    pdfs, _ = rows(spark, duck, sf_dir, "SELECT doc_id, layer, body, page_count, has_blocks, corrupt FROM pdfs", "pdfs")
    good = {r.doc_id: r.good for r in spark.createDataFrame([(r[0], r[1]) for r in pdfs], "doc_id long, text string").selectExpr("doc_id", f"{t.trustworthy(queries.SPARK, 'text')} AS good").collect()}
    import re

    kinds, digital, score, heads = {}, {}, {}, {}
    for i, layer, body, pages, blocks, corrupt in pdfs:
        score[i] = max(body.count("/XObject"), body.count("/Subtype /Image")) - len(re.findall(r"\([^)]{4,}\)", body)) - 5 * body.count("TJ")
        size = len(layer.strip(" \t\n\f\r\x0b"))
        first, third = size >= 200 and size / pages >= 15 and good[i], size >= 200 and good[i]
        kinds[i] = "SCAN" if corrupt else "TEXT" if first else "SCAN" if score[i] > 10 else "TEXT" if third else "SCAN"
        ops, marked = len(re.findall(r"\([^)]{3,}\)", body)) + 5 * body.count("TJ"), len(re.findall(r"/Type\s*/Page[^s]", body))
        digital[i] = blocks or len(body) >= 100 and (marked > 0 and ops / marked > 3 or ops > 20)
        heads[i] = marked or max(body.count("/Pages ["), 1)
    for name, want, column in (("SRC-08", kinds, "kind"), ("SRC-09", score, "score"), ("SRC-10", heads, "pages"), ("SRC-11", digital, "digital")):
        got = {r.doc_id: r[column] for r in q[name](spark, sf_dir).collect()}
        assert got == want and len(set(want.values())) > 1, name
    assert {r.has_tables for r in q["SRC-12"](spark, sf_dir).collect()} == {0, 1}
    assert len({r.status for r in q["SRC-18"](spark, sf_dir).collect()}) == 4
    assert {r.cached for r in q["SRC-14"](spark, sf_dir).collect()} == {True, False}
    assert len({(r.enabled, r.configured) for r in q["JQ-11"](spark, sf_dir).collect()}) == 4
    assert {r.kept for r in q["SNK-03"](spark, sf_dir).collect()} == {True, False}


def test_pairs_and_tables_of_all_rows(spark, duck, sf_dir):
    from foliospark import queries

    q = queries.queries()
    assert q["SRC-15"](spark, sf_dir).count() == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    pages, _ = rows(spark, duck, sf_dir, "SELECT DISTINCT doc_id, page FROM blocks", "blocks")
    assert sorted((r.doc_id, r.page) for r in q["TBL-14"](spark, sf_dir).collect() if r.ord == -1) == sorted(pages)


# tables


def test_verdicts_see_late_lines(spark, tmp_path):
    good = [f"satu dua tiga empat lima desa {n}" for n in range(25)]
    lost = "bcdfg hjklm npqrs tvwxz bcdfg"  # cleaning empties it
    texts = [good, [*good[:17], lost, *good[18:]], [*good[:22], lost, *good[23:]]]
    duckdb.from_df(pd.DataFrame({"doc_id": range(3), "text": ["\n".join(t) for t in texts]})).write_parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql("SELECT 1 AS page_id").write_parquet(str(tmp_path / "pages.parquet"))
    got = {(r.doc_id, r.page): r.value for r in k.queries()["TBL-13"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0): True, (0, 1): True, (1, 0): False, (1, 1): True, (2, 0): True, (2, 1): False}


def test_table_texts():
    row = lambda *c, header=False: {"header": header, "cells": list(c)}
    assert k.table_text([row("0", "1", header=True), row("a", "b"), row("", "")], "p") == k.ascii_grid([["a", "b"]])
    assert k.table_text([row("0", "1", header=True), row("")], "p") == k.table_text([], "p") == "p"
    assert k.table_text([row("a", "b", "c", "d"), row("x")], "p") == "a | b | c | d\nx |  |  | "
    assert [k.grid_usable(r) for r in ([["a"] * 21], [["a", "----"]], [["a"], ["a", "b"], ["a", "b", "c"]], [["a", "b"]])] == [False, False, False, True]


RULE = "+--+--+"


@pytest.mark.parametrize(("lines", "want"), [(["a"], 0), ([RULE, "| a |", "| b |"], 0.1), ([RULE, "| a |", RULE], 0.1), ([RULE, "| a |", RULE, "| b |", RULE], 0.6), ([RULE, "| a |", RULE, "| b | c |"], 0.2), ([RULE, "| a |"] * 12, 1)])
def test_table_score(spark, duck, lines, want):
    from foliospark import queries

    for d, run in ((SPARK, lambda s: spark.sql(s).first()[1]), (DUCK, lambda s: duck.sql(s).fetchall()[0][1])):
        nl = d.newline()
        text = f" || {nl} || ".join(f"'{x}'" for x in lines)
        select = queries.DECLARED["MET-07"][1](d).replace("documents_", "_t")
        assert run(f"WITH _t AS (SELECT 1 AS doc_id, {text} AS text) {select}") == pytest.approx(want)


def test_chapters_beyond_five(spark, duck):
    from foliospark import queries

    lines = ["BAB VI a", "Pasal 9", "Lampiran I", "Pasal 2", "BAB IX b", "BAB VIII c", "BAB XIV d", "BAB 14 e", "BAB XL f", "Pasal V", "Pasal IV"]
    want = [(5, "bab-order", "warning"), (7, "bab-duplicate", "warning"), (10, "pasal-order", "error")]
    for d, run in ((SPARK, lambda s: [tuple(r) for r in spark.sql(s).collect()]), (DUCK, lambda s: duck.sql(s).fetchall())):
        noisy = " UNION ALL ".join(f"SELECT 1 AS doc_id, {i} AS line_no, 0 AS page, '{x}' AS text" for i, x in enumerate(lines))
        got = run(f"WITH noisy AS ({noisy}) {queries.DECLARED['REV-01'][1](d)}")
        assert sorted(r[1:] for r in got) == want
