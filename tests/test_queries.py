import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df):
    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].map(text)
    return sorted(map(tuple, df.itertuples(index=False)))


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert "Query" not in str(entry.entry)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith(("op", "pipeline"))))
def test_against_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


GOLDEN = [("TXT-01", "'a\\r\\nb\\rc'", "a\nb\nc"), ("TXT-02", "'kerja-\\n sama'", "kerjasama"), ("TXT-03", "'• item ● x'", "- item - x"), ("TXT-04", "'“a”–b…'", '"a"-b...'), ("TXT-11", "'kata\\nBaru'", "kata. Baru"), ("TXT-12", "'a\\n\\n\\n\\n\\nb'", "a\n\nb")]


@pytest.mark.parametrize(("name", "text", "want"), GOLDEN)
def test_text_golden(spark, name, text, want):
    from foliospark import queries
    from foliospark.plans.dialect import SPARK

    select = queries.DECLARED[name][1](SPARK)
    assert spark.sql(f"WITH rough AS (SELECT 1 AS doc_id, {text} AS text) {select}").first().text == want


@pytest.mark.parametrize(("word", "garbage"), [*((w, True) for w in ("楼", "Q楼", "123", "ν1", "∪", "u¹5nu1¹5aux", "bo20202")), *((w, False) for w in ("desa", "2020", "Rp5.000", "1.000", "tahun2020"))])
def test_garbage_words(spark, word, garbage):
    from foliospark.functions import text
    from foliospark.plans.dialect import SPARK

    assert spark.sql(f"SELECT {text.garbage_word(SPARK, 'w')} AS g FROM (SELECT '{word}' AS w)").first().g == garbage


def test_quality_bounds(spark):
    from foliospark import queries
    from foliospark.plans.dialect import SPARK

    rows = " UNION ALL ".join(f"SELECT 1 AS doc_id, 0 AS page, {i} AS line_no, {i} AS tok_no, 'desa' AS word, CAST(0.95 AS DOUBLE) AS confidence" for i in range(24))
    score = lambda n: spark.sql(f"WITH words AS ({rows}) {queries.DECLARED[n][1](SPARK)}").first()
    assert score("QM-05").score == 0.625 and not score("QM-06").accepted  # a page without garbage counts as all garbage


def test_flagship_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
