"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

``term_counts`` counts the test terms over all training texts. ``postings`` stores, for chosen terms, every place in
the training texts with the words around it. A phrase goes through the list of its rarest term: each posting's place
less the term's place in the phrase is where the phrase would start, and it matches if the words there are the
phrase's; ``proximity`` accepts the terms in order within a span instead. Test terms and phrases are broadcast while
their counted number is within BROADCAST_ROWS, else joined by shuffles.

Defined results: null or empty texts and texts without words have no postings and no windows; a null item_id hits
words but isn't among the items. Repeated training rows are each reported, repeated items count once. Rows with one
doc_id but different texts are kept apart. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spill, words_alnum

WINDOW = 8
MIN_ITEMS = 2
BROADCAST_ROWS = 200_000


def _sized(df: DataFrame) -> DataFrame:
    """Broadcasts what is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, phrase: every run of size words, or all words of an item with fewer; items without words have none."""
    rows = items.select("item_id", words_alnum(F.col("text")).alias("w")).where("size(w) > 0")
    return rows.select("item_id", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {size - 1}, 1)), i -> slice(w, i, {size}))")).alias("phrase")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences in docs of each of terms (distinct); none: no row."""
    every = docs.select(F.explode(words_alnum(F.col("text"))).alias("term"))
    return every.join(_sized(terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def rarest(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds to each phrase its rarest term and that term's place (from 0); phrases with a term that never occurs go."""
    places = phrases.select("*", F.posexplode("phrase").alias("place", "term"))
    places = places.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = places.groupBy(*phrases.columns).agg(F.min(F.struct("n", "term", "place")).alias("b"))
    return best.where("b.n > 0").select(*phrases.columns, "b.term", "b.place")


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """term, doc_id, text_key, pos, near, at: every place of the terms; near: the words up to reach before and after, of which number at (from 0) is the term."""
    words_ = docs.select("doc_id", _key(F.col("text")).alias("text_key"), words_alnum(F.col("text")).alias("w"))
    every = words_.select("doc_id", "text_key", "w", F.posexplode("w").alias("pos", "term"))
    return every.join(_sized(terms), "term").select("term", "doc_id", "text_key", "pos", F.expr(f"slice(w, greatest(pos - {reach}, 0) + 1, {reach} + least(pos, {reach}) + 1)").alias("near"), F.least("pos", F.lit(reach)).alias("at"))


def phrases(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """item_id, doc_id, text_key, start, n: exact places of wanted (item_id, phrase, term, place)."""
    met = index.join(_sized(wanted), "term").where("at >= place").where("slice(near, at - place + 1, size(phrase)) = phrase")
    return met.select("item_id", "doc_id", "text_key", (F.col("pos") - F.col("place")).alias("start"), F.size("phrase").alias("n"))


def proximity(index: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """item_id, doc_id, text_key, pos: places of the rarest term with all words of the phrase, in order, within span words around it.

    The other terms are found greedily outward from the rarest one, the nearest first, which succeeds if any choice
    does. span is at most the index's reach.
    """
    step = "aggregate({side}, {start}, (k, t) -> if(k < 0, -1, coalesce(nullif(array_position(slice({words}, k + 1, greatest(size({words}) - k, 0)), t), 0) + k, -1)))"
    met = index.join(_sized(wanted), "term").select("*", F.expr(f"slice(near, at + 2, {span})").alias("after_w"), F.expr(f"reverse(slice(near, greatest(at - {span}, 0) + 1, least(at, {span})))").alias("before_w"), F.expr("slice(phrase, place + 2, size(phrase))").alias("after_p"), F.expr("reverse(slice(phrase, 1, place))").alias("before_p"))
    met = met.select("*", F.expr(step.format(side="after_p", start="0L", words="after_w")).alias("right"), F.expr(step.format(side="before_p", start="0L", words="before_w")).alias("left"))
    return met.where(f"left >= 0 and right >= 0 and left + right < {span}").select("item_id", "doc_id", "text_key", "pos")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """A row for each training row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    docs = docs.select("doc_id", "text")
    wanted = spill(windows(items, size))
    terms = wanted.select(F.explode("phrase").alias("term")).distinct()
    wanted = spill(rarest(wanted, term_counts(docs, terms)))
    index = spill(postings(docs, wanted.select("term").distinct(), size - 1))
    hits = phrases(index, wanted)
    places = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n")).alias("p"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    places = places.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.expr("size(array_distinct(flatten(transform(p, x -> sequence(x.start, x.start + x.n - 1)))))").cast("long").alias("n_hit"), "items")
    counted = docs.select("doc_id", _key(F.col("text")).alias("_text_key"), F.size(words_alnum(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(places, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text_key") == F.col("_k")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"), (F.size(items_) >= MIN_ITEMS).alias("contaminated"), items_.alias("items"), F.col("_text_key").alias("text_key"))


def sql(size: int = WINDOW) -> str:
    """The same in DuckDB's SQL."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({lower}, '{word}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + {size - 1}] AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT len(p) AS n FROM win),
g AS (SELECT rid, i, n, w[i:i + n - 1] AS p FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n)),
h AS (SELECT rid, item_id, i, n FROM g JOIN win USING (p)),
c AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
t AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h WHERE item_id IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= {MIN_ITEMS} AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""
