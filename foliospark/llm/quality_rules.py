"""Quality rules: a threshold table, compiled into one Spark projection of built-in functions.

``measure`` adds the counts of a text, ``judge`` the verdict of the rules. No user function runs; windows of
words are compared through a sort of their hashes, so the cost of a text is n log n in its words.

Defined results: a null or empty text has no words, fails the base rule and isn't kept. Ties and repeated rows are
judged row by row. Only the column of the text is read; other columns, whatever their names, pass through
``apply_rules`` untouched, but for those that it adds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_by_space


@dataclass(frozen=True)
class Rule:
    """Keeps a text while low * of <= measure * 100 <= high * of, in whole numbers."""

    name: str
    measure: str
    of: str
    low: int = 0
    high: int = 10**9


#: Percentages: characters a word, symbols a word, exclamation marks a word, lines that repeat, stop words.
RULES = (
    Rule("word length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", 0, 20),
    Rule("exclamations", "n_bangs", "n_words", 0, 30),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0, 40),
    Rule("stop words", "n_stop", "n_words", 2),
)
#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from have in is it not of on or that the this to was were with "
    "au aux avec ce dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "als auf aus das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "con como del el es las los más no para por se su una y"
).split()
STOP = tuple(dict.fromkeys(STOP_WORDS))
#: The base rule of the contract: too few words, or too many of them in repeated windows of three.
MIN_WORDS, MAX_REPEATED = 50, 50


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and the counts of the text, all long."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(*keep, body.alias("_text"), words_by_space(F.col(text)).alias("_w"), F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")).alias("_lines"))
    # equal windows of three words come to stand side by side; the second field leads back to their place
    windows = F.transform(F.arrays_zip(F.col("_w").alias("a"), F.expr("slice(_w, 2, greatest(size(_w) - 1, 0))").alias("b"), F.expr("slice(_w, 3, greatest(size(_w) - 2, 0))").alias("c")), lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
    split = split.withColumn("_s", F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0)))))
    twice = F.expr("transform(filter(transform(_s, (x, j) -> if(coalesce(get(_s, j - 1).h = x.h, false) or coalesce(get(_s, j + 1).h = x.h, false), x.i, null)), x -> x is not null), x -> x)")
    split = split.withColumn("_t", twice)
    return split.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("size(array_distinct(concat(_t, transform(_t, x -> x + 1), transform(_t, x -> x + 2))))").cast("long").alias("n_repeat_words"),
        (F.length("_text") - F.length(F.translate("_text", "!", ""))).cast("long").alias("n_bangs"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP))).cast("long").alias("n_stop"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition over the counts."""
    each = (F.col(r.measure) * 100 >= F.col(r.of) * r.low if r.high >= 10**9 else (F.col(r.measure) * 100).between(F.col(r.of) * r.low, F.col(r.of) * r.high) for r in rules)
    return reduce(lambda a, b: a & b, each)


def apply_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts, base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return measure(docs, text, keep).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def sql(rules: tuple[Rule, ...] = RULES, table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    space = "\\x20\\x09-\\x0D"
    each = " AND ".join(f"{r.measure} * 100 >= {r.low} * {r.of}" + ("" if r.high >= 10**9 else f" AND {r.measure} * 100 <= {r.high} * {r.of}") for r in rules)
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^{space}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
h AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM h) WHERE n >= 2),
p AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[{space}]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(p.n, 0)::BIGINT AS n_repeat_words, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs, len(ls)::BIGINT AS n_lines,
  len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop FROM w LEFT JOIN p USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED} AS base_failed FROM m)
SELECT *, NOT base_failed AND {each} AS kept FROM f"""
