"""The corpus pipeline: STAGES applied to `documents`, each written as Parquet and read again as the next one's docs.

Stages return the columns of documents, the last one its pieces. Repeated ids and rows, nulls and further columns, whatever
their names, are as good as any. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontam, jaccard_join, packing, quality_rules, repeats
from foliospark.llm.common import spill, table
from foliospark.llm.queries import tokenizer


def _whole(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows as one struct beside what a stage needs of them, so that no column's name can clash with the stage's own."""
    return docs.select(F.struct("*").alias("_doc"), "doc_id", "text", *more)


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged = quality_rules.apply_rules(docs.select(F.struct("*").alias("_doc"), "text"), keep=("_doc",))
    # an id in the verdict keeps the optimizer from putting the whole projection into the filter, once for each use
    kept = judged.select("_doc", F.when(F.monotonically_increasing_id() >= 0, F.col("kept")).alias("_kept"))
    return kept.where("_kept").select("_doc.*")


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents, the one with the least doc_id stays, of ties the first row; texts without words stay."""
    # written with their numbers, so that no later scan can number them otherwise, and with each text once, inside its row
    rows = spill(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")))
    classes = jaccard_join.classes(rows.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text"))).select(F.col("doc_id").alias("_row"), "component_id")
    ids = rows.select("_row", F.col("_doc.doc_id").alias("doc_id"))
    first = ids.join(classes, "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")).alias("_f"))
    return rows.join(first.select(F.col("_f._row").alias("_row")), "_row", "left_semi").select("_doc.*")


def _repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again anywhere go; documents stay, with n_chars of what is left."""
    out = repeats.cleaned(docs)
    if dict(docs.dtypes).get("n_chars") == "bigint":
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*docs.columns)


def _decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go, whole; a verdict belongs to an id and a text, so to all rows that repeat them.

    The text judged is the one that this stage gets and that training would see: a passage that the stage before took
    out of a document is no longer in it. One item is enough here, unlike in the operator's flag `contaminated`.
    """
    bad = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_key"))
    return _whole(docs).join(spill(bad), same, "left_anti").select("_doc.*")


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in their sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality rules", _quality), ("n-gram Jaccard join", _near_duplicates), ("suffix-array dedup", _repeats), ("benchmark decontamination", _decontaminated), ("packing", _packed)]
#: Packing needs a tokenizer, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spill(stage(spark, docs, sf_dir))
    return docs
