"""Sinks: text files by name, the ledger, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER = "id int, session_id string, file_name string, original_name string, source_type string, source_url string, file_hash string, jdih_id int, file_type string, ocr_status string, page_count int, file_size_bytes bigint, duration_seconds decimal(10,1), status string, error_message string, output_text string, text_uploaded int, created_at timestamp, updated_at timestamp"


def text_cache(docs: DataFrame, path: str) -> None:
    """SNK-01: texts that aren't blank, partitioned by file name."""
    docs.where(F.trim("text") != "").select("file_name", F.col("text").alias("value")).write.partitionBy("file_name").mode("overwrite").text(path)


def saved(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """ACT-12, SNK-02: the ledger with those new rows whose hash it doesn't have as converted; ids go on from the last."""
    have = ledger.where("status = 'BERHASIL' and output_text is not null").select("file_hash").distinct()
    fresh = new.join(have, "file_hash", "left_anti").dropDuplicates(["file_hash"])
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    # ids by partition and place: no sort of all rows in one task
    spread = fresh.repartition("file_hash").sortWithinPartitions("file_hash").withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id() % F.lit(1 << 33))
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy("a._p").agg(F.coalesce(F.sum("b._c"), F.lit(0)).alias("_b"))
    rows = spread.join(F.broadcast(before), "_p").crossJoin(F.broadcast(last)).withColumn("id", (F.col("last") + F.col("_b") + F.col("_n") + 1).cast("int"))
    return ledger.unionByName(rows.select(*(c for c in ledger.columns if c in rows.columns)), allowMissingColumns=True)


def deleted(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """SNK-03."""
    return ledger.join(ids.select("id"), "id", "left_anti")


def csv_report(lines: DataFrame, path: str) -> None:
    """SNK-05: a text file that begins with a byte order mark; lines: place, value."""
    mark = F.when(F.col("place") == 0, F.concat(F.lit("﻿"), "value")).otherwise(F.col("value"))
    lines.select("place", mark.alias("value")).coalesce(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)
