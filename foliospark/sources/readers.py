"""Sources: work lists, scanned folders, queue payloads, benchmark pairs; and retries."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: Fields of a queue item that may have its address, first to last.
URL_FIELDS = ("url", "pdf_url", "url_file", "file_url", "source_path", "file_path", "path", "file")
ITEM = "id long, converted int, file_name string, nama string, judul string, title string, " + ", ".join(f"{f} string" for f in URL_FIELDS)


def links(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01."""
    return spark.read.schema("id string, url string, nama string").option("multiLine", True).json(path)


def pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-03, 09, 10, 17: files with their hash, version, pages and image score, from their bytes."""
    body = F.decode("content", "ISO-8859-1")
    count = lambda p: F.regexp_count(F.col("body"), F.lit(p)).cast("long")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "length", F.sha2("content", 256).alias("file_hash"), body.alias("body"))
    pages = F.greatest(count(r"/Type\s*/Page[^s]"), F.when(count(r"/Pages\s*\[") > 0, count(r"/Pages\s*\[")).otherwise(F.lit(1)))
    score = F.greatest(count("/XObject"), count(r"/Subtype\s*/Image")) - count(r"\([^)]{4,}\)") - 5 * count("TJ")
    return rows.select("path", "length", "file_hash", F.regexp_extract("body", r"%PDF-(\d\.\d)", 1).alias("version"), pages.alias("pages"), score.alias("image_score"))


def items(payload: Column) -> Column:
    """SRC-04: a payload, as an array or under data or result, as items; anything else has none."""
    kind = f"array<struct<{', '.join(f'{n}: {t}' for n, t in (c.rsplit(' ', 1) for c in ITEM.split(', ')))}>>"
    of = lambda path: F.from_json(F.get_json_object(payload, path), kind)
    whole = F.when(F.trim(payload).startswith("["), F.from_json(payload, kind))
    return F.coalesce(whole, of("$.data"), of("$.result"), F.array().cast(kind))


def address(base: str | None = None) -> Column:
    """SRC-05: the first address that isn't blank; below base if it begins with a slash."""
    first = F.coalesce(*(F.when(F.trim(F.col(f)) != "", F.trim(F.col(f))) for f in URL_FIELDS))
    below = F.concat(F.lit(base.rstrip("/")), first) if base else F.lit(None).cast("string")
    return F.when(first.startswith("/"), below).otherwise(first)


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-15: hypotheses (*.txt) and truths (*.gt.txt) of one base name."""
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select(name.alias("n"), F.decode("content", "UTF-8").alias("text"))
    truth = rows.where(F.col("n").endswith(".gt.txt")).select(F.regexp_replace("n", r"\.gt\.txt$", "").alias("doc"), F.col("text").alias("ref"))
    hyp = rows.where(~F.col("n").endswith(".gt.txt")).select(F.regexp_replace("n", r"\.txt$", "").alias("doc"), F.col("text").alias("hyp"))
    return hyp.join(truth, "doc")


def with_retry(f: Callable[[], T], attempts: int = 3, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """UDF-06: waits delay times the attempt; the last error goes on."""
    for n in range(1, attempts + 1):
        try:
            return f()
        except Exception:
            if n == attempts:
                raise
            sleep(delay * n)
    raise ValueError("no attempts")
