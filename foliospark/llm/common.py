"""What the operators share: tables, the shared scratch folder, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.tables import table

__all__ = ["discard", "documents", "lower_ascii", "scratch", "spill", "table", "words_by_space", "words_alnum"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. A session of one process may leave that unset; it has a temp folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/foliospark-{uuid.uuid4().hex}"


#: Spark then removes an execution's shuffles when the execution ends, instead of at some collection of the driver's heap.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spill(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back. The shuffles of the write go with it."""
    path, conf = scratch(df.sparkSession), df.sparkSession.conf
    was = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.unset(_CLEAN) if was is None else conf.set(_CLEAN, was)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*done: DataFrame) -> None:
    """Deletes what spill wrote, once nothing reads it again."""
    for df in done:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text; other columns, whatever their names, stay out of the operators."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def _split(text: Column, gaps: str) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gaps), "")


def words_by_space(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return _split(text, "[ \\x09-\\x0D]+")


def words_alnum(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case."""
    return _split(lower_ascii(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
