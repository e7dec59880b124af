"""The conversion queue as a stateful stream.

An item is new, then skipped (no url), pending (converted, not yet saved) or acknowledged; a saved pending item is
acknowledged; a reset makes any item new again, which is why its state is a value that can go and not a set of ids seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "id long, seq long, op string, outcome string, url string"
ACTIONS = "id long, seq long, action string, state string"


def step(state: str, op: str, outcome: str | None, url: str | None) -> tuple[str, str]:
    """The next state, and what is done: process, skip, ack, reset or nothing."""
    if op == "reset":
        return "NEW", "reset"
    if op == "save":
        return ("ACKED", "ack") if state == "PENDING" else (state, "none")
    if state in ("PENDING", "ACKED"):
        return state, "none"
    if not (url or "").strip():
        return "SKIPPED", "skip"
    if outcome in ("DIHENTIKAN",):
        return state, "none"
    if outcome == "GAGAL":
        return "NEW", "ack"
    return ("PENDING", "process") if outcome == "BERHASIL" else ("ACKED", "ack")


def fold(events: Iterable[tuple], state: str = "NEW") -> Iterator[tuple[int, str, str]]:
    """seq, action, state of an item's events (seq, op, outcome, url) in order of seq."""
    for seq, op, outcome, url in sorted(events, key=lambda e: e[0]):
        state, action = step(state, op, outcome, url)
        yield seq, action, state


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text = lambda v: None if pd.isna(v) else v
    events = [(int(r.seq), r.op, text(r.outcome), text(r.url)) for f in frames for r in f.itertuples()]
    out = list(fold(events, state.get[0] if state.exists else "NEW"))
    if out:
        state.update((out[-1][2],))
        yield pd.DataFrame({"id": [key[0]] * len(out), "seq": [o[0] for o in out], "action": [o[1] for o in out], "state": [o[2] for o in out]})


def actions(events: DataFrame) -> DataFrame:
    """A streaming frame of EVENTS as what to do with each."""
    return events.groupBy("id").applyInPandasWithState(_advance, ACTIONS, "state string", "append", GroupStateTimeout.NoTimeout)


def drain(spark: SparkSession, events_path: str, out_path: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Takes what the source has, batch by batch, and stops when it is empty. Batches are written under their number, so a repeated one replaces itself."""
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(events_path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    actions(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def counters(done: DataFrame) -> DataFrame:
    """How many events led to each action."""
    return done.agg(F.count("*").alias("fetched"), *(F.sum((F.col("action") == a).cast("long")).alias(n) for a, n in (("process", "processed"), ("ack", "patched"), ("skip", "skipped_no_url"))), F.count_distinct(F.when(F.col("state") == "PENDING", F.col("id"))).alias("pending_save"))
