"""The state of entries kept up to date by a stream of nightly batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_SEEN = "file_id string, eid string, first_seen timestamp, last_seen timestamp, runs_seen int"
_STATE = "first_seen timestamp, last_seen timestamp, runs_seen int"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, last, runs = state.get if state.exists else (None, None, 0)
    if state.hasTimedOut:
        state.remove()
        return
    nights = sorted({t for b in batches for t in b["seen_at"] if not pd.isna(t)})
    nights = [t for t in nights if last is None or t > pd.Timestamp(last)]
    if nights:
        first = first if first is not None else nights[0].to_pydatetime()
        last, runs = nights[-1].to_pydatetime(), runs + len(nights)
        state.update((first, last, runs))
    if last is not None:
        yield pd.DataFrame({"file_id": [key[0]], "eid": [key[1]], "first_seen": [first], "last_seen": [last], "runs_seen": [runs]})


def seen_entries(stream: DataFrame) -> DataFrame:
    """(file_id, eid, first_seen, last_seen, runs_seen) after each micro-batch, for a stream of (file_id, eid, seen_at).

    Keyed state by (file_id, eid); times of one key are counted once each and
    only if later than the last one, so a batch sent again changes nothing.
    """
    rows = stream.where("file_id is not null and eid is not null").select("file_id", "eid", F.col("seen_at").cast("timestamp").alias("seen_at"))
    return rows.groupBy("file_id", "eid").applyInPandasWithState(_update, _SEEN, _STATE, "update", GroupStateTimeout.NoTimeout)


def daily_arrivals(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(file_id, day, entries): arrivals per file and day of first_seen, final once ``late`` has passed."""
    rows = stream.where("first_seen is not null").withColumn("at", F.col("first_seen").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy("file_id", F.window("at", "1 day").alias("w")).agg(F.count("*").alias("entries")).select(
        "file_id", F.col("w.start").alias("day"), "entries")


def each_night(stream: DataFrame, run: Callable[[DataFrame, str], None], checkpoint: str):
    """Runs ``run(batch, name)`` on every micro-batch that is there; the name is the batch's own.

    A batch that is repeated after a failure comes with the same name, so a
    run that writes by append_once() has its effect once.
    """
    return (stream.writeStream.foreachBatch(lambda df, k: run(df, f"{k:012d}")).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def upsert_nights(state: DataFrame, batch: DataFrame, as_of: datetime) -> DataFrame:
    """The state after one night's entries (file_id, eid, text, first_seen); entries not in the batch stay.

    A batch may bring a first_seen of its own, which stands where the state has none.
    """
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    new = batch.where("file_id is not null and eid is not null").groupBy("file_id", "eid").agg(F.min("first_seen").alias("came"))
    both = state.select("file_id", "eid", "first_seen", "last_seen", "runs_seen").join(new.withColumn("here", F.lit(True)), ["file_id", "eid"], "full")
    here = F.coalesce("here", F.lit(False)) & (F.col("last_seen").isNull() | (F.col("last_seen") < now))
    return both.select(
        "file_id", "eid", F.coalesce("first_seen", "came", F.when(here, now)).alias("first_seen"),
        F.when(here, now).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.coalesce("runs_seen", F.lit(0)) + here.cast("int")).alias("runs_seen"))
