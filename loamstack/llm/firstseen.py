"""The first_seen that stands for an accepted entry or arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standing(entries: DataFrame, arrivals: DataFrame, state: DataFrame) -> DataFrame:
    """(entry_id, first_seen) of entries, from state, and of arrivals, from themselves.

    Of the rows of state with the file_id and eid of an entry, repeated or
    late, the one of the latest last_seen that has a first_seen holds (null
    last_seen first, then the earlier first_seen); one after its last_seen is
    taken as null.  An arrival counts in its lowest batch; a first_seen more
    than a day before the middle one of its batch is too early and taken as
    null.  Where nothing is left, first_seen is null; no time is made up.
    """
    seen = (state.where("first_seen is not null and (last_seen is null or first_seen <= last_seen)")
            .groupBy("file_id", "eid").agg(F.max_by("first_seen", F.struct(F.col("last_seen"), -F.unix_micros(F.col("first_seen").cast("timestamp")))).alias("first_seen")))
    old = entries.select("entry_id", "file_id", "eid").dropDuplicates(["entry_id"]).join(seen, ["file_id", "eid"], "left").select("entry_id", "first_seen")
    once = arrivals.groupBy("entry_id").agg(F.min("batch_no").alias("batch_no"), F.min_by("first_seen", "batch_no").alias("first_seen"))
    middle = once.groupBy("batch_no").agg(F.expr("percentile_approx(first_seen, 0.5)").alias("middle"))
    new = once.join(F.broadcast(middle), "batch_no", "left").select(
        "entry_id", F.expr("if(first_seen < middle - interval 1 day, null, first_seen)").alias("first_seen"))
    return old.unionByName(new)
