"""Entries that have been known for too long, and the state that knows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstack.functions import text as T
from loamstack.sources.state import latest_state


def ages(entries: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """Entries with first_seen and age in days; both null where the state does not know them."""
    known = latest_state(state).select("file_id", "eid", "first_seen")
    return entries.join(known, ["file_id", "eid"], "left").withColumn("age", T.age_days(as_of, "first_seen"))


def aged_out(entries: DataFrame, state: DataFrame, as_of: Column, max_age: int | None) -> DataFrame:
    """(file_id, pos, age) of the entries first seen more than ``max_age`` days ago.

    Headings never age; an entry without a known first_seen has age 0.  With
    no max_age, or 0, none ages.
    """
    aged = ages(entries.where("not is_header").select("file_id", "pos", "eid"), state, as_of)
    if not max_age:
        return aged.where("false").select("file_id", "pos", "age")
    return aged.where(F.col("age") > max_age).select("file_id", "pos", "age")


def upsert_state(survivors: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """(file_id, eid, first_seen, last_seen, runs_seen, preview): the state after a run.

    Only surviving entries have a row, so what comes back later starts anew.
    first_seen stays, runs_seen (null or negative: 0) goes up by one.  Of
    entries of one eid the one later in the list gives the preview.
    """
    one = survivors.groupBy("file_id", "eid").agg(F.max_by("text", F.struct("slot", "pos")).alias("text"))
    old = latest_state(state).select("file_id", "eid", "first_seen", "runs_seen")
    return one.join(old, ["file_id", "eid"], "left").select(
        "file_id", "eid", F.coalesce("first_seen", as_of).alias("first_seen"), as_of.alias("last_seen"),
        (F.greatest(F.coalesce("runs_seen", F.lit(0)), F.lit(0)) + 1).alias("runs_seen"), T.preview("text", 60).alias("preview"))
