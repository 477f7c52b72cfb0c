"""Limits on what one file may ask for; files beyond them are listed and refused, never cut short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.functions import constants as K


def comparisons(entries: DataFrame, supersede: bool = True) -> DataFrame:
    """(file_id, comparisons): pairs that comparing all of a file's different entries would score, at most.

    Headings are no partners.  The pair search here scores far fewer; the
    number is a guard, not a cost.
    """
    each = entries.where("not is_header").groupBy("file_id", "eid").agg(F.first(F.lit(1)).alias("one"))
    n = each.groupBy("file_id").agg(F.count("*").alias("n"))
    return n.select("file_id", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs")).select(
        "file_id", (F.col("pairs") * (2 if supersede else 1)).alias("comparisons"))


def refused(entries: DataFrame, max_entries: int | None = K.MAX_ENTRIES, max_comparisons: int | None = None, supersede: bool = True) -> DataFrame:
    """(file_id, entries, reason) of the files beyond a limit; null means no limit."""
    counts = entries.groupBy("file_id").agg(F.count("*").alias("entries"))
    counts = counts.join(comparisons(entries, supersede), "file_id", "left")
    many = (F.col("entries") > max_entries) if max_entries else F.lit(False)
    long = (F.col("comparisons") > max_comparisons) if max_comparisons else F.lit(False)
    reason = F.when(many, "too many entries").when(long, "too many comparisons")
    return counts.withColumn("reason", reason).where("reason is not null").select("file_id", "entries", "reason")
