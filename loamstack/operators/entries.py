"""Entries once each, with their tokens, name and subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.functions import text as T
from loamstack.operators.filters import repeated


def once(entries: DataFrame, filtered: bool = False) -> DataFrame:
    """Entries by (file_id, pos), each once; rows without either name no entry and go.

    Deliveries of one entry are identical, so any may stand for it.
    ``filtered`` reads the keys first, so that only rows that may come twice are shuffled.
    """
    key = ["file_id", "pos"]
    rows = entries.where("file_id is not null and pos is not null")
    if not filtered:
        return rows.dropDuplicates(key)
    again = repeated(rows, key)
    return rows.where(~again).unionByName(rows.where(again).dropDuplicates(key))


def analyze(entries: DataFrame) -> DataFrame:
    """(file_id, pos, text, is_header, toks, eid) of (file_id, pos, text[, is_header]) rows.

    Tokens are computed from the text; a null text is the empty one, a null
    is_header is false.
    """
    header = F.coalesce(F.col("is_header"), F.lit(False)) if "is_header" in entries.columns else F.lit(False)
    rows = entries.select("file_id", "pos", F.coalesce("text", F.lit("")).alias("text"), header.alias("is_header"))
    rows = rows.withColumn("toks", T.tokens("text"))
    return rows.withColumn("eid", T.entry_id("text", "toks"))


def stored(entries: DataFrame, filtered: bool = False) -> DataFrame:
    """Parsed entries as delivered: each once, null tokens as none, null is_header as false; no column beside the six."""
    return once(entries.select("file_id", "pos", "text", "is_header", "toks", "eid"), filtered).select(
        "file_id", "pos", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("is_header", F.lit(False)).alias("is_header"),
        F.coalesce("toks", F.array().cast("array<string>")).alias("toks"), "eid")


def content_size(entries: DataFrame, formats: DataFrame) -> DataFrame:
    """(file_id, entries, size): characters of the entries and of what stands between them.

    A section delimiter counts three, any other gap one; ``formats`` gives
    (file_id, format).  The sums combine on the map side, so no file is gathered.
    """
    sums = entries.groupBy("file_id").agg(F.count("*").alias("entries"), F.sum(F.length("text")).cast("long").alias("chars"))
    gap = F.when(F.col("format") == "sections", 3).otherwise(1)
    return sums.join(formats.select("file_id", "format"), "file_id", "left").select(
        "file_id", "entries", (F.col("chars") + (F.col("entries") - 1) * gap).alias("size"))
