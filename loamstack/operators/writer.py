"""Entries as files again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstack.functions import constants as K


def separator(fmt: str | Column) -> Column:
    fmt = F.col(fmt) if isinstance(fmt, str) else fmt
    return F.when(fmt == "sections", K.SECTION_DELIMITER).when(fmt == "bullets", "\n").otherwise("\n\n")


def serialize(entries: DataFrame, files: DataFrame, max_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """(file_id, format, entries, bytes, text): each file as one text, its entries by pos.

    ``files`` gives (file_id, format, preamble).  Sections are joined alone;
    the other formats have their preamble and a blank line before them and a
    line feed after.  The bytes are summed first; a file of more than
    ``max_bytes`` is refused, that is, its text is null and its entries are
    not gathered, which is what bounds a task.  serialize_lines() has no limit.
    """
    sums = entries.groupBy("file_id").agg(F.count("*").alias("entries"), F.sum(F.octet_length("text")).alias("held"))
    f = files.select("file_id", "format", F.coalesce("preamble", F.lit("")).alias("preamble")).join(sums, "file_id")
    sep = F.octet_length(separator("format"))
    around = F.when(F.col("format") == "sections", 0).otherwise(1 + F.when(F.col("preamble") != "", F.octet_length("preamble") + 2).otherwise(0))
    f = f.withColumn("bytes", F.col("held") + (F.col("entries") - 1) * sep + around)
    fits = f.where(F.col("bytes") <= max_bytes).select("file_id")
    texts = (entries.join(fits, "file_id", "left_semi").groupBy("file_id")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("e")))
    rows = f.join(texts, "file_id", "left").select("file_id", "format", "entries", "bytes", "preamble", F.col("e.text").alias("t"))
    text = F.when(F.col("format") == "sections", F.array_join("t", K.SECTION_DELIMITER)).otherwise(
        F.concat(F.when(F.col("preamble") != "", F.concat("preamble", F.lit("\n\n"))).otherwise(""), F.when(
            F.col("format") == "bullets", F.array_join("t", "\n")).otherwise(F.array_join("t", "\n\n")), F.lit("\n")))
    return rows.select("file_id", "format", "entries", "bytes", F.when(F.col("t").isNotNull(), text).alias("text"))


def serialize_lines(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, pos, piece): the same text in pieces, for files too large for one value.

    The pieces of a file in order of pos, the preamble at pos -1, are the file
    when written one after the other; sorting by (file_id, pos) as ranges
    splits a large file over many tasks.
    """
    last = entries.groupBy("file_id").agg(F.max("pos").alias("last"))
    f = files.select("file_id", "format", F.coalesce("preamble", F.lit("")).alias("preamble"))
    end = F.when(F.col("pos") < F.col("last"), separator("format")).when(F.col("format") == "sections", "").otherwise("\n")
    pieces = entries.select("file_id", "pos", "text").join(last, "file_id").join(f.select("file_id", "format"), "file_id").select(
        "file_id", "pos", F.concat("text", end).alias("piece"))
    heads = f.where("format <> 'sections' and preamble <> ''").join(last, "file_id", "left_semi").select(
        "file_id", F.lit(-1).alias("pos"), F.concat("preamble", F.lit("\n\n")).alias("piece"))
    return heads.unionByName(pieces).repartitionByRange("file_id", "pos").sortWithinPartitions("file_id", "pos")
