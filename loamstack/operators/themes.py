"""Token frequencies of a file: recurring themes, and how much an entry says that no other does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstack.functions import constants as K


def document_frequency(entries: DataFrame) -> DataFrame:
    """(file_id, token, n): in how many entries of the file a token stands."""
    return (entries.select("file_id", F.explode(F.array_distinct("toks")).alias("token"))
            .groupBy("file_id", "token").agg(F.count("*").alias("n")))


def themes(entries: DataFrame, records: int = K.THEME_RECORDS, shown: int = K.THEMES_SHOWN) -> DataFrame:
    """(file_id, rank, token, n): the most frequent tokens of a file among those of ``records`` entries or more.

    Headings count.  Equal counts go by token, so the result does not depend
    on any order of rows.  The limit of the rank is applied before the shuffle.
    """
    order = Window.partitionBy("file_id").orderBy(F.desc("n"), "token")
    return (document_frequency(entries).where(F.col("n") >= records).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= shown).select("file_id", "rank", "token", "n"))


def information_density(entries: DataFrame) -> DataFrame:
    """(file_id, pos, unique_tokens, density): tokens that no other entry has, per character.

    Headings are left out of both sides; an entry without tokens has none.
    """
    body = entries.where("not is_header")
    once = document_frequency(body).where("n = 1").select("file_id", "token")
    each = body.select("file_id", "pos", F.explode(F.array_distinct("toks")).alias("token"))
    unique = each.join(once, ["file_id", "token"]).groupBy("file_id", "pos").agg(F.count("*").alias("u"))
    return body.join(unique, ["file_id", "pos"], "left").select(
        "file_id", "pos", F.coalesce("u", F.lit(0)).cast("long").alias("unique_tokens"),
        ((F.coalesce("u", F.lit(0)) + F.lit(0.1)) / F.greatest(F.length("text"), F.lit(1))).alias("density"))


def first_victim(entries: DataFrame) -> DataFrame:
    """(file_id, pos, density): the entry of each file that a budget would cost first; of equal ones the earliest."""
    d = information_density(entries)
    return (d.groupBy("file_id").agg(F.min(F.struct("density", "pos")).alias("v"))
            .select("file_id", F.col("v.pos").alias("pos"), F.col("v.density").alias("density")))
