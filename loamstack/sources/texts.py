"""Whole text files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.functions import constants as K


def read_files(spark: SparkSession, path: str, max_bytes: int = K.MAX_FILE_BYTES, glob: str | None = None) -> DataFrame:
    """(file_id, content, format, budget, size, modified, problem), one row per file below ``path``.

    file_id is the path of the file.  The size is checked before the content
    is read: a file of more than ``max_bytes`` has no content and the problem
    ``too large``; one that is not strict UTF-8 has the problem ``not utf-8``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    small = files.where(F.col("length") <= max_bytes)  # pushed to the source, which then skips the content
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    read = small.select(F.col("path").alias("file_id"), F.when(valid, F.col("content").cast("string")).alias("content"),
                        F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
                        F.when(~valid, "not utf-8").alias("problem"))
    large = files.where(F.col("length") > max_bytes).select(
        F.col("path").alias("file_id"), F.lit(None).cast("string").alias("content"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), F.lit("too large").alias("problem"))
    return read.unionByName(large).select(
        "file_id", "content", F.lit(None).cast("string").alias("format"), F.lit(None).cast("int").alias("budget"), "size", "modified", "problem")

