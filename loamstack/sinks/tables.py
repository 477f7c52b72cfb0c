"""Runs over many files as tables: appended once per transaction, replaced by comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.plans import pipeline
from loamstack.plans.options import Options
from loamstack.sources.state import state_json  # noqa: F401  (the state of a file in its JSON form)


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_once(records: DataFrame, path: str, run: str) -> None:
    """Appends (tx, ...) records of a run, except those whose tx another run has written.

    Each run has a partition of its own and overwrites only that, so that a
    run that is repeated after a loss writes the same rows to the same place.
    """
    if _exists(records, path):
        written = records.sparkSession.read.parquet(path).where(F.col("run") != run).select("tx").distinct()
        records = records.join(written, "tx", "left_anti")
    (records.withColumn("run", F.lit(run)).write.partitionBy("run").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def retain(path: str, records: DataFrame, runs: int) -> DataFrame:
    """The records of the last ``runs`` runs of a journal; runs are named so that later ones sort higher."""
    names = records.select("run").distinct().orderBy(F.desc("run")).limit(runs)
    return records.join(F.broadcast(names), "run", "left_semi")


def write_run(plan: pipeline.Plan, files: DataFrame, options: Options, path: str, run: str) -> None:
    """Writes a plan below ``path``: archive before contents, then journal and state.

    ``files`` gives (file_id, format, content, preamble).  Every part is keyed by the content-made tx of its
    file and by run; writing the same run again changes nothing.
    """
    tx = pipeline.cut(pipeline.transactions(plan, files, options))
    key = tx.select("file_id", "tx")
    append_once(pipeline.archive_records(plan.actions, options.stamp()).join(key, "file_id"), f"{path}/archive", run)
    append_once(tx.where("changed").select("file_id", "tx", F.sha2("original", 256).alias("was"), F.col("new_text").alias("content")), f"{path}/files", run)
    append_once(tx.select("file_id", "tx", "report"), f"{path}/journal", run)
    append_once(plan.state.join(key, "file_id"), f"{path}/state", run)


def commit_contents(current: DataFrame, written: DataFrame) -> DataFrame:
    """(file_id, content, stale): contents after a compare-and-set with those of a run.

    A file gets its new text if it still is what the run read (by SHA-256) or
    already is the new text; else it stays, marked stale.
    """
    new = written.select("file_id", "was", F.col("content").alias("new"))
    j = current.select("file_id", "content").join(new, "file_id", "left")
    fits = (F.sha2("content", 256) == F.col("was")) | (F.col("content") == F.col("new"))
    return j.select("file_id", F.when(fits, F.col("new")).otherwise(F.col("content")).alias("content"),
                    (F.col("new").isNotNull() & ~F.coalesce(fits, F.lit(False))).alias("stale"))
