"""Session helpers: table access, the shared folder, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only with a local master, as in tests, a temporary folder of this machine
    stands in for it; on a cluster the setting must be there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    set_before = sc._jsc.sc().getCheckpointDir()
    if named is None and set_before.isDefined():
        return set_before.get()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loamstack-")
    if not set_before.isDefined():
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/loamstack/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a path below the shared folder, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a table: compressed by column, and read by the columns asked for.

    The shuffles that made it are not needed any more and are removed at once;
    those of the folds before it stay until the driver collects its garbage, so
    it is asked to.
    """
    return staged(df)[0]


def staged(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``stage``, with the path, to be removed when nothing will read the table any more."""
    path, conf = fresh_path(df.sparkSession, "stage"), df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path), path
