"""Connected components of an edge table, without collecting any group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loamstack.runtime import fresh_path, remove


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Alternating large-star and small-star rounds: every node hangs its
    neighbours below the smallest one it knows.  A round is two shuffles on
    node ids with map-side minima; no neighbour list is ever gathered, so a
    node with a third of all edges costs no task more than its share after
    the partial aggregation.  Each round's edges are a table in the shared folder,
    written in one job that also tells whether anything changed.
    Self-loops and null ends are dropped; an empty table gives an empty one.
    """
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    # the first edges are often none, and then nothing is left to do
    e, seen, path = _written(e)
    before = None
    while seen != before and seen[0]:
        # large-star: larger neighbours of u move to the minimum around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        # small-star: smaller neighbours of u, and u, move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v").where("u <> v").distinct()
        )
        before, old = seen, path
        e, seen, path = _written(small)
        remove(edges.sparkSession, old)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _written(e: DataFrame) -> tuple[DataFrame, tuple, str]:
    """The edges as a table in the shared folder, with their number and a sum of hashes from the same job."""
    path, seen = fresh_path(e.sparkSession, "edges"), Observation()
    e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(path)
    got = seen.get
    return e.sparkSession.read.schema(e.schema).parquet(path), (got["n"], got["h"]), path
