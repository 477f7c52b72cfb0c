"""Later statements of the same subject, and pairs that may contradict each other."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.functions import constants as K
from loamstack.operators.components import connected_components
from loamstack.operators.folds import fold_sorted

_DEEP = "file_id string, slot_i int, slot_j int, kind string, pos_i int, old_pos int, new_pos int, subject double, body double"


def _walk() -> Callable[[dict], Iterable[tuple]]:
    removed: set[int] = set()

    def step(r: dict) -> Iterable[tuple]:
        if r["old_pos"] in removed or r["new_pos"] in removed:
            return []
        if r["kind"] == "superseded":
            removed.add(r["old_pos"])
        return [(r["file_id"], r["slot_i"], r["slot_j"], r["kind"], r["pos_i"], r["old_pos"], r["new_pos"], r["subject"], r["jaccard"])]

    return step


def banded(edges: DataFrame) -> DataFrame:
    """Subject edges with their kind, superseded or conflict; those of another band are gone."""
    body = F.col("jaccard")
    kind = (F.when((body >= K.SUPERSEDE_BODY_LOW) & (body < K.SUPERSEDE_BODY_HIGH), "superseded")
            .when((body >= K.CONFLICT_BODY_LOW) & (body < K.SUPERSEDE_BODY_LOW), "conflict"))
    return edges.withColumn("kind", kind).where("kind is not null")


def supersessions(edges: DataFrame, slots: DataFrame) -> DataFrame:
    """(file_id, slot_i, slot_j, kind, pos_i, old_pos, new_pos, subject, body) of subject edges, in their order of decision.

    Pairs are taken by the slots of their entries, lower slot first.  A pair of
    which one was removed before decides nothing.  In the band of supersession
    the entry of the lower pos is removed (kind ``superseded``); in the band
    below, the pair is only reported (kind ``conflict``).  ``slots`` gives
    (file_id, pos, slot).  Edges are folded by connected component.
    """
    rows = banded(edges).select("file_id", "a", "b", "kind", "subject", "jaccard")
    node = [F.struct("file_id", F.col(x).alias("pos")) for x in ("a", "b")]
    roots = connected_components(rows.select(node[0].alias("a"), node[1].alias("b")))
    for side in ("a", "b"):
        rows = rows.join(slots.select("file_id", F.col("pos").alias(side), F.col("slot").alias(f"slot_{side}")), ["file_id", side])
    rows = rows.withColumn("node", F.struct("file_id", F.col("a").alias("pos"))).join(roots, "node").select(
        F.col("root.pos").alias("root"), "file_id", F.least("slot_a", "slot_b").alias("slot_i"), F.greatest("slot_a", "slot_b").alias("slot_j"),
        F.when(F.col("slot_a") < F.col("slot_b"), F.col("a")).otherwise(F.col("b")).alias("pos_i"), F.col("a").alias("old_pos"), F.col("b").alias("new_pos"), "kind", "subject", "jaccard")
    return fold_sorted(rows, ["file_id", "root"], ["slot_i", "slot_j"], _DEEP, _walk)
