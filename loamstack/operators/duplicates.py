"""Exact and near duplicates of a file, and which of them stay."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.operators.components import connected_components
from loamstack.operators.filters import among, without
from loamstack.operators.folds import fold_sorted
from loamstack.runtime import stage


def exact_duplicates(entries: DataFrame) -> DataFrame:
    """(file_id, pos, entry_id, removed, kept_entry_id, result), one row per entry that the exact pass removes.

    Of the entries of a file with one eid the one of the lowest pos stays and
    is named in each row.  Headers are removed too (T2).  An entry that was
    delivered again has the same pos and is no duplicate of itself.  Rows
    without a file_id or eid have no key and are no duplicates.
    """
    key = ["file_id", "eid"]
    rows = entries.where("file_id is not null and eid is not null").select("file_id", "eid", "pos", "entry_id", "text").dropDuplicates(["file_id", "pos"])
    first = rows.groupBy(*key).agg(F.min_by(F.struct("pos", "entry_id", "text"), "pos").alias("first"))
    return (rows.join(first, key).where("pos > first.pos")
            .select("file_id", "pos", "entry_id", F.col("text").alias("removed"),
                    F.col("first.entry_id").alias("kept_entry_id"), F.col("first.text").alias("result")))


def named(entries: DataFrame) -> DataFrame:
    """The entries that have a file_id and an eid; others take no part in a run."""
    return entries.where("file_id is not null and eid is not null")


def drop_exact(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries without later copies, (file_id, removed_pos, kept_pos)) of analyzed entries.

    The first of equal eids stays, found by a minimum that combines on the
    map side; headings take part.  Names alone are shuffled for it.
    """
    keyed = named(entries)
    names = keyed.select("file_id", "eid", "pos")
    first = names.groupBy("file_id", "eid").agg(F.min("pos").alias("kept_pos"))
    later = stage(names.join(first, ["file_id", "eid"]).where("pos > kept_pos").select("file_id", F.col("pos").alias("removed_pos"), "kept_pos"))
    return without(keyed, later.select("file_id", F.col("removed_pos").alias("pos")), ["file_id", "pos"]), later


_NEAR = "file_id string, at_pos int, removed_pos int, kept_pos int, slot int, jaccard double"


def _near_walk() -> Callable[[dict], Iterable[tuple]]:
    """Slots of one component; every row is an edge to the entry that is being placed."""
    slot: dict[int, int] = {}  # slot of each entry that stands in one
    seen: set[int] = set()
    length: dict[int, int] = {}
    around: list[dict] = []

    def place() -> Iterable[tuple]:
        if not around:
            return
        b, file = around[0]["b"], around[0]["file_id"]
        met = [r for r in around if r["a"] in slot]
        seen.add(b)
        if not met:
            slot[b] = b
            return
        r = min(met, key=lambda r: slot[r["a"]])
        a, at = r["a"], slot[r["a"]]
        if length[b] >= length[a]:  # b stands later, so it wins ties too
            del slot[a]
            slot[b] = at
            yield file, b, a, b, at, r["jaccard"]
        else:
            yield file, b, b, a, at, r["jaccard"]

    def step(row: dict) -> Iterable[tuple]:
        done: list[tuple] = []
        if around and around[0]["b"] != row["b"]:
            done = list(place())
            around.clear()
        length[row["a"]], length[row["b"]] = row["length_a"], row["length_b"]
        if row["a"] not in seen:  # without an earlier neighbour: it opened a slot of its own
            seen.add(row["a"])
            slot[row["a"]] = row["a"]
        around.append(row)
        return done

    step.finish = place
    return step


def near_duplicates(edges: DataFrame) -> DataFrame:
    """(file_id, at_pos, removed_pos, kept_pos, slot, jaccard): what the near pass removes.

    Entries are placed in order of pos.  One that has an edge to what stands
    in a slot by then joins the first such slot; the longer text stands in it
    from then on, of equally long ones the later; any other entry opens a slot.
    slot is the pos of the entry that opened it.  Edges are folded by connected
    component, which is as far as decisions depend on each other; groups are
    not closed transitively.
    """
    node = [F.struct("file_id", F.col(x).alias("pos")) for x in ("a", "b")]
    roots = connected_components(edges.select(node[0].alias("a"), node[1].alias("b")))
    rows = (edges.select("file_id", "a", "b", "jaccard", "length_a", "length_b", node[1].alias("node"))
            .join(roots, "node").select(F.col("root.pos").alias("root"), "file_id", "a", "b", "jaccard", "length_a", "length_b"))
    return fold_sorted(rows, ["file_id", "root"], ["b", "a"], _NEAR, _near_walk, lambda step: step.finish())


def after_near(entries: DataFrame, removed: DataFrame, earlier: DataFrame) -> DataFrame:
    """The entries that stay, with their slot: their place in the list from here on.

    ``earlier`` gives (file_id, pos) of what went before.  One filter tells all
    that went or moved, so the entries are read twice and few are shuffled.
    """
    key = ["file_id", "pos"]
    gone = removed.select("file_id", F.col("removed_pos").alias("pos")).unionAll(earlier.select(*key))
    moved = removed.where("kept_pos = at_pos").select("file_id", F.col("kept_pos").alias("pos"), "slot")
    hit = among(gone.unionAll(moved.select(*key)), key)
    found = entries.where(hit).join(gone, key, "left_anti").join(moved, key, "left").withColumn("slot", F.coalesce("slot", "pos"))
    return entries.where(~hit).withColumn("slot", F.col("pos")).unionByName(found)
