"""New batches against all accepted history: a prefix-tree hash forest.

Each tree gives every token set of a file a label of DEPTH min-hashes.  The
labels are stored as runs in the shared folder, sorted by (tree and file,
label), with the range of each stored file in a manifest, so that the forest
can be opened again by another process.  A batch reads only the stored files
whose ranges it touches; its entries then meet the stored labels in sorted
order, and each is located by a range search on the longest prefix of its
label.  The prefix is widened, one min-hash at a time, until the recall target
holds for the least similarity an entry of its size can have to a near one.
What is found is compared exactly.  Accepted batches are appended as further
runs, and runs are merged when there are many.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.llm.base import list_parts, or_fold, token_set
from loamstack.runtime import cut, fresh_path, remove

TREES = 17
DEPTH = 4  #: min-hashes a label holds, 16 bits each
RECALL = 0.9999
FILTER_WORDS = 1 << 18  #: 64-bit words of the batch's key filter: 2 MB, whatever the batch
SLICES = 1 << 16  #: slices of the nodes by which stored files are left out
MAX_RUNS = 8  #: with more runs than this they are merged into one
PAIRS = 2_000_000  #: pairs a task compares at a time

_RUN = "node long, label long, bits long, n int, cid long"
_SETS = "cid long, fkey long, hs array<long>"


def reached(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair of this similarity shares a prefix of this length in some tree."""
    return 1 - (1 - similarity ** depth) ** trees


@lru_cache(maxsize=8)
def search_depths(num: int = 3, den: int = 4, largest: int = 256) -> np.ndarray:
    """The prefix length by set size, up to ``largest`` and beyond.

    An entry of n tokens can have only certain similarities of at least
    num/den; the search is widened until the least of them meets the target.
    """
    out = np.ones(largest + 1, np.int64)
    for n in range(1, largest + 1):
        sizes = range(-(-num * n // den), den * n // num + 1)
        overlaps = ((-(-num * (n + r) // (num + den)), r) for r in sizes)
        least = min((o / (n + r - o) for o, r in overlaps if o <= min(n, r)), default=1.0) if n < largest else num / den
        d = DEPTH
        while d > 1 and reached(least, d) < RECALL:
            d -= 1
        out[n] = d
    return out


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20240229)
    mult = rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        off, h = list_parts(b.column("hs"))
        h, rows = h.view(np.uint64), len(off) - 1
        n = np.diff(off).astype(np.int32)
        bits = np.bitwise_or.reduceat(np.uint64(1) << ((h >> np.uint64(20)) & np.uint64(63)), off[:-1]).view(np.int64)
        fkey, cid = b.column("fkey").to_numpy(zero_copy_only=False).view(np.uint64), b.column("cid")
        for t in range(TREES):
            label = np.zeros(rows, np.uint64)
            for k in range(t * DEPTH, (t + 1) * DEPTH):
                low = np.minimum.reduceat((h ^ flip[k]) * mult[k], off[:-1])
                label = label << np.uint64(16) | (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
            node = (fkey ^ flip[t * DEPTH]) * mult[t * DEPTH]  # one to one within a tree
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), pa.array((label ^ np.uint64(1 << 63)).view(np.int64)), pa.array(bits), pa.array(n), cid],
                names=["node", "label", "bits", "n", "cid"])


def _block_shift(num: int, den: int) -> int:
    """Bits of a label behind the widest prefix."""
    return 16 * (DEPTH - int(search_depths(num, den)[1:].min()))


def _range_search(num: int, den: int):
    """(q, cid) from stored and asked labels sorted by (node, block, side, label), the asked ones (side 0) first in each block."""
    depths, shift = search_depths(num, den), _block_shift(num, den)
    low_mask = np.uint64((1 << shift) - 1)

    def found(asked: list[np.ndarray], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ag, alow, abits, an, aid = asked
        hg, hlow, hbits, hn, hid = held
        key = hg << np.int64(shift) | hlow  # sorted
        wide = (16 * (DEPTH - depths[np.minimum(an, len(depths) - 1)])).astype(np.int64)
        start = alow >> wide << wide
        lo = np.searchsorted(key, ag << np.int64(shift) | start, "left")
        hi = np.searchsorted(key, ag << np.int64(shift) | start | ((np.int64(1) << wide) - 1), "right")
        many = hi - lo
        ends = np.cumsum(many)
        begin = 0
        while begin < len(many):  # so many queries at a time that the pairs stay bounded
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
            m = many[begin:stop]
            q = np.repeat(np.arange(begin, stop), m)
            h = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[begin:stop], m)
            begin = stop
            for c in range(0, len(q), PAIRS):
                x, y = q[c:c + PAIRS], h[c:c + PAIRS]
                # a near pair shares at least num/(num+den) of both sizes together, which bounds what either lacks
                lack_q = np.bitwise_count((abits[x] & ~hbits[y]).view(np.uint64)).astype(np.int64)
                lack_h = np.bitwise_count((hbits[y] & ~abits[x]).view(np.uint64)).astype(np.int64)
                ok = (lack_q * (num + den) <= den * an[x] - num * hn[y]) & (lack_h * (num + den) <= den * hn[y] - num * an[x])
                yield pa.RecordBatch.from_arrays([pa.array(aid[x[ok]]), pa.array(hid[y[ok]])], names=["q", "cid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        carried: list[np.ndarray] | None = None  # the asked labels of a block that goes on
        for b in batches:
            if not b.num_rows:
                continue
            node, block, side, label, bits, n, cid = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "block", "side", "label", "bits", "n", "cid"))
            new = np.r_[last is None or (node[0], block[0]) != last, (node[1:] != node[:-1]) | (block[1:] != block[:-1])]
            g = np.cumsum(new).astype(np.int64)  # block 0 is the one that goes on
            low = (label.view(np.uint64) & low_mask).astype(np.int64)
            a, h = side == 0, side == 1
            asked = [c[a] for c in (g, low, bits, n.astype(np.int64), cid)]
            if carried is not None and not new[0]:
                asked = [np.concatenate([x, y]) for x, y in zip([np.zeros(len(carried[0]), np.int64), *carried], asked)]
            held = [c[h] for c in (g, low, bits, n.astype(np.int64), cid)]
            if len(asked[0]) and len(held[0]):
                yield from found(asked, held)
            end = asked[0] == g[-1]
            carried = [c[end] for c in asked[1:]]
            last = (node[-1], block[-1])

    return run


def _cell(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = key.view(np.uint64) >> np.uint64(64 - 24)
    return (c >> np.uint64(6)).astype(np.int64), np.uint64(1) << (c & np.uint64(63))


def _set_bits(column: str):
    def add(arr: np.ndarray, b: pa.RecordBatch) -> None:
        word, bit = _cell(b.column(column).to_numpy(zero_copy_only=False))
        np.bitwise_or.at(arr, word, bit)

    return add


def _only(df: DataFrame, column: str, wanted: np.ndarray) -> DataFrame:
    """Rows whose hashed column may be among the wanted ones; drops no wanted row."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, bit = _cell(b.column(column).to_numpy(zero_copy_only=False))
            yield b.filter(pa.array((shared.value[word] & bit) != 0))

    return df.mapInArrow(keep, df.schema)


class HashForest:
    """Accepted history as token sets and sorted label runs below a folder of the shared one.

    ``add`` takes (file_id, id, toks, eid) rows.  Copies within a file collapse
    to their smallest id.  Null or empty tokens are near to nothing; a null
    file_id belongs to no file.  Every change writes a new manifest; a forest
    without a path is a new one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or fresh_path(spark, "forest")
        self.sets: list[str] = []
        self.eids: list[str] = []
        self.runs: list[list[tuple[str, int, int]]] = []  # by run, its stored files with their least and greatest node
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HashForest:
        """The forest as its last manifest has it."""
        forest = cls(spark, path)
        rows = spark.read.option("wholetext", "true").text(f"{path}/manifest/*").collect()  # one short row for each change since the last merge
        last = max((json.loads(r[0]) for r in rows if r[0].strip()), key=lambda m: m["version"])
        forest.sets, forest.eids, forest.version = last["sets"], last["eids"], last["version"]
        forest.runs = [[tuple(f) for f in run] for run in last["runs"]]
        return forest

    def _store(self) -> HashForest:
        self.version += 1
        text = json.dumps({"version": self.version, "sets": self.sets, "eids": self.eids, "runs": self.runs})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{self.version:08d}")
        return self

    def _place(self, what: str) -> str:
        return f"{self.path}/{what}-{fresh_path(self.spark, '').rsplit('-', 1)[1]}"

    def add(self, rows: DataFrame) -> HashForest:
        """Appends accepted rows as one more run; merges when there are many."""
        rows = rows.where("file_id is not null and id is not null").withColumn("fkey", F.xxhash64("file_id"))
        hashed = rows.select("fkey", "id", token_set("toks").alias("hs")).where("size(hs) > 0")
        sets = (hashed.groupBy("fkey", F.xxhash64(F.lit(7), "hs").alias("f0"), F.xxhash64(F.lit(9), "hs").alias("f1"))
                .agg(F.min("id").alias("cid"), F.first("hs").alias("hs")).select("cid", "fkey", "hs"))
        eid = self._place("eids")
        (rows.where("eid is not null").groupBy("fkey", "eid").agg(F.min("id").alias("cid"))
         .write.option("compression", "zstd").parquet(eid))
        self.eids.append(eid)
        return self.add_sets(sets)

    def add_sets(self, sets: DataFrame) -> HashForest:
        """Stores (cid, fkey, hs) and their labels as one more sorted run."""
        path = self._place("sets")
        sets.select("cid", "fkey", "hs").write.option("compression", "zstd").parquet(path)
        self.sets.append(path)
        self._write_run(self.spark.read.schema(_SETS).parquet(path).mapInArrow(_labels, _RUN))
        return self.merge_runs() if len(self.runs) > MAX_RUNS else self._store()

    def _write_run(self, labels: DataFrame) -> None:
        run = self._place("run")
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        (labels.repartitionByRange(parts, "node", "label").sortWithinPartitions("node", "label")
         .write.option("compression", "zstd").parquet(run))
        files = (self.spark.read.schema(_RUN).parquet(run).groupBy(F.input_file_name().alias("f"))
                 .agg(F.min("node"), F.max("node")).collect())  # a row for each stored file
        self.runs.append([tuple(f) for f in files])

    def merge_runs(self) -> HashForest:
        """One run, sorted over all its files, in place of many."""
        old = {f.rsplit("/", 1)[0] for run in self.runs for f, _, _ in run}
        if self.runs:
            labels = self._held([f for run in self.runs for f, _, _ in run])
            self.runs = []
            self._write_run(labels)
        self._store()
        for folder in old:
            remove(self.spark, folder)
        return self

    def _held(self, files: list[str]) -> DataFrame:
        reader = self.spark.read.schema(_RUN)
        return reader.parquet(*files) if files else self.spark.createDataFrame([], _RUN)

    def touched(self, slices: np.ndarray) -> list[str]:
        """The stored files that may hold a node of the marked slices."""
        before = np.r_[0, np.cumsum(slices)]
        return [f for run in self.runs for f, low, high in run
                if before[(high >> 48) + SLICES // 2 + 1] > before[(low >> 48) + SLICES // 2]]

    def near(self, queries: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
        """(q, cid): near sets of the same file for ``queries`` (cid, fkey, hs); itself included."""
        block = F.shiftright("label", _block_shift(num, den))
        key = F.xxhash64("node", block)
        asked = cut(queries.mapInArrow(_labels, _RUN)).withColumn("key", key)

        def add(arr: np.ndarray, b: pa.RecordBatch) -> None:
            arr[(b.column("node").to_numpy(zero_copy_only=False) >> 48) + SLICES // 2] = 1

        files = self.touched(or_fold(asked.select("node"), SLICES, "uint8", "or", add))
        wanted = or_fold(asked.select("key"), FILTER_WORDS, "uint64", "or", _set_bits("key"))
        held = _only(self._held(files).withColumn("key", key), "key", wanted)
        both = held.withColumn("side", F.lit(1)).unionByName(asked.withColumn("side", F.lit(0))).drop("key").withColumn("block", block)
        cand = cut(both.repartition("node", "block").sortWithinPartitions("node", "block", "side", "label")
                   .mapInArrow(_range_search(num, den), "q long, cid long").distinct())
        ids = or_fold(cand.select(F.xxhash64("cid").alias("h")), FILTER_WORDS, "uint64", "or", _set_bits("h"))
        sets = self.spark.read.schema(_SETS).parquet(*self.sets).select("cid", "fkey", "hs", F.xxhash64("cid").alias("h"))
        sets = _only(sets, "h", ids).select("cid", "fkey", "hs")
        mine = queries.select(F.col("cid").alias("q"), F.col("hs").alias("qs"), F.col("fkey").alias("qf"))
        return (cand.join(sets, "cid").join(mine, "q").where("fkey = qf")
                .withColumn("o", F.size(F.array_intersect("hs", "qs")))
                .where(f"o * {den} >= {num} * (size(hs) + size(qs) - o)").select("q", "cid"))

    def same_eid(self) -> DataFrame:
        return self.spark.read.schema("fkey long, eid string, cid long").parquet(*self.eids).groupBy("fkey", "eid").agg(F.min("cid").alias("cid"))


def first_come(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node,) of those refused: nodes are taken in order, and refused if joined to one accepted before.

    ``nodes`` (node, at, kind): at is the order; nodes of one non-null kind are
    all joined to each other, without being paired.  ``edges`` (u, v): u comes
    before v.  Every round accepts the undecided nodes that have no undecided
    one before them and refuses their successors, so the number of rounds is
    the longest chain of dependent decisions.
    """
    several = nodes.where("kind is not null").groupBy("kind").agg(F.count("*").alias("k")).where("k > 1").select("kind")
    linked = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    undecided = cut(nodes.join(several, "kind", "left_semi").unionByName(nodes.join(linked, "node", "left_semi").select("kind", "node", "at").select(*nodes.columns)).distinct())
    left = cut(edges.join(undecided.select(F.col("node").alias("u")), "u", "left_semi").join(undecided.select(F.col("node").alias("v")), "v", "left_semi").select("u", "v").distinct())
    gone: list[DataFrame] = []
    while not undecided.isEmpty():
        least = undecided.where("kind is not null").groupBy("kind").agg(F.min("at").alias("least"))
        open_ = undecided.join(left.select(F.col("v").alias("node")), "node", "left_anti").join(least, "kind", "left")
        heads = cut(open_.where("kind is null or at = least").select("node", "at", "kind"))
        by_edge = left.join(heads.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node"))
        by_kind = undecided.join(heads.where("kind is not null").select("kind", F.col("at").alias("first")), "kind").where("at > first").select("node")
        killed = cut(by_edge.unionByName(by_kind).distinct())
        gone = [cut(gone[0].unionByName(killed))] if gone else [killed]
        undecided = cut(undecided.join(heads, "node", "left_anti").join(killed, "node", "left_anti"))
        left = cut(left.join(undecided.select(F.col("node").alias("u")), "u", "left_semi").join(undecided.select(F.col("node").alias("v")), "v", "left_semi"))
    return gone[0] if gone else nodes.select("node").where("false")


def admit(forest: HashForest, arrivals: DataFrame, num: int = 3, den: int = 4) -> tuple[DataFrame, DataFrame]:
    """(cases, accepted) of new rows (id, batch, file_id, toks, eid) against a forest.

    Rows are taken by lowest batch, then id.  One that has the eid of, or is
    near to, something accepted of its file is a case: (accepted id, id), the
    accepted id being the smallest it repeats.  All others are accepted, as
    rows for HashForest.add.  A row sent again, in the same or a later batch,
    counts once, in its lowest batch.  Without a file_id, or with neither
    tokens nor eid, a row repeats nothing and is accepted.
    """
    rows = arrivals.where("id is not null").groupBy("id").agg(
        F.min("batch").alias("batch"), F.min_by(F.struct("file_id", "toks", "eid"), "batch").alias("x")).select("id", "batch", "x.*")
    rows = cut(rows.withColumn("hs", F.when(F.size("toks") > 0, token_set("toks")))
               .withColumn("fkey", F.when(F.col("file_id").isNotNull(), F.xxhash64("file_id"))))
    known = rows.where("fkey is not null and (size(hs) > 0 or eid is not null)")
    # equal sets with equal eid decide alike: the first is their node
    kinds = ["fkey", "f0", "f1", "eid"]
    keyed = known.withColumn("f0", F.coalesce(F.xxhash64(F.lit(7), "hs"), F.lit(0))).withColumn("f1", F.coalesce(F.xxhash64(F.lit(9), "hs"), F.lit(0)))
    keyed = keyed.withColumn("f0", F.when(F.size("hs") > 0, F.col("f0"))).withColumn("f1", F.when(F.size("hs") > 0, F.col("f1")))
    nodes = cut(keyed.groupBy(*kinds).agg(F.min(F.struct("batch", "id")).alias("at"), F.first("hs").alias("hs"))
                .select(F.col("at.id").alias("node"), "at", *kinds, "hs"))
    same = [F.col(f"k.{k}").eqNullSafe(F.col(f"n.{k}")) for k in kinds]
    members = keyed.alias("k").join(nodes.alias("n"), same).select(F.col("k.id").alias("id"), F.col("n.node").alias("node"))

    queries = nodes.where("size(hs) > 0").select(F.col("node").alias("cid"), "fkey", "hs")
    near = forest.near(queries, num, den).select(F.col("q").alias("node"), "cid")
    by_eid = nodes.where("eid is not null").join(forest.same_eid(), ["fkey", "eid"]).select("node", "cid")
    old = cut(near.unionByName(by_eid).groupBy("node").agg(F.min("cid").alias("old")))

    # among the arrivals themselves: their own run; equal eids are kinds
    mine = HashForest(forest.spark).add_sets(queries)
    order = nodes.select("node", "at")
    pairs = mine.near(queries, num, den).select(F.col("cid").alias("u"), F.col("q").alias("v")).where("u <> v")
    ordered = (pairs.join(order.select(F.col("node").alias("u"), F.col("at").alias("ua")), "u")
               .join(order.select(F.col("node").alias("v"), F.col("at").alias("va")), "v").where("ua < va").select("u", "v"))
    kinded = nodes.select("node", "at", F.when(F.col("eid").isNotNull(), F.struct("fkey", "eid")).alias("kind"))
    free = cut(kinded.join(old, "node", "left_anti"))
    edges = cut(ordered.join(free.select(F.col("node").alias("u")), "u", "left_semi").distinct())
    refused = first_come(free, edges)
    taken = cut(free.join(refused, "node", "left_anti"))
    by_near = edges.join(taken.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node"), F.col("u").alias("new"))
    firsts = taken.where("kind is not null").select("kind", F.col("node").alias("new"), F.col("at").alias("first"))
    same = kinded.join(firsts, "kind").where("at > first").select("node", "new")
    newer = by_near.unionByName(same).groupBy("node").agg(F.min("new").alias("new"))
    best = (nodes.select("node").join(old, "node", "left").join(newer, "node", "left")
            .join(taken.select("node", F.col("node").alias("self")), "node", "left")
            .select("node", F.least("old", "new", "self").alias("accepted")))
    cases = members.join(best, "node").where("accepted is not null and accepted <> id").select("accepted", "id")
    accepted = rows.join(cases, "id", "left_anti").select("id", "file_id", "toks", "eid")
    return cases, accepted
