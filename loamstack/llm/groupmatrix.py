"""Near-duplicate search by a token-group matrix.

Records with equal token sets form a class; similar classes form a group.  A
group is stored with the union of its members' tokens as a row of bits.  A
class asks only for groups that share one of its rarest tokens, the overlap
with a group is bounded from above by its row of bits, and only groups whose
bound reaches the threshold are opened and compared exactly.

Exactness.  Tokens are ordered by (number of records, hash).  The number comes
from a counter array of fixed size, so any collision only changes the order,
never the result.  With q the larger set of a near pair and r the smaller one,
J >= num/den means an overlap of at least num/den * |q| and of at least
num/(num+den) * (|q|+|r|).  So the first common token stands within the first
|q| - ceil(num/den |q|) + 1 tokens of q and the first |r| - ceil(2num/(num+den) |r|) + 1
of r, and the second one at most one further.  Frequent tokens are joined as
pairs (the first two common tokens), all others alone; sets so small that one
common token can make them near have their frequent tokens alone as well, so
nothing is lost at any threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.base import list_parts, or_fold, token_set

COUNTERS = 1 << 22  #: token counters; fixed, 8 MB as 16-bit numbers
GROUP_COUNTERS = 1 << 16  #: counters of rows by group key; fixed
KEY_BITS = 25  #: cells of the key filter, as a power of two; 4 MB as bits
HOT = 2000  #: tokens of more records than this, and of more than one in HOT_SHARE, are joined as pairs
HOT_SHARE = 256
MEMBERS = 4  #: classes a group is meant to hold


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(42)).astype(np.int64)


def _group_bucket(g: np.ndarray) -> np.ndarray:
    return (g.view(np.uint64) >> np.uint64(48)).astype(np.int64)


def parts_of(counts: np.ndarray) -> np.ndarray:
    """In how many parts the groups of each bucket are cut.

    What stands in a bucket beyond the mean of all buckets belongs to its
    large groups; so groups stay whole however many share a bucket, and a
    large one is cut into parts of about MEMBERS rows, whatever its size.
    """
    beyond = np.maximum(counts.astype(np.int64) - int(counts.mean()), 1)
    return -(-beyond // MEMBERS)


def hot_limit(records: int) -> int:
    """Records beyond which a token is frequent.

    It grows with the input: a fixed limit makes ever more tokens frequent,
    and the pairs of a set grow as the square of its frequent tokens.
    """
    return max(HOT, records // HOT_SHARE)


def keyed_sets(df: DataFrame, id_col: str, toks_col: str, scope_col: str | None = None) -> DataFrame:
    """(id, hs, f, g): the token set, its fingerprint and its similarity key.

    The key is made of the three smallest and the three largest hashes, a
    min-hash of six values that the sorted set gives for nothing.  It is strict
    on purpose: a group of sets less alike has a union that bounds nothing.  Rows without tokens,
    or without a scope where one is asked for, are near to nothing and absent.
    """
    scope = [F.col(scope_col)] if scope_col else []
    s = df if scope_col is None else df.where(F.col(scope_col).isNotNull())
    s = s.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), token_set(toks_col, *scope).alias("hs"))
    s = s.where(F.size("hs") > 0)
    return s.select(
        "id", "hs", F.xxhash64(F.lit(7), "hs").alias("f"),
        F.xxhash64(F.lit(11), F.slice("hs", 1, 3), F.slice("hs", F.greatest(F.size("hs") - 2, F.lit(1)), F.lit(3))).alias("g"))


def _count(arr: np.ndarray, batch: pa.RecordBatch) -> None:
    _, flat = list_parts(batch.column("hs"))
    if len(flat):
        arr[:COUNTERS] += np.bincount(_bucket(flat), minlength=COUNTERS).astype(np.uint32)
    g = batch.column("g").to_numpy(zero_copy_only=False)
    arr[COUNTERS:] += np.bincount(_group_bucket(g), minlength=GROUP_COUNTERS).astype(np.uint32)


def _prefix_keys(off: np.ndarray, h: np.ndarray, counts: np.ndarray, num: int, den: int, probe: bool, limit: int = HOT):
    """(key, row, place of the first token, n) of all keys of one side, for token sets (off, h)."""
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    c = counts[_bucket(h)].astype(np.int64)
    order = np.lexsort((h, c, row))
    h, c = h[order], c[order]
    pos = np.arange(len(h)) - np.repeat(off[:-1], n)
    need = -(-num * n // den) if probe else -(-2 * num * n // (num + den))
    prefix = np.repeat(n - need, n)
    hot = c > limit
    lone = np.repeat(need < 2, n)  # sets of which one shared token may be enough
    # single keys: tokens that are not frequent and that other records have
    m = (pos <= prefix) & (~hot | lone) & (c > 1)
    keys, rows, at = [h[m]], [row[m]], [pos[m]]
    # pairs of frequent tokens, the second at most one place further
    m = (pos <= prefix + 1) & hot
    x, r, p = h[m], row[m], pos[m]
    d = 1
    while d < len(x):
        same = r[d:] == r[:-d]
        if not same.any():
            break
        a, z = x[:-d][same].view(np.uint64), x[d:][same].view(np.uint64)
        keys.append((a * np.uint64(0x9E3779B97F4A7C15) ^ z).view(np.int64))
        rows.append(r[d:][same])
        at.append(p[:-d][same])
        d += 1
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(at), n


def _key_cell(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def _useful(sets: DataFrame, shared, num: int, den: int, limit: int = HOT) -> np.ndarray:
    """Bits of the keys that an index side has and at least two records ask for.

    A filter of fixed size: a key it lets through in error only costs its row.
    """
    cells = 1 << KEY_BITS

    def add(arr: np.ndarray, batch: pa.RecordBatch) -> None:
        off, h = list_parts(batch.column("hs"))
        key, *_ = _prefix_keys(off, h, shared.value, num, den, True, limit)
        cell, times = np.unique(_key_cell(key), return_counts=True)
        arr[cell] = np.minimum(arr[cell].astype(np.int64) + times, 2)
        key, *_ = _prefix_keys(off, h, shared.value, num, den, False, limit)
        arr[cells + _key_cell(key)] = 2

    seen = or_fold(sets.select("hs"), 2 * cells, "uint8", "two", add)
    return np.packbits((seen[:cells] > 1) & (seen[cells:] > 0))


def _postings(counts: np.ndarray, useful: np.ndarray, num: int, den: int, probe: bool, limit: int = HOT):
    """Rows of one side of the candidate join, from groups of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            gkey = batch.column("gk").to_numpy(zero_copy_only=False)
            mem = batch.column("members")
            moff = np.asarray(mem.offsets).astype(np.int64)
            items = mem.values.slice(moff[0], moff[-1] - moff[0])
            per_group = np.diff(moff)
            off, h = list_parts(items.field("hs"))
            member_group = np.repeat(np.arange(len(gkey)), per_group)
            bits = (h.view(np.uint64) >> np.uint64(20)) & np.uint64(127)
            one = np.uint64(1) << (bits & np.uint64(63))
            b0 = np.bitwise_or.reduceat(np.where(bits < 64, one, np.uint64(0)), off[:-1])
            b1 = np.bitwise_or.reduceat(np.where(bits >= 64, one, np.uint64(0)), off[:-1])
            key, r, p, n = _prefix_keys(off, h, counts, num, den, probe, limit)
            cell = _key_cell(key)
            keep = (useful[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            key, r, p = key[keep], r[keep], p[keep]
            # what the first common token's place leaves possible, see near_links
            w = den * n[r] - (num + den) * p
            starts = np.r_[0, np.cumsum(per_group)[:-1]]
            if probe:
                place = r - starts[member_group[r]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(gkey[member_group[r]]), pa.array(place.astype(np.int32)), pa.array(n[r].astype(np.int32)),
                     pa.array(w.astype(np.int32)), pa.array(b0[r].view(np.int64)), pa.array(b1[r].view(np.int64))],
                    names=["key", "qg", "qp", "qn", "qw", "q0", "q1"])
                continue
            g = member_group[r]
            order = np.lexsort((key, g))
            key, g, w = key[order], g[order], w[order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (g[1:] != g[:-1])]) if len(key) else np.zeros(0, np.int64)
            if len(first):
                w = np.maximum.reduceat(w, first)
            key, g = key[first], g[first]
            u0, u1 = np.bitwise_or.reduceat(b0, starts), np.bitwise_or.reduceat(b1, starts)
            low, high = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(gkey[g]), pa.array(per_group[g].astype(np.int32)), pa.array(low[g].astype(np.int32)),
                 pa.array(high[g].astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(u0[g].view(np.int64)), pa.array(u1[g].view(np.int64))],
                names=["key", "ig", "im", "low", "high", "iw", "i0", "i1"])

    return run


def near_links(sets: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
    """(ag, af, bg, bf): all pairs of different token sets with Jaccard >= num/den.

    A set is named by its two fingerprints (g, f), 128 bits together.

    ``sets`` as of keyed_sets.  Copies cost nothing beyond the map-side
    aggregation that collapses them; a group of many similar classes is cut
    into parts of about MEMBERS by fingerprint, and every part is still asked
    by every class, so no link is lost.  Nothing but the counters and the
    key filter (12 MB, 20 MB where frequent means more than 65,534 records) is broadcast.  An empty input gives an empty result.
    """
    spark = sets.sparkSession
    counts = or_fold(sets.select("hs", "g"), COUNTERS + GROUP_COUNTERS, "uint32", "sum", _count)
    limit = hot_limit(int(counts[COUNTERS:].sum(dtype=np.int64)))
    top = max(65535, limit + 1)
    shared = spark.sparkContext.broadcast(np.minimum(counts[:COUNTERS], top).astype(np.uint16 if top == 65535 else np.uint32))
    useful = spark.sparkContext.broadcast(_useful(sets, shared, num, den, limit))
    parts = parts_of(counts[COUNTERS:])
    busy = np.flatnonzero(parts > 1)
    salts = spark.createDataFrame([(int(b), int(parts[b])) for b in busy], "gb int, parts long")  # at most GROUP_COUNTERS rows
    keyed = (sets.select("hs", "f", "g").withColumn("gb", F.shiftrightunsigned("g", 48).cast("int")).join(F.broadcast(salts), "gb", "left")
             .withColumn("gk", F.xxhash64("g", F.pmod("f", F.coalesce("parts", F.lit(1))))))
    groups = keyed.groupBy("gk").agg(F.first("g").alias("g"), F.sort_array(F.collect_set(F.struct("f", "hs"))).alias("members"))

    def side(probe: bool, schema: str) -> DataFrame:
        fold = lambda batches: _postings(shared.value, useful.value, num, den, probe, limit)(batches)
        return groups.mapInArrow(fold, schema)

    q = side(True, "key long, qg long, qp int, qn int, qw int, q0 long, q1 long")
    i = side(False, "key long, ig long, im int, low int, high int, iw int, i0 long, i1 long")
    cand = (
        q.join(i, "key")
        # a member r no larger than q, not smaller than num/den of it
        .where("low <= qn")
        .where(f"high * {den} >= qn * {num}")
        # the places of the first common token leave enough tokens on both sides
        .where(f"iw >= {num} * qn").where(f"qw >= {num} * low")
        # tokens of q that the group's union lacks: r holds at least num/(num+den) * (|q|+|r|) of them, and |r| >= low
        .where(f"(bit_count(q0 & ~i0) + bit_count(q1 & ~i1)) * {num + den} <= qn * {den} - low * {num}")
        # a group of one class is r itself, so the same holds for its tokens that q lacks
        .where(f"im > 1 or (bit_count(i0 & ~q0) + bit_count(i1 & ~q1)) * {num + den} <= low * {den} - qn * {num}")
        .where("not (qg = ig and im = 1)")
        .select("qg", "qp", "ig").distinct()
    )
    opened = groups.select(F.col("gk").alias("ig"), F.col("g").alias("rg"), F.col("members").alias("im"))
    asked = groups.select(F.col("gk").alias("qg"), F.col("g").alias("pg"), F.col("members").alias("qm"))
    met = (
        cand.join(asked, "qg").select("ig", "pg", F.get("qm", F.col("qp")).alias("q"))
        .join(opened, "ig").select("pg", "q", "rg", F.explode("im").alias("r"))
        .where("size(r.hs) < size(q.hs) or (size(r.hs) = size(q.hs) and r.f < q.f)")
        .where(f"size(r.hs) * {den} >= size(q.hs) * {num}")
        .withColumn("o", F.size(F.array_intersect("q.hs", "r.hs")))
        .where(f"o * {den} >= {num} * (size(q.hs) + size(r.hs) - o)")
    )
    return met.select(F.col("pg").alias("ag"), F.col("q.f").alias("af"), F.col("rg").alias("bg"), F.col("r.f").alias("bf")).distinct()
