"""Documents into context windows: best fit decreasing by partition, certified by a lower bound, repacked where a gap is left.

Texts of one size can stand for each other, so all decisions are made on
histograms of sizes, of the documents and of each of SALTS partitions of them;
a histogram is no larger than the window, however many the documents.  Every
partition is packed by best fit decreasing, and dual feasible functions say
how few windows it needs at least.  Windows that are not full give their
documents up for exchange with the other partitions, and these are packed
again; while the sum stays above the bound of the whole, full windows in turn
are opened too and join the exchange.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstack.runtime import cut

VOCABULARY = "byte_bpe_multi_50k.tiktoken"  #: the documents are in several languages
SALTS = 16  #: parts of one size are numbered in so many pieces
_KEY = 1 << 40  #: more than the parts of any one size


@cache
def encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoding().encode_ordinary
    for b in batches:
        counts = [len(encode(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])


def token_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, tokens) of the documents that have a token; null and empty texts have none."""
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "text").where("text is not null")
    return docs.mapInArrow(_measure, "doc_id long, tokens long").where("tokens > 0")


def best_fit(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit decreasing of sizes {size: number}: (runs, number of windows).

    A run (size, first, number, window, each) puts the parts first, first + 1,
    ... of that size into windows from ``window`` on, ``each`` to a window.
    Windows of equal free space are kept as ranges, so time and memory depend
    on the capacity and not on the number of parts.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[list[int]]] = defaultdict(list)  # by free space, ranges [window, number]
    spaces: list[int] = []
    windows = 0

    def keep(space: int, window: int, number: int) -> None:
        if space and number:
            if not free[space]:
                insort(spaces, space)
            if free[space] and free[space][-1][0] + free[space][-1][1] == window:
                free[space][-1][1] += number
            else:
                free[space].append([window, number])

    for size in sorted(sizes, reverse=True):
        left, first = sizes[size], 0
        while left:
            k = bisect_left(spaces, size)
            if k == len(spaces):  # none is wide enough: new windows
                each = capacity // size
                space, window, number = capacity, windows, -(-left // each)
                windows += number
            else:
                space = spaces[k]
                window, number = free[space].pop()
                if not free[space]:
                    del spaces[k]
                each = space // size
            # a window is filled on until no further part of this size fits: it stays the best one
            full = min(number, left // each)
            if full:
                runs.append((size, first, full * each, window, each))
                keep(space - each * size, window, full)
                first, left, window, number = first + full * each, left - full * each, window + full, number - full
            if number and left and left < each:
                runs.append((size, first, left, window, left))
                keep(space - left * size, window, 1)
                first, left, window, number = first + left, 0, window + 1, number - 1
            if number:
                keep(space, window, number)
    return runs, windows


def lower_bound(sizes: dict[int, int], capacity: int) -> int:
    """Windows that any packing needs at least, by dual feasible functions.

    The plain sum; f0: parts of more than capacity - x count whole, less than
    x not at all, for every x up to half; and the rounded-down f_k.
    """
    s = np.array(sorted(sizes), np.int64)
    n = np.array([sizes[int(x)] for x in s], np.int64)
    best = -(-int((s * n).sum()) // capacity)
    volume, count = np.r_[0, np.cumsum(s * n)], np.r_[0, np.cumsum(n)]
    for x in {1, *(int(v) for v in s if 2 * v <= capacity), *(capacity - int(v) + 1 for v in s if 2 * (capacity - int(v) + 1) <= capacity)}:
        low, high = np.searchsorted(s, x), np.searchsorted(s, capacity - x, "right")
        whole = int(count[-1] - count[high])
        best = max(best, whole + -(-int(volume[high] - volume[low]) // capacity))
    for k in range(1, 101):
        even = (k + 1) * s % capacity == 0
        value = np.where(even, k * s, (k + 1) * s // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


Pattern = tuple[tuple[int, int], ...]  #: what a window holds: (size, number), larger sizes first


def patterns(runs: list[tuple[int, int, int, int, int]]) -> dict[Pattern, int]:
    """How many windows hold what, from the runs of best_fit; windows between two ends of runs are alike."""
    ranges = [(window, window + -(-number // each), size, each) for size, _, number, window, each in runs]
    opens, closes = defaultdict(list), defaultdict(list)
    for begin, end, size, each in ranges:
        opens[begin].append((size, each))
        closes[end].append((size, each))
    out: dict[Pattern, int] = defaultdict(int)
    held: dict[int, int] = defaultdict(int)
    cuts = sorted({*opens, *closes})
    for at, until in zip(cuts, cuts[1:]):
        for size, each in closes[at]:
            held[size] -= each
        for size, each in opens[at]:
            held[size] += each
        content = tuple(sorted(((z, k) for z, k in held.items() if k), reverse=True))
        if content:
            out[content] += until - at
    return dict(out)


def load(pattern: Pattern) -> int:
    return sum(size * k for size, k in pattern)


def _open(found: dict[Pattern, int]) -> dict[int, int]:
    """The sizes that the windows hold."""
    sizes: dict[int, int] = defaultdict(int)
    for content, n in found.items():
        for size, k in content:
            sizes[size] += k * n
    return dict(sizes)


def repack(partitions: list[dict[int, int]], capacity: int, rounds: int = 40) -> tuple[dict[Pattern, int], int, int]:
    """(windows by content, partitions whose certificate had no gap, rounds of exchange) of partitions given as {size: number}.

    Stops as soon as the number of windows is the lower bound of all sizes
    together, or after ``rounds`` exchanges without one; the fewest windows
    seen stand.
    """
    whole: dict[int, int] = defaultdict(int)
    kept: dict[Pattern, int] = defaultdict(int)
    pool: dict[int, int] = defaultdict(int)
    certified = 0
    for sizes in partitions:
        if not sizes:
            continue
        runs, windows = best_fit(sizes, capacity)
        certified += windows == lower_bound(sizes, capacity)
        for size, n in sizes.items():
            whole[size] += n
        for content, n in patterns(runs).items():
            if load(content) == capacity:
                kept[content] += n
            else:
                for size, n_ in _open({content: n}).items():
                    pool[size] += n_
    bound = lower_bound(dict(whole), capacity) if whole else 0
    best = dict(kept)
    for content, n in patterns(best_fit(dict(pool), capacity)[0]).items():
        best[content] = best.get(content, 0) + n
    used = 0
    share = 1
    while sum(best.values()) > bound and used < rounds:
        # every window that is not full, and of the full ones another share each time, smaller sizes first
        full = sorted((c for c in best if load(c) == capacity), key=lambda c: (-len(c), c[-1]))
        opened = {c: n for c, n in best.items() if load(c) < capacity}
        opened |= {c: best[c] for k, c in enumerate(full) if k % rounds == used or k < share}
        tried = patterns(best_fit(_open(opened), capacity)[0])
        if sum(tried.values()) < sum(opened.values()):
            rest = {c: n for c, n in best.items() if c not in opened}
            for c, n in tried.items():
                rest[c] = rest.get(c, 0) + n
            best = rest
        used, share = used + 1, share * 2
    return best, certified, used


def layout(found: dict[Pattern, int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs as of best_fit, and the number of windows, for windows given by content."""
    taken: dict[int, int] = defaultdict(int)
    runs, window = [], 0
    for content, n in sorted(found.items(), reverse=True):
        for size, k in content:
            runs.append((size, taken[size], k * n, window, k))
            taken[size] += k * n
        window += n
    return runs, window


def parts(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, size): a text is one part, or, if it is larger than the window, full windows and a rest."""
    c = F.lit(capacity).cast("long")
    return counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {capacity}"))).alias("part"), "tokens").select(
        "doc_id", "part", F.least(c, F.col("tokens") - F.col("part") * c).alias("size"))


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, window, each = shared.value
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("size", "rank"))
            at = np.searchsorted(key, size * _KEY + rank, "right") - 1
            placed = window[at] + (rank - first[at]) // each[at]
            yield pa.RecordBatch.from_arrays([pa.array(placed, pa.int64()), b.column("doc_id"), b.column("part"), b.column("size")],
                                             names=["window", "doc_id", "part", "tokens"])

    return run


def pack(counts: DataFrame, capacity: int) -> tuple[DataFrame, int, int, int, int]:
    """((window, doc_id, part, tokens), windows, lower bound, certified partitions, exchanges); windows are numbered from 0.

    Only the histogram of sizes comes to the driver, at most SALTS rows for
    each size up to the capacity, whatever the number of documents.
    """
    p = parts(counts, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS)).cast("int"))
    seen = sorted(tuple(r) for r in p.groupBy("size", "salt").count().collect())
    sizes: dict[int, int] = {}
    partitions: list[dict[int, int]] = [{} for _ in range(SALTS)]
    offsets = np.zeros((capacity + 1) * SALTS, np.int64)
    for size, salt, n in seen:
        offsets[size * SALTS + salt] = sizes.get(size, 0)
        sizes[size] = sizes.get(size, 0) + n
        partitions[salt][size] = n
    found, certified, exchanges = repack(partitions, capacity)
    runs, windows = layout(found)
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 5)
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast((cols[:, 0] * _KEY + cols[:, 1], cols[:, 1], cols[:, 3], cols[:, 4]))
    begin = spark.sparkContext.broadcast(offsets)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, salt, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("size", "salt", "k"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("size"),
                                              pa.array(begin.value[size * SALTS + salt] + k - 1, pa.int64())], names=["doc_id", "part", "size", "rank"])

    order = Window.partitionBy("size", "salt").orderBy("doc_id", "part")
    ranked = p.withColumn("k", F.row_number().over(order).cast("long")).mapInArrow(rank, "doc_id long, part long, size long, rank long")
    return ranked.mapInArrow(_place(shared), "window long, doc_id long, part long, tokens long"), windows, lower_bound(sizes, capacity), certified, exchanges


def pack_contexts(documents: DataFrame, contexts: DataFrame) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """((context_id, window, doc_id, part, tokens) for every context, [(context_id, capacity, windows, lower bound, certified partitions, exchanges)])."""
    counts = cut(token_counts(documents))
    result, certificates = None, []
    for context, capacity in sorted(tuple(r) for r in contexts.select("context_id", "capacity_tokens").distinct().collect()):
        rows, *certificate = pack(counts, capacity)
        certificates.append((context, capacity, *certificate))
        rows = rows.select(F.lit(context).alias("context_id"), "window", "doc_id", "part", "tokens")
        result = rows if result is None else result.unionByName(rows)
    return result, certificates
