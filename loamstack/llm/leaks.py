"""Passages of evaluation items inside documents: rare seeds, then alignment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.base import or_fold
from loamstack.runtime import cut

RUN = 10  #: consecutive words that make a leak
SEED = 5  #: words of a seed
CELL_BITS = 24  #: cells of the filters, as a power of two; fixed, 2 MB as bits
MATCH, MISS, GAP = 2, -1, -1
_SCHEMA = "doc_id long, item_id long, score int, item_words int, matched int, longest_run int"

_WORD = re.compile(r"[^\W_]+")
_ASCII = {i: (chr(i) if chr(i).isalnum() else " ") for i in range(128)}
_WIDTH = {i: chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)} | {
    i: None for i in range(0x80, 0xFFFF) if unicodedata.category(chr(i)) == "Cf"}


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case, width and invisible characters; null and empty give none."""
    if not text:
        return []
    if "&nbsp;" in text:
        text = text.replace("&nbsp;", " ")
    if text.isascii():
        return text.lower().translate(_ASCII).split()
    return _WORD.findall(unicodedata.normalize("NFC", text.translate(_WIDTH).casefold()))


def _word_hashes(texts: list[str | None], known: dict[str, int]) -> list[np.ndarray]:
    """The words of texts as 64-bit hashes, none of them 0."""
    def number(w: str) -> int:
        h = known[w] = xxhash.xxh3_64_intdigest(w) or 1
        return h

    get = known.get
    return [np.array([get(w) or number(w) for w in words(t)], np.uint64) for t in texts]


def grams(ids: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words."""
    n = len(ids) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n]
    return h * np.uint64(0xC2B2AE3D27D4EB4F)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        items = _word_hashes(b.column("text").to_pylist(), known)
        for item, ids in zip(b.column("item_id").to_pylist(), items):
            length = min(SEED, len(ids))
            if length:
                g = grams(ids, length)
                n = len(g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * n, pa.int64()), pa.array([len(ids)] * n, pa.int32()), pa.array([length] * n, pa.int32()),
                     pa.array(range(n), pa.int32()), pa.array(g.view(np.int64))], names=["item_id", "words", "length", "at", "gram"])


def _gram_hits(shared, lengths: list[int]):
    """(gram, doc_id, place): where documents hold a gram that an item may have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        known: dict[str, int] = {}
        for b in batches:
            if len(known) > 2_000_000:
                known.clear()
            docs = _word_hashes(b.column("text").to_pylist(), known)
            if not docs:
                continue
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            gap = np.zeros(1, np.uint64)
            flat = np.concatenate([x for d in docs for x in (d, gap)])
            start = np.r_[0, np.cumsum([len(d) + 1 for d in docs])[:-1]]
            for length in lengths:
                g = grams(flat, length)
                c = _cells(g)
                at = np.flatnonzero((bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1)
                owner = np.searchsorted(start, at, "right") - 1
                inside = at + length <= start[owner] + np.array([len(d) for d in docs])[owner]
                at, owner = at[inside], owner[inside]
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(ids[owner]), pa.array((at - start[owner]).astype(np.int32))],
                                                 names=["gram", "doc_id", "place"])

    return run


def choose_seeds(words_: int, counts: dict[int, int]) -> set[int]:
    """Places of an item's seeds: of each window of RUN words the gram that is rarest in the corpus, of those that occur.

    If a gram of a window occurs nowhere, no document holds the window; so
    any other may stand for it.  An item shorter than a window has one seed.
    """
    places = sorted(counts)
    width = RUN - SEED + 1
    starts = range(len(places) - width + 1) if words_ >= RUN else [0]
    return {min(places[at:at + width] if words_ >= RUN else places, key=lambda k: (counts[k] == 0, counts[k], k)) for at in starts}


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for item, n, g in zip(b.column("item_id").to_pylist(), b.column("words").to_pylist(), b.column("grams").to_pylist()):
            by_place = {x["at"]: x for x in g}
            out += [(by_place[k]["gram"], item, k) for k in choose_seeds(n, {k: x["n"] for k, x in by_place.items()})]
        cols = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()))], names=["gram", "item_id", "at"])


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(score, matched words) of the best Smith-Waterman local alignment of two word lists."""
    width = len(doc)
    slope = np.arange(width + 1) * -GAP
    row, hits = np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64)
    best, matched = 0, 0
    for w in item:
        same = doc == w
        diag = row[:-1] + np.where(same, MATCH, MISS)
        step = np.r_[0, np.maximum(diag, row[1:] + GAP)]
        came = np.r_[0, np.where(diag >= row[1:] + GAP, hits[:-1] + same, hits[1:])]
        # gaps along the row: the best of all places to the left, less its distance
        lifted = np.maximum(step, 0) + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(width + 1), 0))
        row = top - slope
        hits = np.where(row > 0, came[source], 0)
        k = int(row.argmax())
        if row[k] > best:
            best, matched = int(row[k]), int(hits[k])
    return best, matched


def _run_through(doc: np.ndarray, item: np.ndarray, i: int, j: int) -> int:
    """Length of the run of equal words through doc[i] = item[j]."""
    n = 0
    while i - n - 1 >= 0 and j - n - 1 >= 0 and doc[i - n - 1] == item[j - n - 1]:
        n += 1
    k = 0
    while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]:
        k += 1
    return n + k


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        docs = _word_hashes(b.column("text").to_pylist(), known)
        items = _word_hashes(b.column("item_text").to_pylist(), known)
        out = []
        for d, i, doc, item, found in zip(b.column("doc_id").to_pylist(), b.column("item_id").to_pylist(), docs, items, b.column("found").to_pylist()):
            out.append((d, i, *_judge(doc, item, [(x["place"], x["at"]) for x in found])))
        cols = list(zip(*out)) if out else [[]] * 6
        types = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         names=["doc_id", "item_id", "score", "item_words", "matched", "longest_run"])


def _judge(doc: np.ndarray, item: np.ndarray, places: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """(score, words of the item, matched, longest run) over all windows around the seeds."""
    size = len(item)
    windows: list[list[int]] = []
    for i, j in sorted(places):
        low, high = max(0, i - j - size // 4), min(len(doc), i - j + size + size // 4)
        if windows and low <= windows[-1][1]:
            windows[-1][1] = max(windows[-1][1], high)
        else:
            windows.append([low, high])
    score, matched = max(align(doc[a:z], item) for a, z in windows)
    longest, seen = 0, set()
    for i, j in places:
        if (i - j, i) not in seen:
            n = _run_through(doc, item, i, j)
            seen.update((i - j, i + k) for k in range(n))
            longest = max(longest, n)
    return score, size, matched, longest


def leak_alignments(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, item_words, matched, longest_run) for documents that hold a seed of an item.

    score and matched are of the best Smith-Waterman alignment on words around
    the seeds; longest_run is the longest run of equal consecutive words
    through a seed, at least the longest run of RUN words or more there is.
    Items of fewer than RUN words have one seed, those of fewer than SEED
    words their whole.

    The documents are tokenized once, against a bit array of fixed size of the
    items' grams, whatever their number.  The places so found say how common
    each gram is in the corpus; the rarest of each window become seeds, and a
    join on them gives the pairs.  Only documents of pairs are read again for
    the alignment.  Null and empty texts leak nothing; documents with equal
    texts come out each; a repeated id counts once.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text").where("text is not null and doc_id is not null")
    its = items.select(F.col("item_id").cast("long"), "text").where("text is not null and item_id is not null").dropDuplicates(["item_id"])
    held = cut(its.mapInArrow(_item_grams, "item_id long, words int, length int, at int, gram long"))
    lengths = sorted(r.length for r in held.select("length").distinct().collect())  # at most SEED rows

    def add(column: str):
        def run(arr: np.ndarray, b: pa.RecordBatch) -> None:
            arr[_cells(b.column(column).to_numpy(zero_copy_only=False).view(np.uint64))] = 1
        return run

    bits = spark.sparkContext.broadcast(np.packbits(or_fold(held.select("gram"), 1 << CELL_BITS, "uint8", "or", add("gram"))))
    hits = cut(docs.mapInArrow(_gram_hits(bits, lengths), "gram long, doc_id long, place int"))
    common = hits.groupBy("gram").agg(F.count("*").alias("n"))
    counted = held.join(common, "gram", "left").groupBy("item_id", "words").agg(
        F.collect_list(F.struct("at", "gram", F.coalesce("n", F.lit(0)).alias("n"))).alias("grams"))
    seeds = cut(counted.mapInArrow(_seeds, "gram long, item_id long, at int"))
    pairs = cut(hits.join(seeds, "gram").groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("place", "at")).alias("found")))
    wanted = spark.sparkContext.broadcast(np.packbits(or_fold(
        pairs.select(F.xxhash64("doc_id").alias("h")), 1 << CELL_BITS, "uint8", "or", add("h"))))

    def leaking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _cells(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
            yield b.filter(pa.array((wanted.value[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1))

    read = docs.withColumn("h", F.xxhash64("doc_id")).mapInArrow(leaking, "doc_id long, text string, h long").select("doc_id", "text").dropDuplicates(["doc_id"])
    joined = pairs.join(read, "doc_id").join(its.withColumnRenamed("text", "item_text"), "item_id")
    return joined.select("doc_id", "item_id", "text", "item_text", "found").mapInArrow(_judged, _SCHEMA)
