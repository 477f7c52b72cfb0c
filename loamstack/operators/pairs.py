"""Similar pairs of entries within a file, without comparing all pairs.

Candidates come from an equi-join on hashes of (file_id, token) over prefixes:
tokens are ordered from the rarest on, and a set of n tokens that shares at
least m of them with another must share one of its first n - m + 1.  How rare
a token is tells an array of counters of fixed size, so any collision only
changes the order.  Every row of the join carries the sizes, the token's place
and the tokens as 128 bits; these bound the overlap from above within the join,
so only pairs that may pass leave it.  No pair is lost, and every score is
computed exactly afterwards, from the tokens themselves; only those of subjects
within the join, from hashes of 64 bits of all tokens.  As subjects are short,
their keys also name the sizes of both sides, which makes the prefixes shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.functions import constants as K
from loamstack.functions import text as T
from loamstack.operators.filters import among
from loamstack.operators.folds import Packed, list_parts, or_fold
from loamstack.runtime import stage

COUNTERS = 1 << 22  #: token counters; fixed
KEY_BITS = 25  #: cells of the key filter, as a power of two
_ROW = "k long, f long, pos int, n int, m int, i int, s0 long, s1 long"
_WHOLE = "k long, file_id string, pos int, n int, m int, i int, d int, s0 long, s1 long, b0 long, b1 long, b2 long, b3 long, hs array<long>"


def _hashed(entries: DataFrame) -> DataFrame:
    """(file_id, f, pos, hs, lead): an entry's file, and its different tokens and those of its subject, which come first, as hashes with the file."""
    def hashes(toks):
        return F.array_distinct(F.transform(toks, lambda t: F.xxhash64("file_id", t)))
    return entries.select("file_id", F.xxhash64("file_id").alias("f"), "pos", hashes(F.col("toks")).alias("hs"), hashes(T.subject("toks")).alias("lead"))


def _cell(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)


def _bits(off: np.ndarray, h: np.ndarray, words: int = 2) -> list[np.ndarray]:
    """Tokens of each set as ``words`` times 64 bits."""
    b = (h.view(np.uint64) >> np.uint64(20)) & np.uint64(64 * words - 1)
    one = np.uint64(1) << (b & np.uint64(63))
    parts = []
    for word in range(words):
        flags = np.append(np.where(b >> np.uint64(6) == word, one, np.uint64(0)), np.uint64(0))
        got = np.bitwise_or.reduceat(flags, off[:-1])
        parts.append(np.where(np.diff(off) > 0, got, np.uint64(0)))
    return parts


def _placed(off: np.ndarray, h: np.ndarray, counts: np.ndarray, share: float) -> tuple[np.ndarray, ...]:
    """(key, row, place, whether in the prefix) of all tokens, the rarest of each row first."""
    m = np.diff(off)
    row = np.repeat(np.arange(len(m)), m)
    order = np.lexsort((h, counts[_cell(h, 22)], row))
    place = np.arange(len(h)) - np.repeat(off[:-1], m)
    need = np.maximum(np.ceil(m * share - 1e-9).astype(np.int64), 1)
    return h[order], row, place, place < np.repeat(m - need + 1, m)


def _classed(off: np.ndarray, h: np.ndarray, counts: np.ndarray, share: float) -> tuple[np.ndarray, ...]:
    """(key, own, other, twice, row) of the tokens by which short sets meet those of each size.

    Sets of m and n tokens with a jaccard of ``share`` have share / (1 + share) * (m + n) in common, so
    a key names token, m and n, and each pair of sizes has its own prefixes.  Also gives row, place, side (1: the
    set is the larger one, -1: the smaller one, 0: of one size) and the cells of the key filter of the set itself
    and of its partners; sets of one size have half of the filter for themselves, each side a quarter.
    """
    cells = 1 << KEY_BITS
    token, row, place, _ = _placed(off, h, counts, share)
    m = np.diff(off)
    parts = []
    for n in range(1, K.SUBJECT_TOKENS + 1):
        need = np.maximum(np.ceil(share / (1 + share) * (m + n) - 1e-9).astype(np.int64), 1)
        some = (place < (m - need + 1)[row]) & (need <= np.minimum(m, n))[row]
        mine = m[row[some]]
        sizes = (np.minimum(mine, n) * 16 + np.maximum(mine, n)).astype(np.uint64)
        key = (token[some].view(np.uint64) + sizes * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        side, cell = np.sign(mine - n), _cell(key, KEY_BITS)
        own, other = (np.where(side == 0, cell, cells + (side * sign > 0) * (cells >> 1) + (cell >> 1)) for sign in (1, -1))
        parts.append((key, row[some], place[some], side, own, other))
    return tuple(map(np.concatenate, zip(*parts)))


def _candidates(entries: DataFrame, share: float, column: str, all_held: bool, keep: str,
                scores: dict[str, str] | None = None, exact: str = "") -> DataFrame:
    """(f, a, b), each once: pairs that share a token of ``column`` and pass ``keep``.

    With ``scores`` the rows of the join also carry 256 bits of the whole set
    (b0 to b3, as s0 and s1 are of ``column``) and all token hashes (hs), from
    which ``exact`` decides; (file_id, a, b) and the scores come out.

    The token stands in the prefix for ``share`` of both sides, or with
    ``all_held`` of x alone; with ``scores`` share is a jaccard, and keys are
    those of ``_classed``.  Keys that no second entry has are left out by a
    filter of fixed size; one it lets through in error only costs its row.
    """
    sets = _hashed(_pairable(entries))
    sc = entries.sparkSession.sparkContext

    def count(arr: np.ndarray, batch: pa.RecordBatch) -> None:
        _, h = list_parts(batch.column(column))
        arr += np.bincount(_cell(h, 22), minlength=COUNTERS).astype(np.uint32)

    shared = sc.broadcast(Packed(or_fold(sets.select(column), COUNTERS, "uint32", "sum", count)))
    cells = 1 << KEY_BITS

    def ask(arr: np.ndarray, batch: pa.RecordBatch) -> None:
        if scores is not None:
            cell, times = np.unique(_classed(*list_parts(batch.column(column)), shared.value, share)[4], return_counts=True)
            arr[cell] = np.minimum(arr[cell].astype(np.int64) + times, 2)
            return
        key, _, _, first = _placed(*list_parts(batch.column(column)), shared.value, share)
        for at, part in ((0, key[first]), (cells, key))[:1 + all_held]:
            cell, times = np.unique(_cell(part, KEY_BITS), return_counts=True)
            arr[at + cell] = np.minimum(arr[at + cell].astype(np.int64) + times, 2)

    seen = or_fold(sets.select(column), cells * (1 + (all_held or scores is not None)), "uint8", "two", ask)
    asked, once = Packed(np.packbits(seen[:cells] > 1)), Packed(np.packbits(seen[:cells] == 1))
    held = Packed(np.packbits(seen[cells:] > 1)) if all_held else asked
    if scores is not None:  # two of one size, or one of the other side
        asked = once = held = Packed(np.packbits(seen > np.repeat(np.array([1, 0], np.uint8), cells)))
    useful = sc.broadcast((asked, once, held))
    del seen

    ends = ("f", "pos", "n", "m", "i", "s0", "s1") if scores is None else ("file_id", "pos", "n", "m", "i", "d", "s0", "s1", "b0", "b1", "b2", "b3", "hs")

    def postings(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, once, held = useful.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                full, hs = list_parts(batch.column("hs"))
                off, h = list_parts(batch.column(column))
                if scores is None:
                    key, row, place, first = _placed(off, h, shared.value, share)
                    cell = _cell(key, KEY_BITS)
                else:
                    key, row, place, side, _, cell = _classed(off, h, shared.value, share)

                def has(bits: np.ndarray) -> np.ndarray:
                    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1

                if scores is not None:
                    some = has(held)
                else:
                    some = first & has(held) if probe else has(asked) | ~first & has(once)
                key, row, place = key[some], row[some], place[some]
                bits = dict(zip(("s0", "s1"), _bits(off, h)))
                if scores is not None:
                    bits |= zip(("b0", "b1", "b2", "b3"), _bits(full, hs, 4))
                n, m = np.diff(full).astype(np.int32), np.diff(off).astype(np.int32)
                values = {"k": key, "n": n[row], "m": m[row], "i": place.astype(np.int32)}
                if scores is not None:
                    values["d"] = side[some].astype(np.int32)
                values |= {c: b[row].view(np.int64) for c, b in bits.items()}
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(values[c]) if c in values else batch.column(c).take(rows) for c in ("k", *ends)], names=["k", *ends])
        return run

    def side(probe: bool, end: str) -> DataFrame:
        needed = [c for c in sets.columns if c in ("hs", column, *ends)]
        rows = sets.select(*needed).mapInArrow(postings(probe), _ROW if scores is None else _WHOLE)
        return rows.select("k", *[F.col(c).alias(f"{end}{c}") for c in ends])

    x = side(True, "x")
    if all_held:
        y = side(False, "y")
    else:  # the same rows, shuffled once
        y = x.select("k", *[F.col(c).alias(f"y{c[1:]}") for c in x.columns[1:]])
    if scores is not None:
        # not deterministic, so that it stays behind the join: as its condition it would fetch the hashes of every pair that meets
        # with a lambda, so that it is compiled by itself: within the join's loop it makes a method too long for the compiler
        late = f"if(monotonically_increasing_id() < 0, exists(xhs, z -> z = 0), {exact})"
        return x.join(y, "k").where("xfile_id = yfile_id").where(f"xd + yd = 0 and {keep}").where(late).select(
            F.col("xfile_id").alias("file_id"), F.least("xpos", "ypos").alias("a"), F.greatest("xpos", "ypos").alias("b"),
            *[F.expr(e).alias(c) for c, e in scores.items()]).distinct()
    return stage(x.join(y, "k").where("xf = yf").where(keep).select(
        F.col("xf").alias("f"), F.least("xpos", "ypos").alias("a"), F.greatest("xpos", "ypos").alias("b")).distinct())


def _lacks(x: str, y: str, bits: tuple[str, ...] = ("s0", "s1")) -> str:
    """Tokens of x that y surely lacks."""
    return "(" + " + ".join(f"bit_count({x}{b} & ~{y}{b})" for b in bits) + ")"


def _scored(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs (f, a, b), read several times, with their file, both texts' lengths, tokens and scores.

    Of the entries only those that stand in a pair are shuffled.
    """
    e = entries.select(F.xxhash64("file_id").alias("f"), "file_id", "pos", "toks", F.length("text").alias("length"))
    ends = pairs.select("f", F.col("a").alias("pos")).unionAll(pairs.select("f", F.col("b").alias("pos")))
    e = e.where(among(ends, ["f", "pos"]))
    for side in ("a", "b"):
        pairs = pairs.join(e.select("f", F.col("pos").alias(side), F.col("toks").alias(f"toks_{side}"),
                                    F.col("length").alias(f"length_{side}"), F.col("file_id").alias(f"file_{side}")), ["f", side])
    pairs = pairs.where("file_a = file_b").withColumnRenamed("file_a", "file_id").drop("f", "file_b")
    a, b = F.col("toks_a"), F.col("toks_b")
    pairs = pairs.withColumn("shared", T.overlap(a, b)).withColumn("union", F.size(F.array_union(a, b)))
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return pairs.withColumn("jaccard", F.col("shared") / F.col("union")).withColumn("containment", F.col("shared") / smaller)


def _pairable(entries: DataFrame) -> DataFrame:
    """Headings are never partners, and entries without tokens are similar to nothing."""
    return entries.where("not is_header and size(toks) > 0")


def near_duplicate_edges(entries: DataFrame, jaccard: float = K.NEAR_JACCARD, containment: float = K.NEAR_CONTAINMENT) -> DataFrame:
    """(file_id, a, b, shared, union, jaccard, containment, length_a, length_b), a < b by pos.

    Pairs that pass either threshold and hold their shared tokens in the same
    order.  Both thresholds ask for a share of the smaller set, so the smaller
    one's prefix meets all tokens of the larger one.
    """
    low = min(jaccard, containment)
    pairs = _candidates(entries, low, "hs", True, f"(xn < yn or (xn = yn and xpos < ypos)) and {_lacks('x', 'y')} <= xn * {1 - low:.12f} + 1e-6")
    ok = (F.col("jaccard") >= jaccard) | (F.col("containment") >= containment)
    return _scored(pairs, entries).where(ok).where(T.same_sequence("toks_a", "toks_b")).drop("toks_a", "toks_b")


def subject_edges(entries: DataFrame, subject: float = K.SUPERSEDE_SUBJECT, body: float = K.CONFLICT_BODY_LOW) -> DataFrame:
    """(file_id, a, b, subject, jaccard), a < b by pos: pairs alike in their first tokens and in the body.

    Subjects are few words, so very many pairs pass any bound that few bits
    give; their scores are computed within the join, from hashes of 64 bits.
    """
    part, whole = subject / (1 + subject), body / (1 + body)
    lead = " and ".join(f"{_lacks(x, y)} <= {x}m - {part:.12f} * (xm + ym) + 1e-6" for x, y in ("xy", "yx"))
    rest = " and ".join(f"{_lacks(x, y, ('b0', 'b1', 'b2', 'b3'))} <= {x}n - {whole:.12f} * (xn + yn) + 1e-6" for x, y in ("xy", "yx"))
    shared = {"subject": "size(array_intersect(slice(xhs, 1, xm), slice(yhs, 1, ym)))", "jaccard": "size(array_intersect(xhs, yhs))"}
    total = {"subject": "(xm + ym)", "jaccard": "(xn + yn)"}
    scores = {c: f"{shared[c]} / ({total[c]} - {shared[c]})" for c in shared}
    # one intersection of each turns nearly all away before the scores are made
    about = " and ".join(f"{shared[c]} >= {part:.12f} * {total[c]} - 1e-6" for c, part in (("subject", part), ("jaccard", whole)))
    return _candidates(entries, subject, "lead", False, f"xpos < ypos and least(xm - xi, ym - yi) >= {part:.12f} * (xm + ym) - 1e-6 "
                       f"and least(xn, yn) >= {body} * greatest(xn, yn) and {lead} and {rest}", scores,
                       f"{about} and {scores['subject']} >= {float(subject)!r}D and {scores['jaccard']} >= {float(body)!r}D")


def merge_edges(entries: DataFrame, similarity: float = K.MERGE_SIMILARITY) -> DataFrame:
    """(file_id, a, b, ..., jaccard), a < b by pos: pairs of at least this similarity."""
    part = similarity / (1 + similarity)
    bound = " and ".join(f"{_lacks(x, y)} <= {x}n - {part:.12f} * (xn + yn) + 1e-6" for x, y in ("xy", "yx"))
    pairs = _candidates(entries, similarity, "hs", False, f"xpos < ypos and least(xn, yn) >= {similarity} * greatest(xn, yn) "
                        f"and least(xn - xi, yn - yi) >= {part:.12f} * (xn + yn) - 1e-6 and {bound}")
    return _scored(pairs, entries).where(F.col("jaccard") >= similarity).drop("toks_a", "toks_b")


def lead_edges(entries: DataFrame, n: int = K.LEAD_TOKENS, without: DataFrame | None = None) -> DataFrame:
    """(file_id, a, b, ..., jaccard), a < b by pos: pairs with the same first ``n`` tokens, whatever the rest.

    Files whose file_id is in ``without`` are left out; places and leads alone are shuffled for it.
    """
    led = _pairable(entries).where(F.size("toks") >= n).select("file_id", "pos", F.xxhash64(F.slice("toks", 1, n)).alias("lead"))
    if without is not None:
        led = led.join(without, "file_id", "left_anti")
    pairs = stage(led.select("file_id", "lead", F.col("pos").alias("a")).join(led.select("file_id", "lead", F.col("pos").alias("b")), ["file_id", "lead"])
                  .where("a < b").select(F.xxhash64("file_id").alias("f"), "a", "b"))
    same = F.slice("toks_a", 1, n) == F.slice("toks_b", 1, n)
    return _scored(pairs, entries).where(same).drop("toks_a", "toks_b")


def best_merge_pair(entries: DataFrame) -> DataFrame:
    """(file_id, a, b, jaccard): the pair of each file that would be merged first.

    The most similar pair, of equal ones the first by (a, b).  Pairs with the
    same first tokens are looked at only in files without a pair of enough
    similarity, where alone they can be the best.
    """
    pairs = stage(merge_edges(entries).select("file_id", "a", "b", "jaccard"))
    done = pairs.select("file_id").distinct()
    led = lead_edges(entries, without=done).select("file_id", "a", "b", "jaccard")
    best = F.max_by(F.struct("a", "b", "jaccard"), F.struct(F.col("jaccard"), -F.col("a"), -F.col("b")))
    return pairs.unionByName(led).groupBy("file_id").agg(best.alias("p")).select("file_id", "p.*")
