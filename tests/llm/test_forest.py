import random

import numpy as np
from loamstack.llm import forest as fo
from loamstack.llm.base import token_set
from pyspark.sql import functions as F

ROWS = "id long, file_id string, toks array<string>, eid string"


def near(a, b):
    a, b = set(a or ()), set(b or ())
    return bool(a and b) and 4 * len(a & b) >= 3 * len(a | b)


def made(rng, n, first):
    """Facts, many of them restated with one or two words changed; nulls, empties, equal eids."""
    facts = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 24))] for _ in range(n // 3)]
    rows = []
    for i in range(n):
        toks = list(rng.choice(facts))
        for _ in range(rng.randint(0, 2)):
            toks[rng.randrange(len(toks))] = f"w{rng.randint(0, 400)}"
        if i % 41 == 0:
            toks = None if i % 2 else []
        rows.append((first + i, None if i % 97 == 5 else rng.choice("fg"), toks, None if i % 53 == 7 else f"e{rng.randint(0, 9 * n)}"))
    return rows


def plain(history, arrivals):
    held = [h for h in history if h[1] is not None]
    cases, seen = set(), set()
    for i, b, f, t, e in sorted(arrivals, key=lambda r: (r[1], r[0])):
        if i in seen:
            continue
        seen.add(i)
        hits = [h[0] for h in held if f is not None and h[1] == f and (near(h[2], t) or (e is not None and h[3] == e))]
        if hits:
            cases.add((min(hits), i))
        elif f is not None:
            held.append((i, f, t, e))
    return cases


def test_depths_meet_the_target():
    d = fo.search_depths()
    assert d[1] == fo.DEPTH and d[1:].min() >= 2 and fo.reached(0.75, int(d[-1])) >= fo.RECALL
    assert all(fo.reached(0.75, int(x)) >= fo.RECALL or x > d[-1] for x in d[1:])


def test_nights_against_a_plain_loop(spark):
    rng = random.Random(4)
    history = made(rng, 240, 1)
    new = made(rng, 120, 1000)
    arrivals = [(i, 1 + k // 60, *rest) for k, (i, *rest) in enumerate(new)] + [(new[0][0], 2, *new[0][1:])]
    want = plain(history, arrivals)
    h = fo.HashForest(spark).add(spark.createDataFrame(history, ROWS))
    got, reads = set(), []
    for night in (1, 2):
        opened = fo.HashForest.open(spark, h.path)
        seen = {i for i, b, *_ in arrivals if b < night}
        batch = spark.createDataFrame([(i, b, f, t, e) for i, b, f, t, e in arrivals if b == night and i not in seen], "id long, batch int, file_id string, toks array<string>, eid string")
        cases, accepted = fo.admit(opened, batch)
        got |= {tuple(r) for r in cases.collect()}
        opened.add(accepted)
        reads.append(len(opened.runs))
    assert got == want and len(want) > 20 and reads == [2, 3]
    merged = fo.HashForest.open(spark, h.path).merge_runs()
    assert len(merged.runs) == 1 and len(fo.HashForest.open(spark, h.path).runs) == 1


def test_recall_and_pruned_reading(spark):
    rng = random.Random(9)
    rows = [(i, f"file{i % 40}", [f"w{rng.randint(0, 60)}" for _ in range(12)], f"e{i}") for i in range(1200)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        f = fo.HashForest(spark).add(spark.createDataFrame(rows, ROWS))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    queries = spark.createDataFrame([r for r in rows if r[1] == "file3"][:1], ROWS).select(
        F.col("id").alias("cid"), F.xxhash64("file_id").alias("fkey"), token_set("toks").alias("hs"))
    assert {r.cid for r in f.near(queries).collect()} >= {3}
    marks = np.zeros(fo.SLICES, np.uint8)
    marks[(f.runs[0][0][1] >> 48) + fo.SLICES // 2] = 1
    assert 0 < len(f.touched(marks)) < len(f.runs[0])
    assert f.touched(np.zeros(fo.SLICES, np.uint8)) == []


def test_recall_is_measured(spark):
    """Pairs at the threshold itself, the hardest: 6 of 8 tokens shared."""
    rng = random.Random(2)
    rows, asked = [], []
    for i in range(600):
        base = [f"t{i}x{k}" for k in range(7)]
        rows.append((i, "f", base, None))
        asked.append((10_000 + i, "f", base[:6] + [f"new{rng.random()}"], None))
    f = fo.HashForest(spark).add(spark.createDataFrame(rows, ROWS))
    q = spark.createDataFrame(asked, ROWS).select(F.col("id").alias("cid"), F.xxhash64("file_id").alias("fkey"), token_set("toks").alias("hs"))
    found = {(r.q, r.cid) for r in f.near(q).collect()}
    assert found <= {(10_000 + i, i) for i in range(600)} and len(found) >= 0.99 * 600
