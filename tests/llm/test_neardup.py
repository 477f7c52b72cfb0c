import random

import pytest
from loamstack.llm import groupmatrix, neardup

ROWS = "id long, toks array<string>, scope string, a string, g string"


def near(a, b, num, den):
    a, b = set(x for x in a or () if x is not None), set(x for x in b or () if x is not None)
    return bool(a and b) and den * len(a & b) >= num * len(a | b)


def made(n, vocabulary, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toks = [f"w{min(rng.randint(0, vocabulary), rng.randint(0, vocabulary))}" for _ in range(rng.randint(1, 9))]
        toks = rng.choice([toks, toks, toks, ["w0", "w1", "w2", "w3", *toks[:2]], None if i % 50 == 3 else toks, [None, *toks]])
        rows.append((i, toks, rng.choice("xy") if i % 29 else None, "clash", "clash"))
    return rows + [(7, rows[7][1], rows[7][2], "clash", "clash"), (None, ["w1"], "x", "", ""), (n, [], "x", "", "")]


def pairs(rows, num, den, scoped=False):
    once = {r[0]: r for r in rows if r[0] is not None}
    ids = sorted(once)
    return {(x, y) for i, x in enumerate(ids) for y in ids[i + 1:] if near(once[x][1], once[y][1], num, den)
            and (not scoped or (once[x][2] is not None and once[x][2] == once[y][2]))}


@pytest.mark.parametrize(("hot", "num", "den"), [(2000, 3, 4), (3, 3, 4), (3, 1, 2)])
def test_pairs_against_brute_force(spark, monkeypatch, hot, num, den):
    """With every frequent token hot too, and at a threshold that one shared token of two reaches."""
    monkeypatch.setattr(groupmatrix, "HOT", hot)
    rows = made(160, 40, hot + den)
    got = [tuple(r) for r in neardup.near_pairs(spark.createDataFrame(rows, ROWS), "id", "toks", num=num, den=den).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs(rows, num, den)


def test_groups_and_scope(spark):
    rows = made(160, 40, 1)
    df = spark.createDataFrame(rows, ROWS)
    got = {r.id: r.root for r in neardup.near_groups(df, "id", "toks", "scope").collect()}
    root = {}
    for a, b in pairs(rows, 3, 4, True):
        ra, rb = root.get(a, {a}), root.get(b, {b})
        both = ra | rb
        for k in both:
            root[k] = both
    assert got == {k: min(v) for k, v in root.items()}
    assert neardup.near_pairs(df.where("false"), "id", "toks").count() == 0


def test_survivors_take_each_field_from_its_best_row(spark):
    rows = [("g", 1, None, "old"), ("g", 2, "x", "new"), ("g", 2, "y", None), (None, 1, "z", "z")]
    df = spark.createDataFrame(rows, "k string, rank int, a string, b string")
    got = {r.k: (r.a, r.b) for r in neardup.survivors(df, ["k"], {"a": ("a", ["rank"]), "b": ("b", ["rank"])}).collect()}
    assert got == {"g": ("y", "new"), None: ("z", "z")}


def test_parts_of_groups_at_any_size():
    import numpy as np
    rng = np.random.default_rng(1)
    small = rng.poisson(1, 1 << 16)
    assert groupmatrix.parts_of(small).max() <= -(-small.max() // groupmatrix.MEMBERS)
    full = rng.poisson(20_000, 1 << 16)  # 1.3 billion rows in groups of a few
    assert np.mean(groupmatrix.parts_of(full)) < 20
    full[7] += 8_000_000  # a group of a third of a large shard
    assert 0.9 < groupmatrix.parts_of(full)[7] * groupmatrix.MEMBERS / 8_000_000 < 1.1


@pytest.mark.parametrize("records", [400_000, 25_000_000])
def test_keys_of_a_set_do_not_grow_with_the_input(records):
    """Tokens of one record in 400: no set asks for more keys in a large input than in a small one."""
    import numpy as np
    rng = np.random.default_rng(2)
    h = np.concatenate([np.sort(rng.integers(-(1 << 62), 1 << 62, 28)) for _ in range(50)])
    counts = np.full(groupmatrix.COUNTERS, records // 400, np.uint32)
    for probe, prefix in ((True, 8), (False, 5)):
        keys = groupmatrix._prefix_keys(np.arange(51) * 28, h, counts, 3, 4, probe, groupmatrix.hot_limit(records))[0]
        assert len(keys) == 50 * prefix
