import random

from loamstack.operators import pairs
from pyspark.sql import functions as F

ROWS = "file_id string, pos int, text string, is_header boolean, toks array<string>, eid string"


def made(n, seed):
    """Entries of one file; all share words of a small vocabulary, one in ten is an earlier one with a word changed."""
    rng, sets = random.Random(seed), []
    for i in range(n):
        toks = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 14))]
        if i and rng.random() < 0.1:
            toks = [*sets[rng.randrange(i)]]
            toks[rng.randrange(len(toks))] = f"x{i}"
        sets.append(toks)
    return sets


def scores(x, y):
    return len({*x} & {*y}) / len({*x} | {*y}), len({*x} & {*y}) / min(len({*x}), len({*y}))


def test_pairs_of_all_kinds_against_brute_force(spark):
    sets = made(150, 1)
    df = spark.createDataFrame([("f", i, " ".join(t), False, t, str(i)) for i, t in enumerate(sets)], ROWS)
    want = {"near": set(), "subject": set(), "merge": set()}
    for b in range(len(sets)):
        for a in range(b):
            (jac, held), x, y = scores(sets[a], sets[b]), sets[a], sets[b]
            if (jac >= 0.85 or held >= 0.92) and [t for t in x if t in y] == [t for t in y if t in x]:
                want["near"].add((a, b))
            if scores(x[:6], y[:6])[0] >= 0.5 and jac >= 0.25:
                want["subject"].add((a, b))
            if jac >= 0.5:
                want["merge"].add((a, b))
    for kind, find in (("near", pairs.near_duplicate_edges), ("subject", pairs.subject_edges), ("merge", pairs.merge_edges)):
        got = [(r.a, r.b) for r in find(df).select("a", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == want[kind], kind


def test_few_candidates_leave_the_join(spark):
    """Entries that share words but are not alike meet in the join and end there."""
    rng = random.Random(3)
    df = spark.createDataFrame([("f", i, "", False, [f"w{t}" for t in rng.sample(range(150), 24)], str(i)) for i in range(300)], ROWS)
    seen = []
    scored = pairs._scored
    pairs._scored = lambda found, entries: seen.append(found.count()) or scored(found, entries)
    try:
        assert pairs.merge_edges(df).where(F.col("jaccard") < 0.5).count() == 0
    finally:
        pairs._scored = scored
    assert seen[0] < 300  # of 44,850 pairs
