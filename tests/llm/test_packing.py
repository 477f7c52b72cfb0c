import random
from collections import Counter, defaultdict

import __spark_entry__
from loamstack.llm.packing import best_fit, encoding, lower_bound


def _plain_best_fit(items, capacity):
    free = []
    for s in sorted(items, reverse=True):
        fit = [k for k in range(len(free)) if free[k] >= s]
        if fit:
            free[min(fit, key=lambda k: free[k])] -= s
        else:
            free.append(capacity - s)
    return sorted(free)


def test_best_fit_is_the_plain_one():
    rnd = random.Random(1)
    for capacity in (7, 20, 100):
        for _ in range(150):
            items = [rnd.randint(1, rnd.choice([3, capacity])) for _ in range(rnd.randint(1, 60))]
            items = [min(i, capacity) for i in items]
            runs, windows = best_fit(Counter(items), capacity)
            load, placed = Counter(), defaultdict(set)
            for size, first, number, window, each in runs:
                for i in range(number):
                    load[window + i // each] += size
                    assert first + i not in placed[size]
                    placed[size].add(first + i)
            assert {s: len(v) for s, v in placed.items()} == Counter(items)
            assert all(v == set(range(len(v))) for v in placed.values())
            assert sorted(capacity - load[w] for w in range(windows)) == _plain_best_fit(items, capacity)
            assert -(-sum(items) // capacity) <= lower_bound(Counter(items), capacity) <= windows


def test_bound_beats_the_sum():
    assert lower_bound({6: 3}, 10) == 3 and lower_bound({4: 6}, 10) == 3 and lower_bound({10: 2, 1: 1}, 10) == 3


def test_p7_packing(spark, tmp_path):
    docs = [(1, "one two three " * 30), (2, "a short note"), (3, None), (4, ""), (5, "a short note"), (6, "日本語 und Grüße"), (7, "x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 16), (2, 64)], "context_id int, capacity_tokens int").write.parquet(f"{tmp_path}/contexts.parquet")
    rows = __spark_entry__.queries()["p7_packing"](spark, str(tmp_path)).collect()
    for context, capacity in ((1, 16), (2, 64)):
        load, doc = Counter(), Counter()
        own = [r for r in rows if r.context_id == context]
        for r in own:
            load[r.window] += r.tokens
            doc[r.doc_id] += r.tokens
        assert doc == {d: len(encoding().encode_ordinary(t)) for d, t in docs if t}
        assert max(load.values()) <= capacity and len(own) == len({(r.doc_id, r.part) for r in own})
        assert all(n == -(-doc[d] // capacity) for d, n in Counter(r.doc_id for r in own).items())
        bounds = {r.context_id: r for r in __spark_entry__.queries()["p7_bounds"](spark, str(tmp_path)).collect()}
        assert sorted(load) == list(range(bounds[context].windows)) and bounds[context].bound <= bounds[context].windows


def test_repacking_places_everything_and_closes_gaps():
    from loamstack.llm.packing import layout, load, repack
    rnd = random.Random(7)
    for capacity in (20, 100, 512):
        for _ in range(20):
            parts = [Counter(rnd.randint(1, capacity) if rnd.random() < .3 else rnd.randint(1, capacity // 3) for _ in range(rnd.randint(0, 120))) for _ in range(8)]
            whole = sum(parts, Counter())
            found, certified, rounds = repack([dict(p) for p in parts], capacity)
            held = Counter()
            for content, n in found.items():
                assert load(content) <= capacity
                for size, k in content:
                    held[size] += k * n
            assert held == whole and 0 <= certified <= 8
            windows = sum(found.values())
            assert lower_bound(whole, capacity) <= windows <= lower_bound(whole, capacity) * 1.02 + 1
            runs, n = layout(found)
            assert n == windows and Counter({s: sum(r[2] for r in runs if r[0] == s) for s in whole}) == whole
