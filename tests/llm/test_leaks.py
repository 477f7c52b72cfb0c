import re

import __spark_entry__
from loamstack.llm.leaks import RUN

ITEM = "Suppose Velako repeats fact 12 twice and then shortens the map of Gijo for the night watch"
OTHER = "Between Hobo and Kali only 740 words of the plan may remain pinned until the audit is over"
DOCS = [
    (1, f"Before. {ITEM}. After."),  # whole
    (2, "x " + " ".join(ITEM.split()[3:13]) + " y"),  # exactly RUN words
    (3, "x " + " ".join(ITEM.split()[3:12]) + " y"),  # one too few
    (4, " ".join(ITEM.split()[:8] + ["gap"] + ITEM.split()[8:])),  # broken by a word
    (5, "**" + ITEM.upper().replace(" ", ",\n- ") + "**"),  # case, marks and lines
    (6, ITEM.replace("Velako", "Ve​lako").replace(" ", " ").replace("12", "１２")),  # invisible, space, width
    (7, f"{OTHER} {ITEM}"),  # two items
    (8, None), (9, ""), (10, f"Before. {ITEM}. After."),  # an equal text comes out again
]


def _plain(text):
    text = (text or "").replace("​", "").replace("１２", "12")
    return re.findall(r"[^\W_]+", text.lower())


def _brute(docs, items):
    out = set()
    for d, text in docs:
        w = _plain(text)
        runs = {tuple(w[k:k + RUN]) for k in range(len(w) - RUN + 1)}
        for i, item in items:
            v = _plain(item)
            if any(tuple(v[k:k + RUN]) in runs for k in range(len(v) - RUN + 1)):
                out.add((d, i))
    return out


def test_p8_found_is_brute_force(spark, tmp_path):
    items = [(1, ITEM), (2, OTHER), (3, "too short an item")]
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    rows = __spark_entry__.queries()["p8_found"](spark, str(tmp_path)).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    assert {tuple(r) for r in rows} == _brute(DOCS, items) == {(1, 1), (2, 1), (5, 1), (6, 1), (7, 1), (7, 2), (10, 1)}


def test_alignments_of_edited_and_short_items(spark):
    from loamstack.llm.leaks import leak_alignments
    edited = ITEM.replace("Velako", "the Velako").replace("twice", "again")
    docs = [(1, f"a {edited} b"), (2, "see the red map of Gijo tonight"), (3, "red map"), (4, "nothing here"), (4, "nothing here"), (None, ITEM)]
    items = [(1, ITEM), (2, "the red map of Gijo tonight"), (3, "Red map!"), (4, None), (5, "")]
    got = {(r.doc_id, r.item_id): r for r in leak_alignments(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 2), (2, 3), (3, 3)}
    assert got[1, 1].matched == len(ITEM.split()) - 1 and got[1, 1].longest_run >= 5 and got[2, 3].longest_run == 2


def test_seeds_cover_every_window():
    from loamstack.llm.leaks import SEED, choose_seeds
    counts = {k: (k * 7) % 5 for k in range(40)}
    seeds = choose_seeds(40 + SEED - 1, counts)
    assert all(any(at <= k <= at + RUN - SEED for k in seeds) for at in range(40 - (RUN - SEED)))
    assert choose_seeds(3, {0: 4}) == {0}
