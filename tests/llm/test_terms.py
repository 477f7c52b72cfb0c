from collections import Counter

from loamstack.llm import terms

ROWS = [(1, ["a", "b", "a"]), (2, ["a", None, ""]), (2, ["a", None, ""]), (3, None), (4, []), (5, ["é", "é"]), (6, None), (6, ["late"]), (7, ["a"] * 5)]


def plain(rows):
    once = {}
    for i, t in rows:
        if once.get(i) is None:
            once[i] = t
    occ, rec = Counter(), Counter()
    for t in once.values():
        t = [x for x in t or () if x is not None]
        occ.update(t)
        rec.update(set(t))
    return {k: (occ[k], rec[k]) for k in occ}


def test_counts(spark):
    df = spark.createDataFrame(ROWS, "id long, toks array<string>").repartition(3)
    assert {r.term: (r.occurrences, r.records) for r in terms.term_frequencies(df, "id", "toks").collect()} == plain(ROWS)
    assert terms.term_frequencies(df.where("false"), "id", "toks").count() == 0


def test_oversized_partitions_are_split_on_disk(spark, monkeypatch):
    monkeypatch.setattr(terms, "PART_ROWS", 3)
    rows = [(i, [f"t{i % 170}", f"u{i % 90}", "hot"]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, toks array<string>").repartition(5)
    assert {r.term: (r.occurrences, r.records) for r in terms.term_frequencies(df, "id", "toks").collect()} == plain(rows)


def test_marks(spark):
    df = spark.createDataFrame([("x", 2, 2), ("y", 3, 3), ("z", 9, 9)], "term string, occurrences long, records long")
    assert {r.term: r.mark for r in terms.mark_terms(df, 400).collect()} == {"x": "rare", "y": None, "z": "common"}
