import __spark_entry__
from loamstack.llm.formatting import plain_form

LONG = "name of the person who keeps the release calendar of the whole project this year"


def test_keys_of_any_length_are_fields():
    a, b = f"{LONG}: Velako; limit: 12; a key of five words: x", f"a key of five words = x | limit = 12 | {LONG} = Velako"
    assert plain_form(a) == plain_form(b)
    assert plain_form(a) != plain_form(a.replace("12", "13")) and plain_form(a) != plain_form(a.replace("person", "team"))


def test_prose_is_no_record():
    assert plain_form("limit: 12; then the map") != plain_form("then the map; limit: 12")


def test_prose_that_parses_as_fields_keeps_its_copies(spark, tmp_path):
    texts = ["Decision 12 for Velako: take the map because the plan was old. Since 234 days Gijo says: bundle open.",
             "Decision 12 for Velako: take the map because the plan was old / Since 234 days Gijo says: bundle open."]
    spark.createDataFrame([(k, t, False) for k, t in enumerate(texts)], "entry_id long, text string, is_header boolean").write.parquet(f"{tmp_path}/entries.parquet")
    assert [tuple(r) for r in __spark_entry__.queries()["p2_found"](spark, str(tmp_path)).collect()] == [(0, 1)]


def test_p2_counts_has_every_entry_once(spark, tmp_path):
    rows = [(1, f"{LONG}: Velako; limit: 12", False), (2, f"limit: 12; {LONG}: Velako", False), (2, f"limit: 12; {LONG}: Velako", False),
            (3, "A note.", False), (4, "a NOTE", False), (5, "alone", False), (5, "alone", False), (6, "# A note", True), (7, None, False)]
    spark.createDataFrame(rows, "entry_id long, text string, is_header boolean").write.parquet(f"{tmp_path}/entries.parquet")
    q = __spark_entry__.queries()
    assert {tuple(r) for r in q["p2_found"](spark, str(tmp_path)).collect()} == {(1, 2), (3, 4)}
    counts = q["p2_counts"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, counts)) == [(1, 2), (3, 2), (5, 1), (7, 1)]
