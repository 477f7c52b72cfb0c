import __spark_entry__
from loamstack.llm.residue import kinds

RESIDUE = {
    1: "- A note of Velako, see 12.\n- Dear {{first_name}}, your request {0} was moved.",
    2: "The ledger from Gijo needs a __topic__ plan first.",
    3: "决定12:Gijo用%role%替换计划。",
    4: "404 Not Found - Go back to the start page.",
    5: "A note of Velako.\n* ERROR [4F1A] THE SERVER COULD NOT OPEN YOUR PROFILE, 0 BYTES RECEIVED",
    6: "Please&nbsp;enable JavaScript to view this page.",
    7: "Verify you are hu​man to continue.",
    8: "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed eiusmod tempor.",
    9: "Blah blah blah.",
    10: "Your note here",
    11: "We are down for maintenance. Please come back later.",
}
NOTES = {
    20: "Velako formats log lines with %s and {0}, see 12 and the plan.",
    21: "The tag `{role}` of Gijo was renamed to `__team__` in release 12.",
    22: "Error 502 hit Velako while sealing envelopes; restarting the relay solved it (12).",
    23: "Rate limit exceeded is the usual alert of Velako; the editor handles it, note 12.",
    24: "Gijo tests run with scripts disabled before sunrise; result 12 was trusted.",
    25: "The 404 page of Gijo now links to the song list, change 12.",
    26: "Sample text for Gijo came from the owner: the feed is public and costs 12.",
    27: "- [x] Keep the **plan** of [Gijo](http://a.b/c), 100 % of it.\n# Budget",
    28: None, 29: "", 30: " \n ",
}


def test_kinds():
    assert kinds(RESIDUE[1]) == ["placeholder"] and kinds(RESIDUE[4]) == ["error"]
    assert kinds(RESIDUE[6]) == ["script"] and kinds(RESIDUE[8]) == ["filler"]
    assert [d for d, t in RESIDUE.items() if not kinds(t)] == []
    assert [(d, kinds(t)) for d, t in NOTES.items() if kinds(t)] == []


def test_p9_found(spark, tmp_path):
    # the same templates with their slots filled: what makes a place a slot
    filled = ["Dear Marta, your request 17 was moved.", "The ledger from Gijo needs a kitchen plan first.", "决定12:Gijo用绳替换计划。"]
    rows = [*RESIDUE.items(), *NOTES.items(), (40, RESIDUE[9]), *((50 + k, f"- {t}") for k, t in enumerate(filled))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.doc_id for r in __spark_entry__.queries()["p9_found"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [*RESIDUE, 40]


def test_a_name_at_a_place_of_its_own_is_no_slot(spark, tmp_path):
    rows = [(1, "Nobody wrote {{like}} this ever."), (2, "Other things are said here.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = __spark_entry__.queries()["p9_found"]
    assert q(spark, str(tmp_path)).collect() == []
    spark.createDataFrame([(3, "Nobody wrote letters this ever."), (4, "ERROR 502 BAD GATEWAY")], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in q(spark, str(tmp_path)).collect()) == [1, 4]
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert q(spark, str(tmp_path)).collect() == []
