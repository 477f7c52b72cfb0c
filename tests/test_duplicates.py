import __spark_entry__
import duckdb

ROWS = [
    ("f", "e1", 0, 10, "Fact", False), ("f", "e1", 2, 5, "fact!", False), ("f", "e1", 3, 7, "FACT", False),
    ("f", "e1", 0, 10, "Fact", False), ("f", "e1", 2, 5, "fact!", False),  # delivered again
    ("f", "e2", 1, 8, "# Head", True), ("f", "e2", 4, 9, "# Head", True),  # headers are removed too
    ("g", "e1", 0, 20, "Fact", False), ("g", "e1", 0, 20, "Fact", False),  # another file; only delivered again
    ("g", None, 1, 21, "x", False), ("g", None, 2, 22, "x", False),
]
COLUMNS = "file_id string, eid string, pos int, entry_id long, text string, is_header boolean"


def test_exact_duplicates(spark, tmp_path):
    spark.createDataFrame(ROWS, COLUMNS).write.parquet(f"{tmp_path}/entries.parquet")
    rows = sorted(map(tuple, __spark_entry__.queries()["exact_duplicates"](spark, str(tmp_path)).collect()))
    assert rows == [("f", 2, 5, "fact!", 10, "Fact"), ("f", 3, 7, "FACT", 10, "Fact"), ("f", 4, 9, "# Head", 8, "# Head")]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW entries AS SELECT * FROM '{tmp_path}/entries.parquet/*.parquet'")
    assert sorted(db.execute(__spark_entry__.oracle_sql()["exact_duplicates"]).fetchall()) == rows
