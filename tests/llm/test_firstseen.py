from datetime import datetime as D

import __spark_entry__


def test_p6_first_seen(spark, tmp_path):
    words = [f"w{k}" for k in range(8)]
    entries = [(1, "f", False, words, "e1"), (2, "f", False, ["a", "b"], "e2"), (3, "f", False, ["c", "d"], "e3"), (4, "f", False, ["g", "h"], "e4")]
    spark.createDataFrame(entries, "entry_id long, file_id string, is_header boolean, toks array<string>, eid string").write.parquet(f"{tmp_path}/entries.parquet")
    d = [D(2025, 9, k) for k in range(1, 29)]
    arrivals = [(10, 1, "f", words[:7], "x1", d[17]), (11, 1, "f", None, "e2", d[17]), (12, 1, "f", None, "e3", d[17]), (13, 1, "f", None, "e4", d[17]),
                (14, 1, "f", ["m", "n"], "x2", d[17]), (15, 2, "f", ["m", "n"], "x3", d[18]), (14, 2, "f", ["m", "n"], "x2", d[18]),  # sent again
                (16, 1, "f", ["o", "p"], "x4", d[0]), (17, 2, "f", ["o", "p"], "x5", d[18]),  # accepted with a time much too early
                (18, 1, "f", ["q", "r"], "x6", None), (19, 2, "f", ["q", "r"], "x7", d[18])]
    spark.createDataFrame(arrivals, "entry_id long, batch_no int, file_id string, toks array<string>, eid string, first_seen timestamp_ntz").write.parquet(f"{tmp_path}/arrivals.parquet")
    state = [("f", "e1", d[1], d[5]), ("f", "e1", d[1], d[5]), ("f", "e1", d[3], d[4]), ("g", "e1", d[0], d[9]),  # repeated, late older, another file
             ("f", "e2", None, d[8]), ("f", "e2", d[2], d[6]), ("f", "e3", d[9], d[2])]  # null in the newest; last before first; e4 has none
    spark.createDataFrame(state, "file_id string, eid string, first_seen timestamp_ntz, last_seen timestamp_ntz").write.parquet(f"{tmp_path}/state.parquet")
    rows = __spark_entry__.queries()["p6_first_seen"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == [
        (1, 10, d[1]), (2, 11, d[2]), (3, 12, None), (4, 13, None), (14, 15, d[17]), (16, 17, None), (18, 19, None)]
