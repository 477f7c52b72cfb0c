"""What joins write to disk: rows that stand in no pair are not shuffled."""

import random
import time
from pathlib import Path

from loamstack.operators import pairs
from loamstack.plans import catalog
from loamstack.runtime import stage

ROWS = "file_id string, pos int, text string, is_header boolean, toks array<string>, eid string"


def shuffled(spark):
    """Bytes that all tasks so far have shuffled."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def words(rng, n):
    return [f"{rng.getrandbits(400):x}" for _ in range(n)]


def lonely(spark, n=3000):
    """(entries, bytes of their tokens): two of a hundred in each file are alike, the others like none."""
    rng, rows = random.Random(5), []
    for i in range(n):
        toks = rows[-1][4][:-2] + words(rng, 2) if i % 100 == 1 else words(rng, 30)
        rows.append((f"f{i // 100}", i % 100, " ".join(toks), False, toks, str(i)))
    return stage(spark.createDataFrame(rows, ROWS).repartition(4)), sum(len(r[2]) for r in rows)


def test_best_pairs_shuffle_only_what_stands_in_pairs(spark):
    entries, size = lonely(spark)
    before = shuffled(spark)
    got = sorted((r.file_id, r.a, r.b) for r in pairs.best_merge_pair(entries).collect())
    assert got == sorted((f"f{k}", 0, 1) for k in range(30))
    assert shuffled(spark) - before < size / 2


def test_merged_texts_shuffle_only_what_is_merged(spark, tmp_path):
    entries, size = lonely(spark)
    entries.selectExpr("monotonically_increasing_id() AS entry_id", "*").write.parquet(f"{tmp_path}/entries.parquet")
    before = shuffled(spark)
    assert catalog.QUERIES["merged_texts"](spark, str(tmp_path)).count() == 30
    assert shuffled(spark) - before < size / 2


def test_subjects_shuffle_no_tokens_of_pairs(spark):
    """Entries of one subject with different bodies meet in the join and end there."""
    rng = random.Random(6)
    lead = words(rng, 6)
    rows = [("f", i, "", False, lead + words(rng, 30), str(i)) for i in range(200)]
    entries = stage(spark.createDataFrame(rows, ROWS).repartition(4))
    before = shuffled(spark)
    assert pairs.subject_edges(entries).isEmpty()
    assert shuffled(spark) - before < 5_000_000


def test_a_run_keeps_few_copies_of_its_entries(spark):
    from datetime import datetime
    from loamstack.plans import pipeline
    from loamstack.plans.options import Options
    from loamstack.runtime import shared_dir

    def held():
        return sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))

    entries, size = lonely(spark, 600)
    files = spark.createDataFrame([("f0", "sections", None)], "file_id string, format string, budget int")
    state = spark.createDataFrame([], "file_id string, eid string, first_seen timestamp_ntz, last_seen timestamp_ntz, runs_seen int, preview string")
    before, one = held(), held() and sum(p.stat().st_size for p in map(Path, (f.removeprefix("file:") for f in entries.inputFiles())))
    plan = pipeline.consolidate(entries, files, state, Options(datetime(2025, 12, 1)))
    assert held() - before < 4.5 * one
    assert pipeline.conservation(plan).isEmpty()


def on_disk(spark):
    """Bytes of shuffles that lie in Spark's local folders."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_a_stage_leaves_no_shuffle_behind(spark):
    rng = random.Random(7)
    rows = spark.createDataFrame([(i, words(rng, 30)) for i in range(1000)], "i int, toks array<string>").repartition(3, "i")
    before = on_disk(spark)
    table = stage(rows)  # rows stays in use, so no garbage is what frees its files
    for _ in range(50):
        if on_disk(spark) <= before:
            break
        time.sleep(0.1)
    assert on_disk(spark) <= before
    assert rows.count() == table.count() == 1000


def test_a_run_copies_entries_only_where_they_change(spark):
    """The table of the entries, what ageing left and what is kept; nothing whole between them."""
    from datetime import datetime
    from loamstack.plans import pipeline
    from loamstack.plans.options import Options
    from loamstack.runtime import shared_dir

    def held():
        return sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))

    entries, _ = lonely(spark, 600)
    one = sum(p.stat().st_size for p in map(Path, (f.removeprefix("file:") for f in entries.inputFiles())))
    files = spark.createDataFrame([("f0", "sections", None)], "file_id string, format string, budget int")
    state = spark.createDataFrame([], "file_id string, eid string, first_seen timestamp_ntz, last_seen timestamp_ntz, runs_seen int, preview string")
    before = held()
    plan = pipeline.consolidate(entries, files, state, Options(datetime(2025, 12, 1)))
    assert held() - before < 3.5 * one
    assert pipeline.conservation(plan).isEmpty()


def test_subjects_of_one_template_meet_only_where_they_may_pass(spark):
    """Sets of six with three common words: of those alone no key is made, as four must be shared."""
    rng = random.Random(8)
    rows = [("f", i, "", False, ["owner", "of", "changed"] + words(rng, 30), str(i)) for i in range(3000)]
    entries = stage(spark.createDataFrame(rows, ROWS).repartition(4))
    before = shuffled(spark)
    assert pairs.subject_edges(entries).isEmpty()
    assert shuffled(spark) - before < 1_200_000


def test_broadcast_arrays_travel_compressed():
    """Each of them is a file on the driver and on every executor, however small the input."""
    import pickle
    import numpy as np
    from loamstack.operators.folds import Packed

    array = np.zeros(1 << 22, "uint32")
    array[7] = 3
    sent = pickle.dumps(Packed(array))
    assert len(sent) < array.nbytes / 100 and (pickle.loads(sent) == array).all()
