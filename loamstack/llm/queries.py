"""The p queries: one per problem and table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.llm import firstseen, forest, formatting, leaks, lookalike, neardup, packing, residue, terms
from loamstack.runtime import cut, table


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entries").where("not coalesce(is_header, false)")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.entry_groups(table(spark, sf_dir, "entries"), table(spark, sf_dir, "actions"))
    # trust decides who competes: only the texts of the highest seq, else all
    best = neardup.survivors(rows, ["root"], {"keep_entry_id": ("entry_id", ["trust", "length", "pos"])})
    return best.select(F.col("root").alias("first_entry_id"), "keep_entry_id")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record built for each group: text, pos and result, each from its best row."""
    rows = neardup.entry_groups(table(spark, sf_dir, "entries"), table(spark, sf_dir, "actions"))
    rows = rows.withColumn("result", F.expr("if(trust is null, null, text)"))
    return neardup.survivors(rows, ["root"], {
        "keep_entry_id": ("entry_id", ["trust", "length", "pos"]), "text": ("text", ["trust", "length", "pos"]),
        "pos": ("pos", ["pos"]), "result": ("result", ["trust"])}).withColumnRenamed("root", "first_entry_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.near_pairs(_body(spark, sf_dir), "entry_id", "toks")
    return pairs.select(F.col("a").alias("entry_id_a"), F.col("b").alias("entry_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entry with a near one: its group and its number of links."""
    return neardup.near_groups(_body(spark, sf_dir), "entry_id", "toks").select(
        F.col("id").alias("entry_id"), F.col("root").alias("first_entry_id"), "links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = formatting.formatting_copies(_body(spark, sf_dir), "entry_id", "text")
    return copies.select(F.col("root").alias("first_entry_id"), F.col("id").alias("entry_id"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry without its copies, once, with the number of its copies (itself included)."""
    body = _body(spark, sf_dir)
    copies = formatting.formatting_copies(body, "entry_id", "text").withColumnRenamed("id", "entry_id")
    entries = body.select("entry_id").where("entry_id is not null").distinct().join(copies, "entry_id", "left")
    return entries.groupBy(F.coalesce("root", "entry_id").alias("first_entry_id")).agg(F.count("*").alias("copies"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_terms(spark, sf_dir).where("mark is not null").select("term", "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, its entries and its mark."""
    entries = table(spark, sf_dir, "entries")
    total = terms.count_records(entries, "entry_id")
    return terms.mark_terms(terms.term_frequencies(entries, "entry_id", "toks"), total)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike.lookalike_pairs(_body(spark, sf_dir), "entry_id", "text")
    return pairs.select(F.col("a").alias("entry_id_a"), F.col("b").alias("entry_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entry that has a look-alike: its class and the number of different texts in it."""
    return lookalike.lookalike_groups(_body(spark, sf_dir), "entry_id", "text").select(
        F.col("id").alias("entry_id"), F.col("root").alias("first_entry_id"), "texts")


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    history = _body(spark, sf_dir).select(F.col("entry_id").alias("id"), "file_id", "toks", "eid")
    arrivals = table(spark, sf_dir, "arrivals").select(
        F.col("entry_id").alias("id"), F.col("batch_no").alias("batch"), "file_id", "toks", "eid")
    return history, arrivals


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches at once; they are taken in their order all the same."""
    history, arrivals = _history(spark, sf_dir)
    cases, _ = forest.admit(forest.HashForest(spark).add(history), arrivals)
    return cases.select(F.col("accepted").alias("accepted_entry_id"), F.col("id").alias("entry_id"))


def p6_nightly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cases night by night: the forest is opened, the batch admitted, what was accepted appended."""
    history, arrivals = _history(spark, sf_dir)
    first = arrivals.groupBy("id").agg(F.min("batch").alias("batch"), F.min_by(F.struct("file_id", "toks", "eid"), "batch").alias("x"))
    nights = cut(first.select("id", "batch", "x.*"))
    path = forest.HashForest(spark).add(history).path
    found = None
    for r in sorted(nights.select("batch").distinct().collect()):  # a few nights
        opened = forest.HashForest.open(spark, path)
        cases, accepted = forest.admit(opened, nights.where(F.col("batch") == r.batch))
        cases = cut(cases)
        opened.add(accepted)
        found = cases if found is None else found.unionByName(cases)
    rows = found if found is not None else history.select(F.col("id").alias("accepted"), "id").where("false")
    return rows.select(F.col("accepted").alias("accepted_entry_id"), F.col("id").alias("entry_id"))


def p6_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of p6_found with the first_seen of the accepted entry."""
    standing = firstseen.standing(_body(spark, sf_dir), table(spark, sf_dir, "arrivals"), table(spark, sf_dir, "state"))
    return p6_found(spark, sf_dir).join(standing.withColumnRenamed("entry_id", "accepted_entry_id"), "accepted_entry_id", "left").select(
        "accepted_entry_id", "entry_id", "first_seen")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of every document, or of each part of one larger than the window, for each context."""
    return packing.pack_contexts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "contexts"))[0]


def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that p7_packing takes of each context, and how many any packing needs at least."""
    _, rows = packing.pack_contexts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "contexts"))
    return spark.createDataFrame(rows, "context_id int, capacity_tokens int, windows long, bound long, certified int, exchanges int")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leak_alignments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where(F.col("longest_run") >= leaks.RUN).select("doc_id", "item_id").distinct()


def p8_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items that share a seed, with the alignment: edited copies come out by their score."""
    return leaks.leak_alignments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_counts, p3_found, p3_terms, p4_found, p4_groups, p5_found, p5_groups, p6_found, p6_nightly, p6_first_seen, p7_packing, p7_bounds, p8_found, p8_alignments, p9_found)}
