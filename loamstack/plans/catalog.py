"""The queries of the library's own operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.functions import text as T
from loamstack.operators import ageing, duplicates, guards, pairs, squeeze, supersede
from loamstack.operators import themes as theming
from loamstack.operators.entries import content_size, stored
from loamstack.operators.filters import among
from loamstack.operators.writer import serialize
from loamstack.plans import pipeline
from loamstack.plans.options import Options
from loamstack.plans.sql import SQL
from loamstack.runtime import stage, table
from loamstack.sources import readers

AS_OF = datetime(2025, 12, 1)
MAX_AGE = 90

__all__ = ["QUERIES", "SQL"]

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return stored(table(spark, d, "entries"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return readers.with_format(table(spark, d, "files"))


def _first_copies(spark: SparkSession, d: str) -> DataFrame:
    return stage(duplicates.drop_exact(stored(table(spark, d, "entries"), filtered=True))[0])


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


# --- scalars ---------------------------------------------------------------

@query
def entry_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries").select("entry_id", "text").dropDuplicates(["entry_id"]).select(
        "entry_id", F.array_join(T.tokens("text"), " ").alias("tokens"))


@query
def entry_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entries").select("entry_id", "text").dropDuplicates(["entry_id"]).withColumn("toks", T.tokens("text"))
    return rows.select("entry_id", T.entry_id("text", "toks").alias("eid"))


@query
def subjects(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("file_id", "pos", F.array_join(T.subject("toks"), " ").alias("subject"))


@query
def previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.preview("text").alias("preview"))


@query
def sanitized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.sanitize("text").alias("shown"))


@query
def hard_cuts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.hard_cut("text", 120).alias("head"))


@query
def clauses(spark: SparkSession, d: str) -> DataFrame:
    """In how many clauses merging and trimming cut each entry."""
    return _entries(spark, d).select("file_id", "pos", F.size(T.clauses("text")).cast("long").alias("to_merge"),
                                     F.size(T.clauses_to_trim("text")).cast("long").alias("to_trim"))


# --- readers and writers ----------------------------------------------------

@query
def detected_formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", readers.detect_format("text").alias("format"))


@query
def parsed_files(spark: SparkSession, d: str) -> DataFrame:
    return readers.parse(table(spark, d, "files"))


@query
def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    return readers.parse(table(spark, d, "documents"), "doc_id", "text")


@query
def preambles(spark: SparkSession, d: str) -> DataFrame:
    return readers.preambles(table(spark, d, "files"))


@query
def content_sizes(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return content_size(_entries(spark, d).join(files.select("file_id"), "file_id", "left_semi"), files)


@query
def serialized(spark: SparkSession, d: str) -> DataFrame:
    return serialize(_entries(spark, d), _files(spark, d).select("file_id", "format", F.lit("").alias("preamble")))


# --- pairs and phases --------------------------------------------------------

@query
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_duplicates(table(spark, d, "entries"))


@query
def near_duplicate_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = pairs.near_duplicate_edges(_first_copies(spark, d))
    return _rounded(edges.select("file_id", "a", "b", F.col("shared").cast("long").alias("shared"), F.col("union").cast("long").alias("union"), "jaccard", "containment"))


@query
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_duplicates(stage(pairs.near_duplicate_edges(_first_copies(spark, d)))).drop("jaccard")


def _after_light(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.light(stage(stored(table(spark, d, "entries"), filtered=True)))[0]


@query
def subject_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = supersede.banded(pairs.subject_edges(_after_light(spark, d)))
    return _rounded(edges.select("file_id", "a", "b", "subject", "jaccard", "kind"))


def _deep(spark: SparkSession, d: str) -> DataFrame:
    left = _after_light(spark, d)
    return supersede.supersessions(stage(pairs.subject_edges(left)), left.select("file_id", "pos", "slot"))


@query
def superseded(spark: SparkSession, d: str) -> DataFrame:
    return _deep(spark, d).where("kind = 'superseded'").select("file_id", "slot_i", "slot_j", "old_pos", "new_pos")


@query
def conflict_flags(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.deep(_after_light(spark, d))[2]


@query
def aged_out(spark: SparkSession, d: str) -> DataFrame:
    return ageing.aged_out(_entries(spark, d), table(spark, d, "state"), Options(AS_OF).clock(), MAX_AGE)


@query
def state_upsert(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d).withColumn("slot", F.col("pos"))
    return ageing.upsert_state(entries, table(spark, d, "state"), Options(AS_OF).clock())


@query
def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return theming.document_frequency(_entries(spark, d))


@query
def themes(spark: SparkSession, d: str) -> DataFrame:
    return theming.themes(_entries(spark, d))


@query
def information_density(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(theming.information_density(_entries(spark, d)), 12)


@query
def first_victims(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(theming.first_victim(_entries(spark, d)), 12)


@query
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pairs.merge_edges(_first_copies(spark, d)).select("file_id", "a", "b", "jaccard"))


@query
def best_merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pairs.best_merge_pair(_first_copies(spark, d)))


@query
def merged_texts(spark: SparkSession, d: str) -> DataFrame:
    """What the best pair of each file would become."""
    entries = _first_copies(spark, d)
    best = stage(pairs.best_merge_pair(entries))
    ends = best.select("file_id", F.col("a").alias("pos")).unionAll(best.select("file_id", F.col("b").alias("pos")))
    text = entries.select("file_id", "pos", "text").where(among(ends, ["file_id", "pos"]))
    rows = best.join(text.select("file_id", F.col("pos").alias("a"), F.col("text").alias("x")), ["file_id", "a"]).join(
        text.select("file_id", F.col("pos").alias("b"), F.col("text").alias("y")), ["file_id", "b"])
    longer = F.length("x") >= F.length("y")
    rows = rows.select("file_id", "a", "b", F.when(longer, F.col("x")).otherwise(F.col("y")).alias("base"),
                       F.when(longer, F.col("y")).otherwise(F.col("x")).alias("other"))
    return rows.select("file_id", "a", "b", T.merge_texts("base", "other").alias("merged"))


@query
def over_budget(spark: SparkSession, d: str) -> DataFrame:
    return squeeze.over_budget(_entries(spark, d), _files(spark, d))


@query
def comparison_counts(spark: SparkSession, d: str) -> DataFrame:
    return guards.comparisons(_entries(spark, d))


@query
def squeezed(spark: SparkSession, d: str) -> DataFrame:
    """The budget alone, over all entries as they stand."""
    entries = _entries(spark, d).withColumn("slot", F.col("pos"))
    return squeeze.squeeze(entries, _files(spark, d))


# --- whole runs ---------------------------------------------------------------

def _plan(spark: SparkSession, d: str, budgets: bool = True) -> pipeline.Plan:
    files = _files(spark, d)
    if not budgets:
        files = files.withColumn("budget", F.lit(None).cast("int"))
    return pipeline.consolidate(stored(table(spark, d, "entries"), filtered=True), files, table(spark, d, "state"), Options(AS_OF, max_age=MAX_AGE if budgets else None))


@query
def removed_entries(spark: SparkSession, d: str) -> DataFrame:
    """What a run without age limit and budgets removes."""
    return _plan(spark, d, False).actions.select("file_id", "removed_pos", "kind")


@query
def kept_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, False).sizes.join(table(spark, d, "files").select("file_id"), "file_id", "left_semi").select(
        "file_id", F.col("entries_after").alias("entries"), F.col("size_after").alias("size"))


@query
def consolidated_actions(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).actions


@query
def consolidated_entries(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).kept.select("file_id", "pos", "text", "is_header", "eid")


@query
def consolidated_state(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).state


@query
def consolidated_reports(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.reports(_plan(spark, d), Options(AS_OF, max_age=MAX_AGE))


@query
def consolidated_transactions(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    files = files.join(readers.preambles(table(spark, d, "files")).select("file_id", "preamble"), "file_id")
    return pipeline.transactions(_plan(spark, d), files, Options(AS_OF, max_age=MAX_AGE)).select("file_id", "tx", "changed")


@query
def archive_records(spark: SparkSession, d: str) -> DataFrame:
    options = Options(AS_OF, max_age=MAX_AGE)
    return pipeline.archive_records(_plan(spark, d).actions, options.stamp())


@query
def consolidated_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a run without age limit and budgets would change, without writing it."""
    plan = _plan(spark, d, False)
    return pipeline.changes(plan.entries.select("file_id", "text"), plan.kept.select("file_id", "text"))


@query
def conserved(spark: SparkSession, d: str) -> DataFrame:
    """Entries that a run lost: none."""
    return pipeline.conservation(_plan(spark, d))


@query
def action_summary(spark: SparkSession, d: str) -> DataFrame:
    """Actions of earlier runs by phase and kind; repeated rows count once."""
    rows = table(spark, d, "actions").select("file_id", "seq", "phase", "kind", "removed").distinct()
    return rows.groupBy(F.lower("phase").alias("phase"), "kind").agg(F.count("*").alias("actions"), F.count("removed").alias("archived"))
