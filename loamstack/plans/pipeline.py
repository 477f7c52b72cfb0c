"""The phases one after the other: light, deep, age, themes, squeeze; and what a run reports and keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstack.functions import constants as K
from loamstack.functions import text as T
from loamstack.operators import ageing, duplicates, guards, pairs, squeeze, supersede, themes
from loamstack.operators.entries import content_size
from loamstack.operators.filters import among, without
from loamstack.operators.writer import serialize
from loamstack.plans.options import Options
from loamstack.runtime import remove, stage, staged

#: Order of the phases in seq; within a phase two numbers of 30 bits order the actions.
EXACT, NEAR, DEEP, AGE, SQUEEZE = range(1, 6)
ACTION_COLUMNS = ["file_id", "seq", "phase", "kind", "reason", "removed", "result", "removed_pos", "result_pos"]


def _seq(phase: int, first: Column, second: Column | None = None) -> Column:
    """A number that orders actions of a file; it has gaps."""
    second = F.lit(0) if second is None else second
    return (F.lit(phase).cast("long") * (1 << 60) + first.cast("long") * (1 << 30) + second.cast("long"))


def _reason(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@dataclass
class Plan:
    """A run over many files; every part is a DataFrame by file_id.

    removed: (file_id, pos) of all entries that went; kept: the entries that
    stay, by pos; actions: what was done and why; flags: pairs that may
    contradict each other; themes; state: the state after the run; sizes:
    entries and characters before and after.
    """

    entries: DataFrame
    kept: DataFrame
    actions: DataFrame
    flags: DataFrame
    themes: DataFrame
    state: DataFrame
    sizes: DataFrame
    refused: DataFrame


def light(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries left with their slot, actions) of the exact and the near pass.

    ``entries`` must be cheap to read several times; what is left is read from
    them behind a filter and is no copy.
    """
    text = entries.select("file_id", "pos", "text")
    left, exact = duplicates.drop_exact(entries)
    edges, path = staged(pairs.near_duplicate_edges(left))
    near = stage(duplicates.near_duplicates(edges))
    remove(entries.sparkSession, path)
    after = duplicates.after_near(duplicates.named(entries), near, exact.select("file_id", F.col("removed_pos").alias("pos")))
    rows = exact.select("file_id", _seq(EXACT, F.col("removed_pos")).alias("seq"), F.lit("exact-duplicate").alias("kind"),
                        F.lit("same content after normalization; the first copy stays").alias("reason"), "removed_pos", "kept_pos")
    rows = rows.unionByName(near.select(
        "file_id", _seq(NEAR, F.col("at_pos")).alias("seq"), F.lit("near-duplicate").alias("kind"),
        _reason("the same fact in other words (", T.percent("jaccard"), "% of the tokens shared); the fuller wording stays").alias("reason"),
        "removed_pos", "kept_pos"))
    return after, _with_texts(rows, text, "light")


def _with_texts(rows: DataFrame, text: DataFrame, phase: str) -> DataFrame:
    """Actions (file_id, seq, kind, reason, removed_pos, kept_pos), read several times, with both texts; no other text is shuffled."""
    ends = rows.select("file_id", F.col("removed_pos").alias("pos")).unionAll(rows.select("file_id", F.col("kept_pos").alias("pos")))
    text = text.where(among(ends, ["file_id", "pos"]))
    a = text.select("file_id", F.col("pos").alias("removed_pos"), F.col("text").alias("removed"))
    b = text.select("file_id", F.col("pos").alias("kept_pos"), F.col("text").alias("result"))
    return rows.join(a, ["file_id", "removed_pos"]).join(b, ["file_id", "kept_pos"]).select(
        "file_id", "seq", F.lit(phase).alias("phase"), "kind", "reason", "removed", "result", "removed_pos", F.col("kept_pos").alias("result_pos"))


def deep(entries: DataFrame, text: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries left, actions, flags) of supersession; actions take their texts from ``text``, or else from the entries."""
    edges, path = staged(supersede.banded(pairs.subject_edges(entries)))
    found = stage(supersede.supersessions(edges, entries.select("file_id", "pos", "slot")))
    remove(entries.sparkSession, path)
    gone = found.where("kind = 'superseded'")
    rows = gone.select(
        "file_id", _seq(DEEP, F.col("slot_i"), F.col("slot_j")).alias("seq"), "kind",
        _reason("the subject comes again later in the file (", T.percent("subject"), "% of the subject, ", T.percent("body"),
                "% of the body); the newer statement stays").alias("reason"),
        F.col("old_pos").alias("removed_pos"), F.col("new_pos").alias("kept_pos"))
    text = (entries if text is None else text).select("file_id", "pos", "text")
    left = without(entries, gone.select("file_id", F.col("old_pos").alias("pos")), ["file_id", "pos"])
    other = F.when(F.col("pos_i") == F.col("old_pos"), F.col("new_pos")).otherwise(F.col("old_pos"))
    flags = found.where("kind = 'conflict'").select("file_id", "slot_i", "slot_j", F.col("pos_i").alias("pos_a"), other.alias("pos_b"))
    return left, _with_texts(rows, text, "deep"), flags


def age(entries: DataFrame, state: DataFrame, options: Options, text: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries left, actions) of ageing; actions take their texts from ``text``, or else from the entries."""
    gone = ageing.aged_out(entries, state, options.clock(), options.max_age)
    gone = stage(gone.join(entries.select("file_id", "pos", "slot"), ["file_id", "pos"]))
    rows = gone.join((entries if text is None else text).select("file_id", "pos", "text"), ["file_id", "pos"])
    actions = rows.select(
        "file_id", _seq(AGE, F.col("slot")).alias("seq"), F.lit("deep").alias("phase"), F.lit("aged-out").alias("kind"),
        _reason("first seen ", F.col("age").cast("string"), f" days ago (limit {options.max_age})").alias("reason"),
        F.col("text").alias("removed"), F.lit(None).cast("string").alias("result"),
        F.col("pos").alias("removed_pos"), F.lit(None).cast("int").alias("result_pos"))
    return without(entries, gone.select("file_id", "pos"), ["file_id", "pos"]), actions


_REASONS = {
    "archived-for-budget": "still over budget; of all entries this one says the least that no other says",
    "trimmed-tail-clauses": "the last entry is larger than the budget; the clauses that do not fit are archived",
    "hard-truncated": "no clause of the last entry fits the budget; cut at a word",
}


def shrink(entries: DataFrame, files: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(entries left, actions) of the budget."""
    out = stage(squeeze.squeeze(entries, files, options.merge))
    reason = F.when(F.col("kind") == "merged", _reason(
        "over budget; two related entries (", T.percent("overlap"), "% of the tokens shared) made one, every new clause kept"))
    for kind, said in _REASONS.items():
        reason = reason.when(F.col("kind") == kind, said)
    actions = out.where("kind <> 'entry'").select(
        "file_id", _seq(SQUEEZE, F.col("seq")).alias("seq"), F.lit("squeeze").alias("phase"), "kind", reason.alias("reason"), "removed", "result",
        F.lit(None).cast("int").alias("removed_pos"), F.lit(None).cast("int").alias("result_pos"))
    shrunk = squeeze.over_budget(entries, files).select("file_id")
    rest = entries.join(shrunk, "file_id", "left_anti").select("file_id", "pos", "slot", "text", "is_header", "toks", "eid")
    new = (out.where("kind = 'entry'").withColumn("toks", T.tokens("text")).withColumn("eid", T.entry_id("text", "toks"))
           .select("file_id", "pos", F.col("place").alias("slot"), "text", "is_header", "toks", "eid"))
    return rest.unionByName(new), actions


def consolidate(entries: DataFrame, files: DataFrame, state: DataFrame, options: Options) -> Plan:
    """All phases over all files; nothing is written beyond the cuts.

    ``entries`` are analyzed (file_id, pos, text, is_header, toks, eid), each
    once; ``files`` gives (file_id, format, budget), formats already decided.
    Files without entries, and files refused for more than
    options.max_entries or max_comparisons, take no part; the latter are listed.
    """
    entries = entries.select("file_id", "pos", "text", "is_header", "toks", "eid")
    files = files.select("file_id", F.coalesce(F.lit(options.format), "format").alias("format"),
                         F.coalesce("budget", F.lit(options.budget)).cast("int").alias("budget"))
    limited = options.max_entries or options.max_comparisons
    refused = guards.refused(entries, options.max_entries, options.max_comparisons, options.supersede) if limited else entries.where("false").select(
        "file_id", F.lit(0).cast("long").alias("entries"), F.lit("").alias("reason"))
    if limited:
        entries = entries.join(refused, "file_id", "left_anti")
    entries = stage(entries)
    left, light_actions = light(entries)
    flags, deep_actions = None, None
    if options.supersede:
        left, deep_actions, flags = deep(left, entries)
    left, age_actions = age(left, state, options, entries)
    left = stage(left)
    found = themes.themes(left)
    kept, squeeze_actions = shrink(left, files, options)
    kept = stage(kept)
    actions = light_actions
    for more in (deep_actions, age_actions, squeeze_actions):
        if more is not None:
            actions = actions.unionByName(more)
    if flags is None:
        flags = entries.where("false").select("file_id", F.col("pos").alias("slot_i"), F.col("pos").alias("slot_j"), F.col("pos").alias("pos_a"), F.col("pos").alias("pos_b"))
    before = content_size(entries, files).select("file_id", F.col("entries").alias("entries_before"), F.col("size").alias("size_before"))
    after = content_size(kept, files).select("file_id", F.col("entries").alias("entries_after"), F.col("size").alias("size_after"))
    sizes = before.join(after, "file_id", "left").join(files.select("file_id", "budget"), "file_id", "left").select(
        "file_id", "entries_before", F.coalesce("entries_after", F.lit(0)).alias("entries_after"),
        "size_before", F.coalesce("size_after", F.lit(0)).alias("size_after"), "budget")
    return Plan(entries, kept, stage(actions.select(*ACTION_COLUMNS)), flags, found,
                ageing.upsert_state(kept, state, options.clock()), sizes, refused)


def action_text() -> Column:
    """One action as lines of a report."""
    def part(label: str, column: str) -> Column:
        some = F.col(column).isNotNull() & (F.col(column) != "")
        return F.when(some, F.concat(F.lit(f"\n    {label}: "), T.preview(column, 100))).otherwise("")
    return F.concat(F.lit("["), "phase", F.lit("] "), "kind", F.lit(" — "), "reason", part("archived", "removed"), part("kept/now", "result"))


def reports(plan: Plan, options: Options, max_bytes: int = K.MAX_JOURNAL_BYTES) -> DataFrame:
    """(file_id, bytes, report): the report of each file, null where it would be larger than ``max_bytes``.

    The lines are summed up first, and only those of files within the limit
    are gathered, so that a report bounds its task.
    """
    s = plan.sizes
    head = F.concat(F.lit(f"## consolidation — {options.stamp()} — "), "file_id", F.lit("\n\n- entries: "), F.col("entries_before").cast("string"), F.lit(" -> "),
                    F.col("entries_after").cast("string"), F.lit(" | chars: "), F.col("size_before").cast("string"), F.lit(" -> "),
                    F.col("size_after").cast("string"), F.when(F.col("budget") > 0, F.concat(F.lit(" | budget: "), F.col("budget").cast("string"))).otherwise(""))
    rows = s.select("file_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), head.alias("line"))
    done = plan.actions.select("file_id", F.lit(2).alias("part"), F.col("seq").alias("at"),
                               F.concat(F.lit("- "), F.regexp_replace(action_text(), "\n", "\n  ")).alias("line"))
    busy = plan.actions.groupBy("file_id").agg(F.first(F.lit(True)).alias("busy"))
    opener = s.select("file_id").join(busy, "file_id", "left").select(
        "file_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), F.when(F.col("busy"), "").otherwise(
            "- nothing to do: no duplicates and nothing superseded.").alias("line"))
    text = plan.entries.select("file_id", "pos", T.preview("text", 100).alias("t"))
    f = plan.flags.join(text.select("file_id", F.col("pos").alias("pos_a"), F.col("t").alias("ta")), ["file_id", "pos_a"]).join(
        text.select("file_id", F.col("pos").alias("pos_b"), F.col("t").alias("tb")), ["file_id", "pos_b"])
    flags = f.select("file_id", F.lit(4).alias("part"), _seq(0, F.col("slot_i"), F.col("slot_j")).alias("at"), F.concat(
        F.lit("- possible conflict, not resolved: too little in common\n      a: "), "ta", F.lit("\n      b: "), "tb").alias("line"))
    flag_head = plan.flags.select("file_id").distinct().select("file_id", F.lit(3).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("\n### flags (no action taken)").alias("line"))
    named = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token", "n"))), lambda x: F.concat(
        x["token"], F.lit(" (x"), x["n"].cast("string"), F.lit(")"))), ", ")
    theme = plan.themes.groupBy("file_id").agg(named.alias("t")).select(  # at most THEMES_SHOWN rows a file
        "file_id", F.lit(5).alias("part"), F.lit(0).cast("long").alias("at"), F.concat(F.lit("\n### recurring themes\n- "), "t").alias("line"))
    rows = stage(rows.unionByName(opener).unionByName(done).unionByName(flag_head).unionByName(flags).unionByName(theme))
    sums = rows.groupBy("file_id").agg((F.sum(F.octet_length("line") + 1) - 1).alias("bytes"))
    fits = sums.where(F.col("bytes") <= max_bytes).select("file_id")
    texts = rows.join(fits, "file_id", "left_semi").groupBy("file_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("part", "at", "line")))["line"], "\n").alias("report"))
    return sums.join(texts, "file_id", "left").select("file_id", "bytes", "report")


def archive_records(actions: DataFrame, stamp: str) -> DataFrame:
    """(file_id, seq, record): one record for every action that removed something."""
    record = F.concat(F.lit(f"## {stamp} — "), "kind", F.lit(" ("), "reason", F.lit(")\n\n"), "removed", F.lit("\n"))
    return actions.where("removed <> ''").select("file_id", "seq", record.alias("record"))


def transactions(plan: Plan, files: DataFrame, options: Options) -> DataFrame:
    """(file_id, tx, changed, original, new_text): the run of each file as a transaction, named by its content.

    ``files`` gives (file_id, format, content, preamble).  The name is made of the old and the new text,
    the report and digests of the archive records, so the same run has the
    same name and a repeated write is recognised.  Files too large for one
    text have a null new_text and no transaction.
    """
    new = serialize(plan.kept, files).select("file_id", F.col("text").alias("new_text"))
    # order-free digest of the records: sums combine on the map side, so no archive is gathered
    arch = archive_records(plan.actions, options.stamp()).groupBy("file_id").agg(
        F.sum(F.xxhash64("seq", "record").cast("decimal(38,0)")).cast("string").alias("archive"))
    rep = reports(plan, options).select("file_id", "report")
    rows = (files.select("file_id", F.col("content").alias("original"), "format", "preamble").join(plan.sizes.select("file_id", "entries_after"), "file_id")
            .join(new, "file_id", "left").join(rep, "file_id", "left").join(arch, "file_id", "left"))
    empty = F.when(F.col("format") == "sections", "").when(F.col("preamble") != "", F.concat("preamble", F.lit("\n\n\n"))).otherwise("\n")
    rows = rows.withColumn("new_text", F.when(F.col("entries_after") == 0, empty).otherwise(F.col("new_text")))
    return rows.select("file_id", T.content_digest("original", "new_text", "archive", "report").alias("tx"),
                       (T.strip("new_text") != T.strip("original")).alias("changed"), "original", "new_text", "report")


def conservation(plan: Plan) -> DataFrame:
    """(file_id, pos): entries that are neither kept nor archived nor merged into another; none if all is well."""
    kept = plan.kept.select("file_id", F.md5("text").alias("h"))
    gone = plan.actions.where("removed is not null").select("file_id", F.md5("removed").alias("h"))
    merged = plan.actions.where("phase = 'squeeze'").select("file_id").distinct()
    held = kept.unionByName(gone).distinct()
    lost = plan.entries.withColumn("h", F.md5("text")).join(held, ["file_id", "h"], "left_anti")
    return lost.join(merged, "file_id", "left_anti").select("file_id", "pos")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, line, change, times): entries that a run takes out (``-``) or puts in (``+``), and how often; a dry run's difference.

    Texts of (file_id, text) rows are compared as multisets.
    """
    def counted(df: DataFrame, sign: int) -> DataFrame:
        return df.groupBy("file_id", "text").agg((F.count("*") * sign).alias("n"))
    both = counted(before, -1).unionByName(counted(after, 1)).groupBy("file_id", "text").agg(F.sum("n").alias("n")).where("n <> 0")
    return both.select("file_id", F.col("text").alias("line"), F.when(F.col("n") > 0, "+").otherwise("-").alias("change"), F.abs("n").alias("times"))
