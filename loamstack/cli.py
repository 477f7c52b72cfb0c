"""Consolidates single files from the command line."""

from __future__ import annotations

import difflib
import os
import re
import sys
from dataclasses import replace as with_changes
from datetime import datetime
from pathlib import Path

from loamstack.functions import constants as K
from loamstack.plans.options import Options

VERSION = "0.2.0"
USAGE = """usage: python -m loamstack [options] FILE...

A dry run shows the report and the changes; --apply writes them.

  --apply          write, with backup, archive, journal and state
  --profile        the files of the profile folder (LOAM_HOME, else ~/.loam)
  --budget N       characters a file may have
  --max-age D      archive entries first seen more than D days ago
  --format F       auto, sections, bullets or paragraphs
  --no-merge       no merging for the budget
  --no-supersede   no supersession
  --quiet          one line per file
  -h, --help       this text
  -v, --version    the version"""

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f‪-‮⁦-⁩\ud800-\udfff]")


class Usage(ValueError):
    """The command line cannot be understood."""


def show(text: object, file=None) -> None:
    print(_CONTROL.sub("", str(text)), file=file)


def parse_arguments(argv: list[str], as_of: datetime) -> tuple[Options, dict, list[str]]:
    """(options, flags, files); flags: apply, quiet, profile."""
    given: dict = {}
    flags = {"apply": False, "quiet": False, "profile": False}
    files: list[str] = []
    rest = iter(argv)
    for a in rest:
        if a[2:] in flags and a.startswith("--"):
            flags[a[2:]] = True
        elif a in ("--no-merge", "--no-supersede"):
            given[a[5:]] = False
        elif a in ("--budget", "--max-age"):
            value = next(rest, None)
            if value is None or not re.fullmatch(r"\+?\d+", value) or int(value) <= 0:
                raise Usage(f"{a} needs a positive whole number")
            given[a[2:].replace("-", "_")] = int(value)
        elif a == "--format":
            value = next(rest, None)
            if value not in (*K.FORMATS, "auto"):
                raise Usage("--format needs auto, sections, bullets or paragraphs")
            given["format"] = None if value == "auto" else value
        elif a.startswith("-"):
            raise Usage(f"unknown option {a}")
        else:
            files.append(a)
    if not files and not flags["profile"]:
        raise Usage("no file")
    return Options(as_of, **given), flags, files


def plan_file(spark, target: Path, options: Options):
    """(transaction, sizes) of a run over one local file; (None, None) if it has no entries."""
    from pyspark.sql import functions as F

    from loamstack.operators.entries import analyze
    from loamstack.plans import pipeline
    from loamstack.sinks.local import Transaction, side_files
    from loamstack.sources import readers
    from loamstack.sources.local import read_text
    from loamstack.sources.state import parse_state, state_json

    text, _ = read_text(target)
    raw, _ = read_text(side_files(target)["state"], K.MAX_SIDE_BYTES)
    name = target.name
    files = spark.createDataFrame([(name, text, options.format, options.budget, raw)], "file_id string, content string, format string, budget int, state string")
    files = readers.with_format(files)
    parsed = readers.parse(files)
    if parsed.isEmpty():
        return None, None
    files = files.join(readers.preambles(files).select("file_id", "preamble"), "file_id")
    plan = pipeline.consolidate(analyze(parsed), files, parse_state(files), with_changes(options, format=None, max_entries=options.max_entries or K.MAX_ENTRIES))
    sizes = plan.sizes.first()
    if sizes is None:
        raise ValueError(f"{name} has more than {K.MAX_ENTRIES} entries")
    row = pipeline.transactions(plan, files, options).first()
    if row["report"] is None:
        raise ValueError(f"the report of {name} is larger than {K.MAX_JOURNAL_BYTES} bytes")
    records = pipeline.archive_records(plan.actions, options.stamp()).orderBy("seq").collect()  # one file, bounded by its size limit
    state = state_json(plan.state).first()
    archive = "\n".join(r["record"] for r in records)
    tx = Transaction(name, options.stamp(), text, row["new_text"], archive, row["report"], raw, state["state"] if state else "{}")
    return tx, sizes


def consolidate_file(spark, target: str | Path, options: Options, apply: bool = False, quiet: bool = False) -> int:
    """One run over one local file: 0 if it went well, 1 if the file is refused."""
    from loamstack.sinks import local

    target = Path(os.path.abspath(target))
    try:
        if not os.path.lexists(target):
            raise FileNotFoundError(f"{target} does not exist")
        if not apply:
            tx, sizes = plan_file(spark, target, options)
            return _preview(target, tx, sizes, quiet)
        with local.folder_lock(local.side_files(target)["lock"]):
            local.recover(target)
            tx, sizes = plan_file(spark, target, options)
            if tx is None:
                show(f"{target.name}: no entries, nothing to do")
            elif tx.new_text.strip() == tx.original.strip():
                local.apply_unchanged(target, tx)
                show(f"{target.name}: clean, nothing to change")
            else:
                local.apply(target, tx)
                show(_sizes(target, sizes))
                if not quiet:
                    show(f"  backup: {tx.backup}")
        return 0
    except (OSError, ValueError) as e:
        show(f"error: {e}", sys.stderr)
        return 1


def _sizes(target: Path, s) -> str:
    return f"{target.name}: {s['entries_before']} -> {s['entries_after']} entries, {s['size_before']} -> {s['size_after']} chars"


def _preview(target: Path, tx, sizes, quiet: bool) -> int:
    if tx is None:
        show(f"{target.name}: no entries, nothing to do")
    elif quiet:
        show(f"{_sizes(target, sizes)} (dry run)")
    else:
        show(tx.report)
        changes = list(difflib.unified_diff(tx.original.splitlines(), tx.new_text.splitlines(), target.name, f"{target.name} (consolidated)", lineterm=""))
        for line in changes:
            show(line)
        show("dry run, nothing written" if changes else "no changes needed")
    return 0


def main(argv: list[str] | None = None, spark=None, as_of: datetime | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0] in ("-h", "--help", "help"):
        show(USAGE)
        return 0
    if argv[0] in ("-v", "--version", "version"):
        show(VERSION)
        return 0
    try:
        options, flags, files = parse_arguments(argv, as_of or datetime.now())
    except Usage as e:
        show(f"error: {e}", sys.stderr)
        return 2
    runs = [(f, options) for f in files]
    if flags["profile"]:
        from loamstack.sources.local import profile_targets

        home = Path(os.environ.get("LOAM_HOME") or Path.home() / ".loam")
        found = profile_targets(home)
        if not found:
            show(f"error: nothing in {home / 'memories'}", sys.stderr)
            return 1
        runs = [(p, with_changes(options, budget=options.budget or budget, format=options.format or "sections")) for p, budget in found] + runs
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    return max(consolidate_file(spark, f, o, flags["apply"], flags["quiet"]) for f, o in runs)
