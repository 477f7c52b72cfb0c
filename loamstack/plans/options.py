"""What a run is told."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    """Options of a run.

    as_of is the only clock; budget, where given, holds for files without one
    of their own; max_entries and max_comparisons refuse
    larger files (null: none); supersede and
    merge switch phases off.
    """

    as_of: datetime
    budget: int | None = None
    format: str | None = None
    max_age: int | None = None
    merge: bool = True
    supersede: bool = True
    max_entries: int | None = None
    max_comparisons: int | None = None

    def clock(self) -> Column:
        return F.lit(self.as_of.isoformat(sep=" ")).cast("timestamp_ntz")

    def stamp(self) -> str:
        return self.as_of.strftime("%Y-%m-%d %H:%M")
