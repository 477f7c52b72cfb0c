"""The state of earlier runs: from JSON or a table, once per (file_id, eid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstack.functions.text import _c

_RAW = "map<string,string>"


def _field(value: Column, name: str) -> Column:
    """A field of a JSON object as JSON text; null if the value is no object."""
    return F.from_json(value, _RAW)[name]


def parse_state(files: DataFrame, json_col: str = "state", id_col: str = "file_id") -> DataFrame:
    """(file_id, eid, first_seen, last_seen, runs_seen, preview) of one JSON object per file.

    Anything malformed is repaired field by field: a state that is no object
    has no rows, a time that is no ISO time is null, a count that is not a
    whole number of 0 or more is 0.
    """
    rows = files.select(id_col, F.explode(F.from_json(_c(json_col), _RAW)).alias("eid", "value"))
    count = F.regexp_extract(F.get_json_object("value", "$.runs_seen"), r"^\d{1,9}$", 0)
    quoted = F.col("value").rlike(r'"runs_seen"\s*:\s*"')

    def time(name: str) -> Column:
        return F.try_to_timestamp(_field(F.col("value"), name)).cast("timestamp_ntz")

    return rows.select(
        id_col, "eid", time("first_seen").alias("first_seen"), time("last_seen").alias("last_seen"),
        F.when((count != "") & ~quoted, count.cast("int")).otherwise(0).alias("runs_seen"),
        F.get_json_object("value", "$.preview").alias("preview"))


def latest_state(state: DataFrame) -> DataFrame:
    """One row per (file_id, eid), the one of the latest last_seen.

    Repeated rows count once; of rows with one last_seen (null comes first)
    the one with more runs, then the earlier first_seen, then the larger
    preview stands.  Rows without a file_id or eid name nothing and go.
    A single aggregation with a map-side combine; no row is gathered.
    """
    earliest_wins = -F.unix_micros(F.col("first_seen").cast("timestamp"))
    best = F.max_by(F.struct("first_seen", "last_seen", "runs_seen", "preview"),
                    F.struct(F.col("last_seen"), F.col("runs_seen"), earliest_wins, F.col("preview")))
    return (state.where("file_id is not null and eid is not null").groupBy("file_id", "eid").agg(best.alias("s"))
            .select("file_id", "eid", "s.*"))


def state_json(state: DataFrame) -> DataFrame:
    """(file_id, state): one JSON object per file, entries by eid; times in ISO seconds.

    A file's state is one text, as its readers expect; it is no larger than
    the entries of the file, which are bounded by its size limit.
    """
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    value = F.struct(F.date_format("first_seen", iso).alias("first_seen"), F.date_format("last_seen", iso).alias("last_seen"),
                     F.col("runs_seen"), F.col("preview"))
    packed = F.sort_array(F.collect_list(F.struct(F.col("eid"), value.alias("v"))))
    return state.groupBy("file_id").agg(F.to_json(F.map_from_entries(packed)).alias("state"))
