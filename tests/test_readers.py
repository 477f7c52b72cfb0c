from loamstack.operators.entries import analyze, content_size
from loamstack.operators.writer import serialize, serialize_lines
from loamstack.sources import readers
from loamstack.sources.state import latest_state, parse_state
from loamstack.sources.texts import read_files

FILES = {
    "sections": ("first entry\n§\nsecond entry\nwith a line\n§\n \n§\nthird", None),
    "lone": ("§", None),
    "loose": ("a\n§ \nb", None),
    "crlf": ("a\r\n§\r\nb", None),
    "bullets": ("# Title\n\n- one\n  more\n\n- two\n## Part\nstray text\n* three\n- # four", None),
    "paragraphs": ("# Title\n\nblock one\nline two\n \n\nblock two\n", None),
    "hashes": ("# only\n## headings", None),
    "blank": (" \n\n", None),
    "null": (None, None),
    "told": ("a\n\nb", "sections"),
    "odd": ("- a\n- b", "auto"),
}


def frame(spark):
    return spark.createDataFrame([(k, t, f, 1) for k, (t, f) in FILES.items()], "file_id string, content string, format string, pos int")


def parsed(spark):
    out = {}
    for r in sorted(readers.parse(frame(spark)).collect(), key=lambda r: (r.file_id, r.pos)):
        out.setdefault(r.file_id, []).append((r.pos, r.text, r.is_header))
    return out


def test_formats(spark):
    got = {r.file_id: r.format for r in readers.with_format(frame(spark)).collect()}
    assert got == {"sections": "sections", "lone": "sections", "loose": "sections", "crlf": "paragraphs", "bullets": "bullets", "paragraphs": "paragraphs",
                   "hashes": "paragraphs", "blank": "paragraphs", "null": "paragraphs", "told": "sections", "odd": "bullets"}


def test_entries(spark):
    got = parsed(spark)
    assert got["sections"] == [(0, "first entry", False), (1, "second entry\nwith a line", False), (2, "third", False)]
    assert got["lone"] == [(0, "§", False)]
    assert got["loose"] == [(0, "a\n§ \nb", False)]  # the delimiter is detected but does not split
    assert got["bullets"] == [(0, "- one\n  more", False), (1, "- two", False), (2, "## Part", True), (3, "* three", False), (4, "- # four", False)]
    assert got["paragraphs"] == [(0, "block one\nline two", False), (1, "block two", False)]
    assert got["told"] == [(0, "a\n\nb", False)]
    assert not {"blank", "null", "hashes"} & set(got)


def test_preambles(spark):
    got = {r.file_id: r.preamble for r in readers.preambles(frame(spark)).collect()}
    assert got["bullets"] == "# Title\n\nstray text"
    assert got["paragraphs"] == "# Title"
    assert got["hashes"] == "# only\n## headings"
    assert got["sections"] == ""


def test_round_trip_and_sizes(spark):
    files = readers.preambles(frame(spark))
    entries = readers.parse(frame(spark))
    texts = {r.file_id: r.text for r in serialize(entries, files).collect()}
    assert texts["paragraphs"] == "# Title\n\nblock one\nline two\n\nblock two\n"
    assert texts["sections"] == "first entry\n§\nsecond entry\nwith a line\n§\nthird"
    again = spark.createDataFrame([(k, t, None) for k, t in texts.items()], "file_id string, content string, format string")
    kinds = ["sections", "bullets", "paragraphs"]
    assert sorted(readers.parse(again).where(readers.F.col("file_id").isin(kinds)).select("file_id", "pos", "text").collect()) == sorted(
        entries.where(readers.F.col("file_id").isin(kinds)).select("file_id", "pos", "text").collect())
    pieces = {}
    for r in sorted(serialize_lines(entries, files).collect(), key=lambda r: (r.file_id, r.pos)):
        pieces[r.file_id] = pieces.get(r.file_id, "") + r.piece
    assert pieces == texts
    sizes = {r.file_id: r["size"] for r in content_size(entries, files).collect()}
    assert sizes["sections"] == len(texts["sections"])
    assert sizes["paragraphs"] == len("block one\nline two") + len("block two") + 1


def test_oversized_files_are_refused_and_not_gathered(spark):
    r = serialize(readers.parse(frame(spark)), readers.preambles(frame(spark)), 10)
    assert {x.file_id for x in r.where("text is null").collect()} >= {"sections", "bullets"}


def test_read_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("- x\n- y")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.md").write_text("z" * 100)
    got = {r.file_id.rsplit("/", 1)[1]: (r.content, r.problem) for r in read_files(spark, str(tmp_path), 50).collect()}
    assert got == {"a.md": ("- x\n- y", None), "b.md": (None, "not utf-8"), "c.md": (None, "too large")}


def test_state_repairs(spark):
    raw = '{"a":{"first_seen":"2025-01-02T03:04:05","last_seen":"x","runs_seen":4,"preview":"p"},"b":{"first_seen":7,"runs_seen":-1},"c":5,"d":{"runs_seen":"9"}}'
    files = spark.createDataFrame([("f", raw), ("g", "[1]"), ("h", ""), ("i", None)], "file_id string, state string")
    got = {r.eid: (str(r.first_seen), r.last_seen, r.runs_seen, r.preview) for r in parse_state(files).collect()}
    assert got["a"] == ("2025-01-02 03:04:05", None, 4, "p")
    assert {k: v[2] for k, v in got.items()} == {"a": 4, "b": 0, "c": 0, "d": 0}


def test_latest_state_takes_the_last_row(spark):
    rows = [("f", "e", None, "2025-01-01 00:00:00", 1, "a"), ("f", "e", "2024-01-01 00:00:00", "2025-02-01 00:00:00", 2, "b"),
            ("f", "e", "2024-01-01 00:00:00", "2025-02-01 00:00:00", 2, "b"), ("f", "e", "2023-01-01 00:00:00", None, 9, "c"), (None, "e", None, None, 1, "x")]
    df = spark.createDataFrame(rows, "file_id string, eid string, first_seen string, last_seen string, runs_seen int, preview string")
    df = df.withColumn("first_seen", readers.F.col("first_seen").cast("timestamp_ntz")).withColumn("last_seen", readers.F.col("last_seen").cast("timestamp_ntz"))
    got = latest_state(df).collect()
    assert len(got) == 1 and got[0].preview == "b"


def test_empty_tables(spark):
    none = frame(spark).where("false")
    assert readers.parse(none).count() == readers.preambles(none).count() == 0
    assert analyze(readers.parse(none)).count() == 0
