import os
from datetime import datetime

import pytest
from loamstack import cli
from loamstack.sinks import local
from loamstack.sinks.tables import append_once, commit_contents, retain
from loamstack.sources.local import Refused, profile_budgets, profile_targets, read_text

NOW = datetime(2025, 6, 1, 12, 0)
TEXT = "Deploys use blue green rollout\n§\ndeploys use blue green rollout\n§\nTeam meets on Friday"


def tx(target, **changes):
    values = {"target": target.name, "stamp": "2025-06-01 12:00", "original": "old", "new_text": "new", "archive": "gone", "report": "did", "state_before": "", "state_after": "{}"}
    return local.Transaction(**(values | changes))


def test_apply_and_repeat(tmp_path):
    t = tmp_path / "m.md"
    t.write_text("old")
    os.chmod(t, 0o640)
    local.apply(t, tx(t))
    side = local.side_files(t)
    assert t.read_text() == "new" and os.stat(t).st_mode & 0o777 == 0o640
    assert "gone" in side["archive"].read_text() and "did" in side["journal"].read_text() and side["state"].read_text() == "{}"
    assert not side["pending"].exists() and (tmp_path / tx(t).backup).read_text() == "old"
    before = {p: p.read_bytes() for p in tmp_path.iterdir()}
    local.replace(side["pending"], tx(t).to_json(), None)
    assert local.recover(t) and {p: p.read_bytes() for p in tmp_path.iterdir()} == before


@pytest.mark.parametrize("step", ["archive", "target", "journal", "state"])
def test_crash_after_each_step_is_finished_later(tmp_path, monkeypatch, step):
    t = tmp_path / "m.md"
    t.write_text("old")
    real, side = local.replace, local.side_files(t)

    def failing(path, *rest):
        if path == (t if step == "target" else side[step]):
            raise OSError("lost")
        real(path, *rest)

    monkeypatch.setattr(local, "replace", failing)
    with pytest.raises(OSError):
        local.apply(t, tx(t))
    if t.read_text() == "new":
        assert "gone" in side["archive"].read_text()
    monkeypatch.setattr(local, "replace", real)
    assert local.recover(t) and not local.recover(t)
    assert t.read_text() == "new" and side["journal"].read_text().count("loam-tx") == 1


def test_outside_change_is_not_overwritten(tmp_path):
    t = tmp_path / "m.md"
    t.write_text("someone else's")
    with pytest.raises(Refused):
        local.apply(t, tx(t))
    assert t.read_text() == "someone else's"


def test_changed_or_foreign_transactions_are_refused(tmp_path):
    t = tmp_path / "m.md"
    good = tx(t).to_json()
    for bad in (good.replace('"new"', '"bad"'), good.replace('"version": 1', '"version": 2'), "{}", "[", good.replace("m.md", "n.md")):
        with pytest.raises(Refused):
            local.Transaction.from_json(bad, t.name)
    assert local.Transaction.from_json(good, t.name).tx == tx(t).tx


def test_links_pipes_and_limits_are_refused(tmp_path):
    (tmp_path / "a").write_text("x" * 20)
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.mkfifo(tmp_path / "pipe")
    os.link(tmp_path / "a", tmp_path / "twin")
    for name in ("link", "pipe", "twin", "a"):
        with pytest.raises(Refused):
            read_text(tmp_path / name)
    os.unlink(tmp_path / "twin")
    with pytest.raises(Refused):
        read_text(tmp_path / "a", 10)
    (tmp_path / "b").write_bytes(b"\xff")
    with pytest.raises(Refused):
        read_text(tmp_path / "b")
    assert read_text(tmp_path / "none") == ("", None)


def test_journal_rotates_and_archive_does_not(tmp_path):
    p = tmp_path / "j"
    local.append_once(p, "journal", "1", "x" * 60, 120, rotate=True)
    local.append_once(p, "journal", "2", "y" * 60, 120, rotate=True)
    assert "rotated" in p.read_text() and "x" not in p.read_text().replace("tx", "")
    q = tmp_path / "a"
    local.append_once(q, "archive", "1", "x" * 60, 120)
    with pytest.raises(Refused):
        local.append_once(q, "archive", "2", "y" * 60, 120)


def test_lock(tmp_path):
    with local.folder_lock(tmp_path / "l"), pytest.raises(Refused), local.folder_lock(tmp_path / "l", 0.1):
        pass


def test_profile(tmp_path):
    assert profile_budgets("memory_char_limit: 99\n") == {"MEMORY.md": 99, "USER.md": 1375}
    (tmp_path / "memories").mkdir()
    (tmp_path / "memories" / "USER.md").write_text("x")
    assert [(p.name, b) for p, b in profile_targets(tmp_path)] == [("USER.md", 1375)]


def test_tables_append_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    a = spark.createDataFrame([("f", "t1"), ("g", "t2")], "file_id string, tx string")
    append_once(a, path, "001")
    append_once(a, path, "001")
    append_once(a.unionByName(spark.createDataFrame([("h", "t3")], "file_id string, tx string")), path, "002")
    rows = spark.read.parquet(path)
    assert sorted(r.tx for r in rows.collect()) == ["t1", "t2", "t3"]
    assert [r.tx for r in retain(path, rows, 1).collect()] == ["t3"]


def test_compare_and_set_of_tables(spark):
    from hashlib import sha256
    now = spark.createDataFrame([("a", "old"), ("b", "new"), ("c", "other"), ("d", "quiet")], "file_id string, content string")
    run = spark.createDataFrame([(k, sha256(b"old").hexdigest(), "new") for k in "abc"], "file_id string, was string, content string")
    assert {r.file_id: (r.content, r.stale) for r in commit_contents(now, run).collect()} == {
        "a": ("new", False), "b": ("new", False), "c": ("other", True), "d": ("quiet", False)}


def test_command_line(spark, tmp_path, capsys):
    t = tmp_path / "m.md"
    t.write_text(TEXT)
    assert cli.main([str(t)], spark, NOW) == 0 and t.read_text() == TEXT
    out = capsys.readouterr().out
    assert "-deploys use blue" in out and "3 -> 2" in out
    assert cli.main([str(t), "--apply"], spark, NOW) == 0 and t.read_text() == "Deploys use blue green rollout\n§\nTeam meets on Friday"
    after = t.read_bytes()
    assert cli.main([str(t), "--apply"], spark, NOW) == 0 and t.read_bytes() == after
    assert '"runs_seen":2' in local.side_files(t)["state"].read_text()
    assert cli.main([str(tmp_path / "none")], spark, NOW) == 1
    (tmp_path / "empty.md").write_text("")
    assert cli.main([str(tmp_path / "empty.md")], spark, NOW) == 0


@pytest.mark.parametrize(("argv", "rc"), [([], 0), (["-h"], 0), (["--version"], 0), (["--apply"], 2), (["x", "--budget"], 2), (["x", "--budget", "0"], 2), (["x", "--max-age", "no"], 2),
                                          (["x", "--format", "xml"], 2), (["x", "--what"], 2)])
def test_arguments(argv, rc):
    assert cli.main(argv, object(), NOW) == rc


def test_parse_arguments():
    options, flags, files = cli.parse_arguments(["a", "--budget", "10", "--max-age", "3", "--format", "auto", "--no-merge", "--no-supersede", "--quiet"], NOW)
    assert (options.budget, options.max_age, options.format, options.merge, options.supersede) == (10, 3, None, False, False)
    assert flags == {"apply": False, "quiet": True, "profile": False} and files == ["a"]
