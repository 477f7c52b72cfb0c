"""Phases on small texts, and against a plain walk on random ones."""

import random
from datetime import datetime

from loamstack.functions import pytext
from loamstack.operators.entries import analyze
from loamstack.plans import pipeline
from loamstack.plans.options import Options

NOW = datetime(2025, 6, 1)
EMPTY_STATE = "file_id string, eid string, first_seen timestamp_ntz, last_seen timestamp_ntz, runs_seen int, preview string"


def run(spark, texts, fmt="sections", headers=(), budgets=(), state=(), partitions=None, **options):
    """texts by file; headers as (file, pos); budgets by file."""
    budgets = dict(budgets)
    rows = [(f, i, t, (f, i) in headers) for f, ts in texts.items() for i, t in enumerate(ts)]
    entries = analyze(spark.createDataFrame(rows, "file_id string, pos int, text string, is_header boolean"))
    if partitions:
        entries = entries.repartition(partitions)
    files = spark.createDataFrame([(f, fmt, budgets.get(f)) for f in texts], "file_id string, format string, budget int")
    return pipeline.consolidate(entries, files, spark.createDataFrame(list(state), EMPTY_STATE), Options(NOW, **options))


def kept(plan):
    out = {}
    for r in plan.kept.orderBy("file_id", "pos").collect():
        out.setdefault(r.file_id, []).append(r.text)
    return out


def kinds(plan):
    out = {}
    for r in plan.actions.orderBy("file_id", "seq").collect():
        out.setdefault(r.file_id, []).append(r.kind)
    return out


SHORT, FULL = "server restarts nightly maintenance window", "server restarts nightly maintenance window every Sunday morning"
FORTH, BACK = "alpha service calls beta gateway", "beta gateway calls alpha service"
OLD = "database backup schedule runs every night at two using cron machine"
NEW = "database backup schedule runs every week at two using worker pool"
HEADS = ["## Deployment notes here", "- deployment notes here", "## Deployment notes here"]
DUP = ["Deploys use blue green rollout", "deploys use BLUE, green rollout!", "Team meets on Friday"]
AGED = ["retired server rack moved", "fresh printer paper ordered", "never seen before entry"]


def test_light_deep_and_age(spark):
    eids = {r.text: r.eid for r in analyze(spark.createDataFrame([("f", i, t) for i, t in enumerate(AGED)], "file_id string, pos int, text string")).collect()}
    state = [("age", eids[AGED[0]], datetime(2025, 3, 1), datetime(2025, 5, 1), 3, "x"), ("age", eids[AGED[1]], datetime(2025, 5, 2), None, None, "y")]
    texts = {"dup": DUP, "short": [SHORT, FULL], "full": [FULL, SHORT], "old": [OLD, NEW], "new": [NEW, OLD], "heads": HEADS, "age": AGED,
             "empty": ["", None, "  ", "real words here"], "none": [], "big": [f"entry number{i} text{i}" for i in range(9)]}
    plan = run(spark, texts, "bullets", headers={("heads", 0), ("heads", 2)}, state=state, max_age=30, max_entries=6)
    k = kept(plan)
    assert k == {"dup": [DUP[0], DUP[2]], "short": [FULL], "full": [FULL], "old": [NEW], "new": [OLD], "heads": HEADS[:1], "age": AGED[1:],
                 "empty": ["", "real words here"]}
    assert kinds(plan) == {"dup": ["exact-duplicate"], "short": ["near-duplicate"], "full": ["near-duplicate"], "old": ["superseded"], "new": ["superseded"],
                           "heads": ["exact-duplicate"] * 2, "age": ["aged-out"], "empty": ["exact-duplicate"] * 2}
    assert {(r.first_seen, r.runs_seen) for r in plan.state.where("file_id = 'age'").collect()} == {(datetime(2025, 5, 2), 1), (NOW, 1)}
    assert [r.file_id for r in plan.refused.collect()] == ["big"]
    reports = {r.file_id: r.report for r in pipeline.reports(plan, Options(NOW)).collect()}
    assert "entries: 3 -> 2" in reports["dup"] and "[light] exact-duplicate" in reports["dup"] and "archived:" in reports["dup"]
    assert pipeline.reports(plan, Options(NOW), 10).where("report is not null").isEmpty()
    assert any("deploys use BLUE" in r.record for r in pipeline.archive_records(plan.actions, "now").collect())
    files = spark.createDataFrame([("dup", "sections", "a", "")], "file_id string, format string, content string, preamble string")
    one, two = (pipeline.transactions(plan, files, Options(NOW)).first() for _ in range(2))
    assert one.tx == two.tx and len(one.tx) == 24 and one.changed
    assert pipeline.conservation(plan).isEmpty()


def test_order_and_greed_without_supersession(spark):
    """Reversed order is no copy; a file is not closed transitively."""
    chain = ["alpha beta gamma", "alpha beta gamma delta epsilon zeta", "gamma unrelated words entirely", "different topic altogether here"]
    k = kept(run(spark, {"order": [FORTH, BACK], "chain": chain, "old": [OLD, NEW]}, supersede=False))
    assert k == {"order": [FORTH, BACK], "chain": chain[1:], "old": [OLD, NEW]}


def test_budget(spark):
    a, b = "Gateway timeout set to thirty seconds. Owner is Marta.", "Gateway timeout set to thirty seconds. Alerts go to Pavel."
    many = [f"subject{i} unique{i} word{i} fact{i} about thing{i}" for i in range(6)]
    long = " ".join(f"token{i}" for i in range(500))
    tail = ["First part stays. Second part is a good deal longer than that. Third."]
    # a heading is a list entry of its own, so its bullet is not trimmed
    texts = {"merge": [a, b], "many": many, "long": [long], "tail": tail, "head": ["# Head", "- " + long], "fits": [a]}
    plan = run(spark, texts, headers={("head", 0)}, budgets={"merge": 100, "many": 120, "long": 220, "tail": 40, "head": 100, "fits": 100}, supersede=False)
    k, did = kept(plan), kinds(plan)
    assert did["merge"] == ["merged"] and "Marta" in k["merge"][0] and "Pavel" in k["merge"][0]
    assert set(did["many"]) == {"archived-for-budget"} and sum(map(len, k["many"])) + 3 * (len(k["many"]) - 1) <= 120
    assert did["long"] == ["hard-truncated"] and len(k["long"][0]) <= 220 and long.startswith(k["long"][0])
    assert did["tail"] == ["trimmed-tail-clauses"] and k["tail"] == ["First part stays. Third."]
    assert k["head"] == texts["head"] and "head" not in did and k["fits"] == [a] and "fits" not in did


# --- a plain walk over one list, by the rules in the docstrings ---------------

def jac(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def walk(texts):
    """(kept texts, flags) of the light and deep phases."""
    items = []
    for i, t in enumerate(texts):
        toks = pytext.tokens(t)
        name = " ".join(toks) or t.strip().lower()
        if all(name != x["name"] for x in items):
            items.append({"pos": i, "text": t, "toks": toks, "name": name})
    slots = []
    for e in items:
        for k, s in enumerate(slots):
            a, b = set(e["toks"]), set(s["toks"])
            if not a or not b:
                continue
            if (jac(a, b) >= .85 or len(a & b) / min(len(a), len(b)) >= .92) and [x for x in e["toks"] if x in b] == [x for x in s["toks"] if x in a]:
                if len(e["text"]) >= len(s["text"]):
                    slots[k] = e
                break
        else:
            slots.append(e)
    gone, flags = set(), 0
    for i, x in enumerate(slots):
        for y in slots[i + 1:]:
            if x["pos"] in gone or y["pos"] in gone or jac(x["toks"][:6], y["toks"][:6]) < .5:
                continue
            body = jac(x["toks"], y["toks"])
            if .4 <= body < .85:
                gone.add(min(x["pos"], y["pos"]))
            elif .25 <= body < .4:
                flags += 1
    return sorted(s["pos"] for s in slots if s["pos"] not in gone), flags


def test_against_a_plain_walk(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(14)]
    texts = {f"f{k}": [" ".join(rng.choices(words[:rng.choice([6, 14])], k=rng.randint(1, 9))) for _ in range(30)] for k in range(20)}
    plan = run(spark, texts)
    got = {f: [] for f in texts}
    for r in plan.kept.collect():
        got[r.file_id].append(r.pos)
    flags = {r.file_id: r["count"] for r in plan.flags.groupBy("file_id").count().collect()}
    for f, ts in texts.items():
        assert (sorted(got[f]), flags.get(f, 0)) == walk(ts)
    assert pipeline.conservation(plan).isEmpty()


def test_squeeze_against_a_plain_loop(spark):
    """The operator alone, on two partitionings."""
    from loamstack.operators.squeeze import squeeze
    rng = random.Random(3)
    texts = {f"f{k}": [" ".join(f"tok{rng.randint(0, 25)}" for _ in range(rng.randint(3, 9))) + "." for _ in range(15)] for k in range(8)}
    rows = [(f, i, i, t, False, pytext.tokens(t)) for f, ts in texts.items() for i, t in enumerate(ts)]
    entries = spark.createDataFrame(rows, "file_id string, pos int, slot int, text string, is_header boolean, toks array<string>")
    files = spark.createDataFrame([(f, "sections", 260) for f in texts], "file_id string, format string, budget int")
    one, two = (sorted(map(tuple, squeeze(entries.repartition(p), files).select("file_id", "kind", "text", "removed").collect()), key=str) for p in (1, 7))
    assert one == two
    for f, ts in texts.items():
        assert sorted(r[2] for r in one if r[0] == f and r[1] == "entry") == sorted(t for t, _ in plain_squeeze([[t, i] for i, t in enumerate(ts)], 260))


def plain_squeeze(items, budget):
    def size():
        return sum(len(t) for t, _ in items) + 3 * (len(items) - 1)
    while size() > budget:
        scored = []
        for i, (a, _) in enumerate(items):
            for j in range(i + 1, len(items)):
                x, y = pytext.tokens(a), pytext.tokens(items[j][0])
                s = jac(x, y)
                if s >= .5 or (len(x) >= 3 and x[:3] == y[:3]):
                    scored.append((-s, i, j))
        if not scored:
            break
        _, i, j = min(scored)
        (a, p), (b, q) = items[i], items[j]
        merged = pytext.merge_texts(a, b) if len(a) >= len(b) else pytext.merge_texts(b, a)
        if len(merged) > budget:
            break
        items = [x for k, x in enumerate(items) if k not in (i, j)] + [[merged, min(p, q)]]
    while size() > budget and len(items) > 1:
        bags = [set(pytext.tokens(t)) for t, _ in items]
        density = [(sum(sum(t in b for b in bags) == 1 for t in bag) + .1) / max(1, len(items[k][0])) for k, bag in enumerate(bags)]
        del items[density.index(min(density))]
    return items


def test_guards_and_changes(spark):
    from loamstack.operators import guards
    rows = [("f", i, f"text{i}", False, [f"t{i}"], f"e{i}") for i in range(5)] + [("g", 0, "x", False, ["x"], "e"), ("g", 1, "x", False, ["x"], "e"), ("g", 2, "# h", True, [], "h")]
    e = spark.createDataFrame(rows, "file_id string, pos int, text string, is_header boolean, toks array<string>, eid string")
    assert {r.file_id: r.comparisons for r in guards.comparisons(e).collect()} == {"f": 20, "g": 0}
    assert [(r.file_id, r.reason) for r in guards.refused(e, 4).collect()] == [("f", "too many entries")]
    assert [(r.file_id, r.reason) for r in guards.refused(e, None, 19).collect()] == [("f", "too many comparisons")]
    assert guards.refused(e, None, None).isEmpty()
    after = e.where("not (file_id = 'g' and pos = 1)").unionByName(spark.createDataFrame([("g", 9, "new", False, [], "n")], e.schema))
    assert sorted(map(tuple, pipeline.changes(e.select("file_id", "text"), after.select("file_id", "text")).collect())) == [("g", "new", "+", 1), ("g", "x", "-", 1)]
