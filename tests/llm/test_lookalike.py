import unicodedata

from loamstack.llm import lookalike
from loamstack.llm.formatting import fold_case, plain_form

SAME = ["The café plan", "The café plan", "Тhe café plan", "The café plan", "The ca​fé plan", "Ｔｈｅ café plan"]
OTHER = ["The cafe plan", "the café plan", "The  café plan", "The café plan.", "The café² plan", "The cafè plan"]
ROWS = "entry_id long, text string, is_header boolean, c0 string, form string"


def test_canonical():
    assert {lookalike.canonical(t) for t in SAME} == {SAME[0]}
    assert len({lookalike.canonical(t) for t in [SAME[0], *OTHER]}) == 1 + len(OTHER)
    assert lookalike.canonical(None) is None and lookalike.canonical("") == ""
    assert lookalike.canonical("oﬁce") == "ofice" and lookalike.canonical("①½™²") == "①½™²"
    long = ("x" * 999 + "é") * 200
    assert lookalike.canonical(unicodedata.normalize("NFD", long)) == long


def test_canonical_is_stable():
    for t in SAME + OTHER + list(lookalike.LETTERS):
        assert lookalike.canonical(lookalike.canonical(t)) == lookalike.canonical(t)


def test_pairs_and_groups(spark):
    texts = SAME + OTHER + [SAME[0], None, ""]
    rows = [(k, t, False, "clash", "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [rows[1], (None, SAME[0], False, "", "")], ROWS)
    same = {k: t for k, t in enumerate(texts) if t in SAME}
    want = {(a, b) for a in same for b in same if a < b and same[a] != same[b]}
    got = [tuple(r) for r in lookalike.lookalike_pairs(df, "entry_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in lookalike.lookalike_groups(df, "entry_id", "text").collect()} == {(k, 0, len(SAME)) for k in same}
    assert lookalike.lookalike_pairs(df.where("false"), "entry_id", "text").count() == 0


def test_case_folding_leaves_lookalikes_alone():
    """Formatting folds case only: signs and ligatures that look like letters stay what they are."""
    assert fold_case("STRASSE") == fold_case("Straße") == fold_case("straẞe") and fold_case("ΟΔΟΣ") == fold_case("οδος")
    for a, b in (("oﬁce", "ofice"), ("5 K", "5 k"), ("Å", "å"), ("Ω", "ω"), ("µ", "μ"), ("ſ", "s")):
        assert fold_case(a) != fold_case(b)
    assert plain_form("## Title") == plain_form("# Title") == plain_form("Title")
    assert plain_form("C# plan") != plain_form("C plan") and plain_form("a & b") != plain_form("a b")
