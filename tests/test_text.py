from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loamstack.functions import pytext
from loamstack.functions import text as T
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("z")).first()[0]


CASES = {
    "The agents were running tests": ["agent", "runn", "test"],
    "flies carries ties boxes bases worried": ["fli", "carry", "tie", "box", "base", "worry"],
    "not 30 but 60": [],
    "قواعد البيانات": ["قاعد", "بيان"],
    "قاعدة البيانات": ["قاعد", "بيان"],
    "部署服务": ["部署", "署服", "服务"],
    "หองน x": ["หอ", "อง", "งน"],
    "abc部def": ["abc", "部", "def"],
    "snake_case_name": ["snake_case_name"],
    "": [],
}


@pytest.mark.parametrize("text", list(CASES))
def test_tokens(spark, text):
    assert one(spark, T.tokens("t"), t=text) == CASES[text] == pytext.tokens(text)


def test_null_text_has_no_tokens(spark):
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aeiostngdyrسلامكوبةءا部署กข_1 .,;!؟\n-", max_size=40), min_size=40, max_size=60))
def test_columns_and_python_agree(spark, texts):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:]))], "i int, a string, b string")
    for r in df.select("a", "b", T.tokens("a").alias("t"), T.merge_texts("a", "b").alias("m")).collect():
        assert r.t == pytext.tokens(r.a)
        assert r.m == pytext.merge_texts(r.a, r.b)


def test_entry_ids_ignore_short_and_stop_words(spark):
    def eid(t):
        return one(spark, T.entry_id("t", T.tokens("t")), t=t)
    assert eid("Limit is 30") == eid("limit is not 60!") != eid("limits of memory")
    assert eid("  1 2 ") == eid("1 2") != eid("1 3")
    assert len(eid("")) == 12


def test_scores_of_empty_lists_are_zero(spark):
    none = F.array().cast("array<string>")
    some = F.array(F.lit("a"))
    assert one(spark, T.jaccard(none, some)) == 0.0
    assert one(spark, T.containment(none, none)) == 0.0
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("a"), F.lit("b")), some)) == 0.5
    assert one(spark, T.containment(F.array(F.lit("a"), F.lit("b")), some)) == 1.0


def test_order_guard(spark):
    def a(*xs):
        return F.array(*[F.lit(x) for x in xs])
    assert one(spark, T.same_sequence(a("x", "calls", "y"), a("x", "often", "calls", "y")))
    assert not one(spark, T.same_sequence(a("x", "calls", "y"), a("y", "calls", "x")))
    assert not one(spark, T.same_sequence(a("x", "x", "y"), a("x", "y")))


def test_merge_keeps_only_new_clauses(spark):
    assert one(spark, T.merge_texts("t", F.lit("Uses port 8080. Owner Marta.")), t="Service uses port 8080.") == "Service uses port 8080 ; Owner Marta"
    assert one(spark, T.merge_texts("t", F.lit("uses the port")), t="Service uses port.") == "Service uses port."


def test_percent_is_half_even(spark):
    assert one(spark, T.percent("x"), x=0.625) == "62"


def test_age_counts_whole_days(spark):
    def age(a, b):
        return one(spark, T.age_days(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")))
    assert age("2025-01-02 00:00:30", "2025-01-01 23:59:30") == 0
    assert age("2025-01-02 23:59:30", "2025-01-01 23:59:30") == 1
    assert age("2025-01-01 00:00:00", "2025-01-01 00:00:01") == -1


def test_preview_cut_and_sanitize(spark):
    assert one(spark, T.preview("t", 5), t="  a\t\tb\n c d e") == "a b c…"
    assert one(spark, T.hard_cut("t", 7), t="one two three") == "one"
    assert one(spark, T.hard_cut("t", 3), t="onetwo") == "one"
    assert one(spark, T.sanitize("t"), t="a\x1b[31m\tb‮c\x85") == "a[31m\tbc"


def test_strip_is_linear_and_unicode(spark):
    assert one(spark, T.strip("t"), t="  \x1f a" + " " * 200_000 + "b \n") == "a" + " " * 200_000 + "b"


def test_options_clock(spark):
    from loamstack.plans.options import Options
    o = Options(datetime(2025, 3, 4, 5, 6, 7))
    assert o.stamp() == "2025-03-04 05:06"
    assert one(spark, o.clock()) == datetime(2025, 3, 4, 5, 6, 7)
