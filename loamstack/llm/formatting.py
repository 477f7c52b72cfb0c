"""Copies that differ only in formatting, found by refining a partition."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_SPACE = re.compile("[ \t\r\n]+")
#: Marks of categories other than punctuation that serve as markup or separators.
_MARKUP = set("|=~`^<>+")
#: Punctuation that means something by itself.
_CONTENT = set("&@%#§¶‰†‡№")
_SIGNS = set("+-−±")
#: A field: words of any length and number without a colon or equals sign, one of these, a value.
_FIELD = re.compile(r"([^:=;|\n]+)[:=](.*)", re.DOTALL)
_SECOND = re.compile(r"[^\s:=][ \t]*=|:(?:\s|$)|\s:")
_LEAD = re.compile(r"[ \t\r\n]*(?:[*>~\-•+#]+[ \t\r\n]+)+")


#: Signs that only look like a letter (Kelvin, angstrom, ohm); their lower case is another character.
_LOOKALIKES = {0x212A: "\ue0fa", 0x212B: "\ue0fb", 0x2126: "\ue0fc"}
_AFTER = {0xE0FA: "\u212a", 0xE0FB: "\u212b", 0xE0FC: "\u2126", ord("ς"): "σ", ord("ß"): "ss"}


def fold_case(text: str) -> str:
    """Lower case, with one sigma and ss for sharp s; ligatures and look-alike signs stay what they are."""
    if text.isascii():
        return text.lower()
    return text.translate(_LOOKALIKES).lower().translate(_AFTER)


@lru_cache(maxsize=4096)
def _formatting(c: str) -> bool:
    return c in _MARKUP or (unicodedata.category(c)[0] == "P" and c not in _CONTENT)


def _chunk(c: str) -> str:
    """A chunk between spaces without the formatting at its ends; number signs alone are a heading's markup."""
    if c.count("#") == len(c):
        return ""
    i, j = 0, len(c)
    while i < j and _formatting(c[i]):
        if c[i] in _SIGNS and i + 1 < j and c[i + 1].isdigit():
            break
        i += 1
    while j > i and _formatting(c[j - 1]):
        if c[j - 1] == "+" and j - 2 >= i and (c[j - 2].isalnum() or c[j - 2] == "+"):
            break
        j -= 1
    return c[i:j]


def _words(text: str) -> str:
    return " ".join(w for c in _SPACE.split(text) if (w := _chunk(c)))


def _fields(text: str) -> list[tuple[str, str]] | None:
    """The fields of a record of ``key: value`` fields only, else None."""
    text = _LEAD.sub("", text, count=1) if _LEAD.match(text) else text
    for sep in (";", r"\|", r"\s/\s", r",\s", r"\n"):
        parts = [p for p in re.split(sep, text) if p.strip()]
        if len(parts) < 2:
            continue
        out = []
        for p in parts:
            m = _FIELD.fullmatch(p.strip())
            if not m or _SECOND.search(m[2].lstrip()):
                break
            key, value = _words(m[1]), _words(m[2])
            if not key:
                break
            out.append((key, value))
        else:
            return sorted(out)
    return None


def word_form(text: str) -> str:
    """The words of the text without case and formatting."""
    return _words(fold_case(text))


def field_form(text: str) -> str | None:
    """The sorted fields of a text made of ``key: value`` fields only, else None."""
    if ":" not in text and "=" not in text:
        return None
    fields = _fields(fold_case(text))
    return None if fields is None else "\x00".join(f"{k}\x01{v}" for k, v in fields)


def plain_form(text: str | None) -> str | None:
    """The text without its formatting: its sorted fields, if it is made of fields only, else its words.

    Plain spaces, tabs, line breaks, letter case, and punctuation and markup
    at the ends of words are formatting; marks inside a word or number, a sign
    directly before a number, and plus signs that end a name are content.
    Null stays null; a text of formatting alone becomes the empty form.
    """
    if text is None:
        return None
    form = field_form(text)
    return word_form(text) if form is None else form


@F.pandas_udf(StructType([StructField("words", StringType()), StructField("fields", StringType())]))
def _forms_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"words": [word_form(t) for t in texts], "fields": [field_form(t) for t in texts]}, dtype=object)


def cheap_invariants(text: Column) -> Column:
    """One number of what no formatting changes: stripped length and letter counts."""
    bare = F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    counts = [F.length(bare) - F.length(F.translate(bare, c, "")) for c in ("A", "E", "I", "N", "O", "R", "T", "0", "1", "5")]
    return F.xxhash64(F.length(bare), *counts)


def formatting_copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(root, id) for every id whose text has an earlier copy; root is the smallest id of its group.

    Progressive refinement: one pass gives every row two hashes of its text
    and one of the cheap invariants, and only these are kept; identical texts
    collapse by a minimum on the map side; only classes of the invariants with
    several distinct texts fetch one text each and are given the costly forms,
    which decide: texts are copies if their words are equal, or if both are
    made of fields only and their sorted fields are equal; prose that merely
    parses as fields still has its words.  Classes of words are joined through
    equal fields as components, so that groups come out as stars; no pairs are
    made and no group is gathered.  Ids delivered twice count once.  Null
    texts and ids take no part; texts of formatting alone are one group.
    """
    from loamstack.operators.components import connected_components
    from loamstack.runtime import cut

    text = F.col("text")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    held = cut(rows.select("id", F.xxhash64(F.lit(3), text).alias("t0"), F.xxhash64(F.lit(5), text).alias("t1"), cheap_invariants(text).alias("k")))
    heads = cut(held.groupBy("t0", "t1").agg(F.min("id").alias("head"), F.first("k").alias("k")))
    mixed = heads.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    # rows whose text is none of the wanted ones are dropped before the join's shuffle where the planner sees a gain
    wanted = heads.join(mixed, "k").select(F.col("head").alias("id"), "t0", "t1")
    formed = rows.dropDuplicates(["id"]).join(wanted, "id").select(F.col("id").alias("head"), "t0", "t1", _forms_udf(text).alias("form"))
    words, fields = F.col("form.words"), F.col("form.fields")
    formed = cut(formed.select("t0", "t1", "head", F.xxhash64(F.lit(3), words).alias("c0"), F.xxhash64(F.lit(5), words).alias("c1"),
                               F.when(fields.isNotNull(), F.xxhash64(F.lit(7), fields)).alias("f0"), F.when(fields.isNotNull(), F.xxhash64(F.lit(9), fields)).alias("f1")))
    by_words = formed.groupBy("c0", "c1").agg(F.min("head").alias("root"))
    linked = cut(formed.join(by_words, ["c0", "c1"]).select("t0", "t1", "head", "root", "f0", "f1"))
    fielded = linked.where("f0 is not null").select("f0", "f1", "root").distinct()
    edges = fielded.join(fielded.groupBy("f0", "f1").agg(F.min("root").alias("low")), ["f0", "f1"]).where("root <> low")
    joined = connected_components(edges.select(F.col("root").alias("a"), F.col("low").alias("b")))
    linked = linked.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    roots = linked.select("t0", "t1", F.coalesce("top", "root").alias("root")).where("root is not null")
    all_heads = heads.select("t0", "t1", "head").join(roots, ["t0", "t1"], "left")
    ids = held.select("t0", "t1", "id").distinct()
    return (ids.join(all_heads, ["t0", "t1"]).withColumn("root", F.coalesce("root", "head"))
            .where("root <> id").select("root", "id"))
