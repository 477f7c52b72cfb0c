"""One form for text that looks the same but differs in its characters.

Every code point is folded by a rule (its decomposition kind, category or the
table of letters below); a text is only touched in segments that hold a code
point that folding or composition may change, each taken with the character
before it, and the normal form of the segment is spliced into the rest.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamstack.runtime import cut

# Letters of other scripts that have the shape of a Latin letter,
# Cyrillic, Greek, Cherokee, Lisu, Coptic, Armenian and phonetic, each with that letter.
LETTERS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I",
    "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X",
    "Ү": "Y", "Ӏ": "I",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L",
    "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T",
    "օ": "o", "ո": "n", "ց": "g", "ս": "u", "հ": "h", "Օ": "O", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
_FOLDED = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Format characters that are visible signs, and joiners handled on their own.
_KEPT = set("؀؁؂؃؄؅۝܏࣢\U000110bd\U000110cd")
_IGNORED = set("͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ") | {chr(c) for c in range(0xFE00, 0xFE0E)}
_EMOJI_JOIN = re.compile("(?<=[☀-➿️\U0001f000-\U0001faff])‍")

#: Ranges no fold or composition changes: a cheap first look on the JVM.  Anything else is looked at closely.
QUIET = (r"\t\n\r\x20-\x7EÀ-ıĴ-ľŁ-ňŊ-ž،؛؟ء-ي"
         r"–—‘-”、。一-龥가-힣")


def _fold(c: str) -> str:
    """What one code point stands for, before composition."""
    if c in LETTERS:
        return LETTERS[c]
    cat = unicodedata.category(c)
    if cat == "Zs":
        return " " if c != " " else c
    if c in _IGNORED or (cat == "Cf" and c not in _KEPT) or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    kind = unicodedata.decomposition(c).partition(" ")[0]
    if kind in _FOLDED or (kind == "<compat>" and (cat[0] == "L" or "⺀" <= c <= "⿟")):
        return "".join(_fold(x) for x in unicodedata.normalize("NFKC", c))
    return c


@lru_cache(maxsize=1)
def _rules() -> tuple[dict[int, str], re.Pattern]:
    """The folds that change something, and the pattern of an unstable segment."""
    table, unstable = {}, set()
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000 or 0xF0000 <= i:
            continue
        c = chr(i)
        cat = unicodedata.category(c)
        if cat in ("Cn", "Co"):
            continue
        f = _fold(c)
        if f != c:
            table[i] = f
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and not 0xAC00 <= i < 0xD7A4:
            unstable.update(parts[1:])  # these may compose with what stands before
        if unicodedata.combining(c) or unicodedata.normalize("NFC", "".join(_fold(x) for x in parts)) != c:
            unstable.add(c)
    unstable.update(map(chr, range(0x1161, 0x1176)))
    unstable.update(map(chr, range(0x11A8, 0x11C3)))
    codes = sorted(map(ord, unstable))
    spans, start = [], codes[0]
    for a, b in zip(codes, [*codes[1:], -1]):
        if b != a + 1:
            spans.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}" if a > start else re.escape(chr(a)))
            start = b
    return table, re.compile(f".?[{''.join(spans)}]+", re.DOTALL)


def canonical(text: str | None) -> str | None:
    """The consistent form of a text; null stays null, the empty text empty."""
    if text is None or text.isascii():
        return text
    table, segment = _rules()

    def settle(m: re.Match) -> str:
        # a joiner between emoji makes one picture of them; elsewhere it is invisible
        pieces = _EMOJI_JOIN.split(m.group())
        return "‍".join(unicodedata.normalize("NFC", unicodedata.normalize("NFD", p).translate(table)) for p in pieces)

    # a removed character can bring two others together, so repeat until it holds
    while (done := segment.sub(settle, text)) != text:
        text = done
    return text


@F.pandas_udf(StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def canonical_text(text: str | Column) -> Column:
    """canonical() as a column; texts of quiet characters alone never leave the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    odd = F.when(text.rlike(f"[^{QUIET}]"), text)
    return F.coalesce(_canonical_udf(odd), text)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t0, t1, c0, c1), each id once: hashes of the text and of its consistent form, from one pass over the texts."""
    text = F.col("text")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    hashes = rows.withColumn("form", canonical_text("text")).select(
        "id", F.xxhash64(F.lit(3), text).alias("t0"), F.xxhash64(F.lit(5), text).alias("t1"),
        F.xxhash64(F.lit(3), "form").alias("c0"), F.xxhash64(F.lit(5), "form").alias("c1"))
    return cut(cut(hashes).distinct())


def _mixed(rows: DataFrame) -> DataFrame:
    """The different texts of the classes that hold several; copies of a text combine on the map side."""
    texts = rows.groupBy("c0", "c1", "t0", "t1").agg(F.min("id").alias("head"))
    several = texts.groupBy("c0", "c1").agg(F.count("*").alias("texts"), F.min("head").alias("root")).where("texts > 1")
    return cut(texts.join(several, ["c0", "c1"]))


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b), a < b: ids whose texts are not the same characters but look the same.

    Different texts of one class are paired first, on 128-bit hashes of the
    consistent form, and only then spread over the ids that hold them; so
    copies of a text cost what the result has of them.  Ids delivered twice
    count once; null texts and null ids take no part.
    """
    rows = _texts(df, id_col, text_col)
    texts = _mixed(rows)
    x = texts.select("c0", "c1", F.col("t0").alias("x0"), F.col("t1").alias("x1"))
    y = texts.select("c0", "c1", F.col("t0").alias("y0"), F.col("t1").alias("y1"))
    pairs = x.join(y, ["c0", "c1"]).where("x0 < y0 or (x0 = y0 and x1 < y1)").drop("c0", "c1")
    left = rows.select(F.col("t0").alias("x0"), F.col("t1").alias("x1"), F.col("id").alias("p"))
    right = rows.select(F.col("t0").alias("y0"), F.col("t1").alias("y1"), F.col("id").alias("q"))
    return pairs.join(left, ["x0", "x1"]).join(right, ["y0", "y1"]).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def lookalike_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, root, texts) of every id whose text has a look-alike: the smallest id of its class, and its number of different texts.

    One row per id, whatever the number of copies; nulls as in lookalike_pairs.
    """
    rows = _texts(df, id_col, text_col)
    return rows.join(_mixed(rows).select("t0", "t1", "root", "texts"), ["t0", "t1"]).select("id", "root", "texts")
