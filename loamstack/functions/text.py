"""Text functions as Column expressions; nothing here leaves the JVM.

A null text is treated as the empty one unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamstack.functions import constants as K

_STRING_ARRAY = "array<string>"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def strip(text: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(text), rf"^[{K.SPACE}]+|(?<![{K.SPACE}])[{K.SPACE}]+\z", "")


def one_line(text: str | Column) -> Column:
    """Stripped, with every run of white space as one space."""
    return F.regexp_replace(strip(text), rf"[{K.SPACE}]+", " ")


def preview(text: str | Column, n: int = 100) -> Column:
    """The first ``n`` characters of the text as one line, with an ellipsis if there are more."""
    return _let(one_line(text), lambda t: F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("…"))).otherwise(t))


def sanitize(text: str | Column) -> Column:
    """Without control characters other than tab, LF and CR, and without bidirectional controls; for display only."""
    return F.regexp_replace(_c(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f‪-‮⁦-⁩]", "")


def lines(text: str | Column) -> Column:
    """The lines of a text, without a last empty one."""
    t = F.coalesce(_c(text), F.lit(""))
    parts = F.split(t, K.LINE_END)
    return _let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


# --- tokens ---------------------------------------------------------------

def segments(text: str | Column) -> Column:
    """Runs of word characters in lower case, cut where a script without spaces begins or ends."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(_c(text), F.lit(""))),
        F.lit(rf"[{K.WORD}&&[{K.NO_SPACE}]]+|[{K.WORD}&&[^{K.NO_SPACE}]]+"), F.lit(0))


def no_space_script(word: str | Column) -> Column:
    return _c(word).rlike(f"^[{K.NO_SPACE}]")


def bigrams(word: str | Column) -> Column:
    """The pairs of neighbouring characters; a single character stays one."""
    w = _c(word)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))


def stem_english(word: str | Column) -> Column:
    w = _c(word)
    n = F.length(w)

    def ends(suffix: str) -> Column:
        return w.endswith(suffix) & (n > len(suffix) + 2)

    def less(k: int) -> Column:
        return F.left(w, n - k)

    return (F.when(ends("ing"), less(3))
            .when(ends("ied") | ends("ies"), F.concat(less(3), F.lit("y")))
            .when(ends("ed"), less(2))
            .when(ends("es"), F.when(w.rlike("[aei]ses$"), less(1)).otherwise(less(2)))
            .when(ends("s"), less(1)).otherwise(w))


def _plural(word: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in K.PLURAL_STEMS.items() for x in pair])[word]


def stem_arabic(word: str | Column) -> Column:
    """Dictionary, else without the first prefix, dictionary again, else without the first suffix; three letters stay."""
    w = _c(word)
    bare = F.regexp_replace(w, rf"^(?:{'|'.join(K.ARABIC_PREFIXES)})(?=.{{3}})", "")
    # the suffixes come by falling length, so the shortest rest has the first one that fits
    cut = _let(bare, lambda b: F.coalesce(_plural(b), F.regexp_replace(b, rf"^(.{{3,}}?)(?:{'|'.join(K.ARABIC_SUFFIXES)})$", "$1")))
    return F.coalesce(_plural(w), cut)


def stem(word: str | Column) -> Column:
    w = _c(word)
    return F.when(w.between("؀", "ۿ\U0010ffff"), stem_arabic(w)).otherwise(stem_english(w))


def _tokens_any(text: str | Column) -> Column:
    """tokens() for every script, word by word."""
    spaced = F.filter(segments(text), lambda s: no_space_script(s) | (F.length(s) >= 3))
    raw = F.flatten(F.transform(spaced, lambda s: F.when(no_space_script(s), bigrams(s)).otherwise(F.array(s))))
    stems = F.transform(F.filter(raw, lambda t: ~t.isin(*K.STOP_WORDS)), stem)
    return F.filter(stems, lambda t: ~t.isin(*K.STOP_WORDS) & ((F.length(t) >= 3) | no_space_script(t)))


def _tokens_spaced(text: Column) -> Column:
    """tokens() for text without Arabic letters and scripts without spaces.

    All words are stemmed at once, as one string with spaces; an ending in y
    has no other ending to lose, so two replacements do what stem() does.
    """
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(rf"[{K.WORD}]{{3,}}"), F.lit(0)), lambda t: ~t.isin(*K.STOP_WORDS))
    joined = F.regexp_replace(F.array_join(words, " "), r"(?<![^ ])([^ ]{3,})i(?:ed|es)(?= |$)", "$1y")
    joined = F.regexp_replace(joined, r"(?<![^ ])(?:([^ ]+[aei]se)s|([^ ]{3,}?)(?:ing|ed|es|s))(?= |$)", "$1$2")
    return F.filter(F.split(joined, " "), lambda t: ~t.isin(*K.STOP_WORDS) & (F.length(t) >= 3))


def tokens(text: str | Column) -> Column:
    """The stemmed words of a text in order and with repeats; null and empty texts have none.

    Words of fewer than three characters and stop words go before and after
    stemming; scripts without spaces give bigrams, which have no such floor.
    """
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(t.rlike(rf"[{K.NO_SPACE}؀-ۿ]"), _tokens_any(t)).otherwise(_tokens_spaced(t))


def entry_id(text: str | Column, toks: str | Column) -> Column:
    """Twelve hexadecimal digits that name the content: of the tokens, or of the text if it has none."""
    content = F.when(F.size(_c(toks)) > 0, F.array_join(_c(toks), " ")).otherwise(F.lower(strip(F.coalesce(_c(text), F.lit("")))))
    return F.substring(F.md5(F.encode(content, "UTF-8")), 1, 12)


def subject(toks: str | Column, n: int = K.SUBJECT_TOKENS) -> Column:
    return F.slice(_c(toks), 1, n)


# --- similarity of token lists -------------------------------------------

def overlap(a: str | Column, b: str | Column) -> Column:
    """Number of different tokens in both."""
    return F.size(F.array_intersect(_c(a), _c(b)))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared tokens by all tokens; 0 if either has none or is null."""
    a, b = _c(a), _c(b)
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, overlap(a, b) / F.size(F.array_union(a, b))).otherwise(0.0)


def containment(a: str | Column, b: str | Column) -> Column:
    """Shared tokens by those of the smaller side; 0 if either has none or is null."""
    a, b = _c(a), _c(b)
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, overlap(a, b) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))).otherwise(0.0)


def same_sequence(a: str | Column, b: str | Column) -> Column:
    """Whether the shared tokens, with repeats, stand in the same order in both."""
    a, b = _c(a), _c(b)
    return F.coalesce(F.filter(a, lambda t: F.array_contains(b, t)) == F.filter(b, lambda t: F.array_contains(a, t)), F.lit(False))


# --- clauses --------------------------------------------------------------

_AFTER_MARK = rf"(?<=[.;؛!؟?])[{K.SPACE}]+|\n+"


def clauses(text: str | Column) -> Column:
    """Parts after a closing mark and white space, or line feeds; as merging takes them."""
    return F.split(_c(text), _AFTER_MARK)


def clauses_to_trim(text: str | Column) -> Column:
    """As clauses(), and cut at `` ; `` too."""
    return F.split(_c(text), _AFTER_MARK + "| ; ")


def merge_texts(base: str | Column, other: str | Column) -> Column:
    """base and those clauses of other that have a token base and the clauses before lack; base if there is none."""
    base = _c(base)
    state = F.struct(tokens(base).alias("seen"), F.array().cast(_STRING_ARRAY).alias("novel"))
    parts = F.transform(clauses(other), lambda c: F.regexp_replace(c, r"^[ \-•\t]+|(?<![ \-•\t])[ \-•\t]+\z", ""))
    parts = F.transform(parts, lambda c: F.struct(c.alias("c"), tokens(c).alias("t")))

    def step(s: Column, p: Column) -> Column:
        new = F.size(F.array_except(p["t"], s["seen"])) > 0
        return F.struct(
            F.when(new, F.array_union(s["seen"], p["t"])).otherwise(s["seen"]).alias("seen"),
            F.when(new, F.array_append(s["novel"], F.regexp_replace(p["c"], r"[.؛;]+\z", ""))).otherwise(s["novel"]).alias("novel"))

    novel = F.aggregate(parts, state, step, lambda s: s["novel"])
    return _let(novel, lambda n: F.when(
        F.size(n) > 0, F.concat(F.regexp_replace(base, r"[.؛; ]+\z", ""), F.lit(" ; "), F.array_join(n, " ; "))).otherwise(base))


def hard_cut(text: str | Column, budget: int | Column) -> Column:
    """The first ``budget`` characters, cut at the last space if there is one."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    head = F.left(_c(text), F.greatest(budget, F.lit(0)))
    return _let(head, lambda h: F.when(
        F.contains(h, F.lit(" ")), F.left(h, F.length(h) - F.length(F.substring_index(h, " ", -1)) - 1)).otherwise(h))


# --- numbers and times ----------------------------------------------------

def percent(x: str | Column) -> Column:
    """A share as a whole number of percent, halves to even."""
    return F.bround(_c(x) * 100, 0).cast("long").cast("string")


def age_days(as_of: Column, since: str | Column) -> Column:
    """Whole periods of 24 hours from ``since`` to ``as_of``, rounded down."""
    micros = F.timestamp_diff("MICROSECOND", _c(since), as_of)
    return F.floor(micros / F.lit(86_400_000_000))


def is_header(text: str | Column, fmt: str | Column) -> Column:
    """Headings are structure in bullets only."""
    return F.coalesce((_c(fmt) == "bullets") & _c(text).rlike(rf"^[{K.SPACE}]*#"), F.lit(False))


def content_digest(*parts: str | Column) -> Column:
    """24 hexadecimal digits of the parts, null taken as empty, with a NUL between them."""
    joined = F.concat_ws("\0", *[F.coalesce(_c(p), F.lit("")) for p in parts])
    return F.substring(F.sha2(F.encode(joined, "UTF-8"), 256), 1, 24)
