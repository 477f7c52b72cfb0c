"""Texts as ordered entries: format detection and the three readers.

All of it is Column expressions within the row of a file: no shuffle, no
Python, and a file is never spread and gathered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstack.functions import constants as K
from loamstack.functions.text import _c, _let, is_header, lines, strip

_BULLET = r"^[-*] "
_HEADING = rf"^[{K.SPACE}]*#"


def _blank(line: Column) -> Column:
    return ~line.rlike(rf"[^{K.SPACE}]")


def detect_format(text: str | Column) -> Column:
    """sections, bullets or paragraphs.

    sections if the delimiter is there, or a delimiter with a trailing space,
    or the text is the mark alone; bullets if at least six tenths of the lines
    that are neither blank nor headings begin one; else paragraphs.
    Null stays null.
    """
    t = _c(text)
    content = F.filter(lines(t), lambda x: ~_blank(x) & ~x.rlike(_HEADING))
    bullets = _let(content, lambda c: (F.size(c) > 0) & (
        F.size(F.filter(c, lambda x: x.rlike(_BULLET))) >= F.greatest(F.lit(1.0), F.size(c) * F.lit(0.6))))
    sections = F.contains(t, F.lit(K.SECTION_DELIMITER)) | F.contains(t, F.lit("\n§ \n")) | (strip(t) == "§")
    return F.when(t.isNull(), None).when(sections, "sections").when(bullets, "bullets").otherwise("paragraphs")


def _sections(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, K.SECTION_DELIMITER), strip), lambda x: x != "")
    return F.struct(F.lit("").alias("preamble"), parts.alias("texts"))


def _after_preamble(text: Column, use) -> Column:
    """use(leading heading and blank lines, the other lines)."""
    def cut(ls: Column) -> Column:
        starts = F.transform(ls, lambda x: x.rlike(_BULLET) | ~(_blank(x) | x.rlike(_HEADING)))
        first = F.array_position(starts, F.lit(True)).cast("int")
        lead = F.when(first > 0, first - 1).otherwise(F.size(ls))
        return _let(lead, lambda n: use(F.slice(ls, F.lit(1), n), F.slice(ls, n + 1, F.greatest(F.size(ls) - n, F.lit(0)))))
    return _let(lines(text), cut)


def _bullets(text: Column) -> Column:
    """A bullet takes the lines up to the next bullet or heading; other text goes to the preamble."""
    def parts(lead: Column, rest: Column) -> Column:
        body = F.array_join(F.filter(rest, lambda x: ~_blank(x)), "\n")
        pieces = F.split(body, rf"\n(?=[-*] |[{K.SPACE}]*#)")

        def from_pieces(ps: Column) -> Column:
            def stray(p: Column) -> Column:
                after = F.when(F.contains(p, F.lit("\n")), F.substr(p, F.instr(p, "\n") + 1)).otherwise("")
                return F.when(p.rlike(_BULLET), "").when(p.rlike(_HEADING), after).otherwise(p)

            held = F.filter(ps, lambda p: p.rlike(_BULLET) | p.rlike(_HEADING))
            texts = F.transform(held, lambda p: strip(F.when(p.rlike(_BULLET), p).otherwise(F.substring_index(p, "\n", 1))))
            strays = F.filter(F.transform(ps, stray), lambda x: x != "")
            return F.struct(strip(F.array_join(F.concat(lead, strays), "\n")).alias("preamble"), texts.alias("texts"))

        return _let(pieces, from_pieces)

    return _after_preamble(text, parts)


def _paragraphs(text: Column) -> Column:
    def parts(lead: Column, rest: Column) -> Column:
        body = F.array_join(F.transform(rest, lambda x: F.when(_blank(x), "").otherwise(x)), "\n")
        blocks = F.filter(F.transform(F.split(body, "\n\n+"), strip), lambda x: x != "")
        return F.struct(strip(F.array_join(lead, "\n")).alias("preamble"), blocks.alias("texts"))

    return _after_preamble(text, parts)


def parsed(text: str | Column, fmt: str | Column) -> Column:
    """struct(preamble, texts) of a text in a format; a null text has no entries, an unknown format is paragraphs."""
    t, f = F.coalesce(_c(text), F.lit("")), _c(fmt)
    return F.when(f == "sections", _sections(t)).when(f == "bullets", _bullets(t)).otherwise(_paragraphs(t))


def with_format(files: DataFrame, text_col: str = "content", format_col: str = "format") -> DataFrame:
    """``files`` with their own format, or the detected one where that is null, ``auto`` or unknown; paragraphs if there is no text."""
    own = F.when(F.col(format_col).isin(*K.FORMATS), F.col(format_col))
    return files.withColumn(format_col, F.coalesce(own, detect_format(text_col), F.lit("paragraphs")))


def parse(files: DataFrame, id_col: str = "file_id", text_col: str = "content", format_col: str = "format") -> DataFrame:
    """(file_id, pos, text, is_header): the entries of each file in order, pos from 0.

    The format is the file's own or else detected.  Null and blank texts have
    no entries; other columns are not read.
    """
    f = with_format(files.select(id_col, text_col, format_col), text_col, format_col)
    texts = f.select(id_col, F.col(format_col).alias("__format"), parsed(text_col, format_col)["texts"].alias("__texts"))
    rows = texts.select(F.col(id_col), "__format", F.posexplode("__texts").alias("pos", "text"))
    return rows.select(F.col(id_col), "pos", "text", is_header("text", "__format").alias("is_header"))


def preambles(files: DataFrame, id_col: str = "file_id", text_col: str = "content", format_col: str = "format") -> DataFrame:
    """(file_id, format, preamble): the text before the entries, which no phase touches."""
    f = with_format(files.select(id_col, text_col, format_col), text_col, format_col)
    return f.select(id_col, format_col, parsed(text_col, format_col)["preamble"].alias("preamble"))
