"""Documents that hold template residue, filler, error messages or script notices.

Records are the sentences of all documents.  Records of one template are
aligned by the words around a place: a place whose neighbours (one on each
side, or two on one side) hold different fillers somewhere in the corpus is a
slot of a template.  A slot that retains a variable name, a default or a blank
is residue.  Error pages, script notices and dummy texts are whole templates:
a sentence that is one, and every sentence of the same skeleton (numbers and
ids apart), is residue wherever it stands.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.functions.constants import NO_SPACE
from loamstack.llm.base import or_fold
from loamstack.runtime import cut

_INVISIBLE = re.compile("[" + "".join(chr(i) for i in range(0x80, 0x10000) if unicodedata.category(chr(i)) == "Cf") + "]")
_BULLET = re.compile(r"^(?:(?:[-*•+>#§]+|\d+[.)]|Q:|A:)\s+)+")
_SENTENCE = re.compile(r"(?<=[.!?。!?؟])\s+|(?<=[。!?])| - ")

#: An unfilled placeholder: a name in the marks of some template language, or a bracketed order to fill in.
_NAME = r"[^\W\d_][\w .-]{0,30}"
_TAGS = "a|b|i|u|s|p|em|br|hr|li|ul|ol|td|th|tr|h[1-6]|dl|dt|dd|div|pre|sub|sup|img|code|span|strong|body|html|head|table|thead|tbody|script|style|kbd|small|del|ins|mark|blockquote|email|url"
PLACEHOLDER = re.compile(
    r"\{\{[^{}]{1,60}\}\}|[$#]\{[^{}]{1,60}\}|\{%[^{}]{1,60}%\}|<%=?[^<>]{1,60}%>|\{(?:\d+|" + _NAME + r")\}|%\(" + _NAME + r"\)[sd]"
    r"|\$\$" + _NAME + r"\$\$|@@" + _NAME + r"@@|(?<![A-Za-z0-9_])__" + _NAME + r"__(?![A-Za-z0-9_])|(?<![A-Za-z0-9_%])%[A-Za-z][A-Za-z0-9_.-]*%(?![A-Za-z0-9_])|\*\*\*[^\W\d][\w.-]*\*\*\*"
    r"|(?<![A-Za-z0-9_:]):[A-Za-z][A-Za-z0-9_.-]*:(?![A-Za-z0-9_:])"
    r"|\[\[" + _NAME + r"\]\]|\[(?!(?:x|X)\])" + _NAME + r"\](?!\()|<<" + _NAME + r">>|<(?!(?:" + _TAGS + r")\b)" + _NAME + r">|<FIELD_\d+>|【[^【】]{1,30}】")
#: Words of a sentence that is about placeholders, not one that was to be filled.
_ABOUT = re.compile(
    r"`[^`]*`|\bformats? (?:log )?lines\b|\bfields? in\b|\bstyle variables\b|\bthe (?:tag|word|variable|placeholder)\b|\bdo not type\b"
    r"|\bby hand\b|\bthe template\b|\brenders\b|\bsyntax of\b", re.I)

_HEAD = r"(?:(?:fatal error|error|exception|warning|oops|sorry|failure|failed|fehler|erreur|fout|errore)\b\s*(?:\[\w+\])?\s*[:!.,-]?\s*)"
_WHO = r"(?:the|this|our|your|memory|a|an)\s+(?:[a-z]+\s+){0,1}?(?:server|app|site|reader|system|service|page|upstream|website|application|client|gateway|host)|memory service|the upstream"
_FAILED = r"(?:failed to|could not|couldn't|cannot|can't|can not|(?:was|is) unable to|timed out|refused to|lost the connection|is not allowed to|did not (?:answer|respond)|is (?:temporarily )?unavailable|is not responding)"
_STATUS = (r"(?:bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|too many requests"
           r"|internal server error|not implemented|bad gateway|service unavailable|gateway timeout)")
_ERROR = [re.compile(p, re.I) for p in (
    _HEAD + r"?(?:http\s*)?[45]\d\d\W+" + _STATUS + r"\b(?!\s+(?:hit|page|of|for|in|on|from)\b).*",
    _STATUS + r"\s*\([45]\d\d\).*",
    _HEAD + r"?(?:" + _WHO + r")\s+" + _FAILED + r"\b.*",
    _HEAD + r"(?:unexpected|invalid|unknown|unhandled|undefined|null|cannot|could not|out of memory)\b.*",
    r"(?:connection|access|permission) (?:refused|denied|reset|timed out|lost)\b(?: by (?:the )?\w+)?(?:[:.!,-].*)?",
    r"(?:unexpected|unknown|internal) error\b(?: (?:has )?occurred)?(?:[:.!,-].*)?",
    r"(?:oops|sorry|error)?\W*something went wrong\b.*", r"an? (?:\w+ )?error (?:has )?occurred\b.*",
    r"the page (?:you (?:asked for|requested|are looking for)|requested) (?:does not exist|was not found|could not be found|cannot be found)\b.*",
    r"(?:this )?page not found\W*", r"you do not have permission to \w+ this \w+\W*", r"this (?:content|page|note|site) is no longer available\W*",
    r"your session has (?:expired|timed out|ended)\b.*", r"session expired\W*(?:(?:please )?(?:sign|log) in again\W*)?", r"rate limit exceeded\W*(?:(?:please )?(?:retry|try|wait|slow)\b.*)?", r"too many requests\W*(?:(?:please )?(?:retry|try|wait|slow)\b.*)?",
    r"(?:we are|the (?:site|page|service|server) is|this (?:site|page|service) is) (?:currently |temporarily )?(?:down|offline|closed|unavailable)(?: for maintenance)?\W*(?:please come back later\W*)?",
    r"(?:request id|trace)[: ]+(?:id )?\w*\d\w*\W*", r"please contact the administrator\W*", r"(?:please )?try again (?:later|in a few minutes)\W*", r"go back to the start page\W*",
    r"traceback\b\W+(?:most recent call last\b.*|\w*(?:error|exception)\b.*)", r"segmentation fault.*", r"no response from upstream\W*",
    r"no se encontró la página\W*", r"ha ocurrido un error\b.*", r"se ha producido un error\b.*", r"une erreur (?:\w+ )?(?:est survenue|s'est produite)\b.*", r"page introuvable\b.*", r"vérifiez l'adresse\W*",
    r"(?:die )?seite (?:wurde )?nicht gefunden\W*", r"(?:es ist )?ein (?:interner |unerwarteter )?fehler (?:ist )?aufgetreten\b.*", r"zugriff verweigert\b.*", r"acceso denegado\b.*", r"accès refusé\b.*",
    r"حدث خطأ\b.*", r"عذرا، ?الصفحة غير موجودة\W*", r"الصفحة غير موجودة\W*", r"页面(?:不存在|未找到|找不到).*", r"服务器(?:繁忙|错误|内部错误).*", r"(?:抱歉|出错了|发生错误).*")]

_SCRIPT = [re.compile(p, re.I) for p in (
    r"(?:(?:please|you|need|needs|must|have|has|to|should|kindly|we|this|app)[ ,]+){0,6}(?:enable|activate|turn on|allow|switch on) (?:java ?scripts?|scripts?|scripting|cookies?)\b.*",
    r"(?:java ?script|scripts?|scripting|cookies?) (?:is|are|must be|has been|have been|needs to be) (?:turned off|disabled|blocked|required|off|not enabled|switched off|enabled)\b.*",
    r"your browser (?:blocks|does not support|has disabled|is blocking)\b.*", r"this (?:page|site|app|application) (?:needs|requires|works only with) (?:java ?script|scripts?|a browser|cookies)\b.*",
    r"loading requires a browser\b.*", r"turn it on and reload\W*",
    r"(?:please )?(?:verify|confirm|prove|check)(?: \w+)? (?:that )?you(?:'re| are) (?:a )?(?:human|not a (?:robot|bot)|no robot)\b.*", r"(?:we are |please wait[,. ]*(?:while )?(?:we )?)?(?:are )?check(?:ing)? (?:your browser|if (?:the site|you))\b.*",
    r"(?:please )?(?:complete|solve|enter) the (?:captcha|security check|puzzle)\b.*", r"are you (?:a robot|human)\W*", r"i(?:'m| am) not a robot\W*",
    r"(?:veuillez|merci d'|vous devez) ?(?:activer|autoriser) (?:java ?script|les scripts|les cookies)\b.*", r"bitte (?:aktivieren sie|schalten sie) (?:java ?script|skripte|cookies)\b.*",
    r"(?:por favor,? )?(?:active|activa|habilite|habilita|debe activar|debe habilitar) (?:java ?script|los scripts|las cookies)\b.*",
    r"(?:يرجى|الرجاء) (?:تفعيل|تمكين) (?:جافاسكر\w+|البرامج النصية|الكوكيز)\b.*", r"请(?:先)?(?:启用|开启|打开)(?:脚本|javascript|浏览器脚本).*", r"请(?:完成验证|证明你不是机器人).*")]

_FILL = [re.compile(p, re.I) for p in (
    r"(?:your |the |some |insert |enter |put |add )*(?:text|note|content|title|description|name|entry|body|message)s? (?:goes |go |comes )?here\W*",
    r"(?:add|enter|insert|write|type) (?:your|a|the|some) (?:\w+ )?(?:description|text|note|content|title|entry|message)(?: here)?\W*",
    r"to ?do: (?:write|add|fill|complete|describe|insert) (?:this|the|a|in|here)\b.*", r"(?:content|text|more) coming soon\W*",
    r"(?:this is )?(?:a |some )?(?:sample|dummy|placeholder|filler|example) (?:text|content|note|entry)\W*", r"(?:placeholder|tbd|tba|todo|fixme|n/a)(?:\W+(?:placeholder|tbd|tba|todo|fixme|n/a))*\W*",
    r"hier (?:steht|kommt) (?:ihr|dein|der) text(?: hin)?\W*", r"(?:beispieltext|blindtext|platzhalter(?:text)?)\W*", r"texte (?:de remplacement|d'exemple|factice|provisoire)\W*", r"(?:votre|insérez votre) texte ici\W*",
    r"texto de (?:relleno|ejemplo|prueba|muestra)(?:\W+.*)?", r"(?:su|tu|escriba su|inserte su) texto aquí\W*", r"(?:هذا )?نص (?:تجريبي|بديل|مؤقت)\b.*", r"(?:اكتب|أدخل|ضع) (?:نصك|النص|المحتوى) هنا\W*",
    r"(?:请)?(?:在)?(?:此处|这里|此)(?:填写|输入|插入)(?:内容|文字|文本).*", r"(?:示例|占位|测试)(?:文字|文本|内容)\W*")]
_LATIN = tuple("lor ips dol sita amet cons kons adip elit sed eius temp inci labo magn aliq enim mini veni quis nost exer exea ulla comm komo duis aute irur repr volu velit esse cill fugi null pari exce sint occa cupi proi sunt culp offi dese moll anim".split())
_MASH = re.compile(r"(?:asdf|sdf|qwer|qwerty|jkl|hjkl|zxcv|uiop|fdsa|dfgh|fghj|yxcv|blah|bla|foo|bar|baz|x{2,}|test)+\Z")


_ANY_ERROR = re.compile("|".join(f"(?:{r.pattern})" for r in _ERROR), re.I)
_ANY_SCRIPT = re.compile("|".join(f"(?:{r.pattern})" for r in _SCRIPT), re.I)
_ANY_FILL = re.compile("|".join(f"(?:{r.pattern})" for r in _FILL), re.I)
_MARKS = re.compile(r"[\[{<%$@*_:【]")


def clean(text: str) -> str:
    text = text.replace("&nbsp;", " ")
    return text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


_FIRST_WORDS = re.compile(r"[\W\d_]*" + r"[\W\d_]*".join([r"([^\W\d_]*)"] * 4))


def _filler(s: str) -> bool:
    """One word again and again, keyboard mash, or words that nearly all look like dummy Latin."""
    first = [w.casefold() for w in _FIRST_WORDS.match(s[:80]).groups() if w]
    if sum(w.startswith(_LATIN) for w in first) < 2 and not (first and _MASH.match(first[0])) and len(set(first)) == len(first):
        return False
    words = re.findall(r"[^\W\d_]+", s.casefold())
    if len(words) >= 3 and len(set(words)) == 1 or words and len("".join(words)) >= 8 and all(_MASH.match(w) for w in words):
        return True
    return len(words) >= 4 and 10 * sum(w.startswith(_LATIN) for w in words) >= 8 * len(words)


def _said(s: str) -> str | None:
    if _ANY_ERROR.fullmatch(s):
        return "error"
    if _ANY_SCRIPT.fullmatch(s):
        return "script"
    return "filler" if _ANY_FILL.fullmatch(s) or _filler(s) else None


#: A record's tokens: marked names as a whole, single characters of scripts without spaces, words, numbers.
_PLAIN_TOKEN = re.compile(rf"[{NO_SPACE}]|[^\W_{NO_SPACE}]+")
_TOKEN = re.compile(rf"({PLACEHOLDER.pattern})|[{NO_SPACE}]|[^\W_{NO_SPACE}]+")
_ID = re.compile(r"[^\W_]*\d[^\W_]*")
CELL_BITS = 24  #: cells of the filters, as a power of two; fixed, 2 MB as bits
_EDGE = np.uint64(0x9AE16A3B2F90404F)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def entries_of(text: str | None) -> list[str]:
    """The entries of a text on one line each, without list marks; null and blank texts have none."""
    if not text or not text.strip():
        return []
    lines = (" ".join(x.split()) for x in re.split(r"[\r\n§]+", clean(text)))
    return [y for x in lines if x and (y := x if x[0].isalpha() and x[1:2] != ":" else _BULLET.sub("", x))]


def sentences(entry: str) -> list[str]:
    return [p for s in _SENTENCE.split(entry) if (p := s.strip())]


def whole_template(entry: str, parts: list[str]) -> list[tuple[str, str]]:
    """(kind, sentence) for what is an error message, a script notice or dummy text as a whole."""
    return [(k, s) for s in dict.fromkeys([entry, *parts]) if (k := _said(s))]


def skeleton(sentence: str) -> int:
    """A hash of a sentence without case, marks, numbers and ids."""
    words = _ID.sub("0", sentence.casefold())
    return xxhash.xxh3_64_intdigest(" ".join(re.findall(r"[^\W_]+", words)))


_TWO_WORDS = re.compile(r"[\W_]*([^\W_]*)[\W_]*([^\W_]*)")


def opening(sentence: str) -> int:
    """A hash of the first two words, numbers and ids apart: sentences of one skeleton share it, and it is quickly had."""
    words = " ".join(_TWO_WORDS.match(sentence).groups()).casefold()
    return xxhash.xxh3_64_intdigest(_ID.sub("0", words), 7)


def _unfilled(sentence: str) -> bool:
    """Whether a name in template marks stands in a sentence that does not talk about such names."""
    return bool(_MARKS.search(sentence) and PLACEHOLDER.search(sentence) and not _ABOUT.search(sentence))


def kinds(text: str | None) -> list[str]:
    """The kinds of residue that the entries of a text may hold, by form alone; sorted."""
    found = set()
    for entry in entries_of(text):
        parts = sentences(entry)
        found.update(k for k, _ in whole_template(entry, parts))
        if any(map(_unfilled, parts)):
            found.add("placeholder")
    return sorted(found)


class _Aligned:
    """Sentences of a batch as one array of token hashes, each with two edges on both sides.

    With ``marked``, only those that hold an unfilled name, and the places of the names.
    """

    def __init__(self, parts: list[list[str]], marked: bool) -> None:
        self.hashes: dict[str, int] = {}
        flat: list[int] = [int(_EDGE)] * 2
        self.owner: list[int] = []  # row and place of each unfilled name
        self.place: list[int] = []
        get, number = self.hashes.get, self._number
        for row, sentences_ in enumerate(parts):
            for s in sentences_:
                if marked:
                    if not _unfilled(s):
                        continue
                    for m in _TOKEN.finditer(s):
                        if m[1] is not None:
                            self.owner.append(row)
                            self.place.append(len(flat))
                        w = m[0].lower()
                        flat.append(get(w) or number(w))
                elif _MARKS.search(s):
                    flat += [get(w) or number(w) for w in (m[0].lower() for m in _TOKEN.finditer(s))]
                else:
                    flat += [get(w) or number(w) for w in _PLAIN_TOKEN.findall(s.lower())]
                flat += [int(_EDGE)] * 2
        self.flat = np.array(flat, np.uint64)

    def _number(self, word: str) -> int:
        h = self.hashes[word] = xxhash.xxh3_64_intdigest(word) or 1
        return h

    def contexts(self) -> list[np.ndarray]:
        """Three hashes of the neighbours of each place from the third to the third last."""
        t = self.flat
        back2, back, on, on2 = t[:-4], t[1:-3], t[3:-1], t[4:]
        return [(back * _M1 ^ on) * _M2 + np.uint64(1), (back2 * _M1 ^ back) * _M2 + np.uint64(2), (on * _M1 ^ on2) * _M2 + np.uint64(3)]


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, kind, h): contexts of unfilled names; skeletons of whole templates, and their openings without a kind."""
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        texts = [[(e, sentences(e)) for e in entries_of(t)] for t in b.column("text").to_pylist()]
        a = _Aligned([[s for _, parts in t for s in parts] for t in texts], True)
        rows, place = np.array(a.owner, np.int64), np.array(a.place, np.int64) - 2
        out = [(ids[rows], np.full(len(rows), "placeholder", object), c[place].view(np.int64)) for c in a.contexts()] if len(rows) else []
        whole = [(row, k, s) for row, t in enumerate(texts) for e, parts in t for k, s in whole_template(e, parts)]
        if whole:
            doc = ids[np.array([row for row, _, _ in whole])]
            out.append((doc, np.array([k for _, k, _ in whole], object), np.array([skeleton(s) for _, _, s in whole], np.uint64).view(np.int64)))
            out.append((doc, np.full(len(doc), None, object), np.array([opening(s) for _, _, s in whole], np.uint64).view(np.int64)))
        for doc, kind, h in out:
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(kind, pa.string()), pa.array(h, pa.int64())], names=["doc_id", "kind", "h"])


def _set_cells(arr: np.ndarray, b: pa.RecordBatch) -> None:
    arr[_cells(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64))] = 1


def _fillers(shared):
    """(h, low, high, doc_id): least and greatest filler of each wanted context of a batch; documents of wanted skeletons."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            texts = [[(e, sentences(e)) for e in entries_of(t)] for t in b.column("text").to_pylist()]
            a = _Aligned([[s for _, parts in t for s in parts] for t in texts], False)
            filler = a.flat[2:-2]
            got = []
            for c in a.contexts():
                keep = wanted[_cells(c)] & (filler != _EDGE)
                got.append((c[keep], filler[keep]))
            h, f = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((f, h))
            h, f = h[order], f[order]
            if len(h):
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                last = np.r_[first[1:], len(h)] - 1
                n = len(first)
                yield _filler_batch(h[first], f[first], f[last], np.zeros(n, bool), np.zeros(n, np.int64))
            bits = shared.value
            seen = [(skeleton(x), d) for d, t in zip(ids.tolist(), texts) for e, parts in t for x in (parts if parts == [e] else (e, *parts))
                    if bits[(k := opening(x) >> (64 - CELL_BITS)) >> 3] >> (7 - (k & 7)) & 1]
            if seen:
                h, d = np.array([s for s, _ in seen], np.uint64), np.array([d for _, d in seen], np.int64)
                keep = wanted[_cells(h)]
                yield _filler_batch(h[keep], h[keep], h[keep], np.ones(keep.sum(), bool), d[keep])

    return run


def _filler_batch(h: np.ndarray, low: np.ndarray, high: np.ndarray, whole: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(whole, pa.bool_()), pa.array(doc)],
                                      names=["h", "low", "high", "whole", "doc_id"])


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind), each once, for the documents that hold residue.

    Two passes over the texts.  The first finds names in template marks with
    their contexts, and sentences that are whole templates; a bit array of
    fixed size of their hashes goes to the tasks.  The second aligns all
    records: of the contexts in the array it counts, on the map side first,
    whether they hold different fillers.  Only names in slots so induced are
    residue.  A name at a place that no other record has is no slot; a
    sentence that speaks about such names is not looked at.  Null and blank
    texts hold none; equal texts come out each.
    """
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "text").where("text is not null")
    found = cut(docs.mapInArrow(_candidates, "doc_id long, kind string, h long").distinct())
    bits = or_fold(found.select("h"), 1 << CELL_BITS, "uint8", "or", _set_cells)
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(bits))
    aligned = cut(docs.mapInArrow(_fillers(shared), "h long, low long, high long, whole boolean, doc_id long"))
    slots = aligned.where("not whole").groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("h")
    named = found.where("kind = 'placeholder'").join(slots, "h").select("doc_id", "kind")
    templates = found.where("kind <> 'placeholder'").groupBy("h").agg(F.min("kind").alias("kind"))
    pages = aligned.where("whole").select("h", "doc_id").distinct().join(templates, "h").select("doc_id", "kind")
    return named.unionByName(pages).distinct()
