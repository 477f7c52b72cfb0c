"""DuckDB SQL for the p queries that SQL can express on whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

#: Entries once each, without headers, with their distinct tokens.
_SETS = """
WITH e AS (SELECT DISTINCT entry_id, file_id, pos, text, toks FROM entries WHERE NOT coalesce(is_header, false)),
t AS (SELECT DISTINCT entry_id, file_id, unnest(toks) AS tok FROM e),
n AS (SELECT entry_id, count(*) AS n FROM t GROUP BY entry_id)
"""

_NEAR = """
shared AS (SELECT a.entry_id AS a, b.entry_id AS b, count(*) AS o
  FROM t a JOIN t b ON a.tok = b.tok AND a.entry_id < b.entry_id {scope} GROUP BY 1, 2),
near AS (SELECT a, b FROM shared JOIN n x ON x.entry_id = a JOIN n y ON y.entry_id = b
  WHERE 4 * o >= 3 * (x.n + y.n - o))
"""

SQL["p5_found"] = _SETS + "," + _NEAR.format(scope="") + "SELECT a AS entry_id_a, b AS entry_id_b FROM near"

_GROUPS = """,
bothways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT DISTINCT a AS x, a AS y FROM bothways UNION SELECT r.x, bothways.b FROM reach r JOIN bothways ON bothways.a = r.y),
grp AS (SELECT x AS entry_id, min(y) AS root FROM reach GROUP BY x)
"""

_RANKED = _GROUPS + """,
said AS (SELECT file_id, result, max(seq) AS trust FROM actions WHERE result IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT g.root, e.entry_id, e.text, e.pos, s.trust, row_number() OVER (PARTITION BY g.root
  ORDER BY s.trust DESC NULLS LAST, length(e.text) DESC, e.pos DESC) AS k, max(e.pos) OVER (PARTITION BY g.root) AS top
  FROM grp g JOIN e USING (entry_id) LEFT JOIN said s ON s.file_id = e.file_id AND s.result = e.text)
"""

_RECURSIVE = (_SETS + "," + _NEAR.format(scope="AND a.file_id = b.file_id")).replace("WITH e", "WITH RECURSIVE e", 1)

SQL["p1_found"] = _RECURSIVE + _RANKED + "SELECT root AS first_entry_id, entry_id AS keep_entry_id FROM ranked WHERE k = 1"

SQL["p1_records"] = _RECURSIVE + _RANKED + """SELECT root AS first_entry_id, entry_id AS keep_entry_id, text, top AS pos,
  CASE WHEN trust IS NULL THEN NULL ELSE text END AS result FROM ranked WHERE k = 1"""

SQL["p5_groups"] = (_SETS + "," + _NEAR.format(scope="")).replace("WITH e", "WITH RECURSIVE e", 1) + _GROUPS + """,
s AS (SELECT entry_id, list_sort(list(tok)) AS toks FROM t GROUP BY entry_id),
l AS (SELECT b.a AS entry_id, count(DISTINCT y.toks) FILTER (WHERE y.toks <> x.toks) AS links
  FROM bothways b JOIN s x ON x.entry_id = b.a JOIN s y ON y.entry_id = b.b GROUP BY 1)
SELECT entry_id, root AS first_entry_id, links FROM grp JOIN l USING (entry_id)"""

_TERMS = """
WITH e AS (SELECT entry_id, any_value(toks) AS toks FROM entries GROUP BY entry_id),
u AS (SELECT entry_id, unnest(toks) AS term FROM e),
f AS (SELECT term, count(*) AS occurrences, count(DISTINCT entry_id) AS records FROM u WHERE term IS NOT NULL GROUP BY term),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 100 > 2 * (SELECT count(*) FROM e) THEN 'common' END AS mark FROM f)
"""

SQL["p3_terms"] = _TERMS + "SELECT term, occurrences, records, mark FROM m"

SQL["p3_found"] = _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL"

_FULL = "".join(chr(i) for i in range(0xFF01, 0xFF5F)).replace("'", "''")
_NARROW = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)).replace("'", "''")
_WORDS = (r"regexp_extract_all(nfc_normalize(lower(translate(regexp_replace(replace(text, '&nbsp;', ' '), '\p{Cf}', '', 'g'), '"
          + _FULL + "', '" + _NARROW + r"'))), '[\p{L}\p{N}]+')")

SQL["p8_found"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 10], ' ') AS run FROM (SELECT doc_id, w, unnest(range(len(w) - 9)) AS k FROM d)),
ir AS (SELECT DISTINCT item_id, array_to_string(w[k + 1:k + 10], ' ') AS run FROM (SELECT item_id, w, unnest(range(len(w) - 9)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)"""

#: Arrivals one by one, file by file; the list holds what was accepted of them so far.
SQL["p6_found"] = SQL["p6_nightly"] = """
WITH RECURSIVE h AS (SELECT DISTINCT entry_id AS id, file_id, toks, eid FROM entries WHERE NOT coalesce(is_header, false)),
a AS (SELECT entry_id AS id, batch_no, file_id, toks, eid FROM arrivals QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY batch_no) = 1),
r AS (SELECT id, file_id, toks, eid, true AS old FROM h UNION ALL SELECT id, file_id, toks, eid, false FROM a),
t AS (SELECT DISTINCT id, file_id, old, unnest(toks) AS tok FROM r),
n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
near AS (SELECT u, v, old FROM (SELECT x.id AS u, y.id AS v, x.old, count(*) AS o FROM t x JOIN t y ON x.file_id = y.file_id AND x.tok = y.tok AND NOT y.old AND x.id <> y.id GROUP BY ALL) s
  JOIN n p ON p.id = u JOIN n q ON q.id = v WHERE 4 * o >= 3 * (p.n + q.n - o)),
rel AS (SELECT u, v, old FROM near UNION SELECT x.id, y.id, x.old FROM r x JOIN a y ON x.file_id = y.file_id AND x.eid = y.eid AND x.id <> y.id),
was AS (SELECT v, min(u) FILTER (WHERE old) AS old, coalesce(list(u) FILTER (WHERE NOT old), []) AS us FROM rel GROUP BY v),
steps AS (SELECT a.id, a.file_id, w.old, coalesce(w.us, []) AS us, row_number() OVER (PARTITION BY a.file_id ORDER BY batch_no, a.id) AS k
  FROM a LEFT JOIN was w ON w.v = a.id WHERE a.file_id IS NOT NULL),
walk AS (SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS first FROM steps
  UNION ALL SELECT file_id, k, CASE WHEN first IS NULL THEN list_append(taken, id) ELSE taken END, id, first FROM
  (SELECT w.file_id, s.k, w.taken, s.id, least(s.old, list_min(list_intersect(s.us, w.taken))) AS first FROM walk w JOIN steps s ON s.file_id = w.file_id AND s.k = w.k + 1))
SELECT first AS accepted_entry_id, id AS entry_id FROM walk WHERE first IS NOT NULL"""

# Formatting copies.  Marks with a meaning of their own, and signs that look like letters, stand aside as private
# characters, so that one class holds all formatting.
_OWN = "&@%#§¶‰†‡\u212a\u212b\u2126"
_ASIDE = "".join(chr(0xE000 + k) for k in range(len(_OWN)))
_F = r"\p{P}|=~`^<>+"
_FOLDED = f"replace(translate(lower(translate(text, '{_OWN}', '{_ASIDE}')), 'ς', 'σ'), 'ß', 'ss')"
_HASH = _ASIDE[3]


def _plain_words(x: str) -> str:
    """The words of an expression: chunks without the formatting at their ends."""
    lead = rf"regexp_extract(c, '^[{_F}]*?([+\-]\p{{Nd}}.*|[^{_F}].*)$', 1)"
    chunk = rf"CASE WHEN regexp_matches(c, '^{_HASH}+$') THEN '' ELSE regexp_extract({lead}, '^(.*(?:[^{_F}]|[\p{{L}}\p{{N}}+]\+))', 1) END"
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '[ \\t\\r\\n]+'), lambda c: {chunk}), lambda d: d <> ''), ' ')"


def _plain_fields(sep: str) -> str:
    """The sorted fields by one separator, null unless there are several and all parts are fields."""
    parts = f"list_filter(regexp_split_to_array(u, '{sep}'), lambda p: trim(p, chr(32) || chr(9) || chr(10) || chr(13)) <> '')"
    bare = "trim(q, chr(32) || chr(9) || chr(10) || chr(13))"
    key, value = (rf"regexp_extract({bare}, '(?s)^([^:=;|\n]+)[:=](.*)$', {k})" for k in (1, 2))
    field = (rf"regexp_matches({bare}, '(?s)^[^:=;|\n]+[:=].*$') AND NOT regexp_matches(ltrim({value}), '[^\s:=][ \t]*=|:(?:\s|$)|\s:') "
             f"AND {_plain_words(key)} <> ''")
    made = f"list_sort(list_transform({parts}, lambda q: {_plain_words(key)} || chr(1) || {_plain_words(value)}))"
    return f"CASE WHEN len({parts}) >= 2 AND len(list_filter({parts}, lambda q: NOT ({field}))) = 0 THEN array_to_string({made}, chr(2)) END"


_SEPARATORS = (";", r"\|", r"\s/\s", r",\s", r"\n")
_COPIES = rf"""
WITH e AS (SELECT DISTINCT entry_id AS id, text FROM entries WHERE NOT coalesce(is_header, false)),
t AS (SELECT text, min(id) AS id FROM e WHERE text IS NOT NULL GROUP BY text),
a AS (SELECT id, text, {_FOLDED} AS t FROM t),
b AS (SELECT id, text, t, regexp_replace(t, '^[ \t\r\n]*(?:[*>~\-•+{_HASH}]+[ \t\r\n]+)+', '') AS u FROM a),
f AS (SELECT id, text, {_plain_words('t')} AS words, CASE WHEN t LIKE '%:%' OR t LIKE '%=%' THEN coalesce({', '.join(map(_plain_fields, _SEPARATORS))}) END AS fields FROM b),
r1 AS (SELECT *, min(id) OVER (PARTITION BY words) AS r FROM f),
r2 AS (SELECT id, text, words, fields, min(r) OVER (PARTITION BY coalesce(chr(3) || fields, words)) AS r FROM r1),
r3 AS (SELECT id, text, words, fields, min(r) OVER (PARTITION BY words) AS r FROM r2),
r4 AS (SELECT id, text, words, fields, min(r) OVER (PARTITION BY coalesce(chr(3) || fields, words)) AS r FROM r3),
r5 AS (SELECT text, min(r) OVER (PARTITION BY words) AS root FROM r4)
"""

SQL["p2_found"] = _COPIES + "SELECT root AS first_entry_id, e.id AS entry_id FROM e JOIN r5 USING (text) WHERE e.id <> root"

SQL["p2_counts"] = _COPIES + "SELECT coalesce(root, e.id) AS first_entry_id, count(*) AS copies FROM e LEFT JOIN r5 USING (text) GROUP BY 1"
