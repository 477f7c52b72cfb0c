"""DuckDB SQL for the library's own queries, written apart from the DataFrame plans."""

from __future__ import annotations

from loamstack.functions import constants as K

AS_OF = "TIMESTAMP '2025-12-01 00:00:00'"

_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
_NS = f"[{K.NO_SPACE}]"
_WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_PLURALS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in K.PLURAL_STEMS.items()) + "}"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _one_line(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '{_WS}+', ' ', 'g')"


def _preview(x: str, n: int) -> str:
    t = _one_line(x)
    return f"CASE WHEN length({t}) > {n} THEN left({t}, {n}) || '…' ELSE {t} END"


def _english(w: str) -> str:
    return (f"CASE WHEN regexp_matches({w}, '^.{{3,}}ing$') THEN left({w}, length({w}) - 3) "
            f"WHEN regexp_matches({w}, '^.{{3,}}(ied|ies)$') THEN left({w}, length({w}) - 3) || 'y' "
            f"WHEN regexp_matches({w}, '^.{{3,}}ed$') THEN left({w}, length({w}) - 2) "
            f"WHEN regexp_matches({w}, '^.{{3,}}es$') THEN left({w}, length({w}) - CASE WHEN regexp_matches({w}, '(a|e|i)ses$') THEN 1 ELSE 2 END) "
            f"WHEN regexp_matches({w}, '^.{{3,}}s$') THEN left({w}, length({w}) - 1) ELSE {w} END")


def _arabic(w: str) -> str:
    bare = f"regexp_replace({w}, '^(?:{'|'.join(K.ARABIC_PREFIXES)})(.{{3,}})$', '\\1')"
    return (f"coalesce({_PLURALS}[{w}], {_PLURALS}[{bare}], "
            f"regexp_replace({bare}, '^(.{{3,}}?)(?:{'|'.join(K.ARABIC_SUFFIXES)})$', '\\1'))")


def _tokens(x: str) -> str:
    """Token list of a text, script by script; RE2 has no class intersection, so in two steps."""
    runs = rf"regexp_extract_all(lower(coalesce({x}, '')), '[{K.WORD}]+')"
    segments = f"flatten(list_transform({runs}, lambda r: regexp_extract_all(r, '{_NS}+|[^{K.NO_SPACE}]+')))"
    words = (f"flatten(list_transform({segments}, lambda s: CASE WHEN regexp_matches(s, '^{_NS}') "
             "THEN CASE WHEN length(s) < 2 THEN [s] ELSE list_transform(range(1, length(s)), lambda i: substring(s, i, 2)) END "
             "WHEN length(s) >= 3 THEN [s] ELSE [] END))")
    stems = (f"list_transform(list_filter({words}, lambda w: w NOT IN ({_STOP})), lambda w: "
             f"CASE WHEN regexp_matches(w, '^[؀-ۿ]') THEN {_arabic('w')} ELSE {_english('w')} END)")
    return f"list_filter({stems}, lambda t: t NOT IN ({_STOP}) AND (length(t) >= 3 OR regexp_matches(t, '^{_NS}')))"


#: Entries once each; then without exact copies; then their different tokens.
_E = """
e AS (SELECT DISTINCT file_id, pos, coalesce(text, '') AS text, coalesce(is_header, false) AS is_header, coalesce(toks, []) AS toks, eid
  FROM entries WHERE file_id IS NOT NULL AND pos IS NOT NULL)"""
_X = _E + """,
x AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY file_id, eid ORDER BY pos) = 1)"""


def _pairs(source: str, tag: str) -> str:
    """Pairs of entries of a file that share a token, scored."""
    return f""",
{tag}s AS (SELECT file_id, pos, text, toks, len(list_distinct(toks)) AS n FROM {source} WHERE NOT is_header),
{tag}t AS (SELECT DISTINCT file_id, pos, unnest(toks) AS tok FROM {tag}s),
{tag}o AS (SELECT a.file_id, a.pos AS a, b.pos AS b, count(*) AS shared FROM {tag}t a JOIN {tag}t b
  ON a.file_id = b.file_id AND a.tok = b.tok AND a.pos < b.pos GROUP BY ALL),
{tag}p AS (SELECT o.file_id, o.a, o.b, o.shared, x.n + y.n - o.shared AS "union", o.shared / (x.n + y.n - o.shared) AS jaccard,
  o.shared / least(x.n, y.n) AS containment, x.toks AS ta, y.toks AS tb, length(x.text) AS la, length(y.text) AS lb
  FROM {tag}o o JOIN {tag}s x ON x.file_id = o.file_id AND x.pos = o.a JOIN {tag}s y ON y.file_id = o.file_id AND y.pos = o.b)"""


_NEAR = _X + _pairs("x", "n") + f""",
near AS (SELECT * FROM np WHERE (jaccard >= {K.NEAR_JACCARD} OR containment >= {K.NEAR_CONTAINMENT})
  AND list_filter(ta, lambda v: list_contains(tb, v)) = list_filter(tb, lambda v: list_contains(ta, v)))"""

#: The walk: one entry per file and step; the list holds what stands in the slots.
_WALK = _NEAR + """,
nodes AS (SELECT file_id, pos, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS k FROM
  (SELECT file_id, a AS pos FROM near UNION SELECT file_id, b FROM near)),
steps AS (SELECT d.file_id, d.pos, d.k, length(any_value(x.text)) AS len, coalesce(list(n.a) FILTER (WHERE n.a IS NOT NULL), []) AS nbs
  FROM nodes d JOIN x ON x.file_id = d.file_id AND x.pos = d.pos LEFT JOIN near n ON n.file_id = d.file_id AND n.b = d.pos GROUP BY d.file_id, d.pos, d.k),
walk AS (
  SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(slot INTEGER, occ INTEGER, len BIGINT)[]) AS st,
    CAST(NULL AS INTEGER) AS at_pos, CAST(NULL AS INTEGER) AS removed_pos, CAST(NULL AS INTEGER) AS kept_pos, CAST(NULL AS INTEGER) AS slot FROM near
  UNION ALL
  SELECT file_id, k, CASE WHEN m IS NULL THEN list_append(st, {'slot': pos, 'occ': pos, 'len': len})
      WHEN len >= m.len THEN list_transform(st, lambda s: CASE WHEN s.slot = m.slot THEN {'slot': s.slot, 'occ': pos, 'len': len} ELSE s END) ELSE st END,
    pos, CASE WHEN m IS NULL THEN NULL WHEN len >= m.len THEN m.occ ELSE pos END,
    CASE WHEN m IS NULL THEN NULL WHEN len >= m.len THEN pos ELSE m.occ END, m.slot
  FROM (SELECT w.file_id, s.k, w.st, s.pos, s.len, list_filter(w.st, lambda v: list_contains(s.nbs, v.occ))[1] AS m
    FROM walk w JOIN steps s ON s.file_id = w.file_id AND s.k = w.k + 1)),
gone AS (SELECT file_id, at_pos, removed_pos, kept_pos, slot FROM walk WHERE removed_pos IS NOT NULL),
l AS (SELECT x.*, coalesce(m.slot, x.pos) AS slot FROM x LEFT JOIN (SELECT * FROM gone WHERE kept_pos = at_pos) m ON m.file_id = x.file_id AND m.kept_pos = x.pos
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.file_id = x.file_id AND g.removed_pos = x.pos))"""

_DEEP = _WALK + _pairs("l", "dd") + f""",
band AS (SELECT * FROM (SELECT file_id, a, b, jaccard,
    len(list_intersect(list_distinct(ta[1:6]), list_distinct(tb[1:6]))) / len(list_distinct(ta[1:6] || tb[1:6])) AS subject FROM ddp)
  WHERE subject >= {K.SUPERSEDE_SUBJECT} AND jaccard >= {K.CONFLICT_BODY_LOW} AND jaccard < {K.SUPERSEDE_BODY_HIGH}),
ordered AS (SELECT c.*, least(p.slot, q.slot) AS slot_i, greatest(p.slot, q.slot) AS slot_j, CASE WHEN p.slot < q.slot THEN c.a ELSE c.b END AS pos_i,
  row_number() OVER (PARTITION BY c.file_id ORDER BY least(p.slot, q.slot), greatest(p.slot, q.slot)) AS k
  FROM band c JOIN l p ON p.file_id = c.file_id AND p.pos = c.a JOIN l q ON q.file_id = c.file_id AND q.pos = c.b),
deep AS (
  SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS removed, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS INTEGER) AS pos_i,
    CAST(NULL AS INTEGER) AS slot_i, CAST(NULL AS INTEGER) AS slot_j, CAST(NULL AS INTEGER) AS old_pos, CAST(NULL AS INTEGER) AS new_pos,
    CAST(NULL AS DOUBLE) AS subject, CAST(NULL AS DOUBLE) AS body FROM ordered
  UNION ALL
  SELECT file_id, k, CASE WHEN kind = 'superseded' THEN list_append(removed, a) ELSE removed END, kind, pos_i, slot_i, slot_j, a, b, subject, jaccard
  FROM (SELECT o.*, d.removed, CASE WHEN list_contains(d.removed, o.a) OR list_contains(d.removed, o.b) THEN NULL
      WHEN o.jaccard >= {K.SUPERSEDE_BODY_LOW} THEN 'superseded' ELSE 'conflict' END AS kind
    FROM deep d JOIN ordered o ON o.file_id = d.file_id AND o.k = d.k + 1)),
m AS (SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM deep d WHERE d.file_id = l.file_id AND d.old_pos = l.pos AND d.kind = 'superseded'))"""

_STATE = """,
st AS (SELECT file_id, eid, first_seen, last_seen, runs_seen FROM (SELECT DISTINCT * FROM state WHERE file_id IS NOT NULL AND eid IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY file_id, eid ORDER BY last_seen DESC NULLS LAST, runs_seen DESC NULLS LAST, first_seen ASC NULLS LAST, preview DESC NULLS LAST) = 1)"""

_AGED = f"CAST(floor((epoch_us({AS_OF}) - epoch_us(st.first_seen)) / 86400000000) AS BIGINT)"

#: The lines of a text as they are read, numbered; line ends of all kinds.
def _lines(t: str) -> str:
    return rf"string_split(regexp_replace({t}, '\r\n|[\n\x0b\f\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), chr(10))"


def _blank(x: str) -> str:
    return rf"NOT regexp_matches({x}, '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]')"


def _format(t: str) -> str:
    content = f"list_filter({_lines(t)}, lambda x: NOT ({_blank('x')}) AND NOT regexp_matches(x, '^{_WS}*#'))"
    return (f"CASE WHEN {t} IS NULL THEN NULL WHEN contains({t}, chr(10) || '§' || chr(10)) OR contains({t}, chr(10) || '§ ' || chr(10)) OR {_strip(t)} = '§' THEN 'sections' "
            f"WHEN len({content}) > 0 AND len(list_filter({content}, lambda y: regexp_matches(y, '^[-*] '))) >= greatest(1.0, len({content}) * 0.6) "
            "THEN 'bullets' ELSE 'paragraphs' END")


def _fmt(table: str, text: str) -> str:
    return f"coalesce(CASE WHEN {table}.format IN ('sections', 'bullets', 'paragraphs') THEN {table}.format END, {_format(f'{table}.{text}')}, 'paragraphs')"


def _parse(table: str, key: str, text: str) -> str:
    """Gaps and islands over numbered lines."""
    return rf"""
f AS (SELECT {key} AS id, coalesce({text}, '') AS t, {_fmt(table, text)} AS fmt FROM {table}),
sec AS (SELECT id, i, {_strip("p")} AS text FROM (SELECT id, unnest(string_split(t, chr(10) || '§' || chr(10))) AS p, generate_subscripts(string_split(t, chr(10) || '§' || chr(10)), 1) AS i
  FROM f WHERE fmt = 'sections') WHERE {_strip("p")} <> ''),
ln AS (SELECT id, fmt, unnest({_lines("t")}) AS x, generate_subscripts({_lines("t")}, 1) AS i FROM f WHERE fmt <> 'sections'),
k AS (SELECT *, {_blank('x')} AS blank, regexp_matches(x, '^{_WS}*#') AS head, regexp_matches(x, '^[-*] ') AS bullet FROM ln),
lead AS (SELECT id, coalesce(min(i) FILTER (WHERE bullet OR NOT (blank OR head)), max(i) + 1) AS first FROM k GROUP BY id),
rest AS (SELECT k.* FROM k JOIN lead USING (id) WHERE i >= first),
b1 AS (SELECT id, i, x, head, bullet, sum(CASE WHEN bullet OR head THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS g FROM rest WHERE fmt = 'bullets' AND NOT blank),
b2 AS (SELECT id, g, first(CASE WHEN head AND NOT bullet THEN 'h' WHEN bullet THEN 'b' ELSE 's' END ORDER BY i) AS kind, first(x ORDER BY i) AS x1,
  string_agg(x, chr(10) ORDER BY i) AS xs, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT (head AND NOT bullet)), '') AS tail FROM b1 GROUP BY id, g),
bul AS (SELECT id, g AS i, {_strip("CASE WHEN kind = 'b' THEN xs ELSE x1 END")} AS text FROM b2 WHERE kind <> 's'),
p1 AS (SELECT id, i, x, blank, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS g FROM rest WHERE fmt = 'paragraphs'),
par AS (SELECT id, g AS i, {_strip("string_agg(x, chr(10) ORDER BY i)")} AS text FROM p1 WHERE NOT blank GROUP BY id, g),
al AS (SELECT id, i, text FROM sec UNION ALL SELECT id, i, text FROM bul UNION ALL SELECT id, i, text FROM par)"""


_PARSED = """ SELECT al.id AS {key}, CAST(row_number() OVER (PARTITION BY al.id ORDER BY i) - 1 AS INTEGER) AS pos, text,
  f.fmt = 'bullets' AND regexp_matches(text, '^#') AS is_header FROM al JOIN f USING (id)"""

_SIZES = """,
fm AS (SELECT file_id, {fmt} AS format FROM files),
z AS (SELECT e.file_id, count(*) AS entries, CAST(sum(length(text)) + (count(*) - 1) * CASE WHEN any_value(fm.format) = 'sections' THEN 3 ELSE 1 END AS BIGINT) AS size
  FROM e JOIN fm USING (file_id) GROUP BY e.file_id)"""

_DF = """,
df AS (SELECT file_id, token, count(*) AS n FROM (SELECT DISTINCT file_id, pos, unnest(toks) AS token FROM {source}) GROUP BY ALL)"""

_DENSITY = _E + """,
h AS (SELECT * FROM e WHERE NOT is_header)""" + _DF.format(source="h") + """,
u AS (SELECT t.file_id, t.pos, count(*) AS u FROM (SELECT DISTINCT file_id, pos, unnest(toks) AS token FROM h) t JOIN df USING (file_id, token) WHERE n = 1 GROUP BY ALL),
de AS (SELECT h.file_id, h.pos, coalesce(u, 0) AS unique_tokens, (CAST(coalesce(u, 0) AS DOUBLE) + CAST(0.1 AS DOUBLE)) / greatest(length(text), 1) AS density
  FROM h LEFT JOIN u USING (file_id, pos))"""

def _clauses(more: str) -> str:
    marked = rf"regexp_replace(text, '([.;؛!؟?])[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', '\1' || chr(1), 'g')"
    return rf"len(string_split(regexp_replace({marked}, '\n+{more}', chr(1), 'g'), chr(1)))"


SQL: dict[str, str] = {
    "entry_tokens": f"WITH e AS (SELECT DISTINCT entry_id, text FROM entries) SELECT entry_id, array_to_string({_tokens('text')}, ' ') AS tokens FROM e",
    "entry_ids": f"""WITH e AS (SELECT DISTINCT entry_id, text FROM entries), t AS (SELECT entry_id, text, {_tokens('text')} AS toks FROM e)
SELECT entry_id, left(md5(CASE WHEN len(toks) > 0 THEN array_to_string(toks, ' ') ELSE lower({_strip("coalesce(text, '')")}) END), 12) AS eid FROM t""",
    "subjects": f"WITH {_E} SELECT file_id, pos, array_to_string(toks[1:6], ' ') AS subject FROM e",
    "previews": f"SELECT doc_id, {_preview('text', 100)} AS preview FROM documents",
    "sanitized": r"SELECT doc_id, regexp_replace(text, '[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}\x{202a}-\x{202e}\x{2066}-\x{2069}]', '', 'g') AS shown FROM documents",
    "hard_cuts": """SELECT doc_id, CASE WHEN contains(left(text, 120), ' ') THEN regexp_replace(left(text, 120), ' [^ ]*$', '') ELSE left(text, 120) END AS head FROM documents""",
    "detected_formats": f"SELECT doc_id, {_format('text')} AS format FROM documents",
    "parsed_files": f"WITH {_parse('files', 'file_id', 'content')} {_PARSED.format(key='file_id')}",
    "parsed_documents": f"WITH {_parse('documents', 'doc_id', 'text')} {_PARSED.format(key='doc_id')}",
    "preambles": f"""WITH {_parse('files', 'file_id', 'content')},
pre AS (SELECT id, string_agg(x, chr(10) ORDER BY o, i) AS p FROM (
  SELECT k.id, 0 AS o, i, x FROM k JOIN lead USING (id) WHERE i < first
  UNION ALL SELECT id, 1, g, tail FROM b2 WHERE kind <> 'b' AND tail <> '') GROUP BY id)
SELECT f.id AS file_id, f.fmt AS format, {_strip("coalesce(p, '')")} AS preamble FROM f LEFT JOIN pre ON pre.id = f.id""",
    "content_sizes": f"WITH {_E} {_SIZES.format(fmt=_fmt('files', 'content'))} SELECT file_id, entries, size FROM z",
    "serialized": f"""WITH {_E}, fm AS (SELECT file_id, {_fmt('files', 'content')} AS format FROM files)
SELECT file_id, format, count(*) AS entries, CAST(strlen(any_value(t)) AS BIGINT) AS bytes, any_value(t) AS text FROM (
  SELECT e.file_id, fm.format, e.pos, CASE fm.format WHEN 'sections' THEN string_agg(text, chr(10) || '§' || chr(10) ORDER BY pos) OVER w
    WHEN 'bullets' THEN string_agg(text, chr(10) ORDER BY pos) OVER w || chr(10) ELSE string_agg(text, chr(10) || chr(10) ORDER BY pos) OVER w || chr(10) END AS t
  FROM e JOIN fm USING (file_id) WINDOW w AS (PARTITION BY e.file_id)) GROUP BY file_id, format""",
    "exact_duplicates": """
WITH e AS (SELECT DISTINCT file_id, eid, pos, entry_id, text FROM entries WHERE file_id IS NOT NULL AND eid IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS k, first_value(entry_id) OVER w AS kept_entry_id, first_value(text) OVER w AS result
  FROM e WINDOW w AS (PARTITION BY file_id, eid ORDER BY pos))
SELECT file_id, pos, entry_id, text AS removed, kept_entry_id, result FROM r WHERE k > 1""",
    "near_duplicate_edges": f"""WITH {_NEAR} SELECT file_id, a, b, shared, "union", round(jaccard, 9) AS jaccard, round(containment, 9) AS containment FROM near""",
    "near_duplicates": f"WITH RECURSIVE {_WALK} SELECT file_id, at_pos, removed_pos, kept_pos, slot FROM gone",
    "subject_edges": f"""WITH RECURSIVE {_DEEP} SELECT file_id, a, b, round(subject, 9) AS subject, round(jaccard, 9) AS jaccard,
  CASE WHEN jaccard >= {K.SUPERSEDE_BODY_LOW} THEN 'superseded' ELSE 'conflict' END AS kind FROM band""",
    "superseded": f"WITH RECURSIVE {_DEEP} SELECT file_id, slot_i, slot_j, old_pos, new_pos FROM deep WHERE kind = 'superseded'",
    "conflict_flags": f"""WITH RECURSIVE {_DEEP} SELECT file_id, slot_i, slot_j, pos_i AS pos_a, CASE WHEN pos_i = old_pos THEN new_pos ELSE old_pos END AS pos_b
FROM deep WHERE kind = 'conflict'""",
    "aged_out": f"""WITH {_E} {_STATE} SELECT e.file_id, pos, {_AGED} AS age FROM e JOIN st USING (file_id, eid) WHERE NOT is_header AND {_AGED} > 90""",
    "state_upsert": f"""WITH {_E} {_STATE}, w AS (SELECT file_id, eid, arg_max(text, pos) AS text FROM e GROUP BY ALL)
SELECT w.file_id, w.eid, coalesce(st.first_seen, {AS_OF}) AS first_seen, {AS_OF} AS last_seen,
  CAST(greatest(coalesce(st.runs_seen, 0), 0) + 1 AS INTEGER) AS runs_seen, {_preview('text', 60)} AS preview FROM w LEFT JOIN st USING (file_id, eid)""",
    "document_frequencies": f"WITH {_E} {_DF.format(source='e')} SELECT file_id, token, n FROM df",
    "themes": f"""WITH {_E} {_DF.format(source='e')} SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY n DESC, token) AS INTEGER) AS rank, token, n
FROM df WHERE n >= 3 QUALIFY rank <= 8""",
    "information_density": f"WITH {_DENSITY} SELECT file_id, pos, unique_tokens, round(density, 12) AS density FROM de",
    "first_victims": f"WITH {_DENSITY} SELECT file_id, pos, round(density, 12) AS density FROM de QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY density, pos) = 1",
    "merge_candidates": f"WITH {_X} {_pairs('x', 'n')} SELECT file_id, a, b, round(jaccard, 9) AS jaccard FROM np WHERE jaccard >= {K.MERGE_SIMILARITY}",
    "best_merge_pairs": f"""WITH {_X} {_pairs('x', 'n')} SELECT file_id, a, b, round(jaccard, 9) AS jaccard FROM np
WHERE jaccard >= {K.MERGE_SIMILARITY} OR (len(ta) >= 3 AND len(tb) >= 3 AND ta[1:3] = tb[1:3])
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY jaccard DESC, a, b) = 1""",
    "clauses": f"WITH {_E} SELECT file_id, pos, {_clauses('')} AS to_merge, {_clauses('| ; ')} AS to_trim FROM e",
    "removed_entries": f"""WITH RECURSIVE {_DEEP} SELECT file_id, pos AS removed_pos, 'exact-duplicate' AS kind FROM e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.file_id = e.file_id AND x.pos = e.pos)
UNION ALL SELECT file_id, removed_pos, 'near-duplicate' FROM gone
UNION ALL SELECT file_id, old_pos, 'superseded' FROM deep WHERE kind = 'superseded'""",
    "kept_sizes": f"""WITH RECURSIVE {_DEEP}, fm AS (SELECT file_id, {_fmt('files', 'content')} AS format FROM files)
SELECT m.file_id, count(*) AS entries, CAST(sum(length(text)) + (count(*) - 1) * CASE WHEN any_value(fm.format) = 'sections' THEN 3 ELSE 1 END AS BIGINT) AS size
FROM m JOIN fm USING (file_id) GROUP BY m.file_id""",
    "conserved": f"WITH {_E} SELECT file_id, pos FROM e WHERE false",
    "comparison_counts": f"""WITH {_E} SELECT file_id, CAST(n * (n - 1) AS BIGINT) AS comparisons FROM
  (SELECT file_id, count(DISTINCT eid) AS n FROM e WHERE NOT is_header GROUP BY file_id)""",
    "consolidated_changes": f"""WITH RECURSIVE {_DEEP}, c AS (SELECT file_id, text AS line, sum(n) AS n FROM
  (SELECT file_id, text, 1 AS n FROM m UNION ALL SELECT file_id, text, -1 FROM e) GROUP BY ALL)
SELECT file_id, line, CASE WHEN n > 0 THEN '+' ELSE '-' END AS change, CAST(abs(n) AS BIGINT) AS times FROM c WHERE n <> 0""",
    "over_budget": f"""WITH {_E} {_SIZES.format(fmt=_fmt('files', 'content'))} SELECT file_id, fm.format, budget, size FROM z JOIN files USING (file_id) JOIN fm USING (file_id)
WHERE budget > 0 AND size > budget""",
    "action_summary": """SELECT lower(phase) AS phase, kind, count(*) AS actions, count(removed) AS archived FROM
  (SELECT DISTINCT file_id, seq, phase, kind, removed FROM actions) GROUP BY ALL""",
}
