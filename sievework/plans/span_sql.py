"""SQL of queries about units, chunks, anchors and what critics select, where a regular expression can't look around.

Where Spark's pattern looks at what stands before or after a cut, these put a
mark (character 1) there and split at the marks.
"""

from __future__ import annotations

from sievework.functions import cleaning as C
from sievework.operators import patches as P
from sievework.plans.texts import SCIENCE_SQL, WORDS_SQL

_TEXT = "coalesce(text, '')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _replaced(e: str, *pairs: tuple[str, str]) -> str:
    """Patterns replaced in turn; in what replaces them, @ is the mark."""
    for pattern, new in pairs:
        parts = " || ".join(x for x in (f" || chr(1) || ".join(f"'{p}'" for p in new.split("@")),) if x)
        e = f"regexp_replace({e}, '{pattern}', {parts}, 'g')"
    return e


def _units(first: str, edge: str, least: int, longest: int, again: str, prefix: str = "") -> str:
    trimmed = f"trim(s, '{edge}')"
    one = f"regexp_replace({trimmed}, '{prefix}', '')" if prefix else trimmed
    kept = f"list_filter(list_transform(list_filter(string_split({first}, chr(1)), lambda s: s <> ''), lambda s: {one}), lambda s: length(s) >= {least})"
    cut = _replaced("p", (r";\s+", "@"), (rf"\s+({again}):", r"@\1:"))
    parts = f"list_filter(list_transform(list_filter(string_split({cut}, chr(1)), lambda s: s <> ''), lambda s: trim(s, '{edge}')), lambda s: length(s) >= {least})"
    return f"flatten(list_transform({kept}, lambda p: CASE WHEN length(p) > {longest} THEN {parts} ELSE [p] END))"


_CLAIMS = _units(_replaced(_TEXT, (r"([.!?])\s+([A-Z0-9(])", r"\1@\2"), (r"\n+", "@")), " ;,:-", 35, 650, "Condition|Value|Significance")
#: List markers become line ends, but for digits after a digit and a point.
_LINES = _replaced(_TEXT, (r"(^|[:;]|^\.|[^0-9]\.|[0-9]\.\s)\s*[0-9]{1,3}\.\s+", r"\1\n")).replace("'\\1\\n'", "'\\1' || chr(10)")
_LISTS = _units(_replaced(_LINES, (r"([.!?])\s+", r"\1@"), (r"\n+", "@")), " ;,:", 32, 720, "Condition|Control|Compared|Value|Significance|Boundary", r"^\(?[0-9]{1,2}\)\s*")
_SENTENCE = "trim(regexp_replace(unit, '\\s+', ' ', 'g'), ' ;,:')"


def _last(mark: str) -> str:
    """Where a mark of two letters stands last, from 0, or -1."""
    return f"CASE WHEN contains(head, '{mark}') THEN length(head) - instr(reverse(head), '{mark[::-1]}') - {len(mark) - 1} ELSE -1 END"


_PARTS = _replaced(_TEXT, (r"\n(##\s|[-*]\s|[0-9]+[.)]\s)", r"@\1"), (r"\n(##\s|[-*]\s|[0-9]+[.)]\s)", r"@\1"))
_AGAIN = _replaced("part", (r"([.!?])\s+([A-Z0-9(\[])", r"\1@\2"))


def anchors_sql(rows: str, key: str) -> str:
    """`an`: (key, k, s, e, body, text) of the anchors of rows with key and text; pieces keep all of the text, so their lengths give the places."""
    pieces = _replaced("text", (r"(\n\s*\n)", r"@\1@"), (r"([.!?])(\s+[A-Z0-9(\[])", r"\1@\2"))
    return f"""src AS MATERIALIZED ({rows}),
        pc AS (SELECT {key}, text, string_split({pieces}, chr(1)) AS l FROM src),
        pu AS (SELECT {key}, text, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM pc),
        pw AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, trim(p, {_SPACE}) AS body FROM pu),
        an AS MATERIALIZED (SELECT {key}, text, body, row_number() OVER (PARTITION BY {key} ORDER BY i) AS k, CAST(gone + length(p) - length(ltrim(p, {_SPACE})) AS INTEGER) AS s, CAST(gone + length(p) - length(ltrim(p, {_SPACE})) + length(body) AS INTEGER) AS e FROM pw WHERE body <> '')"""


_TURNS = "SELECT conv_id * 100 + turn AS query_id, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'"
#: A turn's first two anchors, and what is before, between and after them.
_TWO = f"""{anchors_sql(_TURNS, "query_id")},
    tw AS (SELECT src.query_id, src.text AS t, a.s AS s1, a.e AS e1, a.body AS b1, b.s AS s2, b.e AS e2, b.body AS b2 FROM src LEFT JOIN an a ON a.query_id = src.query_id AND a.k = 1 LEFT JOIN an b ON b.query_id = src.query_id AND b.k = 2)"""


def _patched(first: str, second: str) -> str:
    """The text with its first two anchors replaced."""
    return f"trim(CASE WHEN s1 IS NULL THEN t WHEN s2 IS NULL THEN t[:s1] || {first} || t[e1 + 1:] ELSE t[:s1] || {first} || t[e1 + 1:s2] || {second} || t[e2 + 1:] END)"


def _key(e: str) -> str:
    plain = f"translate({e}, '‘’“”–—−', '''''\"\"---')"
    return f"trim(regexp_replace(trim(lower(regexp_replace({plain}, '\\s+', ' ', 'g'))), '[.!?]+$', ''))"


_DIRECT_INDEX = f"i % 3 <> 2 AND (i // 3) % {len(C.DIRECT_GROUPS) + 1} <> {len(C.DIRECT_GROUPS)} AND (i // 5) % {len(C.DIRECT_MARKERS) + 1} <> {len(C.DIRECT_MARKERS)}"
_STATE = "{'id': {id}, 'o': {o}, 'a': {a}, 'w': {w}, 'sel': []::BIGINT[], 'why': []::VARCHAR[], 'os': []::BIGINT[], 'an': []::BIGINT[], 'n': 0::BIGINT}"


def _state(**values: str) -> str:
    out = _STATE
    for name, value in values.items():
        out = out.replace("{" + name + "}", value)
    return out


_WHY = f"CASE WHEN list_contains(acc.an, x.a) THEN '_duplicate_anchor' WHEN list_contains(acc.os, x.o) THEN '_duplicate_obligation' WHEN acc.n + x.w > {P.MOST_WORDS} THEN '_total_added_words' END"
_FINE = f"({_WHY}) IS NULL"
_STEP = (
    "{'id': x.id, 'o': x.o, 'a': x.a, 'w': x.w, 'sel': CASE WHEN "
    + _FINE
    + " THEN list_append(acc.sel, x.id) ELSE acc.sel END, 'why': CASE WHEN "
    + _FINE
    + f" THEN acc.why ELSE list_append(acc.why, x.id || ({_WHY})) END, 'os': CASE WHEN "
    + _FINE
    + " THEN list_append(acc.os, x.o) ELSE acc.os END, 'an': CASE WHEN "
    + _FINE
    + " THEN list_append(acc.an, x.a) ELSE acc.an END, 'n': acc.n + CASE WHEN "
    + _FINE
    + " THEN x.w ELSE 0 END}"
)

SPAN_SQL = {
    "direct_records": f"WITH x AS (SELECT doc_id, doc_id AS i, {_TEXT} AS t FROM documents), w AS (SELECT doc_id, i, t AS u, {WORDS_SQL.replace('(u,', '(t,')} FROM x) SELECT doc_id, {_DIRECT_INDEX} AND {SCIENCE_SQL} AS direct FROM w",
    "split_units": f"""
        WITH b AS (SELECT doc_id, 'claims' AS kind, {_CLAIMS} AS l FROM documents UNION ALL SELECT doc_id, 'lists', {_LISTS} FROM documents),
        u AS (SELECT doc_id, kind, unnest(l) AS unit, generate_subscripts(l, 1) - 1 AS place FROM b),
        h AS (SELECT *, {_SENTENCE} AS sentence, trim(unit, ' ;,:.-') AS whole, trim(unit, ' ;,:.-')[1:121] AS head FROM u),
        c AS (SELECT *, greatest({_last('. ')}, {_last('; ')}, {_last(', ')}) AS clause, {_last(' ')} AS space FROM h)
        SELECT doc_id, kind, CAST(place AS INTEGER) AS place, md5(CASE WHEN sentence <> '' AND NOT regexp_matches(sentence, '[.!?]$') THEN sentence || '.' ELSE sentence END) AS unit_md5,
               CAST(CASE WHEN length(whole) <= 120 THEN length(whole) ELSE length(rtrim(CASE WHEN clause >= 72 THEN head[1:clause + 1] WHEN space > 0 THEN head[1:space] ELSE head[1:120] END, ' ;,:.-')) + 1 END AS INTEGER) AS trimmed_chars FROM c""",
    "chunker": f"""
        WITH p AS (SELECT doc_id, list_filter(list_transform(string_split({_PARTS}, chr(1)), lambda s: trim(s, {_SPACE})), lambda s: s <> '') AS l FROM documents),
        r AS (SELECT doc_id, flatten(list_transform(l, lambda part: CASE WHEN length(part) <= 2200 THEN [part] ELSE
            list_transform([list_reduce(list_transform(list_filter(string_split({_AGAIN}, chr(1)), lambda s: s <> ''), lambda s: {{'done': []::VARCHAR[], 'open': s}}),
                lambda a, s: CASE WHEN length(trim(a.open || ' ' || s.open)) > 1800 THEN {{'done': list_append(a.done, a.open), 'open': s.open}} ELSE {{'done': a.done, 'open': trim(a.open || ' ' || s.open)}} END)], lambda z: list_append(z.done, z.open))[1] END)) AS l FROM p),
        c AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM r)
        SELECT doc_id, printf('E%03d', i) AS chunk_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS sha256 FROM c""",
    "anchors": f"WITH {anchors_sql(f'SELECT doc_id, {_TEXT} AS text FROM documents', 'doc_id')} SELECT doc_id, printf('S%03d', k) AS anchor_id, s AS start, e AS \"end\", sha256(body) AS sha256 FROM an",
    "patch_apply": f"""
        WITH {_TWO}, o AS (SELECT query_id, s1, s2, {_patched("b1 || ' New words.'", "'New words.'")} AS out FROM tw)
        SELECT query_id, CAST((s1 IS NOT NULL)::INTEGER + (s2 IS NOT NULL)::INTEGER AS INTEGER) AS actions,
               CASE WHEN s1 IS NOT NULL THEN '[{{"target_anchor_id":"S001","candidate_ids":["S001"],"operations":["APPEND_AFTER_ANCHOR"],"candidate_count":1,"action":"append_all_same_anchor_candidates"}}'
                   || CASE WHEN s2 IS NOT NULL THEN ',{{"target_anchor_id":"S002","candidate_ids":["S002"],"operations":["REPLACE_ANCHOR"],"candidate_count":1,"action":"replace_then_append_all_same_anchor_candidates"}}' ELSE '' END || ']' END AS log,
               CAST(length(out) AS INTEGER) AS n_chars, sha256(out) AS sha256 FROM o""",
    "rematerialise": f"""
        WITH {_TWO}, f AS (SELECT *, {_key('b1')} <> '' AND contains('a control is needed', {_key('b1')}) AS has FROM tw)
        SELECT query_id, CASE WHEN s1 IS NOT NULL THEN list_concat([CASE WHEN has THEN 'replace_already_preserves_anchor' ELSE 'noncorrective_replace_preserved_anchor' END], CASE WHEN s2 IS NOT NULL THEN ['destructive_replace_allowed_causal_correction'] ELSE [] END) END AS actions,
               sha256({_patched("CASE WHEN has THEN 'A control is needed.' ELSE b1 || ' A control is needed.' END", "'A control is needed.'")}) AS sha256 FROM f""",
    "critic_selection": f"""
        WITH l AS (SELECT user_id AS q, list(event_id ORDER BY event_id DESC)[1:4] AS l FROM events GROUP BY 1),
        g AS (SELECT q, CASE WHEN q % 7 = 3 THEN list_append(l, l[1]) WHEN q % 7 = 5 THEN list_append(l, -1) ELSE l END AS ids FROM l),
        w AS (SELECT q, list_reduce(list_prepend({_state(id='NULL::BIGINT', o='NULL::BIGINT', a='NULL::BIGINT', w='0::BIGINT')}, list_transform(ids, lambda i: {_state(id='i', o='i % 5', a='(i // 7) % 4', w='i % 4 * 60 + 10')})), lambda acc, x: {_STEP}) AS s FROM g)
        SELECT q AS query_id, CASE WHEN q % 7 IN (1, 2, 3, 5) THEN '' ELSE coalesce(array_to_string(s.sel, ','), '') END AS selected,
               CASE q % 7 WHEN 1 THEN '' WHEN 2 THEN 'invalid_critic_decision' WHEN 3 THEN 'critic_selection_count_or_duplicates' WHEN 5 THEN 'critic_selected_unknown_candidate' ELSE coalesce(array_to_string(s.why, ','), '') END AS reasons FROM w""",
}
