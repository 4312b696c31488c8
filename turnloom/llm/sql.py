"""SQL for DuckDB of the text problems that SQL can express."""

from __future__ import annotations

from turnloom.llm.lookalikes import character_map

#: White space and invisible characters, as a class of RE2.
_BLANK = r"\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}"

P5_FOUND = f"""
WITH m AS (SELECT session_id, turn, role, original_text, lower(regexp_replace(role, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')) AS r, NOT coalesce(regexp_matches(original_text, '[^{_BLANK}]'), false) AS blank FROM turns WHERE session_id IS NOT NULL),
d AS (SELECT DISTINCT session_id, turn, role, original_text, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r = 'system' THEN 'system' WHEN r != '' THEN 'assistant' END AS speaker, blank FROM m),
t AS (SELECT *, lead(speaker) OVER w AS next_speaker, lead(blank) OVER w AS next_blank FROM d WHERE speaker IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
u AS (SELECT session_id, bool_or(speaker = 'user' AND NOT coalesce(next_speaker = 'assistant' AND NOT next_blank, false)) AS unanswered FROM t GROUP BY session_id),
f AS (SELECT session_id, bool_and(blank) AS empty, count(*) AS n, count(DISTINCT turn) AS turns, min(turn) AS low, max(turn) AS high, count(speaker) AS spoken, count(turn) AS placed, count(*) FILTER (speaker = 'user') AS users FROM d GROUP BY session_id),
x AS (SELECT session_id, CASE WHEN empty THEN 'empty' WHEN NOT (spoken = n AND placed = n AND turns = n AND low = 0 AND high = n - 1 AND users > 0) THEN 'broken' WHEN unanswered THEN 'no_reply' END AS reason FROM f LEFT JOIN u USING (session_id))
SELECT session_id, reason FROM x WHERE reason IS NOT NULL"""

#: The whole sessions in order: of rows taken in twice the one with the least id.
P5_CONVERSATIONS = f"""
WITH m AS (SELECT id, session_id, turn, role, original_text, lower(regexp_replace(role, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')) AS r FROM turns WHERE session_id IS NOT NULL),
d AS (SELECT session_id, turn, role, original_text, min(r) AS r FROM m GROUP BY ALL),
n AS (SELECT session_id, count(*) AS messages FROM d GROUP BY 1), bad AS (SELECT session_id FROM ({P5_FOUND}))
SELECT session_id, turn AS position, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r = 'system' THEN 'system' WHEN r != '' THEN 'assistant' END AS speaker, original_text AS text, messages FROM d JOIN n USING (session_id) WHERE session_id NOT IN (SELECT session_id FROM bad)"""

_SHINGLES = """w AS (SELECT id, list_filter(string_split_regex(lower(original_text), '[^a-z0-9]+'), lambda x: x != '') AS w FROM turns WHERE original_text IS NOT NULL),
s AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 40),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
f AS (SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k / CAST(x.n + y.n - k AS DOUBLE) >= 0.7)"""
P7_FOUND = f"WITH {_SHINGLES} SELECT id_a, id_b FROM f"
P7_GROUPS = f"""
WITH RECURSIVE {_SHINGLES}, c AS (SELECT id, min(id) OVER (PARTITION BY items) AS class_id FROM (SELECT id, list_sort(list(g)) AS items FROM s GROUP BY id)), ways AS (SELECT id_a AS a, id_b AS b FROM f UNION ALL SELECT id_b, id_a FROM f),
r(id, g) AS (SELECT id, id FROM n UNION SELECT ways.b, r.g FROM r JOIN ways ON ways.a = r.id WHERE r.g < ways.b)
SELECT c.id, c.class_id, min(r.g) AS group_id, (SELECT count(*) FROM ways WHERE ways.a = c.id) AS links FROM c JOIN r ON r.id = c.id GROUP BY c.id, c.class_id"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form() -> str:
    """(doc_id, text, form) of the documents with visible text, form by translate, replace and canonical composition."""
    before, after, several = character_map()
    form = "text"
    for one, many in several.items():
        form = f"replace({form}, {_quoted(one)}, {_quoted(many)})"
    # NUL can't stand in SQL text
    form = f"nfc_normalize(translate({form}, {_quoted(before.replace(chr(0), ''))}, {_quoted(after)}))"
    return f"f AS (SELECT doc_id, text, {form} AS form FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^{_BLANK}]'))"


def p10_found() -> str:
    """Pairs of equal forms and unequal texts."""
    return f"WITH {_form()} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text != b.text"


def p10_canonical() -> str:
    """Each document with the shortest text of its form, the least of several, where the form has several texts."""
    return f"""WITH {_form()}, c AS (SELECT form, md5(form) AS class_id, arg_min(text, struct_pack(a := strlen(text), b := encode(text))) AS best FROM f GROUP BY form HAVING count(DISTINCT text) > 1)
SELECT d.doc_id, coalesce(c.best, d.text) AS text, c.class_id FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN c ON c.form = f.form"""


SQL = {"p5_found": P5_FOUND, "p5_conversations": P5_CONVERSATIONS, "p7_found": P7_FOUND, "p7_groups": P7_GROUPS, "p10_found": p10_found(), "p10_canonical": p10_canonical()}
